"""Ordered primitives against plain Python, with slots small enough that every case crosses them."""

import random

from pyspark.sql import functions as F

from cueloom.operators import detections as dt
from cueloom.operators import sequence as seq


def _rows(seed, n=300):
    rng = random.Random(seed)
    at, out = 0, []
    for i in range(n):
        at += rng.choice([0, 50, 300, 900, 2500])
        out.append((1 if i % 3 else 2, i, at, at + rng.randint(100, 4000), rng.choice("AB"), float(i % 7)))
    return out


def _frame(spark, rows):
    return spark.createDataFrame(rows, "media_id long, segment_id long, start_ms long, end_ms long, speaker_label string, value double")


def test_scan_matches_plain_window(spark):
    rows = _rows(1)
    out = seq.scan(_frame(spark, rows), ["media_id"], ["start_ms", "segment_id"], seq.time_slot(width_ms=5_000), {
        "pos": ("row", None), "before": ("lag", F.col("end_ms")), "after": ("lead", F.col("start_ms")), "total": ("sum", F.col("value")),
        "reach": ("max_before", F.col("end_ms")), "last_a": ("last", F.when(F.col("speaker_label") == "A", F.col("segment_id")))}).collect()
    for media in (1, 2):
        mine = sorted((r for r in rows if r[0] == media), key=lambda r: (r[2], r[1]))
        got = sorted((r for r in out if r["media_id"] == media), key=lambda r: r["pos"])
        assert [g["segment_id"] for g in got] == [m[1] for m in mine]
        total, reach, last = 0.0, None, None
        for i, (g, m) in enumerate(zip(got, mine)):
            total += m[5]
            last = m[1] if m[4] == "A" else last
            assert g["before"] == (mine[i - 1][3] if i else None)
            assert g["after"] == (mine[i + 1][2] if i + 1 < len(mine) else None)
            assert (g["total"], g["reach"], g["last_a"]) == (total, reach, last)
            reach = max(m[3], reach or 0)


def _greedy(rows, gap, cap, limit, same_speaker, running):
    rows = sorted(rows, key=lambda r: (r[2], r[3], r[1]))
    out, current = [], []
    for r in rows:
        if current:
            edge = max(c[3] for c in current) if running else current[-1][3]
            fits = r[2] - edge <= gap and r[3] - current[0][2] <= cap and (limit is None or len(current) < limit)
            if fits and (not same_speaker or r[4] == current[-1][4]):
                current.append(r)
                continue
            out.append(current)
        current = [r]
    return out + [current]


def test_capped_sessions_match_greedy_across_slots(spark, monkeypatch):
    original = seq.capped_sessions
    monkeypatch.setattr(dt.seq, "capped_sessions", lambda *a, **k: original(*a, **{**k, "slot_rows": 7}))
    for seed, build, rule in ((3, dt.context_units, (800, 12_000, 6, True, False)), (4, dt.speech_regions, (500, 30_000, None, False, False)), (5, dt.embedding_groups, (450, 8_000, 5, False, False))):
        rows = _rows(seed)
        got = {}
        for r in build(_frame(spark, rows)).select("media_id", "segment_id", "session").collect():
            got.setdefault((r["media_id"], r["session"]), set()).add(r["segment_id"])
        want = [{r[1] for r in g} for m in (1, 2) for g in _greedy([r for r in rows if r[0] == m], *rule)]
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))


def test_vision_units_fixture(spark):
    def units(spans):
        df = spark.createDataFrame([(1, i, int(a * 1000), int(b * 1000), "A", 0.0) for i, (a, b) in enumerate(spans)], "media_id long, segment_id long, start_ms long, end_ms long, speaker_label string, value double")
        return dt.unit_spans(dt.vision_units(df)).count()

    assert units([(0, 2), (2.5, 4), (9, 11)]) == 2
    assert units([(3 * i, 3 * i + 3) for i in range(6)]) == 2
    assert units([(5, 5), (6, 4)]) == 0


def test_plan_ranges_matches_sequential(spark):
    rng = random.Random(9)
    at, ranges = 0, []
    for _ in range(200):
        start = at + rng.choice([0, 0, 1, 7])
        end = start + rng.choice([0, 0, 2, 5, 14])
        ranges.append((start, end))
        at = end + 1
    target, half = 9, 4
    grown = []
    for i, (s, e) in enumerate(ranges):
        if s == e:
            low = grown[-1][1] if grown else -10**9
            nxt = ranges[i + 1][0] if i + 1 < len(ranges) else 10**9
            grown.append((max(s - half, low + 1), min(s + half, nxt - 1)))
        else:
            grown.append((s, e))
    merged = [grown[0]]
    for s, e in grown[1:]:
        ls, le = merged[-1]
        if s <= le + 1 and (e - s + 1 < target or le - ls + 1 < target):
            merged[-1] = (ls, max(le, e))
        else:
            merged.append((s, e))
    df = spark.createDataFrame([(1, s, e) for s, e in ranges], "media_id long, start_frame long, end_frame long")
    got = sorted((r["start_frame"], r["end_frame"]) for r in dt.plan_ranges(df.withColumn("total_frames", F.lit(10**6)), target).collect())
    assert got == merged


def test_adjust_boundaries_matches_sequential(spark):
    rng = random.Random(2)
    rows, at = [], 1000
    for i in range(120):
        at += rng.choice([0, 0, 5, 12, 400, 1500])
        rows.append((1, i, at, at + rng.choice([0, 100, 700, 3000])))
    want = []
    for _, i, s, e in sorted(rows, key=lambda r: (r[2], r[3], r[1])):
        if want:
            p = want[-1]
            if s <= p[1]:
                s = p[1] + 10
            if s < p[2]:
                p[2] = max(p[1] + 50, s - 10)
        if e <= s or e - s < 500:
            e = s + 500
        want.append([i, s, e])
    df = spark.createDataFrame(rows, "media_id long, segment_id long, start_ms long, end_ms long")
    got = {r["segment_id"]: (r["start_ms"], r["end_ms"]) for r in dt.adjust_boundaries(df).collect()}
    assert got == {i: (s, e) for i, s, e in want}
