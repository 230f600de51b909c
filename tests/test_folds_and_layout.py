"""Slot folds, captions, frame lines, regions, tails and clusters on hand-made and random data."""

import random

import numpy as np
from pyspark.sql import functions as F

from cueloom.functions import captions as cp
from cueloom.operators import captions as op
from cueloom.operators import frames as fr
from cueloom.operators import registry as rg
from cueloom.operators import sequence as seq
from cueloom.operators import tails


def test_slot_fold_carries_state_over_many_slots(spark):
    """A running maximum that forgets at rows that open, over one chain of 3,000 rows and over short ones."""
    rng = random.Random(1)
    rows = [(k, i, rng.randrange(1000), i == 0 or (k == 2 and rng.random() < 0.2)) for k in (1, 2) for i in range(3000)]
    want, best = {}, None
    for k, i, v, opens in rows:
        best = v if opens else max(best, v)
        want[k, i] = best
    df = spark.createDataFrame(rows, "k long, pos long, v long, opens boolean")
    for slot_rows in (500, 4000):
        got = seq.slot_fold(df, ["k"], ["v", "opens"], "best long", lambda s, r: F.struct(F.when(r["opens"], r["v"]).otherwise(F.greatest(s["best"], r["v"])).alias("best")), slot_rows)
        assert {(r["k"], r["pos"]): r["best"] for r in got.collect()} == want


SUB = "media_id long, segment_id long, start_ms long, end_ms long, text string, confidence double, x1 long, y1 long, x2 long, y2 long"


def test_collapse_in_any_slot_size(spark):
    rows = [(1, i, 1000 * i, 1000 * i + 900, "今天我们去看海" + ("啊" if i % 3 == 1 else ""), 0.9 - i % 5 / 100, 10, 10, 90, 40) for i in range(300)]
    rows += [(2, 0, 0, 100, " ", 0.5, None, None, None, None), (2, 1, 150, 200, "hi", 0.5, 0, 0, 9, 9), (2, 2, 250, 300, "ho", 0.9, 0, 0, 9, 9), (2, 3, 310, 400, "ho", 0.1, None, None, None, None), (2, 4, 2000, 2100, "ho", 0.2, 0, 0, 9, 9)]
    df = spark.createDataFrame(rows, SUB)
    got = [sorted(map(tuple, op.collapse_duplicates(df, slot_rows=n).collect())) for n in (64, 1024)]
    assert got[0] == got[1]
    by = {(r[0], r[1]): r for r in got[0]}
    assert by[1, 0][3:5] == (299_900, "今天我们去看海啊") and by[1, 0][-1] == 300
    assert by[2, 0][4] == "" and by[2, 0][-1] == 1  # the first row of a media stays, blank as it is
    assert by[2, 1][3:6] == (400, "ho", 0.9) and by[2, 1][-1] == 3 and by[2, 4][-1] == 1


def test_prefix_runs_attach_only_to_their_host(spark):
    rows = [(1, i, 100 * i, 100 * i + 90, "啊", 0.5, 0, 0, 20, 10) for i in range(50)]
    rows += [(1, 50, 5000, 6000, "今天我们去看", 0.4, 0, 0, 60, 10), (2, 0, 0, 90, "啊", 0.9, 0, 0, 20, 10), (2, 1, 100, 900, "see you soon", 0.4, 0, 0, 60, 10), (3, 0, 0, 90, "a", 0.9, 0, 0, 20, 10), (3, 1, 100, 900, "see you soon", 0.4, 0, 0, 60, 10),
             (4, 0, 0, 90, "啊", 0.9, 0, 0, 20, 10), (4, 1, 1000, 1900, "今天我们去看", 0.4, 0, 0, 60, 10), (5, 0, 0, 90, "啊", 0.9, None, None, None, None), (5, 1, 100, 900, "今天我们去看", 0.4, 0, 0, 60, 10)]
    got = {(r["media_id"], r["segment_id"]): r for r in op.attach_prefixes(spark.createDataFrame(rows, SUB)).collect()}
    assert len(got) == 50 + 1 + 1 + 2 + 2 and (1, 49) not in got
    assert (got[1, 50]["start_ms"], got[1, 50]["text"], got[1, 50]["confidence"]) == (4900, "啊今天我们去看", 0.5)
    assert got[2, 1]["text"] == "啊see you soon" and got[3, 1]["text"] == "a see you soon"


def test_each_term_of_a_candidate_can_decide(spark):
    """Groups of two competing readings, alike in all terms but one (or nearly so); the last wins on likeness to the third reading."""
    def group(media, texts):
        return [(media, i, 100 * i, t, c, 10, 10, 100, 40) for i, (t, c) in enumerate(texts)]

    cases = {
        1: ([("今天我们去看海", 0.9), ("今天我们去看湖", 0.9), ("今天我们去看湖", 0.9)], "今天我们去看湖"),  # frequency
        2: ([("今天我们去看海", 0.7), ("今天我们去看湖", 0.9)], "今天我们去看湖"),  # confidence
        3: ([("今天我们去看", 0.9), ("今天我们去看湖", 0.9)], "今天我们去看湖"),  # length
        4: ([("今天我们去看x", 0.9), ("今天我们去看湖", 0.9)], "今天我们去看湖"),  # quality
        5: ([("今天我们去看好海", 0.9), ("今天我们去看大海", 0.9), ("今天我们也看大海", 0.9)], "今天我们去看大海"),  # similarity
        6: ([("  今天我们 ", 0.9)], "  今天我们 "),
    }
    df = spark.createDataFrame([r for m, (texts, _) in cases.items() for r in group(m, texts)], "media_id long, det_id long, t_ms long, text string, confidence double, x1 long, y1 long, x2 long, y2 long")
    got = {r["media_id"]: r for r in op.merge_captions(df, threshold=0.5).collect()}
    assert {m: got[m]["text"] for m in got} == {m: want for m, (_, want) in cases.items()}
    assert (got[6]["end_ms"], got[6]["detections"]) == (500, 1)
    assert tuple(got[1][c] for c in ("x1", "y1", "x2", "y2")) == (3, 1, 107, 49) == tuple(got[1][f"full_{c}"] for c in ("x1", "y1", "x2", "y2"))


def test_caption_cleaning(spark):
    texts = {"ABC 今天\nxy1\n今天。": "今天", "xy1": "xy1", "  \n ": "", "Ｈi　there": "Hi there", "@bob @al 我们走": "我们走", "a\nb": "a\nb", "12\n...": "12"}
    df = spark.createDataFrame([(k,) for k in texts], "t string")
    assert {r["t"]: r["c"] for r in df.select("t", cp.cleaned(F.col("t")).alias("c")).collect()} == texts
    one = df.limit(1).select(cp.quality(F.lit("今天我们去看海")).alias("q"), cp.quality(F.lit(None).cast("string")).alias("none"), cp.norm(F.lit("開Ａ b"), ("開", "开")).alias("n")).first()
    assert abs(one["q"] - (0.42 * 0.5 + 0.36 + 0.16 + 0.06)) < 1e-12 and one["none"] == 0 and one["n"] == "开ab"


def test_frame_lines(spark):
    det = "media_id long, frame long, det_id long, x1 int, y1 int, x2 int, y2 int, text string, confidence double"
    rows = [(1, 0, 1, 50, 100, 90, 120, "world", 0.9), (1, 0, 2, 0, 102, 48, 121, "hello", 0.7), (1, 0, 3, 0, 150, 60, 170, "今", 0.8), (1, 0, 4, 61, 150, 90, 170, "天", 0.8), (1, 0, 5, 600, 150, 640, 170, "far", 0.8),
            (1, 1, 6, 0, 0, 9, 9, "  ", 0.9), (1, 1, 7, 0, 0, 9, 9, "unsure", 0.1), (1, 2, 8, 0, 0, 90, 20, " one ", 0.5)]
    rows += [(1, 3, 100 + i, 10 * (i % 10), 40 * (i // 10), 10 * (i % 10) + 9, 40 * (i // 10) + 20, f"t{i}", 0.9) for i in range(100)]
    rows += [(1, 4, 300 + i, 5, 0, 30, 20, t, 0.9) for i, t in enumerate("ba")]  # ties by centre and left edge go by id
    got = {r["frame"]: r for r in fr.frame_lines(spark.createDataFrame(rows, det)).collect()}
    assert sorted(got) == [0, 2, 3, 4]
    assert got[0]["text"] == "hello world\n今天\nfar" and (got[0]["n_lines"], got[0]["n_boxes"], round(got[0]["confidence"], 9)) == (3, 5, 0.8)
    assert tuple(got[0][c] for c in ("x1", "y1", "x2", "y2")) == (0, 100, 640, 170)
    assert got[2]["text"] == "one" and got[3]["n_lines"] == 10 and got[3]["text"].split("\n")[1] == " ".join(f"t{i}" for i in range(10, 20)) and got[4]["text"] == "b a"


def test_stable_regions_follow_running_means(spark):
    rng = random.Random(3)
    rows = [(1, i, 100, (300 if i % 2 else 180) + rng.randrange(3), 500, (330 if i % 2 else 200) + rng.randrange(3), f"line {i % 7}", 0.9) for i in range(400)] + [(2, 0, 0, 5, 9, 5, "no height", 0.9)]
    media = [(1, 640, 400, 400, None), (2, 640, 400, 5, "bottom")]
    got = sorted(fr.stable_regions(spark.createDataFrame(rows, "media_id long, frame long, x1 int, y1 int, x2 int, y2 int, text string, confidence double"), spark.createDataFrame(media, "media_id long, frame_width int, frame_height int, total_frames long, mode string")).collect(), key=lambda r: r["center_y"])
    assert [r["samples"] for r in got] == [200, 200] and [r["accepted"] for r in got] == [False, True]
    assert got[0]["reject_reasons"] == ["outside_position_band"] and got[1]["text_variety"] == 7 / 200 and got[1]["appearance"] == 0.5


def test_prefix_medians_match_numpy(spark):
    rng = random.Random(5)
    rows, cuts = [], [40, 41, 90, 150]
    for i in range(200):
        rows.append((1, i, sum(i >= c for c in cuts), rng.choice([None, float(rng.randrange(30)), rng.randrange(9) / 2.0]), float(rng.randrange(5))))
    df = spark.createDataFrame(rows, "media_id long, pos long, stretch long, a double, b double")
    got = {r["cut"]: r for r in tails.prefix_medians(df, spark.createDataFrame([(1, 4)], "media_id long, cuts long"), {"x": "a", "y": "b"}).collect()}
    for j, cut in enumerate(cuts, 1):
        for name, at in (("x", 3), ("y", 4)):
            values = [r[at] for r in rows[:cut] if r[at] is not None]
            assert got[j][name] == np.median(values) and got[j][f"{name}_mad"] == np.median(np.abs(np.array(values) - np.median(values)))


def test_one_long_suffix_is_judged_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(seq, "BLOCK_ROWS", 16)
    rows = [(1, i, 2000 * i, 2000 * i + 1500, "我在这里，你的", 0, 300, 100, 330, False) for i in range(1000)]
    rows += [(1, 1000 + i, 2_100_000 + 700 * i, 2_100_000 + 700 * i + 400, "ab", 0, 300, 100, 380, False) for i in range(60)] + [(2, 0, 0, 10, "x", 0, 0, 5, 5, True)]
    df = spark.createDataFrame(rows, "media_id long, segment_id long, start_ms long, end_ms long, text string, x1 int, y1 int, x2 int, y2 int, structural boolean")
    kept = sorted((r["media_id"], r["segment_id"]) for r in tails.drop_trailing_non_dialogue(df).collect())
    assert kept == [(1, i) for i in range(1000)] + [(2, 0)]


def matrix_clusters(vecs, cut, k):
    n = len(vecs)
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    dist, groups = 1 - unit @ unit.T, [[i] for i in range(n)]
    while len(groups) > k:
        best = min((float(dist[np.ix_(a, b)].mean()), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if cut is not None and best[0] >= cut:
            break
        groups[best[1]] += groups.pop(best[2])
    return sorted(map(sorted, groups))


def test_clusters_from_sums_match_the_matrix_form():
    rng = np.random.default_rng(2)
    for n, voices, noise in ((40, 3, 0.9), (60, 12, 0.4), (5, 5, 1.0)):
        vecs = rng.normal(size=(voices, 16))[rng.integers(0, voices, n)] + noise * rng.normal(size=(n, 16))
        merges = rg.average_merges(vecs)
        near = sum(h < 0.38 for h, _, _ in merges)
        for take, cut, k in ((near, 0.38, 1), (n - 4, None, 4)):
            labels = rg.merged_labels(n, merges[:take])
            assert sorted(sorted(np.flatnonzero(labels == c).tolist()) for c in set(labels)) == matrix_clusters(vecs, cut, k)
        unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
        sims = (unit @ unit.T)[np.triu_indices(n, 1)]
        for floor in (np.percentile(sims, 20) - 1e-9, np.percentile(sims, 20) + 1e-9, -2.0, 2.0):
            assert rg.one_voice(unit, floor, 7) == (np.percentile(sims, 20) >= floor)
