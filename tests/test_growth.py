"""Steps that must not grow faster than their input, against plain loops."""

import datetime
import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cueloom.functions import vectors as vx
from cueloom.operators import detections as dt
from cueloom.operators import entities as en
from cueloom.operators import intervals as iv
from cueloom.operators import quality as qa
from cueloom.operators import repair as rp
from cueloom.operators import timeline as tl
from cueloom.streaming import jobs


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_greedy_boxes_as_a_stream(spark):
    rng = random.Random(3)
    cols = "media_id long, tick long, box_id long, x1 int, y1 int, x2 int, y2 int"

    def boxes(n):
        rows = []
        for i in range(n):
            x, y = rng.randrange(12), rng.randrange(12)
            rows.append((rng.choice([1, 2, None]), rng.choice([0, 1, 5000, 9000]), i, x, y, x + 20, y + 20))
        return rows

    pred, truth = boxes(90), boxes(90)
    found = dt.greedy_box_match(spark.createDataFrame(pred, cols), spark.createDataFrame(truth, cols))
    assert "FlatMapGroupsInPandas" not in plan_of(found)

    def iou(a, b):
        w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
        s = max(0, w) * max(0, h)
        return s / (800 - s)

    for row in found.filter("tp > 0").collect():
        tp = 0
        for tick in (0, 1, 5000, 9000):
            left, right = set(), set()
            pairs = [(-iou(a, b), a[2], b[2]) for a in pred for b in truth if a[:2] == b[:2] == (row["media_id"], tick) and iou(a, b) >= 0.5]
            for _, a, b in sorted(pairs):
                if a not in left and b not in right:
                    left.add(a), right.add(b)
            tp += len(left)
        assert (row["tp"], row["tp"] + row["fp"], row["tp"] + row["fn"]) == (tp, sum(p[0] == row["media_id"] for p in pred), sum(t[0] == row["media_id"] for t in truth))


def test_align_by_stretches_of_time(spark):
    rng = random.Random(4)
    base = datetime.datetime(1969, 12, 31, 23, 0)
    cols = "media_id long, {} long, ts timestamp, start_ms long, end_ms long"

    def rows(n):
        out = []
        for i in range(n):
            start = rng.randrange(0, 7_200_000)
            out.append((rng.choice([1, 2]), i, base + datetime.timedelta(milliseconds=start), start, start + rng.randrange(0, 600_000)))
        return [*out, (3, n, None, 0, 10)]

    s, e = rows(60), rows(70)
    near = {(a[0], a[1], b[1]) for a in s for b in e if a[2] and b[2] and a[0] == b[0] and abs(a[3] - b[3]) <= 1_200_000 and a[3] < b[4] and b[3] < a[4]}
    left, right = spark.createDataFrame(s, cols.format("segment_id")), spark.createDataFrame(e, cols.format("event_id"))
    alone = {"left": {(a[0], a[1], None) for a in s} - {(m, i, None) for m, i, _ in near}, "right": {(None, None, b[1]) for b in e if b[1] not in {j for *_, j in near}}}
    for how, want in (("inner", near), ("left_outer", near | alone["left"]), ("right_outer", near | alone["right"]), ("full_outer", near | alone["left"] | alone["right"])):
        found = jobs.align(left, right, "20 minutes", "1 hour", how)
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert ("stretch" in plan_of(found)) == (how != "full_outer")


def test_best_matches_hold_bounded_blocks(spark, monkeypatch):
    monkeypatch.setattr(vx, "PRODUCT", 7)
    monkeypatch.setattr(vx, "LEFT_ROWS", 10)
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(60, 5)).round(1), rng.normal(size=(200, 5)).round(1)
    names = [f"g{i % 31:02d}" if i % 31 else None for i in range(200)]
    left = spark.createDataFrame([*[(None if i == 3 else i, v.tolist()) for i, v in enumerate(a)], (99, None)], "id long, vec array<double>")
    right = spark.createDataFrame([*zip(names, b.tolist()), ("zz", None)], "group_id string, vec array<double>")
    found = vx.best_matches(left, right, 3, 2, 2)
    assert "Pandas" not in plan_of(found)
    got = {}
    for r in found.collect():
        got.setdefault(r["id"], []).append((r["rank"], r["group_id"], r["score"]))
    sims = a @ b.T
    for i in range(60):
        best = {}
        for name, s in zip(names, sims[i].round(6).tolist()):
            best[name] = max(best.get(name, s), s)
        order = sorted(best.items(), key=lambda x: (-x[1], x[0] or ""))[:3]
        assert sorted(got[None if i == 3 else i]) == [(rank, *pair) for rank, pair in enumerate(order, 1)]
    assert len(got) == 60
    same = vx.best_matches(right.selectExpr("group_id AS id", "vec"), right, 1, 2, 2, skip_same=True)
    assert same.filter("id = group_id").isEmpty() and same.count() == 31


def test_speakers_that_know_the_same_ask_once(spark):
    people = [(i, f"P{i % 7}", None, ["hero", "villain"][i % 2], ["m", "f", None][i % 3], None) for i in range(60)]
    library = spark.createDataFrame(people, "persona_id long, name string, aliases array<string>, role string, gender string, work_id string")
    asks = [(1, f"S{i}", "p3", "HERO", "f", None) for i in range(50)] + [(1, "S0", "p3", "HERO", "f", None), (1, None, "p3", None, None, None)]
    speakers = spark.createDataFrame(asks, "media_id long, speaker_label string, name string, role string, gender string, work_id string")
    found = en.match_personas(speakers, library, 3)
    got = {}
    for r in found.collect():
        got.setdefault(r["speaker_label"], []).append((r["rank"], r["persona_id"], r["score"]))
    alone = got["S1"]
    assert set(got) == {f"S{i}" for i in range(50)} and all(sorted(got[f"S{i}"]) == sorted(alone) for i in range(1, 50))
    assert [p for _, p, _ in sorted(got["S0"])] == [sorted(alone)[0][1]] * 2 + [sorted(alone)[1][1]]  # a speaker listed twice is told twice


def test_lone_placements_are_found_in_the_same_scan(spark):
    cols = "media_id long, segment_id string, anchor_start long, anchor_end long, placement_start long, placement_end long, fitted_ms long, source_ms long, has_window boolean, overall_status string, quality_score double"
    spans = [(0, 1000), (900, 1900), (1860, 1900), (9_000_000, 9_001_000), (9_001_000, 9_002_000), (9_001_500, 9_003_000)]
    rows = [(m, f"{i}", a, b, a, b, b - a, b - a, False, "passed", 1.0) for m in (1, 2) for i, (a, b) in enumerate(spans)]
    found = tl.overlap_clusters(spark.createDataFrame(rows, cols)).collect()
    for m in (1, 2):
        got = {r["segment_id"]: (r["cluster"], r["alone"]) for r in found if r["media_id"] == m}
        assert got == {"0": (0, False), "1": (0, False), "2": (2, True), "3": (3, True), "4": (4, False), "5": (4, False)}


def test_known_lines_meet_translations_last(spark):
    """Every side is dealt by line once: nothing is shuffled again behind the full join (duplicate lines and null keys included)."""
    report = spark.createDataFrame([(1, "a", True, 5, "hi", "x", 2.0), (1, "a", False, 3, "ho", "x", 4.0), (1, "b", False, 1, "", "y", None), (None, "n", True, 2, "nn", "z", 1.0)],
                                   "media_id long, segment_id string, placed boolean, start_ms long, target_text string, speaker_id string, judge_score double").withColumn("mix_status", F.lit("placed"))
    lines = spark.createDataFrame([(1, "a", "s", "t", "l", 0, 9), (1, "c", "s2", "t2", "l2", 7, 8), (None, "n", "s3", "t3", "l3", 1, 2)],
                                  "media_id long, segment_id string, source_text string, target_text string, speaker_label string, start_ms long, end_ms long")
    reads = qa.first_backread(report.select("media_id", "segment_id", F.col("start_ms").alias("report_ord"), F.col("target_text").alias("backread_text")))
    judge = report.select("media_id", "segment_id", "judge_score")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        known = qa.enrich(qa.rendered(report.drop("judge_score")), reads, judge)
        rows = qa.with_translations(known, lines)
        assert plan_of(rows).count("Exchange hashpartitioning") == 4
        late = qa.enrich(qa.universe(report.drop("judge_score"), lines), reads, judge)
        assert sorted(map(str, rows.select(*late.columns).collect())) == sorted(map(str, late.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [(r["segment_id"], r["judge_score"], r["backread_text"]) for r in rows.filter("media_id = 1").orderBy("segment_id", "judge_score").collect()] == [("a", 2.0, "ho"), ("a", 4.0, "ho"), ("b", None, ""), ("c", None, "")]


def test_works_of_a_text_are_cut_before_its_tasks(spark):
    """A name that many tasks share and many titles hold is settled once per text; short titles and names count too."""
    titles = [f"ab {c}{d}" for c in "cdefghij" for d in "klmn"] + ["x", "the ab ck", "zz"]
    works = spark.createDataFrame([(i, t, [f"al {i % 3}"]) for i, t in enumerate(titles)], "work_id long, title string, aliases array<string>")
    tasks = spark.createDataFrame([(i, ["ab", "the ab ck", "x", "al 2 zz", "qq", ""][i % 6], ["/p/ab.mov", None, "/a b/zz.mp4"][i % 3]) for i in range(60)], "task_id long, name string, path string")
    got = {}
    for r in en.infer_works(tasks, works).filter("score = 0.9").collect():
        got.setdefault(r["task_id"], []).append((r["rank"], r["work_id"]))
    for t in tasks.collect():
        hay = [x for x in (t["name"], {None: "", "/p/ab.mov": "ab", "/a b/zz.mp4": "zz"}[t["path"]]) if x]
        ids = [i for i, title in enumerate(titles) if any(n in h or h in n for h in hay for n in (title, f"al {i % 3}"))][:3]
        assert sorted(got.get(t["task_id"], [])) == list(enumerate(ids, 1)), t
    pairs = en.containment(tasks.select(F.col("name").alias("text")).filter("text <> ''"), works.select(F.col("title").alias("text")))
    assert "BroadcastHashJoin" in plan_of(pairs) and "SortMergeJoin" not in plan_of(pairs)


def test_speaker_mapping_of_many_media_without_a_pivot(spark):
    """One small matrix a media, unnamed speakers and more names on either side: the best one-to-one mapping, by trying all."""
    from itertools import permutations

    rng = random.Random(17)
    rows, want = [], {}
    for media in range(40):
        left, right = rng.randrange(1, 5), rng.randrange(1, 5)
        grid = [[0] * max(left, right) for _ in range(max(left, right))]
        for i in range(left):
            for j in range(right):
                for _ in range(rng.randrange(3)):
                    n = rng.randrange(1, 500)
                    rows.append((media, f"S{i}", f"X{j}", n))
                    grid[i][j] += n
        rows += [(media, None, "X0", 900), (media, "S0", None, 900)]
        want[media] = max(sum(grid[i][p] for i, p in enumerate(order)) for order in permutations(range(len(grid))))
    shared = spark.createDataFrame(rows, "media_id long, l_speaker string, r_speaker string, shared long")
    got = shared.groupBy("media_id").applyInArrow(iv._assign, iv.ASSIGNED)
    assert {r["media_id"]: r["correct"] for r in got.collect()} == want
    turns = spark.createDataFrame([(1, 0, 1000, "a"), (1, 1000, 3000, "b")], "media_id long, start_ms long, end_ms long, speaker string")
    assert "FlatMapGroupsInPandas" not in plan_of(iv.diarization_error(turns, turns, collar_ms=250))


def test_speaker_groups_are_built_once(spark, monkeypatch):
    """The session fold that makes the embedding groups is read several times, so its rows are kept."""
    from cueloom.plans import registry_queries as rq

    kept = []
    monkeypatch.setattr(rq, "cut_lineage", lambda df: kept.append(df.columns) or df)
    segments = spark.createDataFrame([(1, i, i * 3000, i * 3000 + 2000, 2000, "SPEAKER_00") for i in range(8)], "media_id long, segment_id long, start_ms long, end_ms long, dur_ms long, speaker_label string")
    vectors = spark.createDataFrame([(i, 0, [1.0, float(i)]) for i in range(400)], "vec_id long, label int, embedding array<double>")
    out = rq._assigned({"segments": segments, "vectors": vectors}.__getitem__)
    assert out.count() == 8 and kept == [["media_id", "segment_id", "pos", "session"]]


def test_overlaps_are_settled_with_one_exchange_of_the_items(spark, monkeypatch):
    """Whole linked slots meet in one task; only the slots that join an earlier one are written, and the result is that of a plain loop."""
    rng = random.Random(21)
    cols = "media_id long, segment_id string, anchor_start long, anchor_end long, placement_start long, placement_end long, fitted_ms long, source_ms long, has_window boolean, overall_status string, quality_score double"
    rows = []
    for i in range(400):
        media, a, n = rng.choice([1, 1, 2, 3, None]), rng.choice([-900, 0, 5_000, 70_000]) + rng.randrange(30_000), rng.choice([40, 300, 900, 12_000])
        end = None if rng.random() < 0.03 else a + n
        rows.append((media, f"s{i}", a, a + n, None if rng.random() < 0.03 else a, end, n, rng.randrange(200, 2000), rng.random() < 0.5, rng.choice(["failed", "review", "passed", None]), rng.random() * 3))
    rows += [(4, "x", 0, 500, 0, 500, 500, 500, False, "passed", 1.0)] * 2
    names = [c.split()[0] for c in cols.split(", ")]
    want, ranks = [], {}
    for media in (1, 2, 3, 4):
        known = sorted((dict(zip(names, r, strict=True)) for r in rows if r[0] == media and r[4] is not None), key=lambda r: (r["placement_start"], r["placement_end"] is not None, r["placement_end"] or 0, r["segment_id"]))
        reach, cluster = None, 0
        for i, r in enumerate(known):
            cluster = i if reach is None or r["placement_start"] - reach >= -tl.OVERLAP_TOLERANCE else cluster
            reach = max((x for x in (reach, r["placement_end"]) if x is not None), default=None)
            r["cluster"] = cluster
        ranks |= {(media, r["segment_id"]): r["cluster"] for r in known}
        want += [[None if v != v else v for v in r] for r in tl._settle(pd.DataFrame(known)).astype(object).values.tolist()]
    df = spark.createDataFrame(rows, cols)
    written = []
    monkeypatch.setattr(tl, "cut_lineage", lambda d: written.append(d.columns) or d)
    monkeypatch.setattr(tl, "CLUSTER_ROWS", 7)
    for width in (1_000, 10_000, 3_600_000):
        found = tl.resolve_overlaps(df, width)
        assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(str(tuple(int(v) if isinstance(v, float) and k in (3, 4) else v for k, v in enumerate(r))) for r in want)
        assert {(r["media_id"], r["segment_id"]): r["cluster"] for r in tl.overlap_clusters(df, width).collect()} == ranks
    assert written == [["media_id", "_slot", "_group"]] * 6
    found = tl.resolve_overlaps(df)
    assert plan_of(found).count("MapInArrow") == 1 and len([x for x in plan_of(found).split("\n") if "REPARTITION_BY_NUM" in x]) == 1


def test_attempt_grids_are_made_with_one_exchange_by_line(spark):
    """Texts outermost, clips next (recommended, in use, by rank), backends last; lines listed twice know the clips of both."""
    rng = random.Random(22)
    refs = [(m, s, f"c{i}", i + 1, i + 1 in marks) for m in (1, 2) for s, n, marks in (("a", 6, (2,)), ("b", 1, ()), ("c", 7, (5, 6))) for i in range(n)]
    items = [(rng.choice([1, 2]), f"l{i}", rng.choice([True, False, None]), rng.choice(["a", "b", "c", "d", None]), rng.choice([None, "c0", "c4", "c5", "gone"]), rng.choice(["One", " two ", "", None])) for i in range(60)]
    items += [(1, "l0", True, "a", "c3", "Two"), (1, "l0", True, "a", "c3", "Two"), (1, "l0", False, "b", None, "Two"), (None, "l0", True, "a", "c0", "x"), (1, None, True, "a", "c0", "x")]
    items[0] = (1, "l0", None, "a", "c5", "Two")
    rewrites = [(m, f"l{i}", o, rng.choice(["ONE", "one ", "t", "", None]) if o != 3 else f"u{i}", f"v{o}") for m in (1, 2, None) for i in range(40) for o in range(1, rng.randrange(2, 6))] + [(1, None, 1, "n", "v")]
    want = []
    for m, line in sorted({r[:2] for r in items if None not in r[:2]}):
        own = [r for r in items if r[:2] == (m, line)]
        texts, seen = [], set()
        told = [(o, (t or "").strip(), v) for k, x, o, t, v in rewrites if (k, x) == (m, line)] if any(r[2] for r in own) else []
        for o, t, v in sorted({*told, *((10**6, (r[5] or "").strip(), "current") for r in own)}):
            if t and t.lower() not in seen:
                texts.append((t, v))
                seen.add(t.lower())
        best = {}
        for r in own:
            for k, s, path, rank, marked in refs:
                if (k, s) == (m, r[3]):
                    best[path] = min(best.get(path, (9, 0)), (0 if marked else 1 if path == r[4] else 2, rank))
        grid = [(t, v, p, b) for t, v in texts for p in sorted(best, key=best.get) for b in ("x", "y")]
        want += [(m, line, *g, n) for n, g in enumerate(grid[:5], 1)]
    frames = [spark.createDataFrame(items, "media_id long, segment_id string, may_rewrite boolean, speaker_id string, reference_path string, target_text string"),
              spark.createDataFrame(rewrites, "media_id long, segment_id string, ord int, rewrite_text string, variant string"),
              spark.createDataFrame(refs, "media_id long, speaker_id string, path string, ref_rank long, recommended boolean")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        grid = rp.attempt_grid(*frames, ["x", "y"], 5)
        plan = plan_of(grid)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = [tuple(r) for r in grid.select("media_id", "segment_id", "text", "variant", "path", "backend", "attempt_no").collect()]
    assert len(got) > 90 and sorted(got) == sorted(want)
    assert len([x for x in plan.split("\n") if "Exchange hashpartitioning(media_id" in x and "segment_id" in x.split("],")[0].split("ENSURE")[0]]) == 1


def test_repair_items_settle_what_the_report_tells_before_the_joins(spark):
    """Statuses and paths that only make reasons are not shuffled with the report."""
    report = spark.createDataFrame([(1, "a", 1000, 1700, "failed", "failed", "passed", None, "", "s"), (1, "b", 2000, 2000, "passed", None, "passed", "passed", "w", "s"), (1, "c", None, 2000, "passed", "passed", "passed", "passed", "w", "s")],
                                   "media_id long, segment_id string, source_ms long, generated_ms long, overall_status string, duration_status string, speaker_status string, intelligibility_status string, audio_path string, speaker_id string")
    lines = spark.createDataFrame([(1, "a", 0, 900, "x", False), (1, "c", 0, 900, "y", None)], "media_id long, segment_id string, start_ms long, end_ms long, source_text string, too_short_flag boolean")
    found = rp.repair_items(report, lines, report.filter("segment_id = 'b'"))
    got = {r["segment_id"]: (r["reasons"], r["actions"], r["ratio"], r["priority"], r["overall_status"]) for r in found.collect()}
    assert got["a"] == (["task_d_overall_failed", "duration_failed", "too_short_source", "generated_too_long", "missing_audio_path"], ["merge_short_segments", "rewrite_for_dubbing", "regenerate_candidates", "manual_review"], 1.7, "low", "failed")
    assert got["b"][0] == ["qa_flagged"] and got["c"][:3] == (["too_short_source"], ["manual_review"], None) and "_forced" not in found.columns
    assert [c for c in found.columns if c.startswith("_")] == []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = found.select("media_id", "segment_id", "may_rewrite")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above = plan[: plan.index("Join LeftOuter")]
    assert not re.search(r"\b(audio_path|duration_status|overall_status)#", above)
