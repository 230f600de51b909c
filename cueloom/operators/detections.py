"""Screen-text detections and units: frames, boxes, merging detections into subtitles, layout and credit filters."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueloom.functions import boxes as bx
from cueloom.functions import text as tx
from cueloom.functions.cols import count_if
from cueloom.functions.quantiles import exact_quantiles
from cueloom.operators import sequence as seq
from cueloom.session import cut_lineage, spread

MEDIA = ["media_id"]
ORDER = ["start_ms", "end_ms", "segment_id"]
BUCKET = 4_096


def fold_islands(df: DataFrame, island: str, fold: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType) -> DataFrame:
    """Run `fold` over whole islands, thousands of rows to a call; islands never straddle two calls."""
    rows = spread(df.withColumn("_b", F.floor(F.col(island) / BUCKET)), "media_id", "_b")
    return rows.groupBy("media_id", "_b").applyInPandas(fold, schema)


# ---- units ------------------------------------------------------------------------------------------------------


def context_units(segments: DataFrame) -> DataFrame:
    """Translation units: same speaker, gap up to 0.8 s, up to 12 s and 6 segments."""
    return _sessions(segments, same_speaker=True, gap_ms=800, cap_ms=12_000, max_rows=6)


def embedding_groups(segments: DataFrame) -> DataFrame:
    return _sessions(segments, same_speaker=False, gap_ms=450, cap_ms=8_000, max_rows=5)


def speech_regions(segments: DataFrame) -> DataFrame:
    return _sessions(segments, same_speaker=False, gap_ms=500, cap_ms=30_000, max_rows=None)


def _sessions(segments: DataFrame, same_speaker: bool, gap_ms: int, cap_ms: int, max_rows: int | None) -> DataFrame:
    ctx = seq.scan(segments, MEDIA, ORDER, seq.time_slot(), {
        "pos": ("row", None), "_pl": ("lag", F.col("speaker_label")), "_pe": ("lag", F.col("end_ms"))}).drop("_slot")
    breaks = F.col("_pe").isNull() | (F.col("start_ms") - F.col("_pe") > gap_ms)
    if same_speaker:
        breaks = breaks | (F.col("_pl") != F.col("speaker_label"))
    return seq.capped_sessions(ctx, MEDIA, breaks, cap_ms, max_rows).drop("_pl", "_pe")


def vision_units(segments: DataFrame) -> DataFrame:
    """Gap up to 2 s to the unit's latest end, up to 12 s and 6 segments; empty or reversed segments drop."""
    valid = segments.filter("end_ms > start_ms")
    ranked = seq.positions(valid, MEDIA, ["start_ms", "segment_id"], seq.time_slot())
    return seq.capped_sessions(ranked, MEDIA, F.lit(False), 12_000, 6, gap_ms=2_000)


def reference_groups(segments: DataFrame) -> DataFrame:
    """Adjacent segments of one speaker merged up to 15 s, with the top five by length (valid 1.5-15 s first, else longest)."""
    key = ["media_id", "speaker_label"]
    ctx = seq.scan(segments, key, ORDER, seq.time_slot(), {"pos": ("row", None), "_pe": ("lag", F.col("end_ms"))}).drop("_slot")
    breaks = F.col("_pe").isNull() | (F.col("start_ms") - F.col("_pe") > 600)
    grouped = seq.capped_sessions(ctx, key, breaks, 15_000, None)
    last = F.max_by("end_ms", "pos")
    return grouped.groupBy(*key, "session").agg(
        F.min("start_ms").alias("start_ms"), last.alias("end_ms"), F.count(F.lit(1)).alias("segment_count"), F.sum("value").alias("energy"))


def top_reference_groups(groups: DataFrame, limit: int = 5) -> DataFrame:
    length = F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))
    rows = groups.withColumn("dur_ms", length).withColumn("valid", F.col("dur_ms").between(1_500, 15_000))
    key = ["media_id", "speaker_label"]
    any_valid = rows.groupBy(*key).agg(F.bool_or("valid").alias("_any"))
    kept = rows.join(any_valid, key).filter(F.when(F.col("_any"), F.col("valid")).otherwise(F.col("dur_ms") > 0))
    order = Window.partitionBy(*key).orderBy(F.desc("dur_ms"), F.desc("energy"), "start_ms")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).drop("_any")


def unit_spans(rows: DataFrame, key: list[str] = MEDIA) -> DataFrame:
    return rows.groupBy(*key, "session").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("segment_count"))


def fixed_slices(media: DataFrame, interval_ms: int) -> DataFrame:
    """[0, duration) in equal slices; a tail shorter than a second joins the slice before it."""
    n = F.ceil(F.col("duration_ms") / interval_ms).cast("long")
    tail = F.col("duration_ms") - (n - 1) * interval_ms
    count = F.when((n > 1) & (tail < 1_000), n - 1).otherwise(n)
    rows = media.filter("duration_ms > 0").withColumn("_n", count)
    cut = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("slice"))
    last = F.col("slice") == F.col("_n") - 1
    return cut.withColumn("start_ms", F.col("slice") * interval_ms).withColumn(
        "end_ms", F.when(last, F.col("duration_ms")).otherwise((F.col("slice") + 1) * interval_ms)).drop("_n")


def sample_instants(units: DataFrame, k: int) -> DataFrame:
    """Midpoint of a unit under 2 s, else up to eight instants inset by half a step."""
    k = max(1, min(8, k))
    length = F.col("end_ms") - F.col("start_ms")
    n = F.when(length < 2_000, 1).otherwise(k)
    return units.withColumn("_n", n).select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("sample")).withColumn(
        "t_ms", F.col("start_ms") + length * (F.col("sample") + 0.5) / F.col("_n")).drop("_n")


def event_units(events: DataFrame) -> DataFrame:
    return events.filter("start_ms IS NOT NULL AND end_ms >= start_ms")


def even_subsample(units: DataFrame, n: int, order: list[str], slot: Column) -> DataFrame:
    """Keep the rows at floor(i * count / n), i < n, of each media."""
    ranked = seq.positions(units, MEDIA, order, slot)
    sizes = units.groupBy("media_id").agg(F.count(F.lit(1)).alias("_n"))
    kept = F.col("_n") <= n
    # row p is chosen iff some i has floor(i * count / n) = p, i.e. i = ceil(p * n / count) still maps to p
    i = F.ceil(F.col("pos") * n / F.col("_n"))
    chosen = (F.floor(i * F.col("_n") / n) == F.col("pos")) & (i < n)
    return ranked.join(sizes, "media_id").filter(kept | chosen).drop("_n")


# ---- frames and boxes -------------------------------------------------------------------------------------------


def event_frames(events: DataFrame, tall_px: int = 10) -> DataFrame:
    """Distinct (frame, box) rows of detection events; tall thin boxes drop."""
    wide = ~((F.col("y2") - F.col("y1")) - (F.col("x2") - F.col("x1")) > tall_px) & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    frames = F.sequence("start_frame", F.greatest("start_frame", "end_frame"))
    return events.filter(wide).select("media_id", "x1", "y1", "x2", "y2", F.explode(frames).alias("frame")).distinct()


def region_frames(media: DataFrame, regions: list[tuple[float, float, float, float]]) -> DataFrame:
    """Configured normalised regions on every frame of every media (a literal list times the frame sequence)."""
    specs = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), (min(a, c), min(b, d), max(a, c), max(b, d)))])
                      for a, b, c, d in regions])
    rows = media.select("media_id", "width", "height", "total_frames", F.explode(specs).alias("r")).select(
        "media_id", "total_frames", *[F.bround(F.col(f"r.{n}") * F.col("width" if n[0] == "x" else "height")).cast("int").alias(n) for n in ("x1", "y1", "x2", "y2")])
    valid = rows.filter("x2 > x1 AND y2 > y1 AND total_frames > 0")
    return valid.select("media_id", "x1", "y1", "x2", "y2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total_frames") - 1)).alias("frame"))


def mask_ranges(frames: DataFrame) -> DataFrame:
    """Runs of consecutive frames with the same set of boxes."""
    per = frames.groupBy("media_id", "frame").agg(F.array_sort(F.collect_set(F.struct("x1", "y1", "x2", "y2"))).alias("mask"))
    slot = F.floor(F.col("frame") / 4096).cast("long")
    breaks = F.col("_pf").isNull() | (F.col("frame") - F.col("_pf") != 1) | (F.col("mask") != F.col("_pm"))
    runs = seq.label_islands(per, MEDIA, ["frame"], slot, breaks, {"_pf": ("lag", F.col("frame")), "_pm": ("lag", F.col("mask"))})
    return runs.groupBy("media_id", "island").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame")).drop("island")


def plan_ranges(ranges: DataFrame, target: int) -> DataFrame:
    """Grow single-frame ranges between their neighbours and merge short adjacent ones, clamped to the media's `total_frames`.

    With disjoint sorted ranges the growth only needs the next start and the previous (grown) end, and the greedy merge
    has a closed form: inside a contiguous stretch a range opens a new group iff it is at least `target` long and starts
    at least `target` frames after the stretch.
    """
    slot = F.floor(F.col("start_frame") / 65_536).cast("long")
    half = (target - 1) // 2
    s, e = F.col("start_frame"), F.col("end_frame")
    near = seq.scan(cut_lineage(ranges), MEDIA, ["start_frame"], slot, {
        "_ns": ("lead", s), "_ps": ("lag", s), "_pe": ("lag", e)}).drop("_slot")
    prev_end = F.when(F.col("_ps") == F.col("_pe"), F.least(F.col("_ps") + half, s - 1)).otherwise(F.col("_pe"))
    single = s == e
    grown = near.withColumn("_s", F.when(single, F.greatest(s - half, F.coalesce(prev_end + 1, s - half))).otherwise(s)).withColumn(
        "_e", F.when(single, F.least(s + half, F.coalesce(F.col("_ns") - 1, s + half))).otherwise(e))
    rows = cut_lineage(grown.select("media_id", F.col("_s").alias("start_frame"), F.col("_e").alias("end_frame"), "total_frames"))
    apart = F.col("_pe").isNull() | (s > F.col("_pe") + 1)
    first = cut_lineage(seq.scan(rows, MEDIA, ["start_frame"], slot, {"_pe": ("lag", e), "pos": ("row", None)}))
    begins = cut_lineage(seq.scan(first, MEDIA, ["start_frame"], None, {"_begin": ("last", F.when(apart, s))}))
    opens = (s == F.col("_begin")) | ((e - s + 1 >= target) & (s - F.col("_begin") >= target))
    merged = seq.scan(begins, MEDIA, ["start_frame"], None, {"grp": ("last", F.when(opens, F.col("pos")))}).groupBy("media_id", "grp").agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"), F.max("total_frames").alias("total_frames"))
    return merged.withColumn("end_frame", F.least(F.col("end_frame"), F.col("total_frames") - 1)).filter("end_frame >= start_frame").drop("grp", "total_frames")


def boxes_in_ranges(frames: DataFrame, ranges: DataFrame, bucket: int = 256) -> DataFrame:
    """Distinct boxes active anywhere in each range."""
    r = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_frame") / bucket), F.floor(F.col("end_frame") / bucket))))
    f = frames.withColumn("_b", F.floor(F.col("frame") / bucket))
    return f.join(r, ["media_id", "_b"]).filter(F.col("frame").between(F.col("start_frame"), F.col("end_frame"))).select(
        "media_id", "start_frame", "end_frame", "x1", "y1", "x2", "y2").distinct()


def frame_hits(hits: DataFrame, fps: float, stride: int, lead: int = 0, trail: int = 0) -> DataFrame:
    """Frame hits (with their media's `total_frames`) merged into events: a gap larger than max(2 strides, 0.35 s) after the padded run end opens a new one."""
    reach = F.least(F.col("total_frames") - 1, F.col("frame") + stride * 3 + trail)
    gap = max(stride * 2, int(round(fps * 0.35)))
    slot = F.floor(F.col("frame") / 65_536).cast("long")
    breaks = F.col("_p").isNull() | (F.col("frame") > F.col("_p") + gap)
    runs = seq.label_islands(hits, MEDIA, ["frame", "hit_id"], slot, breaks, {"_p": ("lag", reach)})
    return runs.groupBy("media_id", "island").agg(
        F.greatest(F.lit(0), F.min("frame") - stride * 2 - lead).alias("start_frame"),
        F.least(F.max("total_frames") - 1, F.max("frame") + stride * 3 + trail).alias("end_frame"),
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.avg("confidence").alias("confidence")).drop("island")


def geometry_hint(events: DataFrame, width: int, height: int) -> DataFrame:
    """Per media: medians and spreads of valid boxes and the size limits derived from them (box sides are small integers,
    so the percentile buffers are bounded by their distinct values)."""
    valid = events.filter("x2 > x1 AND y2 > y1")
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    cy = (F.col("y1") + F.col("y2")) / 2.0
    out = valid.groupBy("media_id").agg(
        F.round(F.percentile(w, 0.05), 6).alias("w05"), F.round(F.percentile(w, 0.5), 6).alias("w50"), F.round(F.percentile(w, 0.95), 6).alias("w95"), F.round(F.percentile(h, 0.05), 6).alias("h05"),
        F.round(F.percentile(h, 0.5), 6).alias("h50"), F.round(F.percentile(h, 0.95), 6).alias("h95"), F.percentile((F.col("x1") + F.col("x2")) / 2.0, 0.5).alias("center_x"), F.percentile(cy, 0.5).alias("center_y"),
        F.round(F.percentile(cy, 0.9) - F.percentile(cy, 0.1), 6).alias("spread"), *[F.bround(F.percentile(c, 0.5)).cast("int").alias(f"box_{c}") for c in ("x1", "y1", "x2", "y2")])
    cap_w = F.least(F.lit(width), F.greatest(F.lit(48), F.greatest(F.col("w95") * 1.3, F.col("w50") * 1.8).cast("int")))
    cap_h = F.least(F.lit(height), F.greatest(F.lit(18), F.greatest(F.col("h95") * 1.15, F.col("h50") * 1.3).cast("int")))
    return out.select(
        "media_id", "center_x", "center_y", F.greatest(F.lit(50), (F.col("w05") * 0.75).cast("int")).alias("min_width"),
        F.greatest(F.lit(10), (F.col("h05") * 0.18).cast("int")).alias("min_height"), F.least(cap_w, F.lit(int(width * 0.6))).alias("max_width"),
        F.least(cap_h, F.lit(int(height * 0.28))).alias("max_height"),
        F.greatest(F.lit(70), F.greatest(F.col("w95") * 0.5, F.lit(width * 0.12)).cast("int")).alias("max_dx"),
        F.greatest(F.lit(26), F.greatest(F.col("spread") * 3.0 + 18, F.lit(height * 0.06)).cast("int")).alias("max_dy"), "box_x1", "box_y1", "box_x2", "box_y2")


def matching_geometry(boxes: DataFrame, hints: DataFrame) -> DataFrame:
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    fits = (
        (w > 0) & (h > 0) & (w >= F.col("min_width")) & (h >= F.col("min_height")) & (w <= F.col("max_width")) & (h <= F.col("max_height"))
        & (F.abs((F.col("x1") + F.col("x2")) / 2.0 - F.col("center_x")) <= F.col("max_dx")) & (F.abs((F.col("y1") + F.col("y2")) / 2.0 - F.col("center_y")) <= F.col("max_dy")))
    return boxes.join(hints, "media_id").filter(fits).select(*boxes.columns)


def greedy_box_match(pred: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """tp / fp / fn per media from one-to-one matches per tick, best IoU first.

    Pairs above the threshold come from a join on (media, tick); only those few enter the greedy pass, which reads them sorted, as a stream,
    and holds the boxes taken in one tick.
    """
    columns = ("x1", "y1", "x2", "y2")
    p = pred.select("media_id", "tick", F.col("box_id").alias("p_id"), *[F.col(c).alias(f"p_{c}") for c in columns])
    g = truth.select("media_id", "tick", F.col("box_id").alias("g_id"), *[F.col(c).alias(f"g_{c}") for c in columns])
    pairs = p.join(g, ["media_id", "tick"]).withColumn("iou", bx.iou("p_", "g_")).filter(F.col("iou") >= threshold).select("media_id", "tick", "p_id", "g_id", "iou")

    def match(batches):
        at, left, right = None, set(), set()
        for batch in batches:
            ticks = zip(batch.column("media_id").to_pylist(), batch.column("tick").to_pylist())
            taken = []
            for i, (here, a, b) in enumerate(zip(ticks, batch.column("p_id").to_pylist(), batch.column("g_id").to_pylist())):
                if here != at:
                    at, left, right = here, set(), set()
                if a not in left and b not in right:
                    left.add(a)
                    right.add(b)
                    taken.append(i)
            yield batch.select(["media_id"]).take(pa.array(taken, pa.int64()))

    ordered = pairs.repartition("media_id", "tick").sortWithinPartitions("media_id", "tick", F.desc("iou"), "p_id", "g_id").drop("iou")
    tp = ordered.mapInArrow(match, ordered.select("media_id").schema).groupBy("media_id").agg(F.count(F.lit(1)).alias("tp"))
    counts = pred.groupBy("media_id").agg(F.count(F.lit(1)).alias("_p")).join(truth.groupBy("media_id").agg(F.count(F.lit(1)).alias("_g")), "media_id", "full_outer").join(tp, "media_id", "left").fillna(0)
    return counts.select("media_id", "tp", (F.col("_p") - F.col("tp")).alias("fp"), (F.col("_g") - F.col("tp")).alias("fn"))


def drop_classified(events: DataFrame, classified: DataFrame) -> DataFrame:
    """Events whose index is classified as scene text drop; unclassified ones stay."""
    return events.join(classified.filter(F.col("kind") == "scene_text").select("media_id", "event_id").distinct(), ["media_id", "event_id"], "left_anti")


def drop_competing_anchors(subtitles: DataFrame, anchors: DataFrame) -> DataFrame:
    """Where a media has several anchors and one is at the bottom, subtitles seen only by other anchors drop."""
    stats = anchors.groupBy("media_id").agg(F.bool_or(F.lower("mode") == "bottom").alias("_bottom"), F.count(F.lit(1)).alias("_n"))
    named = F.filter(F.transform("modes", lambda m: F.lower(m)), lambda m: m != "")
    elsewhere = (F.size(named) > 0) & F.forall(named, lambda m: m != "bottom")
    return subtitles.join(stats, "media_id", "left").filter(~(F.coalesce(F.col("_bottom") & (F.col("_n") > 1), F.lit(False)) & elsewhere)).drop("_bottom", "_n")


def anchor_stats(detections: DataFrame) -> DataFrame:
    """Repetition, shortness and median layout per (media, anchor), with the drop rule."""
    key = ["media_id", "anchor"]
    texts = detections.filter("norm_text <> ''").groupBy(*key, "norm_text").agg(F.count(F.lit(1)).alias("_c")).groupBy(*key).agg(
        F.max("_c").alias("_top"), F.sum("_c").alias("_texts"), F.count(F.lit(1)).alias("_kinds"))
    base = detections.groupBy(*key).agg(
        F.count(F.lit(1)).alias("count"), F.first("mode").alias("mode"), F.bool_or("weak").alias("weak"), (count_if(F.col("short")) / F.count(F.lit(1))).alias("short_share"),
        *[F.percentile(c, 0.5).alias(c) for c in ("width_ratio", "center_prior", "edge")])
    rows = base.join(texts, key, "left").withColumn("repeat_share", F.coalesce(F.col("_top") / F.col("_texts"), F.lit(0.0))).withColumn(
        "unique_ratio", F.coalesce(F.col("_kinds") / F.col("_texts"), F.lit(1.0))).drop("_top", "_texts", "_kinds")
    bottom = detections.groupBy("media_id").agg(F.bool_or(F.col("mode") == "bottom").alias("_has_bottom"))
    rep, uni, short, width, centre, edge = (F.col(c) for c in ("repeat_share", "unique_ratio", "short_share", "width_ratio", "center_prior", "edge"))
    has = F.col("_has_bottom")
    side = (
        (has & (rep >= 0.55) & (uni <= 0.40) & (F.col("count") <= 8) & (width <= 0.45))
        | ((rep >= 0.34) & (uni <= 0.60) & (short >= 0.60) & ((centre < 0.78) | (width < 0.24) | (edge > 0.82)))
        | (has & F.col("weak") & (rep >= 0.30) & (short >= 0.50) & (centre < 0.84)))
    low = F.col("weak") & (rep >= 0.50) & (uni <= 0.35) & (short >= 0.80) & (width < 0.18) & (edge > 0.82)
    return rows.join(bottom, "media_id").withColumn("drop_anchor", (F.col("count") >= 5) & F.when(F.col("mode") == "bottom", low).otherwise(side)).drop("_has_bottom")


# ---- detections to subtitles --------------------------------------------------------------------------------------


def merge_detections(detections: DataFrame, tolerance_ms: int = 500, threshold: float = 0.8, min_ms: int = 500) -> DataFrame:
    """Consecutive detections within two tolerances and at least `threshold` similar form a subtitle.

    The text of a subtitle is its best candidate by frequency, confidence and length; a lone detection lasts `min_ms`.
    """
    norm = tx.normalise_transcript(F.col("text"))
    rows = detections.withColumn("norm", norm)
    breaks = F.col("_pt").isNull() | (F.col("t_ms") - F.col("_pt") > tolerance_ms * 2) | (tx.edit_similarity(F.col("norm"), F.col("_pn")) < threshold)
    groups = seq.label_islands(rows, MEDIA, ["t_ms", "det_id"], seq.time_slot("t_ms"), breaks, {"_pt": ("lag", F.col("t_ms")), "_pn": ("lag", F.col("norm"))}, "grp")
    groups = cut_lineage(groups)
    variants = groups.groupBy("media_id", "grp", "norm").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.bround(F.col("confidence") * 100)).alias("c"), F.max_by("text", F.struct("confidence", -F.col("det_id"))).alias("text"), F.min("det_id").alias("first_det"))
    spans = groups.groupBy("media_id", "grp").agg(
        F.min("t_ms").alias("start_ms"), F.max("t_ms").alias("last_ms"), F.count(F.lit(1)).alias("total"), F.avg("confidence").alias("confidence"))
    score = F.col("n") / F.col("total") * 0.34 + F.col("c") / (F.col("n") * 100) * 0.20 + F.least(F.lit(1.0), F.length("norm") / 12.0) * 0.12
    best = variants.join(spans.select("media_id", "grp", "total"), ["media_id", "grp"]).groupBy("media_id", "grp").agg(
        F.max_by("text", F.struct(F.round(score, 9), -F.col("first_det"))).alias("text"))
    return spans.join(best, ["media_id", "grp"]).select(
        "media_id", F.col("grp").alias("segment_id"), "start_ms", F.when(F.col("total") == 1, F.col("start_ms") + min_ms).otherwise(F.col("last_ms")).alias("end_ms"), "text", "confidence",
        F.col("total").alias("detections"))


def adjust_boundaries(subtitles: DataFrame, min_ms: int = 500, slot_rows: int = seq.FOLD_ROWS) -> DataFrame:
    """Strictly increasing starts (10 ms apart on a clash), previous end trimmed, minimum duration.

    A row whose start lies beyond every start the earlier rows could have been pushed to cannot be affected by them; that
    bound is a running maximum, and the fold carries a start only between such rows.
    """
    ranked = cut_lineage(seq.positions(subtitles, MEDIA, ORDER, seq.time_slot()))
    lifted = seq.prefix(ranked, MEDIA, {"_u": ("max_before", F.col("start_ms") - F.col("pos") * 10)})
    rows = lifted.withColumn("opens", F.col("_u").isNull() | (F.col("start_ms") > F.col("_u") + (F.col("pos") - 1) * 10))

    def step(s: Column, r: Column) -> Column:
        return F.struct(F.when(~r["opens"] & (r["start_ms"] <= s["start"]), s["start"] + 10).otherwise(r["start_ms"]).alias("start"))

    moved = ranked.join(seq.slot_fold(rows, MEDIA, ["start_ms", "opens"], "start long", step, slot_rows), ["media_id", "pos"])
    short = (F.col("end_ms") <= F.col("start")) | (F.col("end_ms") - F.col("start") < min_ms)
    held = moved.select("media_id", "segment_id", F.col("start").alias("start_ms"), F.when(short, F.col("start") + min_ms).otherwise(F.col("end_ms")).alias("end_ms"))
    gap = min(10, int(min_ms * 0.2))
    after = seq.scan(held, MEDIA, ["start_ms", "segment_id"], seq.time_slot(), {"_next": ("lead", F.col("start_ms"))}).drop("_slot")
    trimmed = F.when(F.col("_next") < F.col("end_ms"), F.greatest(F.col("start_ms") + 50, F.col("_next") - gap)).otherwise(F.col("end_ms"))
    return after.withColumn("end_ms", trimmed).drop("_next")


def merge_nearby(subtitles: DataFrame, max_gap_ms: int = 1_000, threshold: float = 0.95, slot_rows: int = seq.FOLD_ROWS) -> DataFrame:
    """Neighbours within `max_gap_ms` whose text is the first text of the run, or more than `threshold` like it, extend it."""
    rows = seq.scan(subtitles.withColumn("norm", tx.normalise_transcript(F.col("text"))), MEDIA, ORDER, seq.time_slot(), {"pos": ("row", None), "_pe": ("lag", F.col("end_ms"))}).drop("_slot")
    rows = cut_lineage(rows.withColumn("opens", F.col("_pe").isNull() | (F.col("start_ms") - F.col("_pe") > max_gap_ms)))

    def step(s: Column, r: Column) -> Column:
        same = (r["norm"] != "") & (s["norm"] != "") & ((r["norm"] == s["norm"]) | (tx.edit_similarity(r["norm"], s["norm"]) > threshold))
        joins = F.coalesce(~r["opens"] & same, F.lit(False))
        return F.struct(F.when(joins, s["run"]).otherwise(r["pos"]).alias("run"), F.when(joins, s["norm"]).otherwise(r["norm"]).alias("norm"))

    runs = rows.drop("norm").join(seq.slot_fold(rows, MEDIA, ["norm", "opens"], "run long, norm string", step, slot_rows), ["media_id", "pos"])
    return runs.groupBy("media_id", "run").agg(F.min_by("segment_id", "pos").alias("segment_id"), F.min("start_ms").alias("start_ms"), F.max_by("end_ms", "pos").alias("end_ms"), F.min_by("text", "pos").alias("text"), F.count(F.lit(1)).alias("merged")).drop("run")


def filter_confidence(subtitles: DataFrame, minimum: float) -> DataFrame:
    kept = subtitles.filter(F.col("confidence") >= minimum)
    return seq.positions(kept, MEDIA, ORDER, seq.time_slot(), "index").withColumn("index", F.col("index") + 1)


# ---- dialogue filters ---------------------------------------------------------------------------------------------


def credit_rows(subtitles: DataFrame) -> DataFrame:
    f = tx.credit_features(F.col("text"))
    rows = subtitles.withColumn("_f", f).withColumn("credit", tx.credit_score(F.col("_f"))).withColumn("sentence", tx.sentence_likeness(F.col("text")))
    strong = F.col("_f.role") | F.col("_f.organisation") | F.col("_f.name_list")
    return rows.withColumn("is_credit", (F.col("credit") >= 0.38) | strong | F.col("_f.latin_repeat")).withColumn(
        "is_strong", (F.col("credit") >= 0.48) | strong).drop("_f")


def drop_credit_rolls(subtitles: DataFrame) -> DataFrame:
    """Groups split by a 2.5 s gap drop when their rows look like credits; media under four rows stay whole."""
    breaks = F.col("_pe").isNull() | (F.col("start_ms") - F.col("_pe") > 2_500)
    rows = seq.label_islands(credit_rows(subtitles), MEDIA, ORDER, seq.time_slot(), breaks, {"_pe": ("lag", F.col("end_ms"))}, "grp").drop("_pe")
    rows = cut_lineage(rows)
    n = F.count(F.lit(1))
    groups = rows.groupBy("media_id", "grp").agg(
        n.alias("n"), count_if(F.col("is_credit")).alias("c"), count_if(F.col("is_strong")).alias("s"), count_if(F.col("sentence") < 0.2).alias("low"),
        (F.sum(F.bround(F.col("credit") * 100)) / (n * 100)).alias("mean"), F.min("start_ms").alias("_start"))
    ends = rows.groupBy("media_id").agg(F.max_by("end_ms", "pos").alias("_end"), F.count(F.lit(1)).alias("_total"))
    broad = (F.col("c") >= 2) & ((F.col("c") / F.col("n") >= 0.45) | (F.col("s") >= 2) | (F.col("mean") >= 0.45))
    flat = (F.col("low") / F.col("n") >= 0.70) & ((F.col("n") - F.col("low")) / F.col("n") <= 0.30)
    tail = F.col("_start") >= F.col("_end") * 0.88
    drop = (
        ((F.col("n") >= 4) & broad & ((F.col("c") / F.col("n") >= 0.55) | flat | (F.col("s") >= 3))) | ((F.col("n") >= 6) & broad & flat)
        | (tail & (F.col("c") >= 2) & flat & ((F.col("s") >= 1) | (F.col("mean") >= 0.35))))
    dropped = groups.join(ends, "media_id").filter(drop & (F.col("_total") >= 4)).select("media_id", "grp")
    return rows.join(dropped, ["media_id", "grp"], "left_anti").select(*subtitles.columns)


def main_window(subtitles: DataFrame, durations: DataFrame) -> DataFrame:
    """Drop a sparse head before the first cue cluster and a small tail after a long gap (rules need 40 cues).

    The cluster test only asks whether the cue five places on starts within 30 s, so it is a lead, not a range count.
    """
    lead5 = seq.scan(cut_lineage(subtitles), MEDIA, ["start_ms", "end_ms", "segment_id"], seq.time_slot(), {"pos": ("row", None), "_pe": ("lag", F.col("end_ms"))}).drop("_slot")
    lead5 = cut_lineage(lead5)
    ahead = lead5.select("media_id", (F.col("pos") - 5).alias("pos"), F.col("start_ms").alias("_s5"))
    rows = lead5.join(ahead, ["media_id", "pos"], "left").withColumn("dense", F.coalesce(F.col("_s5") - F.col("start_ms") <= 30_000, F.lit(False)))
    rows = cut_lineage(rows)
    whole = rows.groupBy("media_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("start_ms").alias("first"), F.max_by("end_ms", "pos").alias("last"), F.min(F.when(F.col("dense"), F.col("pos"))).alias("dense_pos"))
    whole = whole.join(durations, "media_id", "left").withColumn("program", F.greatest(F.coalesce("duration_ms", F.lit(0)), F.col("last")))
    span = F.greatest(F.lit(0), F.col("last") - F.col("first"))
    active = (F.col("n") >= 40) & ~((span < 300_000) & (F.col("program") < 600_000))
    scan_limit = F.least(F.col("n"), F.greatest(F.lit(40), F.floor(F.col("n") * 0.12)))
    joined = rows.join(whole, "media_id")
    head = joined.filter(F.col("pos") == F.col("dense_pos")).select("media_id", F.when(
        (F.col("pos") > 0) & (F.col("pos") < scan_limit) & (F.col("start_ms") - F.col("_pe") >= 18_000) & (F.col("pos") <= F.greatest(F.lit(20), F.floor(F.col("n") * 0.08)))
        & (F.greatest(F.lit(0), F.col("_pe") - F.col("first")) <= F.greatest(F.lit(180_000.0), F.greatest(F.lit(1_000), F.col("last") - F.col("first")) * 0.12)), F.col("pos")).otherwise(0).alias("head"))
    bounded = whole.join(head, "media_id", "left").withColumn("head", F.coalesce("head", F.lit(0).cast("long")))
    begins = rows.join(bounded.select("media_id", "head"), "media_id").filter(F.col("pos") == F.col("head")).select("media_id", F.col("start_ms").alias("begin"))
    bounded = bounded.join(begins, "media_id").withColumn("active", active)
    r = rows.join(bounded, "media_id")
    zone = F.greatest(F.col("begin") + F.greatest(F.lit(0), F.col("last") - F.col("begin")) * 0.88, F.greatest("program", "last") * 0.88)
    kept, rest = F.col("pos") - F.col("head"), F.col("n") - F.col("pos")
    body = F.greatest(F.lit(1_000), F.col("_pe") - F.col("begin"))
    suffix = F.greatest(F.lit(0), F.col("last") - F.col("start_ms"))
    cut = (
        (F.col("pos") > F.col("head")) & (F.col("n") - F.col("head") >= 40) & (F.col("start_ms") - F.col("_pe") >= 18_000) & (F.col("start_ms") >= zone)
        & (kept >= F.greatest(F.lit(30), F.floor(F.col("n") * 0.55))) & (rest / F.greatest(F.lit(1), kept) <= 0.08) & ((suffix <= 120_000) | (suffix / body <= 0.06)))
    tails = r.filter(cut).groupBy("media_id").agg(F.max("pos").alias("tail"))
    out = r.join(tails, "media_id", "left").withColumn("tail", F.coalesce("tail", "n"))
    keep = ~F.col("active") | (F.col("head") >= F.col("tail")) | ((F.col("pos") >= F.col("head")) & (F.col("pos") < F.col("tail")))
    return out.filter(keep).select(*subtitles.columns)


def layout_profile(rows: DataFrame, min_rows: int = 20) -> DataFrame:
    """Median box of the rows whose height is within 0.68-1.45 of the raw median (all rows when too few remain)."""
    raw = exact_quantiles(rows, MEDIA, F.col("height"), {"raw": 0.5}, 50.0)
    sized = rows.join(raw, "media_id").withColumn("core", (F.col("height") / F.col("raw")).between(0.68, 1.45))
    counts = sized.groupBy("media_id").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("core")).alias("c"), F.first("raw").alias("raw"))
    usable = counts.filter((F.col("n") >= min_rows) & (F.col("raw") > 1.0)).select("media_id", (F.col("c") >= min_rows).alias("by_core"))
    chosen = sized.join(usable, "media_id").filter(~F.col("by_core") | F.col("core"))
    return chosen.groupBy("media_id").agg(F.count(F.lit(1)).alias("count"), *[F.percentile(c, 0.5).alias(c) for c in ("height", "width", "center_x", "center_y", "bottom_y")])


# ---- signatures and contours --------------------------------------------------------------------------------------


def reuse_neighbours(units: DataFrame, threshold: float) -> DataFrame:
    """A unit whose signature is near its predecessor's takes the last computed payload; an error resets the chain."""
    distance = F.aggregate(F.zip_with("sig", "_ps", lambda a, b: F.abs(a - b)), F.lit(0).cast("long"), lambda s, v: s + v) / F.size("sig")
    near = seq.scan(units, MEDIA, ["start_ms", "unit_id"], seq.time_slot(), {"_ps": ("lag", F.col("sig")), "_pfail": ("lag", F.col("failed"))})
    computed = F.col("_ps").isNull() | F.col("_pfail") | F.col("failed") | (distance >= threshold)
    flagged = cut_lineage(near.withColumn("reused", ~computed))
    return seq.scan(flagged, MEDIA, ["start_ms", "unit_id"], None, {"source_payload": ("last", F.when(~F.col("reused"), F.col("payload")))}).drop("_ps", "_pfail", "_slot")


def downsample(points: DataFrame, start_ms: int, end_ms: int, n: int) -> DataFrame:
    """Points inside a window, thinned evenly to at most `n` per media: positions floor(i * count / n)."""
    inside = points.filter(F.col("t_ms").between(start_ms, end_ms))
    return even_subsample(inside, n, ["t_ms", "point_id"], seq.time_slot("t_ms"))
