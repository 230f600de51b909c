"""Text boxes of one frame to reading lines, and stable text regions of a whole media.  Everything is row-local or grouped; no Python.

A frame holds few boxes, so its lines are a fold over the frame's own array: boxes by vertical centre join the open line while they fit
its running mean, then lines are cut at wide horizontal gaps and read from left to right.

A media holds any number of boxes but few distinct (centre, height) pairs, as a screen has few rows of pixels.  A box equal to one just
taken always fits the cluster that took it (its distance to the mean only shrinks, the tolerance stays above it), so clusters by running mean
are a fold over the distinct pairs with their counts, whatever the media's length; all other figures are plain aggregates by cluster.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.functions import text as tx
from cueloom.functions.cols import flags
from cueloom.session import cut_lineage

# Fixed values of the line rules.
MIN_CONFIDENCE = 0.45
LINE_GAP, LINE_GAP_SHARE = 8, 0.75
HEIGHT_RATIO = 1.8
SIDE_GAP, SIDE_GAP_HEIGHTS, SIDE_OVERLAP = 36.0, 3.4, 0.08
VERTICAL_OVERLAP, CLOSE_CENTER, CLOSE_CENTER_HEIGHTS = 0.18, 8.0, 0.45
SPLIT_WIDTHS = 0.85
BLANK_GAP, BLANK_HEIGHTS = 6.0, 0.45

# Fixed values of the region rules.
Y_TOLERANCE, MIN_CLUSTER = 0.05, 2
MIN_APPEARANCE, WIDTH_RANGE, HEIGHT_RANGE, MIN_SCORE = 0.2, (0.12, 0.98), (0.015, 0.25), 0.525
SCORE_WEIGHTS = {"confidence": 0.45, "appearance": 0.30, "text_variety": 0.15, "center_prior": 0.10}


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it in `then`."""
    return F.transform(F.array(value), then)[0]


def median_of(values: Column) -> Column:
    n = F.size(values)
    return let(F.array_sort(values), lambda s: (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0)


def runs(boxes: Column, fits: Callable[[Column, Column], Column]) -> Column:
    """Consecutive boxes as arrays: a box joins the open run while `fits(run, box)` holds."""
    none = F.slice(boxes, 1, 0)

    def step(acc: Column, box: Column) -> Column:
        joins = (F.size(acc["open"]) == 0) | fits(acc["open"], box)
        return F.when(joins, F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.array(box)).alias("open"))).otherwise(
            F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), F.array(box).alias("open")))

    return F.aggregate(boxes, F.struct(F.slice(F.array(none), 1, 0).alias("done"), none.alias("open")), step, lambda acc: F.filter(F.concat(acc["done"], F.array(acc["open"])), lambda r: F.size(r) > 0))


def _overlap(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    return F.greatest(F.lit(0), F.least(hi_a, hi_b) - F.greatest(lo_a, lo_b)) / F.greatest(F.lit(1), F.least(hi_a - lo_a, hi_b - lo_b))


def _gap(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    return F.greatest(F.lit(0), lo_b - hi_a, lo_a - hi_b)


def _same_line(line_gap: Column) -> Callable[[Column, Column], Column]:
    def fits(line: Column, box: Column) -> Column:
        facts = F.struct(
            (F.aggregate(line, F.lit(0.0), lambda s, b: s + b["cy"]) / F.size(line)).alias("cy"), median_of(F.transform(line, lambda b: b["h"])).alias("h"),
            F.array_max(F.transform(line, lambda b: _overlap(b["y1"], b["y2"], box["y1"], box["y2"]))).alias("shared"),
            F.array_min(F.transform(line, lambda b: b["x1"])).alias("x1"), F.array_max(F.transform(line, lambda b: b["x2"])).alias("x2"))

        def rule(f: Column) -> Column:
            away, small = F.abs(box["cy"] - f["cy"]), F.least(f["h"], box["h"].cast("double"))
            beside = (_gap(f["x1"], f["x2"], box["x1"], box["x2"]) <= F.greatest(F.lit(SIDE_GAP), small * SIDE_GAP_HEIGHTS)) | (_overlap(f["x1"], f["x2"], box["x1"], box["x2"]) >= SIDE_OVERLAP)
            level = (f["shared"] >= VERTICAL_OVERLAP) | (away <= F.greatest(F.lit(CLOSE_CENTER), small * CLOSE_CENTER_HEIGHTS))
            return (away <= line_gap) & (F.greatest(f["h"], box["h"].cast("double")) / F.greatest(F.lit(1.0), small) <= HEIGHT_RATIO) & beside & level

        return let(facts, rule)

    return fits


def _split(line: Column) -> Column:
    """The boxes of a line from left to right, cut where the gap is wide for their height and width."""
    ordered = F.array_sort(F.transform(line, lambda b, i: F.struct(b["x1"].alias("x"), i.alias("i"), b.alias("b"))))

    def cut(typical: Column) -> Column:
        def fits(run: Column, box: Column) -> Column:
            last = F.element_at(run, -1)
            wide = F.greatest(F.lit(SIDE_GAP), typical * SIDE_GAP_HEIGHTS, F.greatest(F.lit(1), last["x2"] - last["x1"]) * SPLIT_WIDTHS)
            return ~((_gap(last["x1"], last["x2"], box["x1"], box["x2"]) > wide) & (_overlap(last["x1"], last["x2"], box["x1"], box["x2"]) < SIDE_OVERLAP))

        return runs(F.transform(ordered, lambda o: o["b"]), fits)

    return let(median_of(F.transform(line, lambda b: b["h"])), cut)


def _read(line: Column) -> Column:
    """Texts joined from left to right: a blank where the boxes leave a glyph's room or ASCII words would fuse."""
    def step(acc: Column, box: Column) -> Column:
        last = acc["last"]
        glyph = F.greatest(F.lit(1.0), F.least(last["y2"] - last["y1"], box["y2"] - box["y1"]).cast("double"))
        blank = (box["x1"] - last["x2"] >= F.greatest(F.lit(BLANK_GAP), glyph * BLANK_HEIGHTS)) | (acc["text"].rlike("[A-Za-z0-9]$") & box["text"].rlike("^[A-Za-z0-9]"))
        return F.struct(F.concat(acc["text"], F.when(blank, " ").otherwise(""), box["text"]).alias("text"), box.alias("last"))

    first = F.get(line, F.lit(0))
    joined = F.aggregate(F.slice(line, 2, F.size(line)), F.struct(first["text"].alias("text"), first.alias("last")), step, lambda acc: acc["text"])
    return tx.strip_spaces(F.regexp_replace(joined, r"(?U)\s+", " "))


def frame_lines(detections: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """One row per frame with readable text: its lines from top to bottom, their texts, number of boxes, mean confidence and hull.

    Takes media_id, frame, det_id, x1, y1, x2, y2, text, confidence.  Blank texts and boxes below the confidence do not count; a frame
    without any other has no row.  Boxes of one centre go by left edge, then by id.
    """
    text = tx.strip_spaces(F.coalesce("text", F.lit("")))
    usable = detections.withColumn("text", text).filter((F.col("text") != "") & (F.coalesce("confidence", F.lit(0.0)) >= min_confidence))
    box = F.struct(((F.col("y1") + F.col("y2")) / 2.0).alias("cy"), "x1", "det_id", "y1", "x2", "y2", F.greatest(F.lit(1), F.col("y2") - F.col("y1")).alias("h"), "text", "confidence")
    frames = usable.groupBy("media_id", "frame").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    total = F.aggregate("boxes", F.lit(0).cast("long"), lambda s, b: s + b["h"])
    frames = frames.withColumn("_gap", F.greatest(F.lit(LINE_GAP), F.floor(total / F.size("boxes") * LINE_GAP_SHARE)))
    lines = F.flatten(F.transform(runs(F.col("boxes"), _same_line(F.col("_gap"))), _split))
    out = frames.withColumn("lines", F.transform(lines, _read))
    hull = [(F.array_min if c in ("x1", "y1") else F.array_max)(F.col("boxes")[c]).alias(c) for c in ("x1", "y1", "x2", "y2")]
    return out.select("media_id", "frame", F.array_join("lines", "\n").alias("text"), F.size("lines").alias("n_lines"), F.size("boxes").alias("n_boxes"), (F.aggregate("boxes", F.lit(0.0), lambda s, b: s + b["confidence"]) / F.size("boxes")).alias("confidence"), *hull)


def position_band(mode: Column, window: float = 0.35) -> tuple[Column, Column]:
    """Lowest and highest centre of a region in its position mode, as shares of the frame height."""
    window = min(max(window, 0.12), 0.6)
    top, middle = F.lower(mode) == "top", F.lower(mode) == "middle"
    low = F.when(top, 0.02).when(middle, max(0.02, 0.5 - window / 2)).otherwise(max(0.02, 0.98 - window))
    return low, F.when(top, min(0.98, 0.02 + window)).when(middle, min(0.98, 0.5 + window / 2)).otherwise(0.98)


def stable_regions(detections: DataFrame, media: DataFrame, score_floor: float = MIN_SCORE, window: float = 0.35) -> DataFrame:
    """Regions of each media where text keeps appearing: cluster means as shares of the frame, score, and why a region is rejected.

    `detections`: media_id, frame, x1, y1, x2, y2, text, confidence; `media`: media_id, frame_width, frame_height, total_frames, mode.  Boxes
    by vertical centre, then height, join a region while their centre is within twice `Y_TOLERANCE` of its mean height from its mean
    centre.  Boxes without height are left out; a media without regions has no row.
    """
    rows = detections.filter("y2 > y1").withColumns({"_cy": (F.col("y1") + F.col("y2")) / 2.0, "_h": (F.col("y2") - F.col("y1")).cast("double")})
    pairs = rows.groupBy("media_id", "_cy", "_h").agg(F.count(F.lit(1)).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("_cy").alias("cy"), F.col("_h").alias("h"), "n")))

    def step(acc: Column, p: Column) -> Column:
        fits = F.abs(p["cy"] - acc["sy"] / acc["n"]) < acc["sh"] / acc["n"] * (Y_TOLERANCE * 2)
        keep = (acc["n"] > 0) & fits
        held = [F.when(keep, acc[c]).otherwise(F.lit(0.0)) for c in ("n", "sy", "sh")]
        region = F.when(keep, acc["region"]).otherwise(acc["region"] + 1)
        return F.struct((held[0] + p["n"]).alias("n"), (held[1] + p["cy"] * p["n"]).alias("sy"), (held[2] + p["h"] * p["n"]).alias("sh"), region.alias("region"),
                        F.concat(acc["out"], F.array(F.struct(p["cy"].alias("_cy"), p["h"].alias("_h"), region.alias("region")))).alias("out"))

    empty = F.array().cast("array<struct<_cy:double,_h:double,region:int>>")
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("sy"), F.lit(0.0).alias("sh"), F.lit(-1).alias("region"), empty.alias("out"))
    placed = pairs.groupBy("media_id").agg(ordered.alias("p")).select("media_id", F.inline(F.aggregate("p", start, step, lambda acc: acc["out"])))
    named = cut_lineage(rows.join(placed, ["media_id", "_cy", "_h"]))
    norm = tx.candidate_text(F.col("text"))
    said = F.when(norm != "", norm)
    avg = {"center_y": F.col("_cy"), "center_x": (F.col("x1") + F.col("x2")) / 2.0, "height": F.col("_h"), "width": (F.col("x2") - F.col("x1")).cast("double")}
    n = F.count(F.lit(1))
    plain = named.groupBy("media_id", "region").agg(n.alias("samples"), *[(F.sum(v) / n).alias(c) for c, v in avg.items()], (F.sum("confidence") / n).alias("confidence"), F.count(said).alias("said"))
    frames = named.select("media_id", "region", "frame").distinct().groupBy("media_id", "region").agg(n.alias("frames"))
    texts = named.select("media_id", "region", said.alias("t")).filter("t IS NOT NULL").distinct().groupBy("media_id", "region").agg(n.alias("texts"))
    r = plain.filter(F.col("samples") >= MIN_CLUSTER).join(frames, ["media_id", "region"]).join(texts, ["media_id", "region"], "left").join(media, "media_id")
    r = r.withColumns({"center_x": F.col("center_x") / F.col("frame_width"), "width": F.col("width") / F.col("frame_width"), "center_y": F.col("center_y") / F.col("frame_height"), "height": F.col("height") / F.col("frame_height"),
                       "appearance": F.col("frames") / F.greatest(F.lit(1), F.coalesce("total_frames", F.lit(0))), "text_variety": F.coalesce("texts", F.lit(0)) / F.greatest(F.lit(1), F.col("said"))})
    r = r.withColumn("center_prior", 1.0 - F.least(F.lit(1.0), F.abs(F.col("center_x") - 0.5) * 2))
    score = sum((F.col(c) * w for c, w in SCORE_WEIGHTS.items()), F.lit(0.0))
    low, high = position_band(F.coalesce("mode", F.lit("bottom")), window)
    reasons = flags(
        (~F.col("center_y").between(low, high), "outside_position_band"), (F.col("appearance") < MIN_APPEARANCE, "appearance_ratio_too_low"),
        (~F.col("width").between(*WIDTH_RANGE), "width_ratio_out_of_range"), (~F.col("height").between(*HEIGHT_RANGE), "height_ratio_out_of_range"), (F.col("score") < score_floor, "score_below_threshold"))
    r = r.withColumn("score", score).withColumn("reject_reasons", reasons).withColumn("accepted", F.size("reject_reasons") == 0)
    return r.select("media_id", "region", "samples", "frames", "appearance", "confidence", "text_variety", "center_prior", "center_x", "center_y", "width", "height", "score", "accepted", "reject_reasons")
