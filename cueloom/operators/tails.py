"""Trailing rows that are no dialogue: credits, watermarks and notices after the last line of a media.

The third rule compares a suffix with the layout of everything before it, which takes order statistics of growing prefixes: the median
and the median deviation of box heights, bottoms and centres before each candidate row.  Nothing is sorted per candidate.  Box values
are few (screen coordinates), so the rows between two candidates are summed to (value, count) bins; running sums of a bin over the
stretches are the bins of every prefix, each valid for a range of candidates; and a weighted percentile over the distinct values of a
prefix gives the median, a second one over the distances to it the deviation.  Suffix sums are totals minus running sums, and the rows
of one long suffix are judged in blocks of positions, so no media needs a task of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions import text as tx
from cueloom.functions.cols import count_if
from cueloom.operators import sequence as seq
from cueloom.operators.detections import layout_profile
from cueloom.session import cut_lineage

MEDIA = ["media_id"]
ORDER = ["start_ms", "end_ms", "segment_id"]

# Fixed values of the rules: shares, lengths in characters, times in milliseconds.
LOW_SENTENCE = 0.20
SHORT_TEXT = 8
VERY_SHORT_MS = 650
GROUP_GAP_MS = 2_500
GROUP_FROM = 0.82
GROUP_ROWS = 8
SPARSE_GAP_MS = 12_000
SPARSE_FROM = 0.96
SPARSE_ROWS = 6
DIALOGUE_MS = 750
DIALOGUE_SENTENCE = 0.30
PROFILE_ROWS = 8
OUTLIER_SCORE = 0.58
OUTLIER_SHARE = 0.67

SUMS = ("low", "short", "very_short", "structural", "length", "duration")
FEATURES = ("height", "bottom_y", "center_x")


def structural_hit(samples: Column, dense_text: Column, lines: Column, components: Column, style: Column, edge: Column) -> Column:
    """The detector's samples of the row look like a text layout (missing metrics are 0; without samples no hit)."""
    dense, lines, components, style, edge = (F.coalesce(c.cast("double"), F.lit(0.0)) for c in (dense_text, lines, components, style, edge))
    return (F.coalesce(samples, F.lit(0)) > 0) & ((dense >= 0.07) | (lines >= 3) | (components >= 5) | (style < 0.45) | (edge >= 0.85))


def _facts(subtitles: DataFrame) -> DataFrame:
    duration = F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))
    length = F.length(tx.candidate_text(F.col("text")))
    boxed = F.col("x1").isNotNull() & F.col("y1").isNotNull() & F.col("x2").isNotNull() & F.col("y2").isNotNull()
    rows = subtitles.withColumn("_sentence", tx.sentence_likeness(F.coalesce("text", F.lit("")))).withColumn("_boxed", boxed)
    return rows.withColumns({
        "_low": (F.col("_sentence") <= LOW_SENTENCE).cast("long"), "_short": (length <= SHORT_TEXT).cast("long"), "_very_short": (duration <= VERY_SHORT_MS).cast("long"),
        "_structural": F.coalesce(F.col("structural"), F.lit(False)).cast("long"), "_length": length.cast("long"), "_duration": duration.cast("long"),
        "_height": F.when(boxed, F.greatest(F.lit(1.0), (F.col("y2") - F.col("y1")).cast("double"))), "_bottom_y": F.when(boxed, F.col("y2").cast("double")),
        "_center_x": F.when(boxed, (F.col("x1") + F.col("x2")) / 2.0)})


def prefix_medians(rows: DataFrame, cuts: DataFrame, features: dict[str, str]) -> DataFrame:
    """media_id, cut (1-based) and per feature the median and median deviation (`<name>`, `<name>_mad`) of the rows before each cut, and `rows` of them.

    `rows` carry media_id, `stretch` (how many cuts lie at or before the row) and the columns that `features` names by output; rows
    whose values are null do not count.  `cuts` holds media_id and the number of cuts.  What grows with a media is summed before it meets.
    """
    values = F.explode(F.array(*(F.struct(F.lit(name).alias("feature"), F.col(c).alias("value")) for name, c in features.items()))).alias("v")
    bins = rows.join(cuts, "media_id").filter(F.col("stretch") < F.col("cuts")).select("media_id", "stretch", "cuts", values).select("media_id", "stretch", "cuts", "v.feature", "v.value").filter("value IS NOT NULL")
    bins = bins.groupBy("media_id", "feature", "value", "stretch", "cuts").agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("media_id", "feature", "value").orderBy("stretch")
    running = bins.withColumn("n", F.sum("n").over(along)).withColumn("until", F.coalesce(F.lead("stretch").over(along), F.col("cuts")))
    held = cut_lineage(running.select("media_id", "feature", "value", "n", F.explode(F.sequence(F.col("stretch") + 1, F.col("until"))).alias("cut")))
    keys = ["media_id", "feature", "cut"]
    middle = held.groupBy(*keys).agg(F.percentile("value", 0.5, F.col("n")).alias("middle"), F.sum("n").alias("rows"))
    spread = held.join(middle, keys).groupBy(*keys, "middle", "rows").agg(F.percentile(F.abs(F.col("value") - F.col("middle")), 0.5, F.col("n")).alias("mad"))
    pick = [F.max(F.when(F.col("feature") == name, F.col(side))).alias(out) for name in features for side, out in (("middle", name), ("mad", f"{name}_mad"))]
    return spread.groupBy("media_id", "cut").agg(F.max("rows").alias("rows"), *pick)


def layout_outliers(height: Column, bottom_y: Column, center_x: Column, profile: dict[str, Column]) -> tuple[Column, Column]:
    """Whether a box stands out of the profile by position, and whether by size of its letters."""
    tall = profile["height"]
    limits = (F.greatest(F.lit(8.0), tall * 0.55, profile["height_mad"] * 3.0), F.greatest(F.lit(18.0), tall * 1.20, profile["bottom_y_mad"] * 3.0), F.greatest(F.lit(80.0), tall * 5.0, profile["center_x_mad"] * 3.0))
    away = [F.least(F.lit(1.0), F.abs(value - profile[name]) / F.greatest(F.lit(1.0), limit)) for value, name, limit in zip((height, bottom_y, center_x), FEATURES, limits)]
    ratio, change = F.greatest(F.lit(1.0), height) / F.greatest(F.lit(1.0), tall), F.abs(F.greatest(F.lit(1.0), height) - F.greatest(F.lit(1.0), tall))
    size = (ratio <= 0.72) | (ratio >= 1.38) | (change >= F.greatest(F.lit(12.0), F.greatest(F.lit(1.0), tall) * 0.28, limits[0] * 0.35))
    return away[0] * 0.42 + away[1] * 0.36 + away[2] * 0.22 >= OUTLIER_SCORE, size


def drop_trailing_non_dialogue(subtitles: DataFrame) -> DataFrame:
    """Three rules, in order: a media whose rows all look like notices goes whole; groups of such rows near the end go; and so does the
    suffix after the first long gap near the end whose rows are sparse notices or leave the layout of everything before.

    Takes media_id, segment_id, start_ms, end_ms, text, x1, y1, x2, y2 (null: no box) and structural (see `structural_hit`).  A media with
    a single row is kept; null texts are empty.
    """
    given = {"pos": ("row", None), "_pe": ("lag", F.col("end_ms")), "_next": ("lead", F.col("_sentence")), "_boxes": ("sum_before", F.col("_boxed").cast("long"))}
    given |= {f"_{s}_before": ("sum_before", F.col(f"_{s}")) for s in SUMS}
    breaks = F.col("_pe").isNull() | (F.col("start_ms") - F.col("_pe") > GROUP_GAP_MS)
    rows = cut_lineage(seq.label_islands(_facts(subtitles), MEDIA, ORDER, seq.time_slot(), breaks, given, "_group"))

    n = F.count(F.lit(1))
    sums = [F.sum(f"_{s}").alias(s) for s in SUMS]
    whole = rows.groupBy(*MEDIA).agg(n.alias("total"), F.greatest(F.lit(0.001), F.max_by("end_ms", "pos")).alias("last_end"), *[F.sum(f"_{s}").alias(f"total_{s}") for s in SUMS])
    every = (F.col("total") >= GROUP_ROWS) & (F.col("total_low") / F.col("total") >= 0.78) & (F.col("total_short") / F.col("total") >= 0.45) & (F.col("total_length") / F.col("total") <= 10.0) \
        & (F.col("total_duration") / F.col("total") <= 1_600) & (F.col("total_structural") / F.col("total") >= 0.45)
    whole = cut_lineage(whole.withColumn("all_notices", every & (F.col("total") > 1)))

    groups = rows.groupBy(*MEDIA, "_group").agg(n.alias("n"), F.min("start_ms").alias("first"), F.max_by("end_ms", "pos").alias("last"), *sums).join(whole.select(*MEDIA, "last_end"), MEDIA)
    near_end = (F.col("first") >= F.col("last_end") * GROUP_FROM) | (F.col("last") >= F.col("last_end") * GROUP_FROM)
    notices = (F.col("low") / F.col("n") >= 0.78) & (F.col("short") / F.col("n") >= 0.50) & (F.col("length") / F.col("n") <= 9.0) & (F.col("duration") / F.col("n") <= 1_600)
    dropped = groups.filter(near_end & (F.col("n") >= GROUP_ROWS) & notices).select(*MEDIA, "_group", F.lit(True).alias("_gone"))

    cuts = sparse_suffixes(rows, whole)
    out = rows.join(whole.select(*MEDIA, "all_notices"), MEDIA).join(dropped, [*MEDIA, "_group"], "left").join(cuts, MEDIA, "left")
    kept = out.filter(~F.col("all_notices") & F.col("_gone").isNull() & (F.col("_cut").isNull() | (F.col("pos") < F.col("_cut"))))
    return kept.select(*subtitles.columns)


def sparse_suffixes(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """media_id, `_cut`: position of the first row whose suffix is to go."""
    rest = F.col("total") - F.col("pos")
    tails = rows.join(whole, MEDIA).filter((F.col("pos") >= 1) & (F.col("start_ms") - F.col("_pe") >= SPARSE_GAP_MS) & (F.col("start_ms") >= F.col("last_end") * SPARSE_FROM))
    share = {s: (F.col(f"total_{s}") - F.col(f"_{s}_before")) / rest for s in SUMS}
    tails = tails.select(*MEDIA, "pos", rest.alias("rest"), "_boxes", *[share[s].alias(s) for s in SUMS], "total",
                         ((F.col("_duration") > DIALOGUE_MS) | (F.greatest("_sentence", "_next") > DIALOGUE_SENTENCE)).alias("dialogue"))
    tails = tails.filter((F.col("very_short") >= 0.67) & (F.col("duration") <= 850))  # what every form of the rule asks
    tails = cut_lineage(tails.withColumn("cut", F.row_number().over(Window.partitionBy(*MEDIA).orderBy("pos")).cast("long")))
    cuts = tails.groupBy(*MEDIA).agg(F.max("cut").alias("cuts"), F.min("pos").alias("first"))

    flagged = rows.join(cuts, MEDIA).join(tails.select(*MEDIA, "pos", "cut"), [*MEDIA, "pos"], "left")
    staged = cut_lineage(seq.prefix(flagged.select(*MEDIA, "pos", "cut", *[f"_{f}" for f in FEATURES]), MEDIA, {"stretch": ("sum", F.col("cut").isNotNull().cast("long"))}))
    profiles = prefix_medians(staged.filter("_height IS NOT NULL"), cuts.select(*MEDIA, "cuts"), {f: f"_{f}" for f in FEATURES})
    known = tails.filter(F.col("_boxes") >= PROFILE_ROWS).select(*MEDIA, "cut", F.explode(F.sequence(F.floor(F.col("pos") / seq.BLOCK_ROWS), F.floor((F.col("total") - 1) / seq.BLOCK_ROWS))).alias("_slot"))
    known = known.join(profiles, [*MEDIA, "cut"])
    after = staged.filter((F.col("stretch") >= 1) & F.col("_height").isNotNull()).withColumn("_slot", seq.block_slot()).withColumn("cut", F.explode(F.sequence(F.lit(1).cast("long"), F.col("stretch"))))
    off_place, off_size = layout_outliers(*[F.col(f"_{f}") for f in FEATURES], {c: F.col(c) for f in FEATURES for c in (f, f"{f}_mad")})
    outliers = after.join(known, [*MEDIA, "cut", "_slot"]).groupBy(*MEDIA, "cut").agg(count_if(off_place).alias("off_place"), count_if(off_size).alias("off_size"))

    judged = tails.join(outliers, [*MEDIA, "cut"], "left").withColumn("breaks_layout", F.greatest(F.coalesce("off_place", F.lit(0)), F.coalesce("off_size", F.lit(0))) / F.col("rest") >= OUTLIER_SHARE)
    long_sparse = (F.col("rest") >= SPARSE_ROWS) & (F.col("low") >= 0.78) & (F.col("short") >= 0.55) & (F.col("very_short") >= 0.70) & (F.col("length") <= 10.0)
    short_noisy = F.col("rest").between(2, SPARSE_ROWS - 1) & (F.col("duration") <= 750) & (F.col("breaks_layout") | ((F.col("structural") >= 0.67) & (F.col("low") >= 0.67)))
    return judged.filter(F.col("breaks_layout") | (~F.col("dialogue") & (long_sparse | short_noisy))).groupBy(*MEDIA).agg(F.min("pos").alias("_cut"))


# ---- rows off the main track --------------------------------------------------------------------------------------

# fixed values: heights against the track's, lengths of texts, shares of the frame
SMALL, VERY_SMALL = 0.76, 0.66
LONG_TEXT, MEDIUM_TEXT, TINY_TEXT = 14, 8, 4


def drop_off_track(subtitles: DataFrame, min_rows: int = 20) -> DataFrame:
    """Rows in letters clearly smaller than the media's main track go when their text or place says overlay: credits, wide or edge-bound
    lines, lines of many parts, unless they read like dialogue.  Media under `min_rows` rows, or without a layout profile, stay whole.

    Takes media_id, start_ms, end_ms, text, x1, y1, x2, y2 (null: no box, kept) and the detector's metrics frame_width_ratio, width_ratio,
    edge_attachment, style_match, temporal_support, line_count, component_count (null: 0).
    """
    box = {"height": F.col("y2") - F.col("y1"), "width": F.col("x2") - F.col("x1"), "center_x": (F.col("x1") + F.col("x2")) / 2.0, "center_y": (F.col("y1") + F.col("y2")) / 2.0, "bottom_y": F.col("y2")}
    boxed = subtitles.filter(F.col("x1").isNotNull()).select("media_id", *[F.greatest(F.lit(1.0), v.cast("double")).alias(n) if n in ("height", "width") else v.cast("double").alias(n) for n, v in box.items()])
    enough = subtitles.groupBy(*MEDIA).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") >= min_rows).select(*MEDIA)
    track = layout_profile(boxed, min_rows).join(enough, MEDIA).select(*MEDIA, *[F.col(c).alias(f"_t_{c}") for c in ("height", "width", "center_y")])
    facts = tx.credit_features(F.col("text"))
    rows = subtitles.join(track, MEDIA, "left").withColumn("_f", facts)
    m = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("frame_width_ratio", "width_ratio", "edge_attachment", "style_match", "temporal_support", "line_count", "component_count")}
    tall, wide_track = F.greatest(F.lit(1.0), F.col("_t_height")), F.greatest(F.lit(1.0), F.col("_t_width"))
    ratio, n = F.greatest(F.lit(1.0), box["height"].cast("double")) / tall, F.length(tx.candidate_text(F.col("text")))
    credit = (tx.credit_score(F.col("_f")) >= 0.38) | F.col("_f.role") | F.col("_f.organisation") | F.col("_f.name_list") | F.col("_f.latin_repeat")
    lower = box["center_y"] - F.col("_t_center_y") >= tall * 0.14
    wide = (m["frame_width_ratio"] >= 0.34) | (m["width_ratio"] >= 0.55) | (F.greatest(F.lit(1.0), box["width"].cast("double")) >= wide_track * 1.45)
    edge, parts = m["edge_attachment"] >= 0.34, (m["line_count"] >= 2) | (m["component_count"] >= 3)
    weak, fleeting = (m["style_match"] > 0) & (m["style_match"] <= 0.55), m["temporal_support"] <= 0.55
    dialogue = (tx.sentence_likeness(F.coalesce("text", F.lit(""))) >= 0.48) & ~credit & ~edge & ~weak
    small, tiny = ratio <= SMALL, ratio <= VERY_SMALL
    layout = wide & (edge | parts | lower | weak) | edge & (weak | fleeting | lower)
    brief = F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms")) <= 1_200
    overlay = tiny & credit & (n >= TINY_TEXT) | tiny & (n >= MEDIUM_TEXT) & (wide | edge | parts) & ~dialogue | small & (n >= LONG_TEXT) & layout & ~dialogue \
        | small & (n >= MEDIUM_TEXT) & credit & (lower | fleeting | brief) & ~((n >= LONG_TEXT) & layout & dialogue)
    off = F.col("x1").isNotNull() & small & ((n > TINY_TEXT) | credit) & (n > 0) & overlay
    return rows.filter(~F.coalesce(off, F.lit(False))).select(*subtitles.columns)
