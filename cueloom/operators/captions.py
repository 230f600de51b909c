"""Detected captions to subtitles: best variant and stable box of a group, collapse of near duplicates, attachment of short prefixes.

The collapse is a fold whose representative changes while rows are absorbed, so what a row is compared with depends on all rows before it.
`sequence.slot_fold` runs it in slots of bounded length and carries one representative from slot to slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions import captions as cp
from cueloom.functions import text as tx
from cueloom.operators import sequence as seq
from cueloom.session import cut_lineage

MEDIA = ["media_id"]
ORDER = ["start_ms", "end_ms", "segment_id"]
BOX = ("x1", "y1", "x2", "y2")

# Weights of a variant, of the terms of a candidate, padding of boxes, limits of the collapse and the attachment.
VARIANT_WEIGHTS = (0.58, 0.42)
CANDIDATE_WEIGHTS = {"frequency": 0.34, "confidence": 0.20, "similarity": 0.18, "length": 0.12, "quality": 0.16}
FULL_LENGTH = 12.0
PAD_X, PAD_Y = (5.0, 0.08), (4.0, 0.3)
SURE_SHARE = 0.8
SAME, SAME_QUALITY = 0.92, 0.02
CONTAINED_GAPS, VARIANT_GAP_MS, VARIANT_GAPS, VARIANT_LENGTH, VARIANT_OVERLAP = 1.2, 180, 0.5, 8, 0.7
PREFIX_LENGTH, HOST_LENGTH, PREFIX_OVERLAP, PREFIX_GAP_MS, PREFIX_GAPS = 4, 6, 0.5, (-50, 700), 0.45


def box_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Shared area by the smaller box."""
    wide, tall = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    area = [F.greatest(F.lit(1), k["x2"] - k["x1"]) * F.greatest(F.lit(1), k["y2"] - k["y1"]) for k in (a, b)]
    return F.when((wide <= 0) | (tall <= 0), 0.0).otherwise((wide * tall) / F.greatest(F.lit(1), F.least(*area)))


def _padded(x1: Column, y1: Column, x2: Column, y2: Column) -> dict[str, Column]:
    """Box with room to either side, whole pixels, at least one wide and tall."""
    pad_x = F.greatest(F.lit(PAD_X[0]), F.greatest(F.lit(1.0), x2 - x1) * PAD_X[1])
    pad_y = F.greatest(F.lit(PAD_Y[0]), F.greatest(F.lit(1.0), y2 - y1) * PAD_Y[1])
    left, top, right, low = (F.bround(v).cast("long") for v in (x1 - pad_x, y1 - pad_y, x2 + pad_x, y2 + pad_y))
    return {"x1": left, "y1": top, "x2": F.greatest(right, left + 1), "y2": F.greatest(low, top + 1)}


def merge_captions(detections: DataFrame, tolerance_ms: int = 500, threshold: float = 0.8, min_ms: int = 500, variants: cp.Variants = cp.NO_VARIANTS) -> DataFrame:
    """Consecutive detections within two tolerances and at least `threshold` alike are one subtitle.

    Its text is the best candidate by share of the group, confidence, mean likeness to all detections of the group, length and quality, where
    detections of one normalised text are one candidate, written as its best variant.  Its box is the padded median of the
    confident boxes with that text, its extent the padded hull of all of them.  A lone detection keeps its text and lasts `min_ms`.

    Takes media_id, det_id, t_ms, text, confidence, x1, y1, x2, y2.  Likeness is summed over the distinct texts of a group, not over its rows.
    """
    rows = detections.withColumn("raw", cp.norm(F.col("text"), variants))
    breaks = F.col("_pt").isNull() | (F.col("t_ms") - F.col("_pt") > tolerance_ms * 2) | (cp.likeness(F.col("raw"), F.col("_pn")) < threshold)
    grouped = seq.label_islands(rows, MEDIA, ["t_ms", "det_id"], seq.time_slot("t_ms"), breaks, {"_pt": ("lag", F.col("t_ms")), "_pn": ("lag", F.col("raw"))}, "grp")
    text = cp.cleaned(F.col("text"), variants)
    facts = grouped.withColumn("clean", text)
    facts = facts.withColumn("shown", F.when(F.col("clean") == "", tx.strip_spaces(F.coalesce("text", F.lit("")))).otherwise(F.col("clean")))
    facts = facts.withColumn("norm", cp.norm(F.col("shown"), variants)).withColumn("key", F.when(F.col("norm") == "", F.col("shown")).otherwise(F.col("norm")))
    facts = cut_lineage(facts.withColumn("quality", cp.quality(F.col("shown"), variants)).drop("_pt", "_pn"))

    n, keys = F.count(F.lit(1)), [*MEDIA, "grp"]
    spans = facts.groupBy(*keys).agg(n.alias("total"), F.min("t_ms").alias("start_ms"), F.max("t_ms").alias("last_ms"), (F.sum(F.bround(F.col("confidence") * 1e6)) / (n * 1e6)).alias("confidence"), F.min_by("text", "pos").alias("first_text"))
    variant = F.bround(F.col("confidence") * VARIANT_WEIGHTS[0] + F.col("quality") * VARIANT_WEIGHTS[1], 9)
    best = F.max_by(F.struct("shown", "norm", "quality"), F.struct(variant, -F.col("pos"))).alias("best")
    candidates = facts.groupBy(*keys, "key").agg(n.alias("n"), (F.sum(F.bround(F.col("confidence") * 1e6)) / (n * 1e6)).alias("sure"), F.min("pos").alias("first"), best).select(*keys, "key", "n", "sure", "first", "best.*")
    candidates = cut_lineage(candidates.join(spans.filter("total > 1").select(*keys, "total"), keys))
    others = facts.groupBy(*keys, "raw").agg(n.alias("m"))
    like = candidates.select(*keys, "key", "norm", "total").join(others, keys).groupBy(*keys, "key").agg((F.sum(cp.likeness(F.col("norm"), F.col("raw")) * F.col("m")) / F.max("total")).alias("similarity"))
    terms = {"frequency": F.col("n") / F.col("total"), "confidence": F.col("sure"), "similarity": F.col("similarity"), "length": F.least(F.lit(1.0), F.length("norm") / FULL_LENGTH), "quality": F.col("quality")}
    score = F.bround(sum((terms[k] * w for k, w in CANDIDATE_WEIGHTS.items()), F.lit(0.0)), 9)
    chosen = candidates.join(like, [*keys, "key"]).groupBy(*keys).agg(F.max_by("shown", F.struct(score, -F.col("first"))).alias("shown_text"))
    texts = spans.join(chosen, keys, "left").withColumn("best_text", F.coalesce("shown_text", "first_text"))

    boxes = facts.join(texts.select(*keys, "best_text"), keys).withColumn("own", F.col("clean") == F.col("best_text")).withColumn("sure", F.greatest(F.lit(0.01), F.col("confidence")))
    tops = boxes.groupBy(*keys).agg(F.max("own").alias("has_own"), F.max(F.when(F.col("own"), F.col("sure"))).alias("top_own"), F.max("sure").alias("top_all"))
    used = boxes.join(tops, keys).filter(F.col("own") | ~F.col("has_own")).withColumn("confident", F.col("sure") >= F.when(F.col("has_own"), F.col("top_own")).otherwise(F.col("top_all")) * SURE_SHARE)
    middle = {c: F.percentile(F.when(F.col("confident"), F.col(c)), 0.5).alias(f"m_{c}") for c in BOX}
    hull = {c: (F.min if c in ("x1", "y1") else F.max)(c).cast("double").alias(f"h_{c}") for c in BOX}
    geometry = used.groupBy(*keys).agg(*middle.values(), *hull.values())
    stable, full = (_padded(*[F.col(f"{p}_{c}") for c in BOX]) for p in "mh")
    extent = {c: (F.least if c in ("x1", "y1") else F.greatest)(full[c], stable[c]).alias(f"full_{c}") for c in BOX}
    out = texts.join(geometry, keys)
    end = F.when(F.col("total") == 1, F.col("start_ms") + min_ms).otherwise(F.col("last_ms"))
    return out.select("media_id", F.col("grp").alias("segment_id"), "start_ms", end.alias("end_ms"), F.col("best_text").alias("text"), "confidence", F.col("total").alias("detections"), *[stable[c].alias(c) for c in BOX], *extent.values())


STATE = "chain long, text string, norm string, quality double, confidence double, x1 long, y1 long, x2 long, y2 long, end_ms long"


def collapse_duplicates(subtitles: DataFrame, tolerance_ms: int = 500, variants: cp.Variants = cp.NO_VARIANTS, slot_rows: int = seq.FOLD_ROWS) -> DataFrame:
    """Adjacent subtitles that say the same become one: alike above `SAME` with few edits, one text within the other, or short variants in
    one place.  The better text stays, the surer box, the higher confidence and the last end.

    Takes media_id, segment_id, start_ms, end_ms, text, confidence, x1, y1, x2, y2 (null: no box); the id of the first row stays.  Rows
    without text after cleaning go, but for a media's first row.
    """
    clean = subtitles.withColumn("text", cp.cleaned(F.col("text"), variants))
    ranked = seq.scan(clean, MEDIA, ORDER, seq.time_slot(), {"_rank": ("row", None)}).drop("_slot").filter((F.col("_rank") == 0) | (F.col("text") != ""))
    facts = ranked.withColumn("norm", cp.norm(F.col("text"), variants)).withColumn("quality", cp.quality(F.col("text"), variants))
    placed = seq.scan(facts, MEDIA, ["_rank"], seq.time_slot(), {"pos": ("row", None), "_pe": ("lag", F.col("end_ms"))}).drop("_slot")
    reach = max(int(tolerance_ms * CONTAINED_GAPS), VARIANT_GAP_MS, int(tolerance_ms * VARIANT_GAPS))
    rows = cut_lineage(placed.withColumn("opens", F.col("_pe").isNull() | (F.col("start_ms") - F.col("_pe") > reach)))

    def step(s: Column, r: Column) -> Column:
        gap, n = r["start_ms"] - s["end_ms"], F.greatest(F.length(r["norm"]), F.length(s["norm"]))
        within = cp.contained(r["norm"], s["norm"])

        def joins(edits: Column) -> Column:
            alike = F.when((r["norm"] == "") | (s["norm"] == ""), 0.0).otherwise(1.0 - edits / n)
            minor = (r["norm"] != "") & (s["norm"] != "") & (within | (edits <= F.when((n > 8) & (n <= 16), 2).otherwise(1)))
            short = (r["x1"].isNotNull() & s["x1"].isNotNull() & (gap <= max(VARIANT_GAP_MS, tolerance_ms * VARIANT_GAPS)) & n.between(1, VARIANT_LENGTH) & (edits <= 1)
                     & (box_overlap({c: r[c] for c in BOX}, {c: s[c] for c in BOX}) >= VARIANT_OVERLAP))
            return F.coalesce(~r["opens"] & (((alike > SAME) & (gap < tolerance_ms) & minor) | (within & (gap < tolerance_ms * CONTAINED_GAPS)) | short), F.lit(False))

        closer = F.abs(r["quality"] - s["quality"]) <= SAME_QUALITY
        taken = F.when(closer, r["confidence"] >= s["confidence"]).otherwise(r["quality"] > s["quality"])
        boxed = r["x1"].isNotNull() & (s["x1"].isNull() | (r["confidence"] >= s["confidence"]))

        def state(join: Column) -> Column:
            text = {c: F.when(join & ~taken, s[c]).otherwise(r[c]).alias(c) for c in ("text", "norm", "quality")}
            box = {c: F.when(join & ~boxed, s[c]).otherwise(r[c]).alias(c) for c in BOX}
            return F.struct(F.when(join, s["chain"]).otherwise(r["pos"]).alias("chain"), *text.values(), F.when(join, F.greatest(s["confidence"], r["confidence"])).otherwise(r["confidence"]).alias("confidence"), *box.values(), r["end_ms"].alias("end_ms"))

        return cp.let(cp.let(F.levenshtein(r["norm"], s["norm"]), joins), state)

    folded = seq.slot_fold(rows, MEDIA, ["start_ms", "end_ms", "text", "norm", "quality", "confidence", *BOX, "opens"], STATE, step, slot_rows)
    last = folded.groupBy(*MEDIA, "chain").agg(F.max_by(F.struct("text", "confidence", *BOX, "end_ms"), "pos").alias("s"), F.count(F.lit(1)).alias("merged"))
    first = rows.select(*MEDIA, F.col("pos").alias("chain"), "segment_id", "start_ms")
    return last.join(first, [*MEDIA, "chain"]).select(*MEDIA, "segment_id", "start_ms", "s.end_ms", "s.text", "s.confidence", *[f"s.{c}" for c in BOX], "merged")


def attach_prefixes(subtitles: DataFrame, tolerance_ms: int = 500, variants: cp.Variants = cp.NO_VARIANTS) -> DataFrame:
    """A very short line right before a longer one in the same place becomes its beginning.

    Prefix and host differ in length (at most `PREFIX_LENGTH`, at least `HOST_LENGTH`), so a host is no prefix itself and no chain of
    attachments can arise: two neighbours decide, whatever the length of a run of candidates.
    """
    rows = subtitles.withColumn("_norm", cp.norm(F.col("text"), variants))
    near = F.struct("start_ms", "end_ms", "text", "_norm", "confidence", *BOX)
    around = seq.scan(rows, MEDIA, ORDER, seq.time_slot(), {"_before": ("lag", near), "_after": ("lead", near)}).drop("_slot")

    def attaches(short: dict[str, Column], host: dict[str, Column]) -> Column:
        gap = host["start_ms"] - short["end_ms"]
        fits = F.length(short["_norm"]).between(1, PREFIX_LENGTH) & (F.length(host["_norm"]) >= HOST_LENGTH) & ~F.contains(short["text"], F.lit("\n"))
        close = gap.between(PREFIX_GAP_MS[0], max(PREFIX_GAP_MS[1], tolerance_ms * PREFIX_GAPS))
        return F.coalesce(short["x1"].isNotNull() & host["x1"].isNotNull() & fits & close & (box_overlap(short, host) >= PREFIX_OVERLAP), F.lit(False))

    names = ("start_ms", "end_ms", "text", "_norm", "confidence", *BOX)
    own, before, after = {c: F.col(c) for c in names}, {c: F.col(f"_before.{c}") for c in names}, {c: F.col(f"_after.{c}") for c in names}
    marked = around.withColumn("_gone", attaches(own, after)).withColumn("_host", attaches(before, own)).filter("NOT _gone")
    text = cp.joined(cp.cleaned(F.col("_before.text"), variants), cp.cleaned(F.col("text"), variants))
    hosted = marked.withColumns({"start_ms": F.when(F.col("_host"), F.col("_before.start_ms")).otherwise(F.col("start_ms")), "text": F.when(F.col("_host"), text).otherwise(F.col("text")),
                                 "confidence": F.when(F.col("_host"), F.greatest(F.col("_before.confidence"), F.col("confidence"))).otherwise(F.col("confidence"))})
    return hosted.select(*subtitles.columns)
