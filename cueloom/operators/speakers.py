"""Speaker diagnostics over segments (media_id, segment_id, start_ms, end_ms, dur_ms, speaker_label, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions.cols import count_if, flags, has
from cueloom.operators import sequence as seq

# fixed values
SHORT_SEGMENT_MS = 1_200
LOW_SAMPLE_SEGMENTS = 2
LOW_SAMPLE_TOTAL_MS = 6_000
LONG_SEGMENT_MS = 8_000
VERY_LONG_SEGMENT_MS = 15_000
SHORT_TEXT_CHARS = 8
SHORT_RUN_MS = 1_500
SANDWICHED_RUN_MS = 3_000
RAPID_GAP_MS = 200
HIGH_RISK = ("single_segment_speaker", "very_long_segment", "sandwiched_run", "long_timing_short_text")

MEDIA = ["media_id"]


def risk_level(risks: Column) -> Column:
    return F.when(has(risks, *HIGH_RISK), "high").when(F.size(risks) > 0, "medium").otherwise("low")


def normalise(raw: DataFrame) -> DataFrame:
    """Segments with a positive duration, a label, trimmed text and a generated id where none came."""
    span = F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))
    rows = raw.select(
        "media_id",
        F.coalesce(F.nullif(F.col("segment_id").cast("string"), F.lit("")),
                   F.format_string("seg-%04d", F.col("ord"))).alias("segment_id"),
        "ord",
        F.coalesce("start_ms", F.lit(0)).alias("start_ms"),
        F.coalesce("end_ms", F.lit(0)).alias("end_ms"),
        F.when(F.coalesce("dur_ms", F.lit(0)) > 0, F.col("dur_ms")).otherwise(span).alias("dur_ms"),
        F.trim(F.coalesce("text", F.lit(""))).alias("text"),
        F.coalesce(F.nullif("speaker_label", F.lit("")), F.lit("UNKNOWN")).alias("speaker_label"),
    )
    return rows


def ordered(segments: DataFrame) -> DataFrame:
    return seq.positions(segments, MEDIA, ["start_ms", "end_ms", "segment_id"], seq.time_slot())


def speaker_rollup(segments: DataFrame) -> DataFrame:
    """One row per (media, speaker): counts, speech time, risk flags, risk level, cloneable default."""
    rolled = segments.groupBy("media_id", "speaker_label").agg(
        F.count(F.lit(1)).alias("segment_count"),
        F.sum("dur_ms").alias("total_ms"),
        count_if(F.col("dur_ms") < SHORT_SEGMENT_MS).alias("short_segment_count"),
        F.coalesce(F.bool_or(F.col("dur_ms").between(1_500, 15_000)), F.lit(False)).alias("_safe"),
    )
    n, total = F.col("segment_count"), F.col("total_ms")
    risks = flags(
        (n == 1, "single_segment_speaker"),
        ((n <= LOW_SAMPLE_SEGMENTS) | (total < LOW_SAMPLE_TOTAL_MS), "low_sample_speaker"),
        (F.col("short_segment_count") * 10 >= n * 4, "mostly_short_segments"),
        ((n < 10) & (total >= n * LONG_SEGMENT_MS), "sparse_long_timing"),
        (~F.col("_safe"), "no_reference_safe_segment"),
    )
    return (
        rolled.withColumn("risk_flags", risks)
        .withColumn("risk_level", risk_level(F.col("risk_flags")))
        .withColumn("avg_ms", total / n)
        .withColumn(
            "cloneable",
            ~has(F.col("risk_flags"), "single_segment_speaker", "low_sample_speaker", "no_reference_safe_segment"),
        )
        .drop("_safe")
    )


ORDER = ["start_ms", "end_ms", "segment_id"]


def _around() -> dict[str, tuple[str, Column | None]]:
    return {
        "pos": ("row", None), "prev_label": ("lag", F.col("speaker_label")), "prev_end": ("lag", F.col("end_ms")),
        "next_label": ("lead", F.col("speaker_label")), "next_start": ("lead", F.col("start_ms")),
    }


def boundary_context(segments: DataFrame) -> DataFrame:
    """Positions plus the previous / next row of the media."""
    return seq.scan(segments, MEDIA, ORDER, seq.time_slot(), _around()).drop("_slot")


def speaker_runs(segments: DataFrame) -> DataFrame:
    """Consecutive rows of one speaker, with their outer neighbours and run risk flags."""
    opens = ~F.col("speaker_label").eqNullSafe(F.col("prev_label"))
    closes = ~F.col("speaker_label").eqNullSafe(F.col("next_label"))
    rows = seq.label_islands(segments, MEDIA, ORDER, seq.time_slot(), opens, _around(), "run_pos")
    runs = rows.groupBy("media_id", "run_pos").agg(
        F.max("speaker_label").alias("speaker_label"),
        F.min("start_ms").alias("start_ms"),
        F.max(F.when(closes, F.col("end_ms"))).alias("end_ms"),
        F.count(F.lit(1)).alias("segment_count"),
        F.max(F.when(opens, F.col("prev_label"))).alias("previous_speaker"),
        F.max(F.when(closes, F.col("next_label"))).alias("next_speaker"),
        F.max(F.when(opens, F.greatest(F.lit(0), F.col("start_ms") - F.col("prev_end")))
              ).alias("gap_before"),
        F.max(F.when(closes, F.greatest(F.lit(0), F.col("next_start") - F.col("end_ms")))).alias("gap_after"),
        F.max(F.when(opens, F.col("prev_end"))).alias("_prev_end"),
        F.max(F.when(closes, F.col("next_start"))).alias("_next_start"),
    )
    gap_before = F.when(F.col("_prev_end").isNotNull(), F.col("gap_before"))
    gap_after = F.when(F.col("_next_start").isNotNull(), F.col("gap_after"))
    duration = F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))
    before, after = F.col("previous_speaker"), F.col("next_speaker")
    return (
        runs.withColumn("gap_before", gap_before)
        .withColumn("gap_after", gap_after)
        .withColumn("duration_ms", duration)
        .withColumn(
            "risk_flags",
            flags(
                (F.col("segment_count") == 1, "single_segment_run"),
                (F.col("duration_ms") < SHORT_RUN_MS, "short_run"),
                ((before == after) & (before != F.col("speaker_label")) & (F.col("duration_ms") <= SANDWICHED_RUN_MS),
                 "sandwiched_run"),
                ((F.coalesce(F.col("gap_before") < RAPID_GAP_MS, F.lit(False)))
                 | (F.coalesce(F.col("gap_after") < RAPID_GAP_MS, F.lit(False))), "rapid_turn_boundary"),
            ),
        )
        .withColumn("risk_level", risk_level(F.col("risk_flags")))
        .drop("_prev_end", "_next_start")
    )


def segment_risks(segments: DataFrame) -> DataFrame:
    """Segment rows with neighbours and boundary / sample risk flags."""
    ctx = boundary_context(segments)
    rollup = speaker_rollup(segments).select(
        "media_id", "speaker_label",
        has(F.col("risk_flags"), "single_segment_speaker", "low_sample_speaker").alias("_sparse"),
    )
    label = F.col("speaker_label")
    rapid = (
        F.coalesce((F.col("prev_label") != label) & (F.col("start_ms") - F.col("prev_end") < RAPID_GAP_MS), F.lit(False))
        | F.coalesce((F.col("next_label") != label) & (F.col("next_start") - F.col("end_ms") < RAPID_GAP_MS), F.lit(False))
    )
    compact = F.length(F.regexp_replace("text", r"\s+", ""))
    return (
        ctx.join(rollup, ["media_id", "speaker_label"], "left")
        .withColumn(
            "risk_flags",
            flags(
                (F.col("dur_ms") < SHORT_SEGMENT_MS, "short_segment"),
                ((F.col("dur_ms") >= LONG_SEGMENT_MS) & (compact < SHORT_TEXT_CHARS), "long_timing_short_text"),
                (F.col("dur_ms") >= VERY_LONG_SEGMENT_MS, "very_long_segment"),
                (rapid, "speaker_boundary_risk"),
                (F.col("_sparse"), "speaker_sample_risk"),
            ),
        )
        .withColumn("risk_level", risk_level(F.col("risk_flags")))
        .drop("_sparse")
    )


def reference_clips(segments: DataFrame, limit: int = 3) -> DataFrame:
    """Top clips per speaker by score among 1.5-12 s segments; a speaker without one gets its longest segment."""
    key = ["media_id", "speaker_label"]
    compact = F.length(F.regexp_replace("text", r"\s+", ""))
    score = F.least(F.col("dur_ms") / 1000, F.lit(8.0)) + F.least(compact / 10.0, F.lit(1.5))
    rows = segments.withColumn("_ok", F.col("dur_ms").between(1_500, 12_000)).withColumn("score", score)
    any_ok = rows.groupBy(*key).agg(F.bool_or("_ok").alias("_any"))
    kept = rows.join(any_ok, key).filter(F.col("_ok") | ~F.col("_any"))
    by = F.when(F.col("_any"), F.col("score")).otherwise(F.col("dur_ms"))
    order = Window.partitionBy(*key).orderBy(by.desc(), "start_ms", "segment_id")
    top = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= F.when(F.col("_any"), limit).otherwise(1))
    return top.select(*key, "segment_id", F.when(F.col("_any"), F.col("score")).otherwise(0.0).alias("score"), "rank", (F.col("rank") == 1).alias("is_best"))


def profile_similarity(rollup: DataFrame) -> DataFrame:
    """Similarity of two speakers of one media from average duration, short share and segment count.

    One row per unordered pair of a media's speakers: a media has few speakers, whatever its number of segments.
    """
    short = F.col("short_segment_count") / F.col("segment_count")
    a = rollup.select("media_id", F.col("speaker_label").alias("a"), (F.col("avg_ms") / 1000).alias("aa"), short.alias("as"), F.col("segment_count").alias("an"))
    b = rollup.select("media_id", F.col("speaker_label").alias("b"), (F.col("avg_ms") / 1000).alias("ba"), short.alias("bs"), F.col("segment_count").alias("bn"))
    pace = F.greatest(F.lit(0.0), 1.0 - F.least(F.abs(F.col("aa") - F.col("ba")) / 5.0, F.lit(1.0)))
    shorts = F.greatest(F.lit(0.0), 1.0 - F.abs(F.col("as") - F.col("bs")))
    sizes = F.least("an", "bn") / F.greatest("an", "bn")
    return a.join(b, "media_id").filter("a < b").select("media_id", "a", "b", F.round(pace * 0.5 + shorts * 0.3 + sizes * 0.2, 3).alias("similarity"))


def similar_peers(pairs: DataFrame, limit: int = 3, threshold: float = 0.55) -> DataFrame:
    both = pairs.unionByName(pairs.select("media_id", F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    order = Window.partitionBy("media_id", "a").orderBy(F.desc("similarity"), "b")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).withColumn("suggest_merge", F.col("similarity") >= threshold)


def suggested_merges(peers: DataFrame) -> DataFrame:
    return peers.filter("suggest_merge").select("media_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def recommended_actions(rollup: DataFrame, peers: DataFrame, runs: DataFrame, segment_rows: DataFrame) -> DataFrame:
    """(item type, item id, action) for speakers, runs and segments."""
    best = peers.filter("rank = 1").select("media_id", F.col("a").alias("speaker_label"), "suggest_merge")
    weak = has(F.col("risk_flags"), "single_segment_speaker", "low_sample_speaker", "no_reference_safe_segment")
    speakers = rollup.join(best, ["media_id", "speaker_label"], "left").select(
        "media_id", F.lit("speaker_profile").alias("item_type"), F.col("speaker_label").alias("item_id"),
        F.when(weak, "mark_non_cloneable").when(F.col("suggest_merge"), "merge_speaker").otherwise("keep_independent").alias("action"))
    before, after = F.col("previous_speaker"), F.col("next_speaker")
    run_rows = runs.select(
        "media_id", F.lit("speaker_run").alias("item_type"), F.col("run_pos").cast("string").alias("item_id"),
        F.when(has(F.col("risk_flags"), "sandwiched_run") & (before == after), "merge_to_surrounding_speaker")
        .when(has(F.col("risk_flags"), "short_run") & before.isNotNull(), "relabel_to_previous_speaker")
        .when(has(F.col("risk_flags"), "single_segment_run") & after.isNotNull(), "relabel_to_next_speaker").otherwise("keep_independent").alias("action"))
    flags_ = F.col("risk_flags")
    segs = segment_rows.select(
        "media_id", F.lit("segment").alias("item_type"), F.col("segment_id").cast("string").alias("item_id"),
        F.when(has(flags_, "speaker_boundary_risk") & F.col("prev_label").isNotNull(), "relabel_to_previous_speaker").when(has(flags_, "very_long_segment"), "keep_independent")
        .when(has(flags_, "speaker_sample_risk") & F.col("next_label").isNotNull(), "relabel_to_next_speaker").otherwise("keep_independent").alias("action"))
    return speakers.unionByName(run_rows).unionByName(segs)


def review_plan(rollup: DataFrame, runs: DataFrame, segment_rows: DataFrame) -> DataFrame:
    """Review items per media and type: everything that carries a risk flag."""
    def items(df: DataFrame, kind: str) -> DataFrame:
        return df.filter(F.size("risk_flags") > 0).select("media_id", F.lit(kind).alias("item_type"), "risk_level")

    both = items(rollup, "speaker_profile").unionByName(items(runs, "speaker_run")).unionByName(items(segment_rows, "segment"))
    return both.groupBy("media_id", "item_type").agg(F.count(F.lit(1)).alias("items"), count_if(F.col("risk_level") == "high").alias("high_risk"))


def diagnostics_summary(rollup: DataFrame, runs: DataFrame, segment_rows: DataFrame) -> DataFrame:
    sp = rollup.groupBy("media_id").agg(F.count(F.lit(1)).alias("speaker_count"), F.sum("segment_count").alias("segment_count"), count_if(F.col("risk_level") == "high").alias("high_risk_speakers"))
    rn = runs.groupBy("media_id").agg(F.count(F.lit(1)).alias("run_count"), count_if(F.size("risk_flags") > 0).alias("review_runs"), count_if(F.col("risk_level") == "high").alias("high_risk_runs"))
    sg = segment_rows.groupBy("media_id").agg(count_if(F.size("risk_flags") > 0).alias("review_segments"))
    return sp.join(rn, "media_id").join(sg, "media_id")
