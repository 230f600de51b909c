"""Voice rules: pitch classes, status tiers, reference scores, voice bank and character ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions.cols import count_if, flags, has, lookup

# fixed values
ATTEMPT_STATUS_SCORE = {"passed": 2.0, "review": 1.0, "failed": 0.0}
BASELINE_STATUS_WEIGHT = {"passed": 2.5, "review": 1.2, "failed": 0.0}


def pitch_rank(hz: Column) -> Column:
    return F.when(hz < 145, 0).when(hz <= 215, 1).when(hz.isNotNull(), 2)


def pitch_class(hz: Column) -> Column:
    return F.coalesce(lookup(pitch_rank(hz), {0: "low", 1: "mid", 2: "high"}), F.lit("unknown"))


def voice_consistency(expected_hz: Column, generated_hz: Column) -> Column:
    distance = F.abs(pitch_rank(expected_hz) - pitch_rank(generated_hz))
    return F.when(distance.isNull(), "review").when(distance >= 2, "failed").when(distance == 1, "review").otherwise("passed")


def speaker_status(similarity: Column) -> Column:
    return F.when(similarity.isNull(), "review").when(similarity >= 0.45, "passed").when(
        similarity >= 0.25, "review").otherwise("failed")


def intelligibility_status(score: Column) -> Column:
    return F.when(score >= 0.9, "passed").when(score >= 0.7, "review").otherwise("failed")


def duration_status(ratio: Column) -> Column:
    return F.when(ratio.between(0.7, 1.35), "passed").when(ratio.between(0.55, 1.65), "review").otherwise("failed")


def worst_status(*statuses: Column) -> Column:
    anyone = F.array(*statuses)
    return F.when(has(anyone, "failed"), "failed").when(has(anyone, "review"), "review").otherwise("passed")


def retry_reasons(ratio: Column) -> Column:
    sim = F.col("speaker_similarity")
    return flags(
        ((F.col("duration_status") == "failed") & ((ratio >= 2.0) | ((ratio > 0) & (ratio <= 0.45))), "pathological_duration"),
        ((F.col("intelligibility_status") == "failed") & (F.coalesce("text_similarity", F.lit(0.0)) < 0.6), "poor_backread"),
        ((F.col("speaker_status") == "failed") & (sim.isNull() | (sim < 0.35)), "poor_speaker_match"),
    )


def proximity(ratio: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - F.abs(1.0 - ratio))


def attempt_score(ratio: Column) -> Column:
    def part(name: str, weight: float) -> Column:
        return F.coalesce(lookup(F.col(name), ATTEMPT_STATUS_SCORE), F.lit(0.0)) * weight

    return (
        part("overall_status", 100.0) + part("duration_status", 24.0) + part("intelligibility_status", 18.0)
        + part("speaker_status", 24.0) + proximity(ratio) + F.coalesce("text_similarity", F.lit(0.0))
        + F.coalesce("speaker_similarity", F.lit(0.0)) * 8.0
    )


def baseline_score(ratio: Column) -> Column:
    weight = F.coalesce(lookup(F.col("overall_status"), BASELINE_STATUS_WEIGHT), F.lit(0.0))
    return (
        weight + proximity(F.coalesce(ratio, F.lit(0.0))) * 0.3
        + F.greatest(F.lit(0.0), F.coalesce("speaker_similarity", F.lit(0.0))) * 0.25
        + F.greatest(F.lit(0.0), F.coalesce("text_similarity", F.lit(0.0))) * 0.35
    )


def character_ledger(report: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row per (media, speaker): failure counts, voice drift against the reference pitch, risk flags, review status."""
    drift = voice_consistency(F.col("reference_pitch_hz"), F.col("pitch_hz")) == "failed"
    rows = report.join(profiles, ["media_id", "speaker_id"])
    out = rows.groupBy("media_id", "speaker_id").agg(
        F.count(F.lit(1)).alias("segment_count"),
        count_if(F.col("speaker_status") == "failed").alias("speaker_failed"),
        count_if(F.col("overall_status") == "failed").alias("overall_failed"),
        count_if((F.col("audio_path") != "") & drift).alias("voice_mismatch_count"),
        F.max("reference_pitch_hz").alias("_ref"),
    )
    ratio = F.col("speaker_failed") / F.col("segment_count")
    return (
        out.withColumn("speaker_failed_ratio", ratio)
        .withColumn("risk_flags", flags(
            (F.col("_ref").isNull(), "reference_voice_unknown"),
            (ratio >= 0.2, "speaker_similarity_failed"),
            (F.col("voice_mismatch_count") > 0, "pitch_class_drift")))
        .withColumn("review_status", F.when(has(F.col("risk_flags"), "reference_voice_unknown") & (F.size("risk_flags") > 1), "blocked")
                    .when(F.size("risk_flags") > 0, "review").otherwise("passed"))
        .drop("_ref")
    )


def reference_metrics(attempts: DataFrame) -> DataFrame:
    """Attempt statistics per reference clip."""
    ratio = F.round(F.col("generated_ms") / F.col("source_ms"), 4)
    kinds = ("overall", "duration", "speaker", "intelligibility")
    return attempts.groupBy("media_id", "reference_path").agg(
        F.count(F.lit(1)).alias("attempt_count"),
        count_if(F.col("selected")).alias("selected_count"),
        *[count_if(F.col(f"{k}_status") == s).alias(f"{k}_{s}") for k in kinds for s in ("passed", "review", "failed")],
        F.avg("speaker_similarity").alias("avg_speaker_similarity"),
        F.avg("text_similarity").alias("avg_text_similarity"),
        F.percentile(ratio, 0.5).alias("median_duration_ratio"),
    )


def benchmark_score(metrics: DataFrame) -> DataFrame:
    """Observed-quality score of a reference, damped until eight attempts, then blended with its heuristic score."""
    def tier(kind: str) -> Column:
        passed, review, failed = (F.col(f"{kind}_{s}") for s in ("passed", "review", "failed"))
        total = passed + review + failed
        return F.when(total > 0, (passed + review * 0.55) / total).otherwise(0.0)

    raw = (
        tier("overall") * 0.26 + tier("duration") * 0.18 + tier("speaker") * 0.18 + tier("intelligibility") * 0.14
        + F.least(F.lit(1.0), F.coalesce("avg_speaker_similarity", F.lit(0.0)) / 0.45) * 0.14
        + F.coalesce("avg_text_similarity", F.lit(0.0)) * 0.10
    )
    weight = F.least(F.lit(0.62), 0.28 + F.col("attempt_count") * 0.035)
    return metrics.withColumn(
        "benchmark_score", F.when(F.col("attempt_count") > 0, raw * F.least(F.lit(1.0), F.col("attempt_count") / 8.0))
    ).withColumn(
        "quality_score",
        F.when(F.col("benchmark_score").isNull(), F.col("base_score")).otherwise(
            F.col("base_score") * (1.0 - weight) + F.col("benchmark_score") * weight),
    )


def recommended_reference(references: DataFrame) -> DataFrame:
    """Best clip per speaker: usable clips first, among them those with aligned text or a benchmark, then by quality."""
    risky = has(F.col("risk_flags"), "too_short_for_auto_clone", "too_long_for_auto_clone", "low_rms")
    aligned = ~has(F.col("risk_flags"), "composite_text_alignment_approx") | F.col("benchmark_score").isNotNull()
    tier = F.when(~risky & aligned, 0).when(~risky, 1).otherwise(2)
    quality = F.when(tier < 2, -F.coalesce("quality_score", F.lit(0.0))).otherwise(0.0)
    first = F.min(F.struct(tier.alias("tier"), quality.alias("q"), "ord", "reference_id"))
    return references.groupBy("media_id", "speaker_id").agg(first.alias("_m")).select(
        "media_id", "speaker_id", F.col("_m.reference_id").alias("reference_id"), F.col("_m.tier").alias("tier")
    )


# ---- reference scores --------------------------------------------------------------------------------------------


def _steps(value: Column, *steps: tuple[float, float], low: float) -> Column:
    """Step curve: the first threshold reached (descending) gives its score."""
    out = None
    for threshold, score in steps:
        out = F.when(value >= threshold, score) if out is None else out.when(value >= threshold, score)
    return out.otherwise(low)


def _band(value: Column, *bands: tuple[float, float, float], low: float) -> Column:
    out = None
    for lo, hi, score in bands:
        cond = value.between(lo, hi)
        out = F.when(cond, score) if out is None else out.when(cond, score)
    return out.otherwise(low)


# fixed values
LAUGHTER_WORDS = ("哈哈", "呵呵", "hahaha", "lol")
EMPHASIS_MARKS = "!！?？~"


def laughter(text: Column) -> Column:
    """Any of the laughter words, in any case."""
    low, found = F.lower(text), F.lit(False)
    for word in LAUGHTER_WORDS:
        found = found | F.contains(low, F.lit(word))
    return found


def synthesis_reference_score(seconds: Column, text: Column, rms: Column) -> Column:
    """Score used to pick a cloning reference (duration 0.5, text 0.3, rms 0.2, laughter -0.15)."""
    compact = F.length(F.regexp_replace(text, r"\s+", ""))
    duration = (
        F.when(seconds.between(8.0, 10.5), 1.0).when((seconds >= 5.0) & (seconds < 8.0), 0.7)
        .when((seconds > 10.5) & (seconds <= 12.0), 0.8)
        .when((seconds > 12.0) & (seconds <= 15.0), F.greatest(F.lit(0.1), 0.6 - (seconds - 12.0) * 0.18)).otherwise(0.0)
    )
    return (
        duration * 0.5
        + _steps(compact, (16, 1.0), (8, 0.8), (4, 0.55), low=0.2) * 0.3
        + _band(rms, (0.02, 0.25, 1.0), (0.01, 0.35, 0.7), (0.005, 0.5, 0.4), low=0.1) * 0.2
        - F.when(laughter(text), 0.15).otherwise(0.0)
    )


def reference_risks(seconds: Column, text: Column, rms: Column) -> Column:
    return flags(
        (seconds < 2.0, "too_short_for_auto_clone"),
        ((seconds >= 2.0) & (seconds < 5.0), "short_reference"),
        (seconds > 11.0, "long_reference_will_be_trimmed"),
        (seconds > 15.0, "too_long_for_auto_clone"),
        (rms <= 0.005, "low_rms"),
        (rms >= 0.45, "high_rms"),
        (text.rlike(f"[{EMPHASIS_MARKS}]{{2,}}") | laughter(text), "expressive_or_laughter"),
    )


def bank_reference_score(seconds: Column, text: Column, rms: Column, risks: Column) -> Column:
    """Heuristic voice-bank score (duration 0.42, text 0.28, rms 0.20, risk 0.10)."""
    compact = F.length(F.regexp_replace(text, r"\s+", ""))
    duration = (
        F.when(seconds.between(8.0, 10.5), 1.0).when((seconds >= 5.0) & (seconds < 8.0), 0.72)
        .when((seconds > 10.5) & (seconds <= 12.0), 0.86).when((seconds > 12.0) & (seconds <= 15.0), 0.66)
        .when((seconds >= 2.0) & (seconds < 5.0), 0.42).otherwise(0.1)
    )
    counted = F.size(F.array_remove(risks, "long_reference_will_be_trimmed"))
    total = (
        duration * 0.42
        + _steps(compact, (24, 1.0), (16, 0.86), (8, 0.66), (4, 0.42), low=0.15) * 0.28
        + _band(rms, (0.02, 0.22, 1.0), (0.01, 0.32, 0.76), (0.005, 0.45, 0.48), low=0.16) * 0.20
        + (1.0 - F.least(F.lit(0.45), counted * 0.08)) * 0.10
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def composite_members(references: DataFrame, top: int = 4, target_ms: int = 9_000, part_ms: int = 3_200,
                      gap_ms: int = 250) -> DataFrame:
    """Clips joined into one composite: the best four by score, taken until the target length is reached."""
    best = Window.partitionBy("media_id", "speaker_id").orderBy(F.desc("heuristic_score"), "ord")
    before = best.rowsBetween(Window.unboundedPreceding, -1)
    piece = F.least(F.col("dur_ms"), F.lit(part_ms))
    ranked = references.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    # audio so far = earlier pieces plus one gap between neighbours
    return (
        ranked.withColumn("_before", F.coalesce(F.sum(piece).over(before), F.lit(0))
                          + F.greatest(F.col("rank") - 2, F.lit(0)) * gap_ms)
        .filter(F.col("_before") < target_ms)
        .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("media_id", "speaker_id")))
        .filter("_n >= 2")
        .select("media_id", "speaker_id", "reference_id", "rank", piece.alias("piece_ms"))
    )


def bank_status(recommended: Column, reference_count: Column, speaker_id: Column, risks: Column) -> Column:
    return (
        F.when(speaker_id.isNull() | (speaker_id == ""), "needs_speaker_review")
        .when(reference_count == 0, "missing_reference").when(recommended.isNull(), "needs_manual_reference")
        .when(has(risks, "short_reference", "composite_text_alignment_approx"), "review").otherwise("available")
    )


# ---- picking speakers, segments and attempts -----------------------------------------------------------------------


def usable(dur_ms: Column, too_short: Column) -> Column:
    return dur_ms.between(1_000, 6_000) & ~too_short


def preferred(dur_ms: Column, too_short: Column, risky: Column) -> Column:
    return usable(dur_ms, too_short) & ~risky & dur_ms.between(1_500, 4_500)


def rank_speakers(lines: DataFrame, profiles: DataFrame) -> DataFrame:
    """Speakers with at least one usable line, ordered by usable, short, reference score, speech, id (all descending)."""
    dur, short_flag = F.col("end_ms") - F.col("start_ms"), F.col("too_short_flag")
    counts = lines.groupBy("media_id", "speaker_id").agg(
        count_if(usable(dur, short_flag)).alias("usable_count"),
        count_if(dur.between(1_000, 4_000) & ~short_flag).alias("short_count"),
    )
    order = Window.partitionBy("media_id").orderBy(
        F.desc("usable_count"), F.desc("short_count"), F.desc("reference_score"), F.desc("total_ms"), F.desc("speaker_id")
    )
    return (
        profiles.filter("cloneable").join(counts.filter("usable_count > 0"), ["media_id", "speaker_id"])
        .withColumn("rank", F.row_number().over(order))
    )


def pick_lines(lines: DataFrame, limit: int) -> DataFrame:
    """First `limit` lines per speaker: preferred lines first, then usable, then any, each by (start, id)."""
    dur = F.col("end_ms") - F.col("start_ms")
    tier = F.when(preferred(dur, F.col("too_short_flag"), F.col("duration_risky")), 0).when(
        usable(dur, F.col("too_short_flag")), 1).otherwise(2)
    order = Window.partitionBy("media_id", "speaker_id").orderBy("tier", "start_ms", "segment_id")
    return lines.withColumn("tier", tier).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def first_lines(lines: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("media_id", "speaker_id").orderBy("start_ms", "segment_id")
    return lines.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def best_attempts(attempts: DataFrame) -> DataFrame:
    """Highest weighted status score per line; the first attempt wins a tie."""
    score = attempt_score(F.col("generated_ms") / F.col("source_ms"))
    best = F.max_by(F.struct("attempt_id", score.alias("score")), F.struct(score, -F.col("attempt_no")))
    return attempts.groupBy("media_id", "segment_id").agg(best.alias("_b")).select(
        "media_id", "segment_id", F.col("_b.attempt_id").alias("attempt_id"), F.col("_b.score").alias("score")
    )


def select_repairs(attempts: DataFrame, baselines: DataFrame, min_gain: float = 0.05) -> DataFrame:
    """Best accepted candidate per line, or NULL when it does not beat the incumbent by `min_gain`."""
    worse = F.coalesce(lookup(F.col("overall_status"), {"passed": 0, "review": 1, "failed": 2}), F.lit(3))
    score = baseline_score(F.col("generated_ms") / F.col("source_ms"))
    best = F.max_by(F.struct("attempt_id", score.alias("score")), F.struct(score, -worse, -F.col("attempt_no")))
    winners = (
        attempts.filter(F.col("strict_accepted") & (F.col("status") == "candidate"))
        .groupBy("media_id", "segment_id").agg(best.alias("_b"))
    )
    keeps = F.col("_b.score") >= F.col("baseline_score") + min_gain
    return baselines.join(winners, ["media_id", "segment_id"], "left").select(
        "media_id", "segment_id", "baseline_score", F.when(keeps, F.col("_b.attempt_id")).alias("selected_attempt_id")
    )
