"""Dub quality: row universe, issue tags, summaries, scorecard, gates and remediation.

Rows come from a render report (media_id, segment_id, placed, statuses, similarities, *_ms) and a translation table.
Lists of segment ids are never collected: where the result names segments it is one row per segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions.cols import count_if, flags, has, lookup, safe_div

# fixed values
DROPOUT_RATIO = 0.34
DROPOUT_MIN_TOKENS = 4
INAUDIBLE_COVERAGE = 0.5
SEVERE_OVERFLOW = 1.45
JUDGE_FAIL = 3.0
ISSUE_SEVERITY = {
    "undubbed": 3, "timbre_mismatch": 2, "low_intelligibility": 2, "dropout": 2, "inaudible": 2, "bad_translation": 2,
    "pacing": 1,
}
SEVERITY_NAMES = {3: "P0", 2: "P1", 1: "P2", 0: "ok"}
ISSUES = tuple(ISSUE_SEVERITY)
GATE_ISSUES = {
    "coverage": ["inaudible", "undubbed"],
    "undubbed_coverage": ["undubbed"],
    "speaker_consistency": ["timbre_mismatch"],
    "character_voice": ["timbre_mismatch"],
    "repair_tournament": [],
}
ACTION_EXECUTOR = {
    "rewrite_translation": "repair", "resynthesize": "repair", "switch_voice": "repair", "switch_tts_backend": "repair",
    "refit_timeline": "render", "retranslate": "rerun", "fill_undubbed": "rerun", "manual_review": "manual",
}
REPAIR_ACTION = {
    "rewrite_translation": "rewrite_for_dubbing", "resynthesize": "regenerate_candidates",
    "switch_voice": "switch_reference_audio", "switch_tts_backend": "switch_tts_backend",
}
AUTO_ACTIONS = ("rewrite_translation", "resynthesize", "switch_voice", "switch_tts_backend", "refit_timeline")
STATUS_COLUMNS = ("overall_status", "duration_status", "speaker_status", "intelligibility_status", "mix_status")

SEGMENT = ["media_id", "segment_id"]


def duration_ratio() -> Column:
    return safe_div(F.col("generated_ms"), F.col("source_ms"))


def universe(report: DataFrame, translations: DataFrame) -> DataFrame:
    """Every translated line plus everything rendered."""
    return with_translations(rendered(report), translations)


def rendered(report: DataFrame) -> DataFrame:
    """One row per line: a placed row beats a skipped one, then the earliest and shortest wins."""
    best = Window.partitionBy(*SEGMENT).orderBy(F.col("placed").desc(), *[F.col(c) for c in ("start_ms", "generated_ms", "speaker_id", "audio_path") if c in report.columns])
    return report.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")


def with_translations(rows: DataFrame, translations: DataFrame) -> DataFrame:
    """Rendered rows with their translated lines; a line that was never rendered is a synthetic undubbed row.

    Join what is known per rendered line before this step: a full join's rows are no longer dealt by line, so each join behind it
    would shuffle them all again.
    """
    tr = translations.select(
        *SEGMENT, F.col("source_text"), F.col("target_text").alias("_t_target"), F.col("speaker_label").alias("_t_label"),
        F.col("start_ms").alias("_t_start"), F.col("end_ms").alias("_t_end"),
    )
    joined = rows.withColumn("_seen", F.lit(True)).join(tr, SEGMENT, "full_outer")
    if "backread_text" in rows.columns:
        joined = joined.withColumn("backread_text", F.coalesce("backread_text", F.lit("")))
    return (
        joined.withColumn("placed", F.coalesce("placed", F.lit(False)))
        .withColumn("mix_status", F.when(F.col("_seen"), F.col("mix_status")).otherwise("not_synthesized"))
        .withColumn("speaker_id", F.coalesce("speaker_id", "_t_label"))
        .withColumn("target_text", F.coalesce(F.nullif("target_text", F.lit("")), "_t_target", F.lit("")))
        .withColumn("source_text", F.coalesce("source_text", F.lit("")))
        .withColumn("start_ms", F.coalesce("start_ms", "_t_start"))
        .withColumn("end_ms", F.col("_t_end"))
        .drop("_seen", "_t_target", "_t_label", "_t_start", "_t_end")
    )


def first_backread(attempt_reads: DataFrame) -> DataFrame:
    """First non-empty read-back per line in report order."""
    text = F.trim("backread_text")
    return (
        attempt_reads.filter(text != "")
        .groupBy(*SEGMENT)
        .agg(F.min(F.struct("report_ord", text.alias("t"))).alias("_m"))
        .select(*SEGMENT, F.col("_m.t").alias("backread_text"))
    )


def enrich(rows: DataFrame, backreads: DataFrame, judge: DataFrame) -> DataFrame:
    """Left-join the read-back and the judge score; a line without a read-back keeps an empty text."""
    return (
        rows.join(backreads, SEGMENT, "left")
        .withColumn("backread_text", F.coalesce("backread_text", F.lit("")))
        .join(judge, SEGMENT, "left")
    )


def override_selected(rows: DataFrame, selected: DataFrame) -> DataFrame:
    """A selected repair replaces field by field; the two similarities are replaced even by NULL."""
    keep = ("speaker_id", "target_text", "generated_ms", "duration_status", "speaker_status", "intelligibility_status",
            "overall_status", "audio_path")
    hard = ("speaker_similarity", "text_similarity")
    right = selected.filter(F.nullif("audio_path", F.lit("")).isNotNull()).select(
        *SEGMENT, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_s_{c}") for c in keep + hard]
    )
    out = rows.join(right, SEGMENT, "left")
    kinds = dict(rows.dtypes)
    for name in keep:
        fresh = F.col(f"_s_{name}")
        blank = fresh == "" if kinds[name] == "string" else fresh == 0
        out = out.withColumn(name, F.coalesce(F.when(~blank, fresh), F.col(name)))
    for name in hard:
        out = out.withColumn(name, F.when(F.col("_hit"), F.col(f"_s_{name}")).otherwise(F.col(name)))
    return out.drop("_hit", *[f"_s_{c}" for c in keep + hard])


def issue_tags() -> Column:
    placed = F.col("placed")
    ratio = duration_ratio()
    severe = F.coalesce(ratio >= SEVERE_OVERFLOW, F.lit(False)) | F.coalesce(
        F.col("fit_strategy") == "overflow_unfitted", F.lit(False)
    )
    dropped = (F.col("dropout_total") >= DROPOUT_MIN_TOKENS) & (
        F.col("dropout_count") >= DROPOUT_RATIO * F.col("dropout_total")
    )
    return flags(
        (~placed & ((F.col("source_text") != "") | (F.col("target_text") != "")), "undubbed"),
        (placed & (F.col("speaker_status") == "failed"), "timbre_mismatch"),
        (placed & (F.col("intelligibility_status") == "failed"), "low_intelligibility"),
        (placed & (F.col("backread_text") != "") & dropped, "dropout"),
        (placed & (F.coalesce(F.col("duration_status") == "failed", F.lit(False)) | severe), "pacing"),
        (placed & (F.col("coverage") < INAUDIBLE_COVERAGE), "inaudible"),
        (F.col("judge_score") < JUDGE_FAIL, "bad_translation"),
    )


def severity_rank(tags: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(tags, lambda t: lookup(t, ISSUE_SEVERITY, 1))), F.lit(0))


def tag_rows(rows: DataFrame) -> DataFrame:
    return (
        rows.withColumn("issue_tags", issue_tags())
        .withColumn("severity_rank", severity_rank(F.col("issue_tags")))
        .withColumn("severity", lookup(F.col("severity_rank"), SEVERITY_NAMES))
    )


def qa_summary(rows: DataFrame) -> DataFrame:
    """Counts per issue and severity, coverage, dropout mean, judge stats and timeline pressure, one row per media."""
    ratio = duration_ratio()
    placed = F.col("placed")
    unfitted = placed & (F.col("fit_strategy") == "overflow_unfitted")
    cut = F.greatest(F.lit(0), F.col("generated_ms") - F.col("fitted_ms"))
    trimmed = unfitted & (F.col("trimmed_tail_ms") > 0)
    measured = F.col("dropout_total") >= DROPOUT_MIN_TOKENS
    out = rows.groupBy("media_id").agg(
        F.count(F.lit(1)).alias("segment_count"),
        count_if(F.size("issue_tags") > 0).alias("problem_segment_count"),
        *[count_if(F.array_contains("issue_tags", t)).alias(f"n_{t}") for t in ISSUES],
        *[count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("P0", "P1", "P2", "ok")],
        count_if(placed).alias("dubbed_count"),
        F.avg(F.when(measured, F.col("dropout_count") / F.col("dropout_total"))).alias("dropout_avg"),
        F.count("judge_score").alias("judge_scored"),
        F.avg("judge_score").alias("judge_avg"),
        F.min("judge_score").alias("judge_min"),
        count_if(placed & (ratio > 1)).alias("overflow_count"),
        count_if(placed & (ratio >= SEVERE_OVERFLOW)).alias("severe_overflow_count"),
        count_if(unfitted).alias("unfitted_count"),
        F.max(F.when(placed & (ratio > 1), ratio)).alias("max_ratio"),
        F.avg(F.when(placed & (ratio > 1), ratio)).alias("avg_overflow_ratio"),
        F.coalesce(F.sum(F.when(unfitted, cut)), F.lit(0)).alias("cut_audio_ms"),
        F.coalesce(F.sum(F.when(trimmed & (F.col("trimmed_speech_ms") > 0), F.col("trimmed_speech_ms"))), F.lit(0))
        .alias("lost_speech_ms"),
        count_if(trimmed & (F.coalesce("trimmed_speech_ms", F.lit(0)) <= 0)).alias("silence_only_trims"),
    )
    return out.withColumn("undubbed_count", F.col("segment_count") - F.col("dubbed_count")).withColumn(
        "perceptual_score", perceptual_score()
    )


def perceptual_score() -> Column:
    n = F.col("segment_count")
    cut = F.least(F.lit(40.0), F.col("cut_audio_ms") / 1000)
    severe = F.least(F.lit(35.0), F.col("severe_overflow_count") / n * 60.0)
    undubbed = F.least(F.lit(25.0), F.col("undubbed_count") / n * 60.0)
    return F.when(n <= 0, 100.0).otherwise(F.greatest(F.lit(0.0), 100.0 - cut - severe - undubbed))


# ---- render report rollups -------------------------------------------------------------------------------------


def status_counts(report: DataFrame, columns: tuple[str, ...] = STATUS_COLUMNS) -> DataFrame:
    """(media, status column, value, count) for every status column in one pass."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("field"), F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown")).alias("value")) for c in columns]
    )
    return (
        report.select("media_id", F.explode(pairs).alias("p"))
        .groupBy("media_id", F.col("p.field").alias("field"), F.col("p.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def quality_averages(report: DataFrame) -> DataFrame:
    ratio = duration_ratio()
    values = {"speaker_similarity": F.col("speaker_similarity"), "text_similarity": F.col("text_similarity"),
              "duration_ratio": F.round(ratio, 4), "quality_score": F.col("quality_score")}
    # medians run on values of at most four decimals, so the percentile buffer is bounded by their distinct count
    return report.groupBy("media_id").agg(
        F.count(F.lit(1)).alias("total_count"),
        *[F.avg(v).alias(f"avg_{k}") for k, v in values.items() if k != "duration_ratio"],
        F.avg(ratio).alias("avg_duration_ratio"),
        *[F.percentile(v, 0.5).alias(f"median_{k}") for k, v in values.items() if k != "duration_ratio"],
    )


def token_counts(report: DataFrame, column: str) -> DataFrame:
    return (
        report.select("media_id", F.explode(column).alias("token"))
        .groupBy("media_id", "token")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .withColumn("rank", F.row_number().over(Window.partitionBy("media_id").orderBy(F.desc("cnt"), "token")))
    )


def failure_combinations(report: DataFrame) -> DataFrame:
    parts = F.concat_ws(
        "+",
        F.when(F.col("duration_status") == "failed", "duration"),
        F.when(F.col("speaker_status") == "failed", "speaker"),
        F.when(F.col("intelligibility_status") == "failed", "intelligibility"),
    )
    reason = F.when(parts == "", "overall").otherwise(parts)
    return (
        report.filter(F.col("overall_status") == "failed")
        .groupBy("media_id", reason.alias("reason"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def _audible() -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("coverage", F.lit(0.0))))


def audible_coverage(report: DataFrame) -> DataFrame:
    rows = report.filter("has_window").withColumn("_c", _audible())
    return rows.groupBy("media_id").agg(
        F.count(F.lit(1)).alias("window_count"),
        count_if(F.col("_c") < INAUDIBLE_COVERAGE).alias("failed_count"),
        F.min("_c").alias("min_coverage"),
        F.avg("_c").alias("avg_coverage"),
    )


def audible_failures(report: DataFrame) -> DataFrame:
    return report.filter(F.col("has_window") & (_audible() < INAUDIBLE_COVERAGE)).select(*SEGMENT)


def mix_counts(report: DataFrame) -> DataFrame:
    """Fit strategies of placed rows and skip reasons of skipped rows."""
    kind = F.when(F.col("placed"), "fit_strategy").otherwise("skip_reason")
    value = F.when(F.col("placed"), F.coalesce(F.nullif("fit_strategy", F.lit("")), F.lit("unknown"))).otherwise(
        F.coalesce(F.nullif("mix_status", F.lit("")), F.lit("skipped"))
    )
    return report.groupBy("media_id", kind.alias("kind"), value.alias("value")).agg(F.count(F.lit(1)).alias("cnt"))


def content_quality(report: DataFrame) -> DataFrame:
    agg = report.groupBy("media_id").agg(
        F.count(F.lit(1)).alias("total_count"),
        count_if(F.col("placed")).alias("placed_count"),
        *[count_if(F.col(f"{k}_status") == "failed").alias(f"{k}_failed") for k in ("overall", "speaker", "intelligibility")],
        count_if(F.col("has_window") & (_audible() < INAUDIBLE_COVERAGE)).alias("audible_failed"),
    )
    n = F.col("total_count")
    skipped = n - F.col("placed_count")
    reasons = flags(
        (n == 0, "no_renderable_segments"),
        ((skipped > 0) | (F.col("placed_count") < 0.98 * n), "coverage_below_deliverable_threshold"),
        (F.col("overall_failed") / n > 0.05, "upstream_failed_segments"),
        (F.col("speaker_failed") / n > 0.10, "speaker_similarity_failed"),
        (F.col("intelligibility_failed") / n > 0.10, "intelligibility_failed"),
        (F.col("audible_failed") > 0, "audible_coverage_failed"),
    )
    status = (
        F.when((n == 0) | (skipped > n * 0.20) | (F.col("audible_failed") > 0), "blocked")
        .when(F.size("reasons") > 0, "review_required")
        .otherwise("deliverable")
    )
    return agg.withColumn("reasons", reasons).withColumn("status", status)


# ---- scorecard -----------------------------------------------------------------------------------------------


def scorecard_metrics(report: DataFrame, characters: DataFrame, manual: DataFrame) -> DataFrame:
    base = report.groupBy("media_id").agg(
        F.count(F.lit(1)).alias("total_count"),
        count_if(F.col("placed")).alias("placed_count"),
        count_if(F.col("has_window") & (_audible() < INAUDIBLE_COVERAGE)).alias("audible_failed"),
        *[count_if(F.col(f"{k}_status") == "failed").alias(f"{k}_failed") for k in ("overall", "speaker", "intelligibility")],
    )
    chars = characters.groupBy("media_id").agg(
        count_if(F.col("review_status") == "review").alias("char_review"),
        count_if(F.col("review_status") == "blocked").alias("char_blocked"),
        F.sum("voice_mismatch_count").alias("voice_mismatch"),
    )
    todo = manual.groupBy("media_id").agg(F.count(F.lit(1)).alias("manual_required"))
    out = base.join(chars, "media_id", "left").join(todo, "media_id", "left")
    return out.fillna(0, ["char_review", "char_blocked", "voice_mismatch", "manual_required"])


def _ratio(name: str) -> Column:
    return F.col(name) / F.greatest(F.col("total_count"), F.lit(1))


def scorecard(metrics: DataFrame) -> DataFrame:
    n, coverage = F.col("total_count"), _ratio("placed_count")
    reasons = flags(
        (n <= 0, "no_rendered_segments"),
        (coverage < 0.98, "coverage_below_deliverable_threshold"),
        (F.col("audible_failed") > 0, "audible_coverage_failed"),
        (_ratio("overall_failed") > 0.05, "upstream_failed_segments"),
        (_ratio("speaker_failed") > 0.15, "speaker_similarity_failed"),
        (_ratio("intelligibility_failed") > 0.10, "intelligibility_failed"),
        (F.col("char_blocked") > 0, "character_voice_blocked"),
        ((F.col("char_review") > 0) | (F.col("voice_mismatch") > 0), "character_voice_review_required"),
        (F.col("manual_required") > 0, "repair_manual_required"),
    )
    blocked = (n <= 0) | (coverage < 0.98) | (F.col("audible_failed") > 0) | (F.col("char_blocked") > 0)
    penalty = (
        F.greatest(F.lit(0.0), 1.0 - coverage) * 60.0
        + F.least(F.lit(30.0), F.col("audible_failed") * 10.0)
        + _ratio("overall_failed") * 20.0
        + _ratio("speaker_failed") * 25.0
        + _ratio("intelligibility_failed") * 25.0
        + F.least(F.lit(20.0), F.col("char_review") * 4.0)
        + F.least(F.lit(25.0), F.col("char_blocked") * 10.0)
        + F.least(F.lit(20.0), F.col("voice_mismatch") * 5.0)
        + F.least(F.lit(15.0), F.col("manual_required") * 3.0)
    )
    return (
        metrics.withColumn("reasons", reasons)
        .withColumn("status", F.when(blocked, "blocked").when(F.size("reasons") > 0, "review_required")
                    .otherwise("deliverable_candidate"))
        .withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - penalty)))
    )


def gates(metrics: DataFrame) -> DataFrame:
    """Five delivery gates per media, one row each."""
    coverage = _ratio("placed_count")
    rows = [
        ("coverage", F.when((coverage >= 0.98) & (F.col("audible_failed") == 0), "passed").otherwise("failed"), coverage),
        ("speaker_consistency", F.when(_ratio("speaker_failed") <= 0.15, "passed").otherwise("review"), _ratio("speaker_failed")),
        ("character_voice", F.when(F.col("char_blocked") > 0, "failed").when(F.col("char_review") > 0, "review")
         .otherwise("passed"), F.col("char_review").cast("double")),
        ("repair_tournament", F.when(F.col("manual_required") > 0, "review").otherwise("passed"),
         F.col("manual_required").cast("double")),
        ("undubbed_coverage", F.when(F.col("total_count") == F.col("placed_count"), "passed").otherwise("failed"),
         (F.col("total_count") - F.col("placed_count")).cast("double")),
    ]
    structs = F.array(*[F.struct(F.lit(g).alias("gate"), s.alias("gate_status"), v.alias("gate_value")) for g, s, v in rows])
    return metrics.select("media_id", F.inline(structs))


# ---- remediation ----------------------------------------------------------------------------------------------


def directives(rows: DataFrame) -> DataFrame:
    """One primary action per problem segment."""
    tags, ratio = F.col("issue_tags"), duration_ratio()
    action = (
        F.when(has(tags, "undubbed"), "fill_undubbed")
        .when(has(tags, "inaudible"), "refit_timeline")
        .when(has(tags, "timbre_mismatch"), "switch_voice")
        .when(has(tags, "dropout", "low_intelligibility"), "resynthesize")
        .when(has(tags, "pacing") & (F.coalesce(F.col("fit_strategy") == "overflow_unfitted", F.lit(False))
                                     | F.coalesce(ratio > 1.3, F.lit(False))), "rewrite_translation")
        .when(has(tags, "pacing"), "refit_timeline")
        .when(has(tags, "bad_translation"), "retranslate")
        .otherwise("manual_review")
    )
    return (
        rows.filter(F.size("issue_tags") > 0)
        .withColumn("action", action)
        .withColumn("executor", lookup(F.col("action"), ACTION_EXECUTOR))
        .withColumn("repair_action", lookup(F.col("action"), REPAIR_ACTION))
        .withColumn("auto_fixable", F.col("action").isin(*AUTO_ACTIONS))
        .withColumn("gain", F.col("severity_rank"))
    )


def remediation_rollup(found: DataFrame) -> DataFrame:
    grouped = found.groupBy("media_id", "action", "executor", "auto_fixable").agg(
        F.count(F.lit(1)).alias("cnt"), F.sum("gain").alias("total_gain")
    )
    order = Window.partitionBy("media_id").orderBy(
        F.desc("auto_fixable"), F.desc("total_gain"), F.desc("cnt"), "action"
    )
    return grouped.withColumn("rank", F.row_number().over(order)).withColumn("next_best", F.col("rank") <= 3)


def delivery_blockers(gate_rows: DataFrame, found: DataFrame) -> DataFrame:
    """Failed / review gates with the number of segments whose defects cause them; gates without one stay."""
    issue_of = F.create_map(
        *[x for g, issues in GATE_ISSUES.items()
          for x in (F.lit(g), F.array(*[F.lit(i) for i in issues]) if issues else F.array().cast("array<string>"))]
    )
    open_gates = gate_rows.filter(F.col("gate_status").isin("failed", "review")).withColumn("_issues", issue_of[F.col("gate")])
    per_issue = found.groupBy("media_id").agg(
        *[count_if(has(F.col("issue_tags"), *issues)).alias(f"_n_{g}") for g, issues in GATE_ISSUES.items() if issues]
    )
    hit = lookup(F.col("gate"), {g: g for g in GATE_ISSUES})
    count = F.lit(0).cast("long")
    for g, issues in GATE_ISSUES.items():
        if issues:
            count = F.when(hit == g, F.coalesce(F.col(f"_n_{g}"), F.lit(0))).otherwise(count)
    return open_gates.join(per_issue, "media_id", "left").select("media_id", "gate", "gate_status", count.alias("cnt"))


def blocker_segments(gate_rows: DataFrame, found: DataFrame) -> DataFrame:
    """(gate, segment) pairs behind the blockers, one row per pair instead of a collected list."""
    causes = F.array(
        *[F.struct(F.lit(g).alias("gate"), has(F.col("issue_tags"), *i).alias("hit")) for g, i in GATE_ISSUES.items() if i]
    )
    pairs = found.select(*SEGMENT, F.inline(causes)).filter("hit").drop("hit")
    return pairs.join(gate_rows.filter(F.col("gate_status").isin("failed", "review")).select("media_id", "gate"),
                      ["media_id", "gate"])
