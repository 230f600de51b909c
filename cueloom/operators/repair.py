"""Repair planning: failure reasons, suggested actions, queue order, attempt grid, reference plans and round acceptance."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions.cols import count_if, flags
from cueloom.operators import sequence as seq

SEGMENT = ["media_id", "segment_id"]


def reason_rules() -> dict[str, Column]:
    """Failure reasons in rule order as plain conditions; a NULL ratio counts as zero (neither too long nor too short)."""
    r = F.coalesce("ratio", F.lit(0.0))
    source = F.coalesce(F.nullif("source_ms", F.lit(0)), F.col("line_ms"), F.lit(0))
    return {
        "task_d_overall_failed": F.col("overall_status") == "failed",
        "duration_failed": F.col("duration_status") == "failed",
        "speaker_failed": F.col("speaker_status") == "failed",
        "intelligibility_failed": F.col("intelligibility_status") == "failed",
        "too_short_source": (source < 1_200) | F.coalesce("too_short_flag", F.lit(False)),
        "generated_too_long": r > 1.65,
        "generated_too_short": (r > 0) & (r < 0.55),
        "missing_audio_path": F.coalesce("audio_path", F.lit("")) == "",
    }


def suggested_actions(on: dict[str, Column]) -> Column:
    """Actions from the reason conditions; a row the quality check forced in tries the whole tournament."""
    rewrite, flagged = on["duration_failed"] | on["intelligibility_failed"], on["qa_flagged"]
    listed = flags(
        (on["too_short_source"] & on["duration_failed"], "merge_short_segments"),
        (rewrite, "rewrite_for_dubbing"),
        (rewrite | flagged, "regenerate_candidates"),
        (flagged, "rewrite_for_dubbing"),
        (on["speaker_failed"] | flagged, "switch_reference_audio"),
        (on["duration_failed"] & on["speaker_failed"] & on["intelligibility_failed"], "switch_tts_backend"),
        (on["missing_audio_path"], "manual_review"),
    )
    quiet = ~(rewrite | flagged | on["speaker_failed"] | on["missing_audio_path"])
    return F.when(quiet, F.array(F.lit("manual_review"))).otherwise(listed)


def priority_tenths(on: dict[str, Column]) -> Column:
    """Priority score in tenths (exact integers)."""
    r = F.coalesce("ratio", F.lit(0.0))
    weights = {"duration_failed": 15, "speaker_failed": 14, "intelligibility_failed": 14, "too_short_source": 7, "qa_flagged": 8}
    total = F.when((r >= 2.5) | ((r > 0) & (r <= 0.35)), 14).otherwise(0)
    for name, weight in weights.items():
        total = total + F.when(on[name], weight).otherwise(0)
    return total


def repair_items(report: DataFrame, translations: DataFrame, forced: DataFrame) -> DataFrame:
    """Report rows that need repair, plus rows the quality check forces in as `qa_flagged`."""
    lines = translations.select(*SEGMENT, (F.col("end_ms") - F.col("start_ms")).alias("line_ms"), "source_text", "too_short_flag")
    rules = reason_rules()
    # what the report alone tells is settled before the joins, so that its statuses, times and paths need not be shuffled with it
    early = {f"_{name}": F.coalesce(cond, F.lit(False)) for name, cond in rules.items() if name != "too_short_source"}
    told = report.withColumn("ratio", F.round(F.col("generated_ms") / F.col("source_ms"), 6)).withColumns({**early, "_told": reduce(or_, early.values())})
    known = {name: F.col(f"_{name}") if f"_{name}" in early else F.coalesce(cond, F.lit(False)) for name, cond in rules.items()}
    anything = F.col("_told") | known["too_short_source"]
    on = {**known, "qa_flagged": ~anything}
    rows = (
        told.join(lines, SEGMENT, "left")
        .join(forced.select(*SEGMENT).distinct().withColumn("_forced", F.lit(True)), SEGMENT, "left")
        .filter(anything | F.coalesce("_forced", F.lit(False)))
    )
    priority = priority_tenths(on)
    return rows.withColumns({
        "reasons": flags(*[(cond, name) for name, cond in on.items()]),
        "strict_blocker": on["task_d_overall_failed"] | on["missing_audio_path"],
        "actions": suggested_actions(on),
        "may_rewrite": on["duration_failed"] | on["intelligibility_failed"] | on["qa_flagged"],
        "switches_reference": on["speaker_failed"] | on["qa_flagged"],
        "speaker_failed": on["speaker_failed"],
        "priority_tenths": priority,
        "priority": F.when(priority >= 50, "high").when(priority >= 30, "medium").otherwise("low"),
    }).drop("_forced", "_told", *early)


def queue(items: DataFrame, id_prefix: int = 4) -> DataFrame:
    """Queue position per media: strict blockers first, priority descending, id; slots keep one huge media splittable."""
    ranked = items.withColumn("_late", F.when(F.col("strict_blocker"), 0).otherwise(1)).withColumn(
        "_prio", -F.col("priority_tenths"))
    slot = F.struct("_late", "_prio", F.substring("segment_id", 1, id_prefix))
    return seq.positions(ranked, ["media_id"], ["_late", "_prio", "segment_id"], slot, "queue_pos").drop("_late", "_prio")


def choose_items(queued: DataFrame, include_risk: bool, allowed: DataFrame | None = None, max_items: int | None = None) -> DataFrame:
    rows = queued if include_risk else queued.filter("strict_blocker")
    if allowed is not None:
        rows = rows.join(allowed.select(*SEGMENT).distinct(), SEGMENT, "left_semi")
    if max_items is not None:
        order = Window.partitionBy("media_id").orderBy("queue_pos")
        rows = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max_items)
    return rows


def repair_stats(items: DataFrame) -> DataFrame:
    """Long (media, kind, name, count) rows over priorities, queue classes, reasons and actions."""
    kinds = F.concat(
        F.array(F.struct(F.lit("priority").alias("kind"), F.col("priority").alias("name")),
                F.struct(F.lit("queue_class").alias("kind"),
                         F.when(F.col("strict_blocker"), "strict_blocker").otherwise("risk_only").alias("name"))),
        F.transform("reasons", lambda r: F.struct(F.lit("reason").alias("kind"), r.alias("name"))),
        F.transform("actions", lambda a: F.struct(F.lit("action").alias("kind"), a.alias("name"))),
    )
    return items.select("media_id", F.inline(kinds)).groupBy("media_id", "kind", "name").agg(F.count(F.lit(1)).alias("cnt"))


def attempt_stats(results: DataFrame) -> DataFrame:
    return results.groupBy("media_id").agg(
        F.count(F.lit(1)).alias("input_count"), F.sum("attempt_count").alias("attempt_count"),
        count_if(F.col("selected_attempt_id").isNotNull()).alias("selected_count"),
        count_if(F.col("selected_attempt_id").isNull()).alias("manual_required_count"),
    )


def dedupe_first(rows: DataFrame, group: list[str], key: str, order: str) -> DataFrame:
    """Keep the first row per key of a group (order-preserving dedupe) and rank these in `_rank`, from 1; rows whose key is NULL go."""
    ahead = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col(key).isNotNull() & ~F.array_contains(F.collect_set(key).over(ahead), F.col(key))
    marked = rows.withColumn("_first", F.coalesce(first, F.lit(False)))
    upto = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("_rank", F.count(F.when(F.col("_first"), 1)).over(upto)).filter("_first").drop("_first")


def reference_choices(asks: DataFrame, references: DataFrame, per_item: int) -> DataFrame:
    """`refs`: the first `per_item` clips for every (media, speaker, clip in use): recommended first, then the clip in use, then the rest in rank order."""
    ask = ["media_id", "speaker_id", "reference_path"]
    by_speaker = Window.partitionBy("media_id", "speaker_id").orderBy("ref_rank")
    leading = references.withColumn("_rn", F.row_number().over(by_speaker)).filter(
        (F.col("_rn") <= per_item) | F.col("recommended")).drop("_rn")
    in_use = references.withColumn("reference_path", F.col("path"))
    paired = (
        asks.join(leading, ["media_id", "speaker_id"])
        .unionByName(asks.join(in_use, ask))
        .dropDuplicates([*ask, "path"])
        .withColumn("_tier", F.when(F.col("recommended"), 0).when(F.col("path") == F.col("reference_path"), 1).otherwise(2))
    )
    by_tier = Window.partitionBy(*ask).orderBy("_tier", "ref_rank")
    leading = paired.withColumn("ref_order", F.row_number().over(by_tier)).filter(F.col("ref_order") <= per_item)
    return leading.groupBy(*ask).agg(F.array_sort(F.collect_list(F.struct("_tier", "ref_rank", "path"))).alias("refs"))


def attempt_grid(items: DataFrame, rewrites: DataFrame, references: DataFrame, backends: list[str], per_item: int) -> DataFrame:
    """First `per_item` distinct (text, reference, backend) combinations per item, texts outermost.

    Clips are ranked and cut for each (media, speaker, clip in use) that items have, not for each item; an item fetches its few in one exchange
    and meets its texts in another.  The grid of a line is made in its rows: at most `per_item` texts and as many clips.
    """
    choices = reference_choices(items.select("media_id", "speaker_id", "reference_path").distinct(), references, per_item)
    known = items.filter("media_id IS NOT NULL AND segment_id IS NOT NULL")
    asked = choices.select(*[F.col(c).alias(f"_{c}") for c in choices.columns])
    mine = (known["media_id"] == asked["_media_id"]) & (known["speaker_id"] == asked["_speaker_id"]) & known["reference_path"].eqNullSafe(asked["_reference_path"])
    current = known.join(asked, mine, "left").select(
        *SEGMENT, F.lit(1_000_000).alias("ord"), F.trim("target_text").alias("text"), F.lit("current").alias("variant"), "may_rewrite", F.col("_refs").alias("refs"))
    others = rewrites.filter("media_id IS NOT NULL AND segment_id IS NOT NULL").select(*SEGMENT, "ord", F.trim("rewrite_text").alias("text"), "variant")
    rows = current.withColumn("_own", F.lit(True)).unionByName(others.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    # all windows of a line share one sort; a line listed twice may know several clips in use
    line = Window.partitionBy(*SEGMENT).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"may_rewrite": F.max("may_rewrite").over(line), "refs": F.collect_set("refs").over(line)}).filter("size(refs) > 0")
    rows = rows.withColumn("_fold", F.when(F.expr("(_own OR may_rewrite) AND text <> ''"), F.lower("text")))
    texts = dedupe_first(rows, SEGMENT, "_fold", "ord").withColumn("text_rank", F.col("_rank").cast("int")).filter(F.col("text_rank") <= per_item)
    listed = texts.withColumn("refs", F.when(F.size("refs") == 1, F.col("refs")[0]).otherwise(F.array_sort(F.array_distinct(F.flatten("refs")))))
    unlike = F.filter("refs", lambda r, i: ~F.exists(F.slice("refs", 1, i), lambda q: q["path"].eqNullSafe(r["path"])))
    listed = listed.withColumn("refs", F.transform(F.slice(unlike, 1, per_item), lambda r: r["path"]))
    before = (F.col("text_rank") - 1) * F.size("refs") * len(backends)
    paired = listed.withColumn("_before", before).filter(F.col("_before") < per_item).select(
        *SEGMENT, "text", "variant", "text_rank", "_before", F.posexplode("refs").alias("ref_order", "path"))
    grid = paired.select(
        *SEGMENT, "text", "variant", "path", "text_rank", (F.col("ref_order") + 1).alias("ref_order"), "_before",
        F.posexplode(F.array(*[F.lit(b) for b in backends])).alias("backend_rank", "backend"),
    )
    number = F.col("_before") + (F.col("ref_order") - 1) * len(backends) + F.col("backend_rank") + 1
    return grid.withColumn("attempt_no", number.cast("int")).drop("_before").filter(F.col("attempt_no") <= per_item)


def reference_plans(items: DataFrame, references: DataFrame, current: DataFrame) -> DataFrame:
    """Per speaker with a queued reference switch: best clip, or the best alternative when the best is in use."""
    queued = (
        items.filter(F.col("switches_reference") & (F.col("speaker_id") != ""))
        .groupBy("media_id", "speaker_id")
        .agg(F.count(F.lit(1)).alias("item_count"),
             count_if(F.col("speaker_failed")).alias("speaker_failed_count"))
    )
    ranked = references.join(current, ["media_id", "speaker_id"], "left").withColumn(
        "is_current", F.coalesce(F.col("path") == F.col("current_path"), F.lit(False)))
    best = ranked.groupBy("media_id", "speaker_id").agg(
        F.min(F.struct("ref_rank", "path", "is_current")).alias("_best"),
        F.min(F.when(~F.col("is_current"), F.struct("ref_rank", "path"))).alias("_other"),
        F.count(F.lit(1)).alias("candidate_count"),
    )
    pick = F.when(F.col("_best.is_current"), F.coalesce("_other.path", "_best.path")).otherwise(F.col("_best.path"))
    return queued.join(best, ["media_id", "speaker_id"], "left").select(
        "media_id", "speaker_id", "item_count", "speaker_failed_count", F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"),
        pick.alias("recommended_path"),
    )


def accumulate_rounds(base: DataFrame, fresh: DataFrame) -> DataFrame:
    """Accepted repairs of all rounds, the latest round winning per segment."""
    both = base.unionByName(fresh)
    return both.groupBy(*SEGMENT).agg(
        F.max_by(F.struct(*[c for c in both.columns if c not in SEGMENT]), "round").alias("_r")
    ).select(*SEGMENT, "_r.*")


def round_acceptance(rounds: DataFrame, eps: float = 0.5) -> DataFrame:
    """Accept a round when its score gains `eps`, or ties and removes problems, against the round before it."""
    before = Window.partitionBy("media_id").orderBy("round")
    rows = rounds.withColumn("_bs", F.lag("score").over(before)).withColumn("_bp", F.lag("problems").over(before))
    fewer = F.coalesce(F.col("problems") < F.col("_bp"), F.lit(False))
    scored = F.col("score").isNotNull() & F.col("_bs").isNotNull()
    accepted = (
        F.when(scored & (F.col("score") >= F.col("_bs") + eps), True)
        .when(scored & (F.col("score") <= F.col("_bs") - eps), False).otherwise(fewer)
    )
    return rows.filter("_bp IS NOT NULL").withColumn("accepted", accepted).drop("_bs", "_bp")


def editor_issues(metric_rows: DataFrame) -> DataFrame:
    """Editor issues: one row per (segment, rule), the overall failure only where no other rule fired."""
    skipped = F.col("mix_status").startswith("skipped") | F.array_contains("notes", "subtitle_window_not_rendered")
    silent = F.col("audible_failed") | F.coalesce(F.col("audible_status") == "failed", F.lit(False))
    rules = [
        (F.col("speaker_status") == "failed", "speaker_similarity_failed", "P1"),
        (F.col("duration_status") == "failed", "duration_fit_failed", "P1"),
        (F.col("pitch_class_drift"), "voice_gender_mismatch", "P0"),
        (silent, "silent_with_subtitle", "P0"),
        (skipped, "render_skipped", "P0"),
        (F.col("intelligibility_status") == "failed", "translation_untrusted", "P2"),
    ]
    found = F.array_compact(F.array(*[
        F.when(c, F.struct(F.lit(n).alias("issue"), F.lit(s).alias("severity"))) for c, n, s in rules]))
    fallback = F.array(F.struct(F.lit("quality_gate_failed").alias("issue"), F.lit("P2").alias("severity")))
    listed = F.when((F.size(found) == 0) & (F.col("overall_status") == "failed"), fallback).otherwise(found)
    return metric_rows.select(*SEGMENT, F.inline(listed)).dropDuplicates([*SEGMENT, "issue"])


def editor_units(translations: DataFrame, timeline: DataFrame, mix_report: DataFrame, characters: DataFrame) -> DataFrame:
    """Segment + timeline row (the mix report overrides it field by field) + character of the speaker."""
    fields = ("overall_status", "fit_strategy", "mix_status", "audio_path")
    first = timeline.select(*SEGMENT, *[F.col(c).alias(f"_t_{c}") for c in fields])
    second = mix_report.select(*SEGMENT, *[F.col(c).alias(f"_m_{c}") for c in fields])
    return (
        translations.join(first, SEGMENT, "left").join(second, SEGMENT, "left")
        .join(characters.select("media_id", "speaker_id", "character_id"), ["media_id", "speaker_id"], "left")
        .select(*SEGMENT, "speaker_id", "character_id", *[F.coalesce(f"_m_{c}", f"_t_{c}").alias(c) for c in fields])
    )


def synthesis_groups(rows: DataFrame) -> DataFrame:
    """`unit_pos`: position of the first row that is synthesised together with this one (`pos`, context_id, start, end, needs_unit).

    Consecutive rows of one non-empty context are one unit if they are two to four, span at most 8 s and one of them needs it;
    all others stand alone.
    """
    key = ["media_id"]
    context = F.coalesce("context_id", F.lit(""))
    ahead = seq.prefix(rows, key, {"_before": ("lag", context)})
    breaks = F.col("_before").isNull() | (context == "") | (context != F.col("_before"))
    marked = seq.islands(ahead, key, breaks, "_run").drop("_before")
    whole = marked.groupBy("media_id", "_run").agg(
        F.count(F.lit(1)).between(2, 4).alias("_few"), (F.max_by("end_ms", "pos") - F.min_by("start_ms", "pos") <= 8_000).alias("_short"), F.bool_or("needs_unit").alias("_need"))
    kept = whole.filter("_few AND _short AND _need").select("media_id", "_run", F.lit(True).alias("_unit"))
    return marked.join(kept, ["media_id", "_run"], "left").withColumn("unit_pos", F.when(F.col("_unit"), F.col("_run")).otherwise(F.col("pos"))).drop("_run", "_unit")
