"""Task, stage, job, artifact and storage listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions.cols import count_if, lookup
from cueloom.operators import sequence as seq

COMMENTARY_TEMPLATE = "asr-commentary"
COMMENTARY_INTENT = "commentary_recap"


def is_commentary(config: str = "config") -> Column:
    """Template or explicit intent, nested or flat, NULL counting as 'not commentary'."""
    def either(name: str) -> Column:
        return F.coalesce(F.get_json_object(config, f"$.pipeline.{name}"), F.get_json_object(config, f"$.{name}"), F.lit(""))

    return (either("template") == COMMENTARY_TEMPLATE) | (either("output_intent") == COMMENTARY_INTENT)


def filter_tasks(tasks: DataFrame, status: str | None = None, target_lang: str | None = None, search: str | None = None,
                 intent: str | None = None) -> DataFrame:
    if status and status != "all":
        tasks = tasks.filter(F.col("status") == status)
    if target_lang:
        tasks = tasks.filter(F.col("target_lang") == target_lang)
    if search:
        tasks = tasks.filter(F.col("name").contains(search))
    if intent and intent != "all":
        tasks = tasks.filter(is_commentary() if intent == "commentary" else ~is_commentary())
    return tasks


def page(rows: DataFrame, number: int, size: int, newest: str = "created_ms", key: str = "task_id") -> DataFrame:
    """One page, newest first; the total is a separate count over the same filter."""
    return rows.orderBy(F.desc(newest), key).offset((number - 1) * size).limit(size)


def text_search(rows: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Case-insensitive substring over any column; `contains` needs no wildcard escaping."""
    hit = F.lit(False)
    for name in columns:
        hit = hit | F.coalesce(F.lower(F.col(name).cast("string")).contains(needle.lower()), F.lit(False))
    return rows.filter(hit)


def owned_by(rows: DataFrame, root: str, column: str = "job_root") -> DataFrame:
    return rows.filter(F.col(column).startswith(root.rstrip("/") + "/"))


def stages_of_page(page_rows: DataFrame, stages: DataFrame) -> DataFrame:
    """Stages of the listed tasks (the page is at most one screen, so it is the broadcast side)."""
    return stages.join(F.broadcast(page_rows.select("task_id")), "task_id", "left_semi")


def stage_report(stages: DataFrame) -> DataFrame:
    return stages.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("node_count"), count_if(F.col("status") == "cached").alias("cached_count"),
        F.min(F.when(F.col("status") == "failed", F.struct("stage_ord", "stage"))).alias("_f"),
    ).select("task_id", "node_count", "cached_count", F.col("_f.stage").alias("first_failed_stage"))


def weighted_progress(latest: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Overall progress in percent = sum of weight x progress over the latest row of each stage."""
    total = float(sum(weights.values()))
    weight = F.coalesce(lookup(F.col("stage"), {k: w / total for k, w in weights.items()}), F.lit(0.0))
    return latest.groupBy("task_id").agg((F.sum(weight * (F.col("progress") / 100.0)) * 100.0).alias("overall_progress"))


def latest_stage(stages: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("status", "progress"), F.struct("ts_ms", "l_partkey", "l_suppkey"))
    return stages.groupBy("task_id", "stage").agg(last.alias("_l")).select("task_id", "stage", "_l.*")


def count_by_bucket(rows: DataFrame, column: str, empty: str = "__unassigned__") -> DataFrame:
    bucket = F.coalesce(F.nullif(F.trim(F.col(column)), F.lit("")), F.lit(empty))
    return rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("cnt"))


def export_readiness(tasks: DataFrame) -> DataFrame:
    """Readiness from task state, intent and boolean asset columns."""
    audio = F.col("has_dub_audio") | F.col("has_preview_audio")
    subtitles = F.col("has_ocr") | F.col("has_asr")
    blockers = F.array_compact(F.array(
        F.when((F.col("intent") == "english_subtitle") & ~F.col("has_clean"), F.lit("missing_clean_video")),
        F.when((F.col("intent") == "bilingual_review") & ~F.col("has_original"), F.lit("missing_original_video")),
        F.when(F.col("intent").isin("english_subtitle", "bilingual_review") & ~subtitles, F.lit("missing_english_subtitles")),
        F.when(~audio, F.lit("missing_audio_track")),
    ))
    waiting, failed = F.col("status").isin("pending", "running"), F.col("status") == "failed"
    empty = F.array().cast("array<string>")
    codes = (
        F.when(waiting, empty).when(failed, F.array(F.lit("task_failed")))
        .when(F.col("commentary"), F.when(F.col("has_recap"), empty).otherwise(F.array(F.lit("missing_recap"))))
        .otherwise(blockers)
    )
    rows = tasks.withColumn("blockers", codes)
    done = F.when(F.col("commentary"), F.lit(True)).otherwise(F.col("has_final"))
    return rows.withColumn(
        "readiness", F.when(waiting, "not_ready").when(F.size("blockers") > 0, "blocked").when(done, "exported").otherwise("ready"))


def evict_oldest(outputs: DataFrame, root: str, max_bytes: int | None, max_count: int | None, slot_ms: int = 86_400_000) -> DataFrame:
    """Unreferenced outputs to delete, oldest first, until the store is within its limits.

    The running totals over one store are a block prefix (see `sequence`), not a single-task global window.
    """
    totals = outputs.groupBy(root).agg(F.sum("size_bytes").alias("_bytes"), F.count(F.lit(1)).alias("_count"))
    running = seq.scan(outputs.filter(~F.col("referenced")), [root], ["mtime_ms", "output_id"], F.floor(F.col("mtime_ms") / slot_ms),
                       {"pos": ("row", None), "_before": ("sum_before", F.col("size_bytes"))})
    over = F.lit(False)
    rows = running.join(totals, root)
    if max_bytes is not None:
        over = over | (F.col("_bytes") - F.col("_before") > max_bytes)
    if max_count is not None:
        over = over | (F.col("_count") - F.col("pos") > max_count)
    return rows.filter(over).drop("_before", "_bytes", "_count", "_slot")


def storage_breakdown(files: DataFrame, groups: list[tuple[str, str]], catch_all: str) -> DataFrame:
    """Bytes per storage group plus the total; a file belongs to the first group whose prefix it has."""
    owner = None
    for name, prefix in groups:
        cond = F.col("path").startswith(prefix)
        owner = F.when(cond, F.lit(name)) if owner is None else owner.when(cond, F.lit(name))
    return (
        files.withColumn("grp", owner.otherwise(F.lit(catch_all))).rollup("grp")
        .agg(F.sum("size_bytes").alias("bytes"), F.count(F.lit(1)).alias("files"))
        .withColumn("grp", F.coalesce("grp", F.lit("total")))
    )


def latest_by_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Last row per key."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def last_write_wins(ops: DataFrame) -> DataFrame:
    """(target, field) -> value of the latest operation; ops are already unpivoted to one row per written field."""
    return ops.groupBy("media_id", "target_id", "field").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


def unpivot_ops(log: DataFrame) -> DataFrame:
    """Operation log rows -> written fields; unknown operations and unreadable payloads are dropped."""
    payload = F.from_json("payload", "k INT")
    fields = {"set_text": "text", "set_speaker": "speaker", "approve": "status", "lock": "voice_lock"}
    value = (
        F.when(F.col("op") == "approve", F.lit("approved")).when(F.col("op") == "lock", F.lit("true"))
        .otherwise(F.concat(F.lit("v"), payload["k"].cast("string")))
    )
    return log.select("media_id", "target_id", "seq", lookup(F.col("op"), fields).alias("field"), value.alias("value")).filter(
        "field IS NOT NULL AND value IS NOT NULL")


def editor_summary(state: DataFrame, issues: DataFrame) -> DataFrame:
    """Approved targets resolve their issues; counts of open issues, open P0 and approved targets per media."""
    status = state.filter("field = 'status'").select("media_id", "target_id", (F.col("value") == "approved").alias("_approved"))
    open_rows = issues.join(status.filter("_approved"), ["media_id", "target_id"], "left_anti")
    opened = open_rows.groupBy("media_id").agg(
        F.count(F.lit(1)).alias("open_issues"), count_if(F.col("severity") == "P0").alias("p0_open"))
    approved = status.groupBy("media_id").agg(count_if(F.col("_approved")).alias("approved"))
    return opened.join(approved, "media_id", "full_outer").fillna(0, ["open_issues", "p0_open", "approved"])
