"""Structured Streaming jobs: status, operation log, decisions, sessions, alignment and rolling counts.

Every job takes a streaming DataFrame with an event time `ts` and is the batch operator's own code where one exists.
Results go to Parquet folders, never through the driver: append results as they close, keyed results as a change log with
one partition per micro-batch, from which `latest` reads the current state.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.operators import catalog as ct
from cueloom.session import shared_dir


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def text_stream(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines log files as they arrive, for `ingest.parse_jsonl`."""
    return spark.readStream.text(path).select(F.lit("log").alias("media_id"), "value")


# ---- transformations -----------------------------------------------------------------------------------------------


def stage_status(updates: DataFrame) -> DataFrame:
    """Latest status and progress per (job, stage)."""
    last = F.max_by(F.struct("status", "progress"), F.struct("ts", "seq"))
    return updates.groupBy("task_id", "stage").agg(last.alias("_l")).select("task_id", "stage", "_l.status", "_l.progress")


def op_log_state(log: DataFrame) -> DataFrame:
    """Last write per (target, field), the batch fold unchanged."""
    return ct.last_write_wins(ct.unpivot_ops(log))


def unique_decisions(log: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Decisions without redeliveries; a redelivery later than the watermark counts as new, unlike in the batch fold."""
    return log.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["target_id", "seq"])


def detection_sessions(detections: DataFrame, gap: str, delay: str = "10 minutes") -> DataFrame:
    """Equal texts of a media separated by less than `gap` form one subtitle session."""
    session = F.session_window("ts", gap)
    return (
        detections.withWatermark("ts", delay).groupBy("media_id", "text", session)
        .agg(F.count(F.lit(1)).alias("detections"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        .drop("session_window")
    )


def align(segments: DataFrame, events: DataFrame, reach: str = "10 seconds", delay: str = "1 minute", how: str = "inner") -> DataFrame:
    """Segments joined to the events that overlap them; both sides are bounded by watermarks and a time range.

    `reach` must cover the longest segment or event.  Rows later than the watermark are dropped, unlike in batch.  The join is by media and
    stretch of `reach`: one side's rows stand in the stretch of their time alone, the other's in the two beside it as well, so that every
    pair meets once and a row is compared with its surroundings only.  A full outer join keeps both sides whole and has no stretches.
    """
    s = segments.select(F.col("media_id").alias("s_media"), "segment_id", F.col("ts").alias("s_ts"), F.col("start_ms").alias("s_start"), F.col("end_ms").alias("s_end")).withWatermark("s_ts", delay)
    e = events.select(F.col("media_id").alias("e_media"), "event_id", F.col("ts").alias("e_ts"), F.col("start_ms").alias("e_start"), F.col("end_ms").alias("e_end")).withWatermark("e_ts", delay)
    near = F.expr(f"e_ts >= s_ts - INTERVAL {reach} AND e_ts <= s_ts + INTERVAL {reach}")
    overlap = (F.col("s_media") == F.col("e_media")) & (F.col("s_start") < F.col("e_end")) & (F.col("e_start") < F.col("s_end"))
    if not how.lower().replace("_", "").startswith(("full", "outer")):
        right = how.lower().startswith("right")
        s, e = stretches(s, "s", reach, beside=right), stretches(e, "e", reach, beside=not right)
        overlap = overlap & (F.col("s_stretch") == F.col("e_stretch"))
    return s.join(e, overlap & near, how).select(F.col("s_media").alias("media_id"), "segment_id", "event_id")


def stretches(rows: DataFrame, side: str, reach: str, beside: bool) -> DataFrame:
    """Rows with the number of the stretch of `reach` that their time lies in; with `beside`, also once for the one before and the one after."""
    at = F.expr(f"unix_micros({side}_ts) div unix_micros(timestamp_micros(0) + INTERVAL {reach})")
    return rows.withColumn(f"{side}_stretch", F.explode(F.array(at - 1, at, at + 1)) if beside else at)


def rolling_counts(rows: DataFrame, width: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Rows, failures and total value per tumbling or sliding window."""
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = rows.withWatermark("ts", delay).groupBy(span, "kind").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("failed"), 1)).alias("failures"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "kind", "rows", "failures")


# ---- sinks ---------------------------------------------------------------------------------------------------------


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"


def append_to(result: DataFrame, folder: str, once: bool = True):
    """Append results to Parquet with exactly-once file commits."""
    writer = result.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/_state").option("path", f"{folder}/rows")
    return (writer.trigger(availableNow=True) if once else writer).start()


def changes_to(result: DataFrame, folder: str, key: list[str], once: bool = True):
    """Write only the keys whose row changed in a micro-batch; a replayed batch overwrites its own partition."""
    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = batch
        if batch_id > 0:
            known = latest(batch.sparkSession, folder, key, before=batch_id)
            fresh = batch.join(known, batch.columns, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{folder}/rows/batch_id={batch_id}")

    writer = result.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/_state")
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest(spark: SparkSession, folder: str, key: list[str], before: int | None = None) -> DataFrame:
    """Current row per key of a change log."""
    rows = spark.read.parquet(f"{folder}/rows")
    if before is not None:
        rows = rows.filter(F.col("batch_id") < before)
    return ct.latest_by_key(rows, key, ["batch_id"]).drop("batch_id")


def run_appending(spark: SparkSession, name: str, result: DataFrame) -> DataFrame:
    folder = new_folder(spark, name)
    append_to(result, folder).awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{folder}/rows")


def run_keyed(spark: SparkSession, name: str, result: DataFrame, key: list[str]) -> DataFrame:
    folder = new_folder(spark, name)
    changes_to(result, folder, key).awaitTermination()
    return latest(spark, folder, key)


Job = Callable[[DataFrame], DataFrame]
