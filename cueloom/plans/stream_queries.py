"""Registered queries: streaming jobs over the events table as a file stream, read back from their sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueloom.plans.registry import query
from cueloom.plans.roles import Source
from cueloom.streaming import jobs

def _stream(src: Source):
    path = f"{src.folder.rstrip(chr(47))}/event[s].parquet"  # a glob, since a file stream takes no single-file path
    rows = jobs.file_stream(src.spark, path, src("events").schema)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _ms(ts):
    return F.unix_millis(ts) - F.unix_millis(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").cast("timestamp"))


@query("stream_stage_status", """WITH u AS (SELECT user_id % 20 AS task_id, 'stage_' || event_type AS stage, CASE WHEN value > 90 THEN 'failed' WHEN value > 60 THEN 'succeeded' ELSE 'running' END AS status, CAST(floor(value) AS BIGINT) AS progress, ts, event_id FROM events)
SELECT task_id, stage, arg_max(status, (ts, event_id)) AS status, arg_max(progress, (ts, event_id)) AS progress FROM u GROUP BY ALL""")
def _(src):
    v = F.col("value")
    updates = _stream(src).select((F.col("user_id") % 20).alias("task_id"), F.concat(F.lit("stage_"), "event_type").alias("stage"), F.when(v > 90, "failed").when(v > 60, "succeeded").otherwise("running").alias("status"),
                                  F.floor(v).alias("progress"), "ts", F.col("event_id").alias("seq"))
    return jobs.run_keyed(src.spark, "stage-status", jobs.stage_status(updates), ["task_id", "stage"])


OPS = """CASE event_type WHEN 'click' THEN 'set_text' WHEN 'view' THEN 'set_speaker' WHEN 'signup' THEN 'approve' WHEN 'purchase' THEN 'lock' ELSE 'malformed' END"""


def _log(src):
    t = F.col("event_type")
    op = F.when(t == "click", "set_text").when(t == "view", "set_speaker").when(t == "signup", "approve").when(t == "purchase", "lock").otherwise("malformed")
    return _stream(src).select(F.col("event_id").alias("seq"), F.col("user_id").alias("target_id"), (F.col("user_id") % 50).alias("media_id"), op.alias("op"), F.col("props").alias("payload"), "ts")


@query("stream_op_log", """WITH w AS (SELECT media_id, target_id, seq, CASE op WHEN 'set_text' THEN 'text' WHEN 'set_speaker' THEN 'speaker' WHEN 'approve' THEN 'status' WHEN 'lock' THEN 'voice_lock' END AS field,
  CASE op WHEN 'approve' THEN 'approved' WHEN 'lock' THEN 'true' ELSE 'v' || json_extract_string(payload, '$.k') END AS value FROM oplog WHERE op <> 'malformed') SELECT media_id, target_id, field, arg_max(value, seq) AS value, max(seq) AS seq FROM w GROUP BY ALL""")
def _(src):
    return jobs.run_keyed(src.spark, "op-log", jobs.op_log_state(_log(src)), ["media_id", "target_id", "field"])


@query("stream_decisions", "SELECT target_id, arg_max(op, seq) AS op, max(seq) AS seq FROM oplog GROUP BY target_id")
def _(src):
    from cueloom.operators import catalog as ct

    log = _log(src)
    redelivered = log.unionByName(log)
    rows = jobs.run_appending(src.spark, "decisions", jobs.unique_decisions(redelivered))
    return ct.latest_by_key(rows.select("target_id", "op", "seq"), ["target_id"], ["seq"])


@query("stream_sessions", """WITH e AS (SELECT user_id % 10 AS media_id, event_type AS text, (epoch_us(ts) // 1000) AS t, ts FROM events), b AS (SELECT *, CASE WHEN t - lag(t) OVER w < 900000 THEN 0 ELSE 1 END AS brk FROM e WINDOW w AS (PARTITION BY media_id, text ORDER BY ts)),
g AS (SELECT *, sum(brk) OVER (PARTITION BY media_id, text ORDER BY ts) AS grp FROM b), s AS (SELECT media_id, text, count(*) AS detections, min(t) - 1704067200000 AS first_ms, max(t) - 1704067200000 AS last_ms, max(ts) AS lt FROM g GROUP BY media_id, text, grp)
SELECT media_id, text, detections, first_ms, last_ms FROM s WHERE lt + INTERVAL 15 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def _(src):
    det = _stream(src).select((F.col("user_id") % 10).alias("media_id"), F.col("event_type").alias("text"), "ts")
    out = jobs.run_appending(src.spark, "sessions", jobs.detection_sessions(det, "15 minutes"))
    return out.select("media_id", "text", "detections", _ms(F.col("first_ts")).alias("first_ms"), _ms(F.col("last_ts")).alias("last_ms"))


@query("stream_align", """WITH s AS (SELECT user_id % 40 AS media_id, event_id, (epoch_us(ts) // 1000) - 1704067200000 AS a, (epoch_us(ts) // 1000) - 1704067200000 + 300000 + event_id % 7 * 60000 AS b FROM events)
SELECT x.media_id, x.event_id AS segment_id, y.event_id AS event_id FROM s x JOIN s y ON x.media_id = y.media_id AND x.a < y.b AND y.a < x.b""")
def _(src):
    def side(name):
        start = _ms(F.col("ts"))
        return _stream(src).select((F.col("user_id") % 40).alias("media_id"), F.col("event_id").alias(name), "ts", start.alias("start_ms"), (start + 300_000 + F.col("event_id") % 7 * 60_000).alias("end_ms"))

    return jobs.run_appending(src.spark, "align", jobs.align(side("segment_id"), side("event_id"), "20 minutes", "1 hour"))


@query("stream_rolling_counts", """SELECT CAST(floor(((epoch_us(ts) // 1000) - 1704067200000) / 3600000) AS BIGINT) AS hour, event_type AS kind, count(*) AS rows, count(*) FILTER (value > 90) AS failures FROM events GROUP BY ALL""")
def _(src):
    rows = _stream(src).select("ts", F.col("event_type").alias("kind"), (F.col("value") > 90).alias("failed"))
    out = jobs.run_keyed(src.spark, "rolling", jobs.rolling_counts(rows, "1 hour"), ["window_start", "window_end", "kind"])
    return out.select(F.floor(_ms(F.col("window_start")) / 3_600_000).alias("hour"), "kind", "rows", "failures")


@query("stream_sliding_counts", """SELECT h - o AS quarter, event_type AS kind, count(*) AS rows, count(*) FILTER (value > 90) AS failures FROM (SELECT *, CAST(floor(((epoch_us(ts) // 1000) - 1704067200000) / 900000) AS BIGINT) AS h FROM events), (VALUES (0), (1), (2), (3)) v(o) GROUP BY ALL""")
def _(src):
    rows = _stream(src).select("ts", F.col("event_type").alias("kind"), (F.col("value") > 90).alias("failed"))
    out = jobs.run_keyed(src.spark, "sliding", jobs.rolling_counts(rows, "1 hour", "15 minutes"), ["window_start", "window_end", "kind"])
    return out.select(F.floor(_ms(F.col("window_start")) / 900_000).alias("quarter"), "kind", "rows", "failures")
