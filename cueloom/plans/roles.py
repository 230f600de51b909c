"""Driver tables seen through the engine's data model.

Each role is one dialect-neutral SELECT, so the Spark plan and the SQL check start from the same rows.  `TS_MS(x)` stands
for milliseconds since 2024-01-01; `{...}` markers are filled with the table or role names.  Times are integer
milliseconds; similarities are integer hundredths divided once.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

ROLES: dict[str, str] = {
    # one user = one media; an event is a spoken segment about 2 s long every 6 s
    "segments": """
        SELECT user_id AS media_id, event_id AS segment_id, start_ms, start_ms + dur_ms AS end_ms, dur_ms,
               CASE WHEN event_type IN ('click', 'view') THEN 'SPEAKER_00' WHEN event_type = 'error' THEN 'SPEAKER_02'
                    ELSE 'SPEAKER_01' END AS speaker_label,
               event_type || ' ' || props AS text, event_type, value
        FROM (SELECT *, CAST(floor(TS_MS(ts) / 8000) AS BIGINT) AS start_ms,
                     200 + CAST(floor(value * 40) AS BIGINT) AS dur_ms FROM {events}) e""",
    # screen-text events near the segments, with a confidence and a kind
    "ocr_events": """
        SELECT media_id, segment_id AS event_id,
               least(start_ms + (segment_id * 101) % 900 - 300, end_ms + (segment_id * 37) % 700 - 200) AS start_ms,
               greatest(start_ms + (segment_id * 101) % 900 - 300, end_ms + (segment_id * 37) % 700 - 200) AS end_ms,
               (60 + (segment_id * 13) % 41) / 100.0E0 AS confidence,
               CASE WHEN segment_id % 3 = 0 THEN substring(text, 1, 6) ELSE text END AS text,
               CASE segment_id % 5 WHEN 0 THEN 'scene_text' WHEN 1 THEN 'watermark' WHEN 2 THEN 'subtitle' END AS kind
        FROM {segments}""",
    # diarization turns: boundary jitter, every 7th speaker swapped, one in five missing
    "turns": """
        SELECT media_id, segment_id AS turn_id, greatest(0, start_ms + (segment_id * 53) % 400 - 200) AS start_ms,
               end_ms + (segment_id * 29) % 300 AS end_ms,
               CASE WHEN segment_id % 7 = 0 THEN 'X_09' ELSE replace(speaker_label, 'SPEAKER', 'X') END AS speaker
        FROM {segments} WHERE segment_id % 5 <> 0""",
    # dialogue cues with real text
    "cues": """
        SELECT conv_id AS media_id, turn AS ord, role AS speaker_label, text,
               turn * 6000 + (conv_id * 37 + turn * 101) % 900 AS start_ms,
               turn * 6000 + (conv_id * 37 + turn * 101) % 900 + 300 + length(text) * 10 AS end_ms
        FROM {conversations}""",
    # subtitles with boxes whose last tenth is squeezed into short, late groups of other size; every eleventh media is all notices
    "tail_subtitles": """
        SELECT media_id, segment_id, s AS start_ms, s + CASE WHEN notices OR late AND media_id % 3 <> 0 THEN CAST(floor(dur_ms / 8) AS BIGINT) ELSE dur_ms END AS end_ms,
               CASE WHEN segment_id % 19 = 0 THEN NULL WHEN notices OR late AND segment_id % 7 <> media_id % 7 THEN substring(event_type, 1, 5) ELSE event_type || '，我在这里的。' END AS text,
               CASE WHEN segment_id % 13 <> 0 THEN segment_id * 7 % 200 + 100 END AS x1, 300 - segment_id % 5 AS y1, segment_id * 7 % 200 + 320 AS x2,
               300 + CASE WHEN late AND media_id % 4 < 2 THEN 45 ELSE 24 + segment_id % 6 END AS y2, notices AND segment_id % 3 <> 0 OR late AND media_id % 5 = 0 AS structural
        FROM (SELECT *, start_ms >= 290000 AS late, media_id % 11 = 0 AS notices,
                     CASE WHEN start_ms < 290000 THEN start_ms
                          ELSE 290000 + (1 + CAST(floor((start_ms - 290000) / 12000) AS BIGINT)) * 14000 + CAST(floor((start_ms % 12000) / (1 + media_id % 8)) AS BIGINT) END AS s
              FROM {segments}) t""",
    # subtitles on a main track and off it: smaller, wider, lower ones, credits among them, with the detector's metrics
    "track_subtitles": """
        SELECT media_id, segment_id, start_ms, end_ms, event_type,
               CASE segment_id % 5 WHEN 0 THEN text || ' ' || text WHEN 1 THEN '主演 张三' WHEN 2 THEN '我在这里，你的我在这里，你的' WHEN 3 THEN '文化传媒有限公司' ELSE event_type || event_type || event_type END AS text,
               CASE WHEN segment_id % 23 <> 0 THEN 100 + segment_id % 40 END AS x1, 300 + CASE WHEN segment_id % 7 = 0 THEN 30 ELSE 0 END AS y1,
               100 + segment_id % 40 + CASE WHEN segment_id % 6 = 0 THEN 320 ELSE 150 END AS x2,
               300 + CASE WHEN segment_id % 7 = 0 THEN 30 ELSE 0 END + CASE segment_id % 4 WHEN 0 THEN 18 WHEN 1 THEN 22 ELSE 30 END AS y2,
               (segment_id * 7 % 50) / 100.0E0 AS frame_width_ratio, (segment_id * 11 % 70) / 100.0E0 AS width_ratio, CASE WHEN segment_id % 3 = 0 THEN (segment_id * 13 % 60) / 100.0E0 END AS edge_attachment,
               (segment_id * 17 % 100) / 100.0E0 AS style_match, (segment_id * 19 % 100) / 100.0E0 AS temporal_support, segment_id % 3 AS line_count, segment_id % 5 AS component_count
        FROM {segments}""",
    # detections of captions on screen: competing readings of a phrase, noise lines, full-width signs, jittering boxes
    "caption_dets": """
        SELECT media_id, segment_id AS det_id, t AS t_ms, CASE segment_id % 8 WHEN 1 THEN replace(base, '我', '找') WHEN 2 THEN 'a ' || base WHEN 3 THEN base || chr(10) || 'x' WHEN 4 THEN base || '！' WHEN 5 THEN replace(base, ' ', '') WHEN 6 THEN base || chr(10) || replace(base, '们', '') || '。'
                    WHEN 7 THEN CASE WHEN segment_id % 3 = 0 THEN ' ' ELSE base END ELSE base END AS text, (60 + segment_id * 13 % 41) / 100.0E0 AS confidence,
               100 + segment_id % 9 AS x1, 300 - segment_id % 5 AS y1, 220 + segment_id * 7 % 40 AS x2, 330 + segment_id % 6 AS y2
        FROM (SELECT media_id, segment_id, t, CASE (CAST(floor(t / 2500) AS BIGINT) + media_id) % 6 WHEN 0 THEN '今天我们去看海' WHEN 1 THEN '你在那里等我' WHEN 2 THEN 'See you later' WHEN 3 THEN '好的' WHEN 4 THEN 'Ｈello 我们' ELSE '啊' END AS base FROM (SELECT media_id, segment_id, CAST(floor(start_ms / 5) AS BIGINT) AS t FROM {segments}) s) b""",
    # subtitles made of such readings, close in time, some without a box
    "caption_rows": """
        SELECT media_id, segment_id, t AS start_ms, t + CAST(floor(dur_ms / 5) AS BIGINT) AS end_ms, CASE segment_id % 8 WHEN 1 THEN replace(base, '我', '找') WHEN 2 THEN 'a ' || base WHEN 3 THEN base || chr(10) || 'x' WHEN 4 THEN base || '！' WHEN 5 THEN replace(base, ' ', '') WHEN 6 THEN base || chr(10) || replace(base, '们', '') || '。'
                    WHEN 7 THEN CASE WHEN segment_id % 3 = 0 THEN ' ' ELSE base END ELSE base END AS text, (60 + segment_id * 13 % 41) / 100.0E0 AS confidence,
               CASE WHEN segment_id % 10 <> 0 THEN 100 + segment_id % 9 END AS x1, CASE WHEN segment_id % 10 <> 0 THEN 300 - segment_id % 5 END AS y1,
               CASE WHEN segment_id % 10 <> 0 THEN 180 + segment_id * 7 % 60 END AS x2, CASE WHEN segment_id % 10 <> 0 THEN 330 + segment_id % 6 END AS y2
        FROM (SELECT media_id, segment_id, t, dur_ms, CASE (CAST(floor(t / 2500) AS BIGINT) + media_id) % 6 WHEN 0 THEN '今天我们去看海' WHEN 1 THEN '你在那里等我' WHEN 2 THEN 'See you later' WHEN 3 THEN '好的' WHEN 4 THEN 'Ｈello 我们' ELSE '啊' END AS base FROM (SELECT media_id, segment_id, dur_ms, CAST(floor(start_ms / 6) AS BIGINT) AS t FROM {segments}) s) b""",
    # reference and hypothesis transcripts of the same cue, in full
    "text_pairs": """
        SELECT conv_id AS media_id, turn AS ord, role AS speaker_label, text AS ref_text,
               CASE WHEN (conv_id + turn) % 4 = 0 THEN text ELSE replace(replace(text, 'an', 'a'), 'the ', '') END AS hyp_text
        FROM {conversations}""",
    # synthesis / render report, one row per dubbed line
    "report": """
        SELECT media_id, segment_id, speaker_id, h, source_ms, generated_ms, start_ms, target_text, audio_path,
               CASE WHEN h % 6 = 0 THEN NULL ELSE 'clip_' || CAST(h % 4 AS STRING) END AS reference_path,
               h % 11 <> 0 AS placed,
               CASE WHEN h % 11 <> 0 THEN 'placed' WHEN h % 2 = 0 THEN 'skipped_overlap' ELSE 'missing_audio' END AS mix_status,
               CASE h % 5 WHEN 0 THEN 'direct' WHEN 1 THEN 'compress' WHEN 2 THEN 'pad' WHEN 3 THEN 'overflow_unfitted'
                    ELSE 'underflow_unfitted' END AS fit_strategy,
               CASE h % 13 WHEN 0 THEN 'failed' WHEN 1 THEN 'review' ELSE 'passed' END AS overall_status,
               CASE h % 8 WHEN 0 THEN 'failed' WHEN 1 THEN 'review' ELSE 'passed' END AS speaker_status,
               CASE h % 9 WHEN 0 THEN 'failed' WHEN 1 THEN 'review' ELSE 'passed' END AS intelligibility_status,
               CASE h % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'review' ELSE 'passed' END AS duration_status,
               CASE WHEN h % 17 <> 0 THEN (h % 101) / 100.0E0 END AS speaker_similarity,
               (h * 3 % 101) / 100.0E0 AS text_similarity,
               CASE WHEN h % 10 <> 0 THEN (h * 7 % 101) / 100.0E0 END AS coverage,
               h % 10 <> 3 AS has_window,
               h % 6 AS dropout_count, h % 12 AS dropout_total,
               CASE WHEN h % 4 <> 0 THEN (h % 51) / 10.0E0 END AS judge_score,
               CAST(floor(generated_ms * (80 + h % 21) / 100) AS BIGINT) AS fitted_ms,
               CASE WHEN h % 3 = 0 THEN h % 900 ELSE 0 END AS trimmed_tail_ms,
               CASE WHEN h % 6 = 0 THEN h % 300 ELSE 0 END AS trimmed_speech_ms,
               (h * 11 % 101) / 100.0E0 AS quality_score
        FROM (SELECT l_suppkey AS media_id,
                     CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING)
                       || '-' || CAST(CAST(l_quantity AS INTEGER) AS STRING)
                       AS segment_id,
                     'spk_' || CAST(l_linenumber AS STRING) AS speaker_id,
                     (l_orderkey * 7 + l_linenumber * 31 + l_partkey * 13) AS h,
                     500 + (l_partkey * 37 + l_orderkey * 11) % 4000 AS generated_ms,
                     600 + (l_orderkey * 13 + l_linenumber * 101) % 3000 AS source_ms,
                     l_orderkey * 2500 + l_linenumber * 300 AS start_ms,
                     CASE WHEN l_linenumber = 7 THEN '' ELSE l_returnflag || ' line ' || CAST(l_partkey AS STRING) END
                       AS target_text,
                     CASE WHEN l_partkey % 19 = 0 THEN '' ELSE 'wav/' || CAST(l_partkey AS STRING) END AS audio_path
              FROM {lineitem}) r""",
    # translated lines: most report rows have one, some were never rendered
    "translations": """
        SELECT l_suppkey AS media_id,
               CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING)
                       || '-' || CAST(CAST(l_quantity AS INTEGER) AS STRING)
                 || CASE WHEN l_orderkey % 23 = 0 THEN '-lost' ELSE '' END AS segment_id,
               'src ' || l_linestatus || ' ' || CAST(l_partkey AS STRING) AS source_text,
               l_returnflag || ' text ' || CAST(l_partkey AS STRING) AS target_text,
               'spk_' || CAST(l_linenumber AS STRING) AS speaker_id, 'SPK ' || CAST(l_linenumber AS STRING) AS speaker_label,
               l_orderkey * 2500 + l_linenumber * 300 AS start_ms,
               l_orderkey * 2500 + l_linenumber * 300 + 600 + (l_orderkey * 13 + l_linenumber * 101) % 3000 AS end_ms,
               l_orderkey % 29 = 0 AS too_short_flag, l_partkey % 31 = 0 AS duration_risky
        FROM {lineitem} WHERE l_linenumber <> 3""",
    # synthesis attempts per line
    "attempts": """
        SELECT media_id, segment_id, speaker_id, CAST(h AS BIGINT) AS attempt_no,
               segment_id || '/' || CAST(h % 5 AS STRING) AS attempt_id,
               coalesce(reference_path, 'clip_none') AS reference_path, h % 4 <> 1 AS strict_accepted, h % 6 = 2 AS selected,
               CASE WHEN h % 7 = 3 THEN 'error' ELSE 'candidate' END AS status, overall_status, speaker_status,
               intelligibility_status, duration_status, speaker_similarity, text_similarity, source_ms, generated_ms
        FROM {report}""",
    # evaluation results of lab runs
    "results": """
        SELECT CAST(l_orderkey AS STRING) || ':' || CAST(l_linenumber AS STRING) AS sample_id,
               'run_' || CAST(extract(year FROM l_shipdate) AS STRING) AS run_id, l_returnflag AS scenario,
               l_linestatus AS arm,
               CASE WHEN l_partkey % 17 = 0 THEN 'failed' WHEN l_partkey % 19 = 0 THEN 'skipped' ELSE 'succeeded' END AS status,
               CASE WHEN l_suppkey % 13 <> 0 THEN (CAST(round(l_discount * 100) AS INTEGER) + l_linenumber) / 100.0E0 END
                 AS primary_metric,
               l_returnflag = 'R' AS higher_is_better,
               CAST(l_partkey % 400 AS BIGINT) AS ref_chars, CAST(l_orderkey % 40 AS BIGINT) AS edits,
               CAST(l_suppkey % 30 AS BIGINT) AS tp, CAST(l_partkey % 7 AS BIGINT) AS fp, CAST(l_orderkey % 5 AS BIGINT) AS fn,
               CASE WHEN l_linenumber <> 5 THEN (l_partkey % 101) / 100.0E0 END AS sim
        FROM {lineitem}""",
    "tasks": """
        SELECT o_orderkey AS task_id, 'Task ' || o_orderpriority || ' #' || CAST(o_custkey AS STRING) AS name,
               CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'succeeded' WHEN 'P' THEN
                    CASE WHEN o_orderkey % 2 = 0 THEN 'failed' ELSE 'pending' END END AS status,
               CASE WHEN o_custkey % 3 = 0 THEN 'en' WHEN o_custkey % 3 = 1 THEN 'ja' ELSE 'zh' END AS target_lang,
               CASE o_orderkey % 4 WHEN 0 THEN '{{"output_intent":"dub_final"}}' WHEN 1 THEN '{{"output_intent":"bilingual_review"}}'
                    WHEN 2 THEN '{{"template":"asr-dub+ocr-subs"}}' END AS config,
               TS_MS(o_orderdate) AS created_ms, CAST(round(o_totalprice * 100) AS BIGINT) AS size_bytes, o_custkey AS owner_id
        FROM {orders}""",
    "stages": """
        SELECT l_orderkey AS task_id, CAST(l_linenumber AS BIGINT) AS stage_ord, 'stage_' || CAST(l_linenumber AS STRING) AS stage,
               CASE l_returnflag WHEN 'A' THEN 'succeeded' WHEN 'N' THEN 'cached' ELSE
                    CASE WHEN l_linestatus = 'F' THEN 'failed' ELSE 'running' END END AS status,
               CAST(l_quantity AS BIGINT) * 2 AS progress, TS_MS(l_shipdate) + l_partkey AS ts_ms, l_partkey, l_suppkey
        FROM {lineitem}""",
    "works": """
        SELECT p_partkey AS work_id, p_name AS title, p_type || ' ' || p_name AS alias, p_brand AS kind, p_size AS year_no
        FROM {part}""",
    # titles many works share, some not Latin; tasks named after them in several ways, with and without an input path
    "work_titles": """
        SELECT p_partkey AS work_id, CASE WHEN p_partkey % 9 = 0 THEN '风起 ' || p_name ELSE p_name END AS title, p_type AS alias FROM {part}""",
    "work_tasks": """
        SELECT o_orderkey AS task_id,
               CASE o_orderkey % 7 WHEN 0 THEN replace(title, ' ', '.') || '.S01E0' || CAST(o_orderkey % 9 AS STRING) || '.mkv' WHEN 1 THEN replace(title, ' ', '') || '.E7' WHEN 2 THEN title || '_1999.mkv'
                    WHEN 3 THEN 'Task ' || o_orderpriority || ' #' || CAST(o_custkey AS STRING) WHEN 4 THEN 'the ' || alias || ' show' WHEN 5 THEN '风起' ELSE '' END AS name,
               CASE o_orderkey % 4 WHEN 0 THEN '/m/x.y/' || upper(title) || '.第3.2004.mp4' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE '/in/' || CAST(o_orderkey AS STRING) || '.mov' END AS path
        FROM {orders} o JOIN {work_titles} w ON w.work_id = o.o_custkey % 200""",
    "personas": """
        SELECT c_custkey AS persona_id, c_mktsegment AS role, 'P ' || c_mktsegment || ' ' || CAST(c_nationkey AS STRING) AS name,
               CASE c_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' END AS gender,
               CASE WHEN c_custkey % 5 = 0 THEN '  ' WHEN c_custkey % 7 = 0 THEN NULL ELSE 'work_' || CAST(c_nationkey AS STRING) END
                 AS work_id, c_nationkey AS media_id, 'SPEAKER_' || CAST(c_custkey % 40 AS STRING) AS speaker_label
        FROM {customer}""",
    # detection boxes per (media, frame): truth and prediction
    "boxes": """
        SELECT l_suppkey AS media_id, l_orderkey AS frame, row_number() OVER
                 (PARTITION BY l_suppkey, l_orderkey ORDER BY l_linenumber, l_partkey) AS box_id,
               (l_partkey * 7) % 400 AS x1, (l_orderkey * 11) % 300 AS y1,
               (l_partkey * 7) % 400 + 20 + (l_partkey % 50) AS x2,
               (l_orderkey * 11) % 300 + 10 + (l_linenumber * 9) AS y2, l_returnflag || CAST(l_partkey % 5 AS STRING) AS text,
               l_discount AS raw_conf, l_linenumber
        FROM {lineitem}""",
    # about ten text boxes a frame, in three rows of the screen with some jitter; blank, unsure, tall and far-off ones among them
    "frame_boxes": """
        SELECT l_suppkey AS media_id, l_orderkey % 60 AS frame, l_orderkey * 100 + l_linenumber * 10 + l_partkey % 10 AS det_id,
               CAST((l_partkey * 37) % 560 AS INTEGER) AS x1, CAST(250 + (l_linenumber % 3) * 30 + l_partkey % 9 AS INTEGER) AS y1,
               CAST((l_partkey * 37) % 560 + 30 + (l_orderkey * 13) % 90 AS INTEGER) AS x2,
               CAST(250 + (l_linenumber % 3) * 30 + l_partkey % 9 + CASE WHEN l_partkey % 31 = 0 THEN 60 ELSE 18 + l_orderkey % 7 END AS INTEGER) AS y2,
               CASE l_partkey % 5 WHEN 0 THEN ' 字幕' || l_returnflag WHEN 1 THEN l_linestatus || '  x' WHEN 2 THEN '今天。' WHEN 3 THEN l_returnflag || CAST(l_linenumber AS STRING)
                    ELSE CASE WHEN l_orderkey % 2 = 0 THEN '  ' ELSE l_linestatus END END AS text,
               (40 + (l_partkey * 7 + l_orderkey) % 60) / 100.0E0 AS confidence
        FROM {lineitem}""",
    "oplog": """
        SELECT event_id AS seq, user_id AS target_id, user_id % 50 AS media_id,
               CASE event_type WHEN 'click' THEN 'set_text' WHEN 'view' THEN 'set_speaker' WHEN 'signup' THEN 'approve'
                    WHEN 'purchase' THEN 'lock' ELSE 'malformed' END AS op, props AS payload, ts, value
        FROM {events}""",
    "vectors": "SELECT vec_id, label, embedding FROM {embeddings}",
}

_NAME = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(_NAME.findall(sql)))


def spark_sql(sql: str) -> str:
    sql = re.sub(r"TS_MS\((\w+)\)", r"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', \1)", sql)
    return sql.replace(", '', 'g')", ", '')")


def duck_sql(sql: str) -> str:
    sql = re.sub(r"TS_MS\((\w+)\)", r"(epoch_us(\1) // 1000 - 1704067200000)", sql)
    return _NAME.sub(r"\1", sql).replace("{{", "{").replace("}}", "}")


class Source:
    """Lazily opened tables and roles of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder.rstrip('/')}/{name}.parquet")

    def __call__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        sql = ROLES[name]
        return self.spark.sql(spark_sql(sql), **{n: self(n) for n in _needs(sql)})


def with_roles(sql: str) -> str:
    """Prefix a check query with the CTEs of every role it mentions."""
    wanted: list[str] = []

    def visit(name: str) -> None:
        for other in _needs(ROLES[name]):
            if other in ROLES:
                visit(other)
        if name not in wanted:
            wanted.append(name)

    for name in ROLES:
        if re.search(rf"\b{name}\b", sql):
            visit(name)
    ctes = ",\n".join(f"{n} AS ({duck_sql(ROLES[n])})" for n in wanted)
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    return f"WITH {ctes}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes} {body}"
