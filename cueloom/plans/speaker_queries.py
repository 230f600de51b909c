"""Registered queries: speaker diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueloom.functions.cols import joined
from cueloom.operators import speakers as sp
from cueloom.plans.registry import query

ROLLUP_SQL = """
WITH r AS (
  SELECT media_id, speaker_label, count(*) AS segment_count, CAST(sum(dur_ms) AS BIGINT) AS total_ms,
         count(*) FILTER (dur_ms < 1200) AS short_segment_count, bool_or(dur_ms BETWEEN 1500 AND 15000) AS safe
  FROM segments GROUP BY ALL),
rollup_rows AS (
  SELECT *, total_ms / segment_count AS avg_ms,
    concat_ws('|', CASE WHEN segment_count = 1 THEN 'single_segment_speaker' END,
      CASE WHEN segment_count <= 2 OR total_ms < 6000 THEN 'low_sample_speaker' END,
      CASE WHEN short_segment_count * 10 >= segment_count * 4 THEN 'mostly_short_segments' END,
      CASE WHEN segment_count < 10 AND total_ms >= segment_count * 8000 THEN 'sparse_long_timing' END,
      CASE WHEN NOT safe THEN 'no_reference_safe_segment' END) AS risk_flags
  FROM r),
rolled AS (
  SELECT media_id, speaker_label, segment_count, total_ms, short_segment_count, avg_ms, risk_flags,
    CASE WHEN contains(risk_flags, 'single_segment_speaker') THEN 'high' WHEN risk_flags <> '' THEN 'medium' ELSE 'low' END
      AS risk_level,
    NOT (contains(risk_flags, 'single_segment') OR contains(risk_flags, 'low_sample')
         OR contains(risk_flags, 'no_reference')) AS cloneable
  FROM rollup_rows)
"""


@query("speaker_rollup", ROLLUP_SQL + "SELECT * FROM rolled")
def _(src):
    return sp.speaker_rollup(src("segments")).withColumn("risk_flags", joined(F.col("risk_flags")))


CONTEXT_SQL = """
ctx AS (
  SELECT *, lag(speaker_label) OVER w AS prev_label, lag(end_ms) OVER w AS prev_end, lead(speaker_label) OVER w AS next_label,
         lead(start_ms) OVER w AS next_start, row_number() OVER w - 1 AS pos
  FROM segments WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, end_ms, segment_id))
"""
RUNS_SQL = "WITH " + CONTEXT_SQL + """,
marked AS (SELECT *, sum(CASE WHEN prev_label IS DISTINCT FROM speaker_label THEN 1 ELSE 0 END)
             OVER (PARTITION BY media_id ORDER BY pos) AS run_no FROM ctx),
grouped AS (
  SELECT media_id, min(pos) AS run_pos, min(speaker_label) AS speaker_label, min(start_ms) AS start_ms,
         arg_max(end_ms, pos) AS end_ms, count(*) AS segment_count FROM marked GROUP BY media_id, run_no),
around AS (
  SELECT *, lag(speaker_label) OVER w AS previous_speaker, lead(speaker_label) OVER w AS next_speaker,
    greatest(0, start_ms - lag(end_ms) OVER w) AS gb, greatest(0, lead(start_ms) OVER w - end_ms) AS ga,
    lag(end_ms) OVER w AS pe, lead(start_ms) OVER w AS ns,
    greatest(0, end_ms - start_ms) AS duration_ms
  FROM grouped WINDOW w AS (PARTITION BY media_id ORDER BY run_pos)),
gaps AS (SELECT *, CASE WHEN pe IS NOT NULL THEN gb END AS gap_before, CASE WHEN ns IS NOT NULL THEN ga END AS gap_after
         FROM around),
runs AS (
  SELECT media_id, run_pos, speaker_label, start_ms, end_ms, segment_count, previous_speaker, next_speaker, gap_before,
    gap_after, duration_ms,
    concat_ws('|', CASE WHEN segment_count = 1 THEN 'single_segment_run' END,
      CASE WHEN duration_ms < 1500 THEN 'short_run' END,
      CASE WHEN previous_speaker = next_speaker AND previous_speaker <> speaker_label AND duration_ms <= 3000
           THEN 'sandwiched_run' END,
      CASE WHEN gap_before < 200 OR gap_after < 200 THEN 'rapid_turn_boundary' END) AS risk_flags
  FROM gaps),
run_rows AS (SELECT *, CASE WHEN contains(risk_flags, 'sandwiched_run') THEN 'high' WHEN risk_flags <> '' THEN 'medium'
             ELSE 'low' END AS risk_level FROM runs)
"""


@query("speaker_runs", RUNS_SQL + "SELECT * FROM run_rows")
def _(src):
    return sp.speaker_runs(src("segments")).withColumn("risk_flags", joined(F.col("risk_flags")))


RISKS_SQL = ROLLUP_SQL + ", " + CONTEXT_SQL + """,
seg_rows AS (
  SELECT c.media_id, c.segment_id, c.pos, c.prev_label, c.next_label,
    concat_ws('|', CASE WHEN dur_ms < 1200 THEN 'short_segment' END,
      CASE WHEN dur_ms >= 8000 AND length(regexp_replace(text, '\\s+', '', 'g')) < 8 THEN 'long_timing_short_text' END,
      CASE WHEN dur_ms >= 15000 THEN 'very_long_segment' END,
      CASE WHEN (prev_label <> c.speaker_label AND start_ms - prev_end < 200)
             OR (next_label <> c.speaker_label AND next_start - end_ms < 200) THEN 'speaker_boundary_risk' END,
      CASE WHEN contains(o.risk_flags, 'single_segment') OR contains(o.risk_flags, 'low_sample')
           THEN 'speaker_sample_risk' END) AS risk_flags
  FROM ctx c LEFT JOIN rolled o USING (media_id, speaker_label)),
risk_rows AS (SELECT *, CASE WHEN contains(risk_flags, 'very_long') OR contains(risk_flags, 'long_timing') THEN 'high'
              WHEN risk_flags <> '' THEN 'medium' ELSE 'low' END AS risk_level FROM seg_rows)
"""


@query("segment_risks", RISKS_SQL + "SELECT * FROM risk_rows")
def _(src):
    rows = sp.segment_risks(src("segments"))
    return rows.select(
        "media_id", "segment_id", "pos", "prev_label", "next_label",
        joined(F.col("risk_flags")).alias("risk_flags"), "risk_level",
    )


SIM_SQL = ROLLUP_SQL + """, sim AS (SELECT a.media_id, a.speaker_label AS a, b.speaker_label AS b, round(greatest(0.0::DOUBLE, 1.0::DOUBLE - least(abs(a.avg_ms / 1000 - b.avg_ms / 1000) / 5.0::DOUBLE, 1.0::DOUBLE)) * 0.5::DOUBLE
  + greatest(0.0::DOUBLE, 1.0::DOUBLE - abs(a.short_segment_count / a.segment_count - b.short_segment_count / b.segment_count)) * 0.3::DOUBLE + least(a.segment_count, b.segment_count) / greatest(a.segment_count, b.segment_count) * 0.2::DOUBLE, 3) AS similarity
  FROM rolled a JOIN rolled b ON a.media_id = b.media_id AND a.speaker_label < b.speaker_label),
peers AS (SELECT *, CAST(row_number() OVER (PARTITION BY media_id, a ORDER BY similarity DESC, b) AS INTEGER) AS rank, similarity >= 0.55 AS suggest_merge FROM (SELECT * FROM sim UNION ALL SELECT media_id, b, a, similarity FROM sim))
"""


def _peers(src):
    return sp.similar_peers(sp.profile_similarity(sp.speaker_rollup(src("segments"))))


@query("profile_similarity", SIM_SQL + "SELECT * FROM sim")
def _(src):
    return sp.profile_similarity(sp.speaker_rollup(src("segments")))


@query("similar_peers", SIM_SQL + "SELECT * FROM peers WHERE rank <= 3")
def _(src):
    return _peers(src)


@query("suggested_merges", SIM_SQL + "SELECT DISTINCT media_id, least(a, b) AS a, greatest(a, b) AS b FROM peers WHERE rank <= 3 AND suggest_merge")
def _(src):
    return sp.suggested_merges(_peers(src))


ALL_SQL = SIM_SQL + ", " + RISKS_SQL[len(ROLLUP_SQL) + 2:] + ", " + RUNS_SQL[RUNS_SQL.index("marked AS"):]


@query("recommended_actions", ALL_SQL + """SELECT r.media_id, 'speaker_profile' AS item_type, r.speaker_label AS item_id, CASE WHEN NOT cloneable THEN 'mark_non_cloneable' WHEN p.suggest_merge THEN 'merge_speaker' ELSE 'keep_independent' END AS action
  FROM rolled r LEFT JOIN peers p ON p.media_id = r.media_id AND p.a = r.speaker_label AND p.rank = 1
UNION ALL SELECT media_id, 'speaker_run', CAST(run_pos AS STRING), CASE WHEN contains(risk_flags, 'sandwiched_run') AND previous_speaker = next_speaker THEN 'merge_to_surrounding_speaker' WHEN contains(risk_flags, 'short_run') AND previous_speaker IS NOT NULL THEN 'relabel_to_previous_speaker'
  WHEN contains(risk_flags, 'single_segment_run') AND next_speaker IS NOT NULL THEN 'relabel_to_next_speaker' ELSE 'keep_independent' END FROM run_rows
UNION ALL SELECT media_id, 'segment', CAST(segment_id AS STRING), CASE WHEN contains(risk_flags, 'speaker_boundary_risk') AND prev_label IS NOT NULL THEN 'relabel_to_previous_speaker' WHEN contains(risk_flags, 'very_long_segment') THEN 'keep_independent'
  WHEN contains(risk_flags, 'speaker_sample_risk') AND next_label IS NOT NULL THEN 'relabel_to_next_speaker' ELSE 'keep_independent' END FROM risk_rows""")
def _(src):
    s = src("segments")
    return sp.recommended_actions(sp.speaker_rollup(s), _peers(src), sp.speaker_runs(s), sp.segment_risks(s))


@query("review_plan", ALL_SQL + """, it AS (SELECT media_id, 'speaker_profile' AS item_type, risk_flags, risk_level FROM rolled UNION ALL SELECT media_id, 'speaker_run', risk_flags, risk_level FROM run_rows UNION ALL SELECT media_id, 'segment', risk_flags, risk_level FROM risk_rows)
SELECT media_id, item_type, count(*) AS items, count(*) FILTER (risk_level = 'high') AS high_risk FROM it WHERE risk_flags <> '' GROUP BY ALL""")
def _(src):
    s = src("segments")
    return sp.review_plan(sp.speaker_rollup(s), sp.speaker_runs(s), sp.segment_risks(s))


@query("diagnostics_summary", ALL_SQL + """, a AS (SELECT media_id, count(*) AS speaker_count, CAST(sum(segment_count) AS BIGINT) AS segment_count, count(*) FILTER (risk_level = 'high') AS high_risk_speakers FROM rolled GROUP BY media_id),
b AS (SELECT media_id, count(*) AS run_count, count(*) FILTER (risk_flags <> '') AS review_runs, count(*) FILTER (risk_level = 'high') AS high_risk_runs FROM run_rows GROUP BY media_id), c AS (SELECT media_id, count(*) FILTER (risk_flags <> '') AS review_segments FROM risk_rows GROUP BY media_id)
SELECT * FROM a JOIN b USING (media_id) JOIN c USING (media_id)""")
def _(src):
    s = src("segments")
    return sp.diagnostics_summary(sp.speaker_rollup(s), sp.speaker_runs(s), sp.segment_risks(s))


@query("normalise_segments", """SELECT media_id, CASE WHEN segment_id % 6 = 0 THEN 'seg-' || lpad(CAST(segment_id % 1000 AS STRING), 4, '0') ELSE CAST(segment_id AS STRING) END AS segment_id, start_ms, end_ms, CASE WHEN segment_id % 4 = 0 THEN greatest(0, end_ms - start_ms) ELSE dur_ms END AS dur_ms,
  CASE WHEN segment_id % 5 = 0 THEN 'UNKNOWN' ELSE speaker_label END AS speaker_label, trim(text) AS text FROM segments""")
def _(src):
    k = F.col("segment_id")
    raw = src("segments").select(
        "media_id", F.when(k % 6 != 0, k.cast("string")).alias("segment_id"), (k % 1000).cast("int").alias("ord"), "start_ms", "end_ms", F.when(k % 4 == 0, -1).otherwise(F.col("dur_ms")).alias("dur_ms"),
        F.when(k % 5 == 0, F.when(k % 2 == 0, "")).otherwise(F.col("speaker_label")).alias("speaker_label"), F.concat(F.lit("  "), "text", F.lit(" ")).alias("text"))
    return sp.normalise(raw).drop("ord")
