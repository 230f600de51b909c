"""Registered queries: dub quality, scorecard and remediation."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueloom.functions.cols import joined
from cueloom.operators import quality as q
from cueloom.plans.registry import query

UNIVERSE_SQL = """
WITH uni AS (
  SELECT media_id, segment_id, coalesce(r.placed, false) AS placed,
    CASE WHEN r.segment_id IS NULL THEN 'not_synthesized' ELSE r.mix_status END AS mix_status,
    coalesce(r.speaker_id, t.speaker_label) AS speaker_id,
    coalesce(nullif(r.target_text, ''), t.target_text, '') AS target_text, coalesce(t.source_text, '') AS source_text,
    coalesce(r.start_ms, t.start_ms) AS start_ms, r.* EXCLUDE (media_id, segment_id, placed, mix_status, speaker_id,
    target_text, start_ms)
  FROM report r FULL OUTER JOIN translations t USING (media_id, segment_id)),
reads AS (SELECT media_id, segment_id, CASE WHEN h % 5 = 0 THEN '' ELSE target_text END AS backread_text FROM report
          WHERE h % 5 <> 0 AND trim(target_text) <> ''),
enriched AS (SELECT u.*, coalesce(b.backread_text, '') AS backread_text, u.generated_ms / u.source_ms AS ratio
  FROM uni u LEFT JOIN reads b USING (media_id, segment_id)),
tagged AS (
  SELECT *, concat_ws('|',
    CASE WHEN NOT placed AND (source_text <> '' OR target_text <> '') THEN 'undubbed' END,
    CASE WHEN placed AND speaker_status = 'failed' THEN 'timbre_mismatch' END,
    CASE WHEN placed AND intelligibility_status = 'failed' THEN 'low_intelligibility' END,
    CASE WHEN placed AND backread_text <> '' AND dropout_total >= 4 AND dropout_count >= 0.34 * dropout_total THEN 'dropout' END,
    CASE WHEN placed AND (duration_status = 'failed' OR ratio >= 1.45 OR fit_strategy = 'overflow_unfitted') THEN 'pacing' END,
    CASE WHEN placed AND coverage < 0.5 THEN 'inaudible' END,
    CASE WHEN judge_score < 3.0 THEN 'bad_translation' END) AS issue_tags
  FROM enriched),
ranked AS (SELECT *, CASE WHEN contains(issue_tags, 'undubbed') THEN 3
    WHEN issue_tags = '' THEN 0 WHEN issue_tags = 'pacing' THEN 1 ELSE 2 END AS severity_rank FROM tagged),
rows_ AS (SELECT *, ['ok', 'P2', 'P1', 'P0'][severity_rank + 1] AS severity FROM ranked)
"""


def _rows(src):
    report = src("report")
    reads = report.select(
        "media_id", "segment_id", F.lit(1).alias("report_ord"),
        F.when(F.col("h") % 5 == 0, "").otherwise(F.col("target_text")).alias("backread_text"),
    )
    judge = report.select("media_id", "segment_id", "judge_score")
    # read-backs and judge scores are the report's own, so they meet its lines before the translations do
    known = q.enrich(q.rendered(report.drop("judge_score")), q.first_backread(reads), judge)
    return q.tag_rows(q.with_translations(known, src("translations")))


@query("qa_rows", UNIVERSE_SQL + """SELECT media_id, segment_id, placed, mix_status, speaker_id, target_text, source_text,
  start_ms, backread_text, issue_tags, severity FROM rows_""")
def _(src):
    return _rows(src).select(
        "media_id", "segment_id", "placed", "mix_status", "speaker_id", "target_text", "source_text", "start_ms",
        "backread_text", joined(F.col("issue_tags")).alias("issue_tags"), "severity",
    )


@query("qa_summary", UNIVERSE_SQL + """, agg AS (SELECT media_id, count(*) AS segment_count,
  count(*) FILTER (issue_tags <> '') AS problem_segment_count,
  count(*) FILTER (contains(issue_tags, 'undubbed')) AS n_undubbed,
  count(*) FILTER (contains(issue_tags, 'timbre_mismatch')) AS n_timbre_mismatch,
  count(*) FILTER (contains(issue_tags, 'low_intelligibility')) AS n_low_intelligibility,
  count(*) FILTER (contains(issue_tags, 'dropout')) AS n_dropout, count(*) FILTER (contains(issue_tags, 'inaudible')) AS n_inaudible,
  count(*) FILTER (contains(issue_tags, 'bad_translation')) AS n_bad_translation,
  count(*) FILTER (contains(issue_tags, 'pacing')) AS n_pacing,
  count(*) FILTER (severity = 'P0') AS "n_P0", count(*) FILTER (severity = 'P1') AS "n_P1",
  count(*) FILTER (severity = 'P2') AS "n_P2", count(*) FILTER (severity = 'ok') AS n_ok,
  count(*) FILTER (placed) AS dubbed_count,
  avg(CASE WHEN dropout_total >= 4 THEN dropout_count / dropout_total END) AS dropout_avg,
  count(judge_score) AS judge_scored, avg(judge_score) AS judge_avg, min(judge_score) AS judge_min,
  count(*) FILTER (placed AND ratio > 1) AS overflow_count, count(*) FILTER (placed AND ratio >= 1.45) AS severe_overflow_count,
  count(*) FILTER (placed AND fit_strategy = 'overflow_unfitted') AS unfitted_count,
  max(CASE WHEN placed AND ratio > 1 THEN ratio END) AS max_ratio, avg(CASE WHEN placed AND ratio > 1 THEN ratio END) AS avg_overflow_ratio,
  CAST(coalesce(sum(CASE WHEN placed AND fit_strategy = 'overflow_unfitted' THEN greatest(0, generated_ms - fitted_ms) END), 0) AS BIGINT) AS cut_audio_ms,
  CAST(coalesce(sum(CASE WHEN placed AND fit_strategy = 'overflow_unfitted' AND trimmed_tail_ms > 0 AND trimmed_speech_ms > 0 THEN trimmed_speech_ms END), 0) AS BIGINT) AS lost_speech_ms,
  count(*) FILTER (placed AND fit_strategy = 'overflow_unfitted' AND trimmed_tail_ms > 0 AND coalesce(trimmed_speech_ms, 0) <= 0) AS silence_only_trims
  FROM rows_ GROUP BY media_id)
SELECT * EXCLUDE (dropout_avg, judge_avg, avg_overflow_ratio), round(dropout_avg, 10) AS dropout_avg, round(judge_avg, 10) AS judge_avg,
  round(avg_overflow_ratio, 10) AS avg_overflow_ratio, segment_count - dubbed_count AS undubbed_count,
  greatest(0.0::DOUBLE, 100.0::DOUBLE - least(40.0::DOUBLE, cut_audio_ms / 1000) - least(35.0::DOUBLE, severe_overflow_count / segment_count * 60.0::DOUBLE)
    - least(25.0::DOUBLE, (segment_count - dubbed_count) / segment_count * 60.0::DOUBLE)) AS perceptual_score
FROM agg""")
def _(src):
    out = q.qa_summary(_rows(src))
    for name in ("dropout_avg", "judge_avg", "avg_overflow_ratio"):
        out = out.withColumn(name, F.round(name, 10))
    return out


@query("status_counts", """
SELECT media_id, field, value, count(*) AS cnt FROM (
  SELECT media_id, unnest(['overall_status','duration_status','speaker_status','intelligibility_status','mix_status']) AS field,
    unnest([overall_status, duration_status, speaker_status, intelligibility_status, mix_status]) AS value FROM report)
GROUP BY ALL""")
def _(src):
    return q.status_counts(src("report"))


@query("quality_averages", """
SELECT media_id, count(*) AS total_count, round(avg(speaker_similarity), 10) AS avg_speaker_similarity,
  round(avg(text_similarity), 10) AS avg_text_similarity, round(avg(quality_score), 10) AS avg_quality_score,
  round(avg(generated_ms / source_ms), 10) AS avg_duration_ratio,
  round(quantile_cont(speaker_similarity, 0.5), 10) AS median_speaker_similarity,
  round(quantile_cont(text_similarity, 0.5), 10) AS median_text_similarity,
  round(quantile_cont(quality_score, 0.5), 10) AS median_quality_score FROM report GROUP BY media_id""")
def _(src):
    out = q.quality_averages(src("report"))
    return out.select("media_id", "total_count", *[F.round(c, 10).alias(c) for c in out.columns[2:]])


@query("flag_token_counts", UNIVERSE_SQL + """, t AS (SELECT media_id, unnest(string_split(issue_tags, '|')) AS token
  FROM rows_ WHERE issue_tags <> '')
SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY cnt DESC, token) AS rank
FROM (SELECT media_id, token, count(*) AS cnt FROM t GROUP BY ALL)""")
def _(src):
    return q.token_counts(_rows(src), "issue_tags")


@query("failure_combinations", """
SELECT media_id, coalesce(nullif(concat_ws('+', CASE WHEN duration_status = 'failed' THEN 'duration' END,
  CASE WHEN speaker_status = 'failed' THEN 'speaker' END, CASE WHEN intelligibility_status = 'failed' THEN 'intelligibility' END), ''),
  'overall') AS reason, count(*) AS cnt FROM report WHERE overall_status = 'failed' GROUP BY ALL""")
def _(src):
    return q.failure_combinations(src("report"))


@query("audible_coverage", """
SELECT media_id, count(*) AS window_count, count(*) FILTER (coalesce(coverage, 0) < 0.5) AS failed_count,
  min(coalesce(coverage, 0)) AS min_coverage, round(avg(coalesce(coverage, 0)), 10) AS avg_coverage
FROM report WHERE has_window GROUP BY media_id""")
def _(src):
    return q.audible_coverage(src("report")).withColumn("avg_coverage", F.round("avg_coverage", 10))


@query("audible_failures", "SELECT media_id, segment_id FROM report WHERE has_window AND coalesce(coverage, 0) < 0.5")
def _(src):
    return q.audible_failures(src("report"))


@query("mix_counts", """
SELECT media_id, CASE WHEN placed THEN 'fit_strategy' ELSE 'skip_reason' END AS kind,
  CASE WHEN placed THEN fit_strategy ELSE mix_status END AS value, count(*) AS cnt FROM report GROUP BY ALL""")
def _(src):
    return q.mix_counts(src("report"))


@query("content_quality", """
WITH a AS (SELECT media_id, count(*) AS total_count, count(*) FILTER (placed) AS placed_count,
  count(*) FILTER (overall_status = 'failed') AS overall_failed, count(*) FILTER (speaker_status = 'failed') AS speaker_failed,
  count(*) FILTER (intelligibility_status = 'failed') AS intelligibility_failed,
  count(*) FILTER (has_window AND coalesce(coverage, 0) < 0.5) AS audible_failed FROM report GROUP BY media_id),
b AS (SELECT *, concat_ws('|', CASE WHEN placed_count < total_count THEN 'coverage_below_deliverable_threshold' END,
  CASE WHEN overall_failed / total_count > 0.05 THEN 'upstream_failed_segments' END,
  CASE WHEN speaker_failed / total_count > 0.10 THEN 'speaker_similarity_failed' END,
  CASE WHEN intelligibility_failed / total_count > 0.10 THEN 'intelligibility_failed' END,
  CASE WHEN audible_failed > 0 THEN 'audible_coverage_failed' END) AS reasons FROM a)
SELECT *, CASE WHEN total_count - placed_count > total_count * 0.2 OR audible_failed > 0 THEN 'blocked'
  WHEN reasons <> '' THEN 'review_required' ELSE 'deliverable' END AS status FROM b""")
def _(src):
    return q.content_quality(src("report")).withColumn("reasons", joined(F.col("reasons")))


CHARACTER_SQL = """
characters AS (
  SELECT media_id, speaker_id, count(*) AS segment_count, count(*) FILTER (speaker_status = 'failed') AS speaker_failed,
    count(*) FILTER (overall_status = 'failed') AS overall_failed, count(*) FILTER (audio_path <> '' AND
      abs((CASE WHEN 90 + h % 200 < 145 THEN 0 WHEN 90 + h % 200 <= 215 THEN 1 ELSE 2 END)
        - (CASE WHEN 90 + CAST(speaker_id[5:] AS INT) * 23 < 145 THEN 0 WHEN 90 + CAST(speaker_id[5:] AS INT) * 23 <= 215 THEN 1 ELSE 2 END)) >= 2
      AND speaker_id <> 'spk_4') AS voice_mismatch_count
  FROM report GROUP BY ALL),
char_flags AS (SELECT *, speaker_failed / segment_count AS speaker_failed_ratio,
  concat_ws('|', CASE WHEN speaker_id = 'spk_4' THEN 'reference_voice_unknown' END,
    CASE WHEN speaker_failed / segment_count >= 0.2 THEN 'speaker_similarity_failed' END,
    CASE WHEN voice_mismatch_count > 0 THEN 'pitch_class_drift' END) AS risk_flags FROM characters),
ledger AS (SELECT *, CASE WHEN contains(risk_flags, 'reference_voice_unknown') AND contains(risk_flags, '|') THEN 'blocked'
  WHEN risk_flags <> '' THEN 'review' ELSE 'passed' END AS review_status FROM char_flags)
"""


def _ledger(src):
    from cueloom.operators import voices

    report = src("report").withColumn("pitch_hz", (90 + F.col("h") % 200).cast("double"))
    number = F.substring("speaker_id", 5, 9).cast("int")
    profiles = report.select("media_id", "speaker_id").distinct().withColumn(
        "reference_pitch_hz", F.when(F.col("speaker_id") != "spk_4", (90 + number * 23).cast("double"))
    )
    return voices.character_ledger(report, profiles)


@query("character_ledger", "WITH " + CHARACTER_SQL + "SELECT * FROM ledger")
def _(src):
    return _ledger(src).withColumn("risk_flags", joined(F.col("risk_flags")))


SCORE_SQL = "WITH " + CHARACTER_SQL + """,
base AS (SELECT media_id, count(*) AS total_count, count(*) FILTER (placed) AS placed_count,
  count(*) FILTER (has_window AND coalesce(coverage, 0) < 0.5) AS audible_failed,
  count(*) FILTER (overall_status = 'failed') AS overall_failed, count(*) FILTER (speaker_status = 'failed') AS speaker_failed,
  count(*) FILTER (intelligibility_status = 'failed') AS intelligibility_failed FROM report GROUP BY media_id),
chars AS (SELECT media_id, count(*) FILTER (review_status = 'review') AS char_review, count(*) FILTER (review_status = 'blocked') AS char_blocked,
  CAST(sum(voice_mismatch_count) AS BIGINT) AS voice_mismatch FROM ledger GROUP BY media_id),
man AS (SELECT media_id, count(*) AS manual_required FROM report WHERE h % 97 = 0 GROUP BY media_id),
metrics AS (SELECT b.*, coalesce(char_review, 0) AS char_review, coalesce(char_blocked, 0) AS char_blocked,
  coalesce(voice_mismatch, 0) AS voice_mismatch, coalesce(manual_required, 0) AS manual_required
  FROM base b LEFT JOIN chars USING (media_id) LEFT JOIN man USING (media_id)),
gate_rows AS (SELECT media_id,
  unnest(['coverage','speaker_consistency','character_voice','repair_tournament','undubbed_coverage']) AS gate,
  unnest([CASE WHEN placed_count / total_count >= 0.98 AND audible_failed = 0 THEN 'passed' ELSE 'failed' END,
    CASE WHEN speaker_failed / total_count <= 0.15 THEN 'passed' ELSE 'review' END,
    CASE WHEN char_blocked > 0 THEN 'failed' WHEN char_review > 0 THEN 'review' ELSE 'passed' END,
    CASE WHEN manual_required > 0 THEN 'review' ELSE 'passed' END,
    CASE WHEN total_count = placed_count THEN 'passed' ELSE 'failed' END]) AS gate_status,
  unnest([placed_count / total_count, speaker_failed / total_count, char_review::DOUBLE, manual_required::DOUBLE,
    (total_count - placed_count)::DOUBLE]) AS gate_value FROM metrics)
"""


def _metrics(src):
    report = src("report")
    return q.scorecard_metrics(report, _ledger(src), report.filter("h % 97 = 0"))


@query("scorecard", SCORE_SQL + """, r AS (SELECT *, placed_count / total_count AS cov FROM metrics)
SELECT * EXCLUDE (cov), concat_ws('|', CASE WHEN cov < 0.98 THEN 'coverage_below_deliverable_threshold' END,
  CASE WHEN audible_failed > 0 THEN 'audible_coverage_failed' END,
  CASE WHEN overall_failed / total_count > 0.05 THEN 'upstream_failed_segments' END,
  CASE WHEN speaker_failed / total_count > 0.15 THEN 'speaker_similarity_failed' END,
  CASE WHEN intelligibility_failed / total_count > 0.10 THEN 'intelligibility_failed' END,
  CASE WHEN char_blocked > 0 THEN 'character_voice_blocked' END,
  CASE WHEN char_review > 0 OR voice_mismatch > 0 THEN 'character_voice_review_required' END,
  CASE WHEN manual_required > 0 THEN 'repair_manual_required' END) AS reasons,
  CASE WHEN cov < 0.98 OR audible_failed > 0 OR char_blocked > 0 THEN 'blocked'
    WHEN overall_failed / total_count > 0.05 OR speaker_failed / total_count > 0.15 OR intelligibility_failed / total_count > 0.10
      OR char_review > 0 OR voice_mismatch > 0 OR manual_required > 0 THEN 'review_required' ELSE 'deliverable_candidate' END AS status,
  greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100.0::DOUBLE - (greatest(0.0::DOUBLE, 1.0::DOUBLE - cov) * 60.0::DOUBLE + least(30.0::DOUBLE, audible_failed * 10.0::DOUBLE)
    + overall_failed / total_count * 20.0::DOUBLE + speaker_failed / total_count * 25.0::DOUBLE + intelligibility_failed / total_count * 25.0::DOUBLE
    + least(20.0::DOUBLE, char_review * 4.0::DOUBLE) + least(25.0::DOUBLE, char_blocked * 10.0::DOUBLE) + least(20.0::DOUBLE, voice_mismatch * 5.0::DOUBLE)
    + least(15.0::DOUBLE, manual_required * 3.0::DOUBLE)))) AS score FROM r""")
def _(src):
    return q.scorecard(_metrics(src)).withColumn("reasons", joined(F.col("reasons")))


@query("scorecard_gates", SCORE_SQL + "SELECT * FROM gate_rows")
def _(src):
    return q.gates(_metrics(src))


DIRECTIVE_SQL = UNIVERSE_SQL + """, found AS (SELECT *, CASE WHEN contains(issue_tags, 'undubbed') THEN 'fill_undubbed'
  WHEN contains(issue_tags, 'inaudible') THEN 'refit_timeline' WHEN contains(issue_tags, 'timbre_mismatch') THEN 'switch_voice'
  WHEN contains(issue_tags, 'dropout') OR contains(issue_tags, 'low_intelligibility') THEN 'resynthesize'
  WHEN contains(issue_tags, 'pacing') AND (fit_strategy = 'overflow_unfitted' OR ratio > 1.3) THEN 'rewrite_translation'
  WHEN contains(issue_tags, 'pacing') THEN 'refit_timeline' ELSE 'retranslate' END AS action FROM rows_ WHERE issue_tags <> ''),
directive AS (SELECT *, CASE action WHEN 'fill_undubbed' THEN 'rerun' WHEN 'retranslate' THEN 'rerun' WHEN 'refit_timeline' THEN 'render'
  ELSE 'repair' END AS executor, action NOT IN ('fill_undubbed', 'retranslate') AS auto_fixable,
  CASE action WHEN 'rewrite_translation' THEN 'rewrite_for_dubbing' WHEN 'resynthesize' THEN 'regenerate_candidates'
    WHEN 'switch_voice' THEN 'switch_reference_audio' END AS repair_action, severity_rank AS gain FROM found)
"""


@query("remediation_directives", DIRECTIVE_SQL + """SELECT media_id, segment_id, action, executor, auto_fixable, repair_action,
  gain, severity FROM directive""")
def _(src):
    return q.directives(_rows(src)).select(
        "media_id", "segment_id", "action", "executor", "auto_fixable", "repair_action", "gain", "severity"
    )


@query("remediation_rollup", DIRECTIVE_SQL + """, g AS (SELECT media_id, action, executor, auto_fixable, count(*) AS cnt,
  CAST(sum(gain) AS BIGINT) AS total_gain FROM directive GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY media_id
  ORDER BY auto_fixable DESC, total_gain DESC, cnt DESC, action) AS rank FROM g) SELECT *, rank <= 3 AS next_best FROM n""")
def _(src):
    return q.remediation_rollup(q.directives(_rows(src)))


BLOCKER_SQL = SCORE_SQL + ", " + DIRECTIVE_SQL.strip()[5:] + """, cause AS (SELECT media_id,
  count(*) FILTER (contains(issue_tags, 'inaudible') OR contains(issue_tags, 'undubbed')) AS c1,
  count(*) FILTER (contains(issue_tags, 'undubbed')) AS c2, count(*) FILTER (contains(issue_tags, 'timbre_mismatch')) AS c3
  FROM directive GROUP BY media_id)
"""


@query("delivery_blockers", BLOCKER_SQL + """SELECT media_id, gate, gate_status, coalesce(CASE gate WHEN 'coverage' THEN c1
  WHEN 'undubbed_coverage' THEN c2 WHEN 'speaker_consistency' THEN c3 WHEN 'character_voice' THEN c3 END, 0) AS cnt
  FROM gate_rows LEFT JOIN cause USING (media_id) WHERE gate_status IN ('failed', 'review')""")
def _(src):
    return q.delivery_blockers(q.gates(_metrics(src)), q.directives(_rows(src)))


@query("blocker_segments", BLOCKER_SQL + """SELECT g.media_id, g.gate, d.segment_id FROM gate_rows g JOIN directive d USING (media_id)
  WHERE gate_status IN ('failed', 'review') AND CASE gate WHEN 'coverage' THEN contains(issue_tags, 'inaudible') OR contains(issue_tags, 'undubbed')
  WHEN 'undubbed_coverage' THEN contains(issue_tags, 'undubbed') WHEN 'speaker_consistency' THEN contains(issue_tags, 'timbre_mismatch')
  WHEN 'character_voice' THEN contains(issue_tags, 'timbre_mismatch') ELSE false END""")
def _(src):
    return q.blocker_segments(q.gates(_metrics(src)), q.directives(_rows(src)))


@query("selected_override", """
WITH sel AS (SELECT media_id, segment_id, 'spk_new' AS speaker_id, '' AS target_text, CASE WHEN h % 2 = 0 THEN 777 ELSE 0 END AS generated_ms,
  'passed' AS duration_status, NULL AS speaker_similarity, text_similarity / 2 AS text_similarity, 'fix/' || segment_id AS audio_path
  FROM report WHERE h % 6 = 2)
SELECT r.media_id, r.segment_id, coalesce(s.speaker_id, r.speaker_id) AS speaker_id, r.target_text,
  coalesce(nullif(s.generated_ms, 0), r.generated_ms) AS generated_ms, coalesce(s.duration_status, r.duration_status) AS duration_status,
  CASE WHEN s.segment_id IS NULL THEN r.speaker_similarity END AS speaker_similarity,
  CASE WHEN s.segment_id IS NULL THEN r.text_similarity ELSE s.text_similarity END AS text_similarity,
  coalesce(s.audio_path, r.audio_path) AS audio_path FROM report r LEFT JOIN sel s USING (media_id, segment_id)""")
def _(src):
    report = src("report")
    selected = report.filter("h % 6 = 2").select(
        "media_id", "segment_id", F.lit("spk_new").alias("speaker_id"), F.lit("").alias("target_text"),
        F.when(F.col("h") % 2 == 0, F.lit(777)).otherwise(F.lit(0)).cast("long").alias("generated_ms"),
        F.lit("passed").alias("duration_status"), F.lit(None).cast("double").alias("speaker_similarity"),
        (F.col("text_similarity") / 2).alias("text_similarity"), F.lit(None).cast("string").alias("speaker_status"),
        F.lit(None).cast("string").alias("intelligibility_status"), F.lit(None).cast("string").alias("overall_status"),
        F.concat(F.lit("fix/"), "segment_id").alias("audio_path"),
    )
    return q.override_selected(report, selected).select(
        "media_id", "segment_id", "speaker_id", "target_text", "generated_ms", "duration_status", "speaker_similarity",
        "text_similarity", "audio_path",
    )
