"""Registered queries: voice rules, repair planning, timeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueloom.functions.cols import joined
from cueloom.operators import repair as rp
from cueloom.operators import timeline as tl
from cueloom.operators import voices as vc
from cueloom.plans.registry import query
from cueloom.session import as_table


def _ratio():
    return F.col("generated_ms") / F.col("source_ms")


@query("status_tiers", """
WITH s AS (SELECT media_id, segment_id, h, CASE WHEN speaker_similarity IS NULL THEN 'review' WHEN speaker_similarity >= 0.45 THEN 'passed'
    WHEN speaker_similarity >= 0.25 THEN 'review' ELSE 'failed' END AS speaker,
  CASE WHEN text_similarity >= 0.9 THEN 'passed' WHEN text_similarity >= 0.7 THEN 'review' ELSE 'failed' END AS intelligibility,
  CASE WHEN generated_ms / source_ms BETWEEN 0.7 AND 1.35 THEN 'passed' WHEN generated_ms / source_ms BETWEEN 0.55 AND 1.65 THEN 'review'
    ELSE 'failed' END AS duration FROM report)
SELECT media_id, segment_id, speaker, intelligibility, duration, CASE WHEN 'failed' IN (speaker, intelligibility, duration) THEN 'failed'
  WHEN 'review' IN (speaker, intelligibility, duration) THEN 'review' ELSE 'passed' END AS overall FROM s""")
def _(src):
    rows = src("report").select(
        "media_id", "segment_id", vc.speaker_status(F.col("speaker_similarity")).alias("speaker"),
        vc.intelligibility_status(F.col("text_similarity")).alias("intelligibility"), vc.duration_status(_ratio()).alias("duration"))
    return rows.withColumn("overall", vc.worst_status(F.col("speaker"), F.col("intelligibility"), F.col("duration")))


@query("retry_reasons", """
SELECT media_id, segment_id, concat_ws('|', CASE WHEN duration_status = 'failed' AND (generated_ms / source_ms >= 2.0 OR
  (generated_ms > 0 AND generated_ms / source_ms <= 0.45)) THEN 'pathological_duration' END,
  CASE WHEN intelligibility_status = 'failed' AND text_similarity < 0.6 THEN 'poor_backread' END,
  CASE WHEN speaker_status = 'failed' AND (speaker_similarity IS NULL OR speaker_similarity < 0.35) THEN 'poor_speaker_match' END) AS reasons
FROM report""")
def _(src):
    return src("report").select("media_id", "segment_id", joined(vc.retry_reasons(_ratio())).alias("reasons"))


SCORE_SQL = """(CASE overall_status WHEN 'passed' THEN 2.0::DOUBLE WHEN 'review' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END * 100.0::DOUBLE
  + CASE duration_status WHEN 'passed' THEN 2.0::DOUBLE WHEN 'review' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END * 24.0::DOUBLE
  + CASE intelligibility_status WHEN 'passed' THEN 2.0::DOUBLE WHEN 'review' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END * 18.0::DOUBLE
  + CASE speaker_status WHEN 'passed' THEN 2.0::DOUBLE WHEN 'review' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END * 24.0::DOUBLE
  + greatest(0.0::DOUBLE, 1.0::DOUBLE - abs(1.0::DOUBLE - generated_ms / source_ms)) + coalesce(text_similarity, 0.0::DOUBLE)
  + coalesce(speaker_similarity, 0.0::DOUBLE) * 8.0::DOUBLE)"""
LINE_ATTEMPTS = """line_attempts AS (SELECT media_id, split_part(segment_id, '-', 1) AS line_id, * EXCLUDE (media_id) FROM attempts)"""


def _line_attempts(src):
    return src("attempts").withColumn("segment_id", F.split_part("segment_id", F.lit("-"), F.lit(1)))


@query("best_attempts", "WITH " + LINE_ATTEMPTS + f"""
SELECT media_id, line_id AS segment_id, arg_max(attempt_id, (score, -attempt_no, attempt_id)) AS attempt_id, max(score) AS score
FROM (SELECT *, {SCORE_SQL} AS score FROM line_attempts) GROUP BY ALL""")
def _(src):
    return vc.best_attempts(_line_attempts(src))


BASELINE = """(CASE overall_status WHEN 'passed' THEN 2.5::DOUBLE WHEN 'review' THEN 1.2::DOUBLE ELSE 0.0::DOUBLE END
  + greatest(0.0::DOUBLE, 1.0::DOUBLE - abs(1.0::DOUBLE - generated_ms / source_ms)) * 0.3::DOUBLE
  + greatest(0.0::DOUBLE, coalesce(speaker_similarity, 0.0::DOUBLE)) * 0.25::DOUBLE
  + greatest(0.0::DOUBLE, coalesce(text_similarity, 0.0::DOUBLE)) * 0.35::DOUBLE)"""


@query("select_repairs", "WITH " + LINE_ATTEMPTS + f""",
base AS (SELECT media_id, line_id, min({BASELINE}) AS baseline_score FROM line_attempts WHERE NOT selected GROUP BY ALL),
cand AS (SELECT media_id, line_id, arg_max(attempt_id, (s, -w, -attempt_no)) AS attempt_id, max(s) AS s FROM (SELECT *, {BASELINE} AS s,
  CASE overall_status WHEN 'passed' THEN 0 WHEN 'review' THEN 1 WHEN 'failed' THEN 2 ELSE 3 END AS w FROM line_attempts
  WHERE strict_accepted AND status = 'candidate') GROUP BY ALL)
SELECT b.media_id, b.line_id AS segment_id, baseline_score, CASE WHEN c.s >= baseline_score + 0.05::DOUBLE THEN attempt_id END AS selected_attempt_id
FROM base b LEFT JOIN cand c ON b.media_id = c.media_id AND b.line_id = c.line_id""")
def _(src):
    attempts = _line_attempts(src)
    base = attempts.filter("NOT selected").groupBy("media_id", "segment_id").agg(
        F.min(vc.baseline_score(_ratio())).alias("baseline_score"))
    return vc.select_repairs(attempts, base)


METRICS_SQL = """WITH m AS (SELECT media_id, reference_path, count(*) AS attempt_count, count(*) FILTER (selected) AS selected_count,
  count(*) FILTER (overall_status = 'passed') AS overall_passed, count(*) FILTER (overall_status = 'review') AS overall_review, count(*) FILTER (overall_status = 'failed') AS overall_failed,
  count(*) FILTER (duration_status = 'passed') AS duration_passed, count(*) FILTER (duration_status = 'review') AS duration_review, count(*) FILTER (duration_status = 'failed') AS duration_failed,
  count(*) FILTER (speaker_status = 'passed') AS speaker_passed, count(*) FILTER (speaker_status = 'review') AS speaker_review, count(*) FILTER (speaker_status = 'failed') AS speaker_failed,
  count(*) FILTER (intelligibility_status = 'passed') AS intelligibility_passed, count(*) FILTER (intelligibility_status = 'review') AS intelligibility_review, count(*) FILTER (intelligibility_status = 'failed') AS intelligibility_failed,
  round(avg(speaker_similarity), 10) AS avg_speaker_similarity, round(avg(text_similarity), 10) AS avg_text_similarity,
  round(quantile_cont(round(generated_ms / source_ms, 4), 0.5), 3) AS median_duration_ratio FROM attempts GROUP BY ALL)"""


def _reference_metrics(src):
    out = vc.reference_metrics(src("attempts"))
    for name, digits in (("avg_speaker_similarity", 10), ("avg_text_similarity", 10), ("median_duration_ratio", 3)):
        out = out.withColumn(name, F.round(name, digits))
    return out


@query("reference_metrics", METRICS_SQL + " SELECT * FROM m")
def _(src):
    return _reference_metrics(src)


@query("benchmark_weighted_score", METRICS_SQL + """, b AS (SELECT *, ((overall_passed + overall_review * 0.55::DOUBLE) / attempt_count * 0.26::DOUBLE
    + (duration_passed + duration_review * 0.55::DOUBLE) / attempt_count * 0.18::DOUBLE + (speaker_passed + speaker_review * 0.55::DOUBLE) / attempt_count * 0.18::DOUBLE
    + (intelligibility_passed + intelligibility_review * 0.55::DOUBLE) / attempt_count * 0.14::DOUBLE
    + least(1.0::DOUBLE, coalesce(avg_speaker_similarity, 0.0::DOUBLE) / 0.45::DOUBLE) * 0.14::DOUBLE + coalesce(avg_text_similarity, 0.0::DOUBLE) * 0.10::DOUBLE)
    * least(1.0::DOUBLE, attempt_count / 8.0::DOUBLE) AS benchmark_score, least(0.62::DOUBLE, 0.28::DOUBLE + attempt_count * 0.035::DOUBLE) AS w FROM m)
SELECT media_id, reference_path, round(benchmark_score, 9) AS benchmark_score, round(0.5::DOUBLE * (1.0::DOUBLE - w) + benchmark_score * w, 9) AS quality_score FROM b""")
def _(src):
    out = vc.benchmark_score(_reference_metrics(src).withColumn("base_score", F.lit(0.5)))
    return out.select("media_id", "reference_path", F.round("benchmark_score", 9).alias("benchmark_score"),
                      F.round("quality_score", 9).alias("quality_score"))


CLIPS_SQL = """clips AS (SELECT media_id, speaker_label AS speaker_id, ord, CAST(media_id AS STRING) || '_clip_' || CAST(ord AS STRING) AS reference_id,
  end_ms - start_ms AS dur_ms, (end_ms - start_ms) / 1000 AS sec, text, ((media_id * 7 + ord * 3) % 60) / 100.0::DOUBLE AS rms FROM cues)"""


def _clips(src):
    return src("cues").select(
        "media_id", F.col("speaker_label").alias("speaker_id"), "ord",
        F.concat(F.col("media_id").cast("string"), F.lit("_clip_"), F.col("ord").cast("string")).alias("reference_id"),
        (F.col("end_ms") - F.col("start_ms")).alias("dur_ms"), ((F.col("end_ms") - F.col("start_ms")) / 1000).alias("sec"),
        "text", (((F.col("media_id") * 7 + F.col("ord") * 3) % 60) / 100.0).alias("rms"))


COMPACT = "length(regexp_replace(text, '\\s+', '', 'g'))"
LAUGH = "regexp_matches(lower(text), '(哈哈|呵呵|hahaha|lol)')"


@query("synthesis_reference_score", "WITH " + CLIPS_SQL + f"""
SELECT media_id, ord, round((CASE WHEN sec BETWEEN 8.0 AND 10.5 THEN 1.0 WHEN sec >= 5.0 AND sec < 8.0 THEN 0.7 WHEN sec > 10.5 AND sec <= 12.0 THEN 0.8
  WHEN sec > 12.0 AND sec <= 15.0 THEN greatest(0.1::DOUBLE, 0.6 - (sec - 12.0) * 0.18) ELSE 0.0 END)::DOUBLE * 0.5::DOUBLE
  + (CASE WHEN {COMPACT} >= 16 THEN 1.0 WHEN {COMPACT} >= 8 THEN 0.8 WHEN {COMPACT} >= 4 THEN 0.55 ELSE 0.2 END)::DOUBLE * 0.3::DOUBLE
  + (CASE WHEN rms BETWEEN 0.02 AND 0.25 THEN 1.0 WHEN rms BETWEEN 0.01 AND 0.35 THEN 0.7 WHEN rms BETWEEN 0.005 AND 0.5 THEN 0.4 ELSE 0.1 END)::DOUBLE * 0.2::DOUBLE
  - (CASE WHEN {LAUGH} THEN 0.15 ELSE 0.0 END)::DOUBLE, 9) AS score FROM clips""")
def _(src):
    return _clips(src).select("media_id", "ord", F.round(vc.synthesis_reference_score(F.col("sec"), F.col("text"), F.col("rms")), 9).alias("score"))


BANK_SQL = "WITH " + CLIPS_SQL + f""", risky AS (SELECT *, concat_ws('|', CASE WHEN sec < 2.0 THEN 'too_short_for_auto_clone' WHEN sec < 5.0 THEN 'short_reference' END,
  CASE WHEN sec > 11.0 THEN 'long_reference_will_be_trimmed' END, CASE WHEN sec > 15.0 THEN 'too_long_for_auto_clone' END,
  CASE WHEN rms <= 0.005 THEN 'low_rms' END, CASE WHEN rms >= 0.45 THEN 'high_rms' END,
  CASE WHEN regexp_matches(lower(text), '[!！?？~]{{2,}}') OR {LAUGH} THEN 'expressive_or_laughter' END) AS risk_flags FROM clips),
bank AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (CASE WHEN sec BETWEEN 8.0 AND 10.5 THEN 1.0 WHEN sec >= 5.0 AND sec < 8.0 THEN 0.72 WHEN sec > 10.5 AND sec <= 12.0 THEN 0.86
    WHEN sec > 12.0 AND sec <= 15.0 THEN 0.66 WHEN sec >= 2.0 AND sec < 5.0 THEN 0.42 ELSE 0.1 END)::DOUBLE * 0.42::DOUBLE
  + (CASE WHEN {COMPACT} >= 24 THEN 1.0 WHEN {COMPACT} >= 16 THEN 0.86 WHEN {COMPACT} >= 8 THEN 0.66 WHEN {COMPACT} >= 4 THEN 0.42 ELSE 0.15 END)::DOUBLE * 0.28::DOUBLE
  + (CASE WHEN rms BETWEEN 0.02 AND 0.22 THEN 1.0 WHEN rms BETWEEN 0.01 AND 0.32 THEN 0.76 WHEN rms BETWEEN 0.005 AND 0.45 THEN 0.48 ELSE 0.16 END)::DOUBLE * 0.20::DOUBLE
  + (1.0::DOUBLE - least(0.45::DOUBLE, len(list_filter(string_split(risk_flags, '|'), lambda x: x <> '' AND x <> 'long_reference_will_be_trimmed')) * 0.08::DOUBLE)) * 0.10::DOUBLE)) AS heuristic_score FROM risky)
"""


def _bank(src):
    rows = _clips(src).withColumn("risk_flags", vc.reference_risks(F.col("sec"), F.col("text"), F.col("rms")))
    return rows.withColumn("heuristic_score", vc.bank_reference_score(F.col("sec"), F.col("text"), F.col("rms"), F.col("risk_flags")))


@query("bank_reference_score", BANK_SQL + "SELECT media_id, ord, risk_flags, round(heuristic_score, 9) AS heuristic_score FROM bank")
def _(src):
    return _bank(src).select("media_id", "ord", joined(F.col("risk_flags")).alias("risk_flags"),
                             F.round("heuristic_score", 9).alias("heuristic_score"))


RECOMMEND_SQL = BANK_SQL + """, q AS (SELECT *, round(heuristic_score, 6) AS quality_score, CASE WHEN ord % 3 = 0 THEN 0.5 END AS benchmark_score FROM bank),
t AS (SELECT *, CASE WHEN contains(risk_flags, 'too_short') OR contains(risk_flags, 'too_long') OR contains(risk_flags, 'low_rms') THEN 2 ELSE 0 END AS tier FROM q),
reco AS (SELECT media_id, speaker_id, arg_min(reference_id, (tier, CASE WHEN tier < 2 THEN -quality_score ELSE 0.0 END, ord)) AS reference_id, min(tier) AS tier FROM t GROUP BY ALL)
"""


def _recommended(src):
    rows = _bank(src).withColumn("quality_score", F.round("heuristic_score", 6)).withColumn(
        "benchmark_score", F.when(F.col("ord") % 3 == 0, 0.5))
    return rows, vc.recommended_reference(rows)


@query("recommended_reference", RECOMMEND_SQL + "SELECT * FROM reco")
def _(src):
    return _recommended(src)[1]


@query("voice_bank_status", RECOMMEND_SQL + """, n AS (SELECT media_id, speaker_id, count(*) AS reference_count FROM clips GROUP BY ALL),
s AS (SELECT n.*, CASE WHEN contains(b.risk_flags, 'short_reference') THEN 'review' ELSE 'available' END AS bank_status FROM n
  JOIN reco r USING (media_id, speaker_id) JOIN bank b ON b.media_id = r.media_id AND b.reference_id = r.reference_id)
SELECT media_id, bank_status, count(*) AS speaker_count, CAST(sum(reference_count) AS BIGINT) AS reference_count FROM s GROUP BY ALL""")
def _(src):
    rows, best = _recommended(src)
    counts = rows.groupBy("media_id", "speaker_id").agg(F.count(F.lit(1)).alias("reference_count"))
    picked = best.join(rows.select("media_id", "reference_id", "risk_flags"), ["media_id", "reference_id"])
    status = vc.bank_status(F.col("reference_id"), F.col("reference_count"), F.col("speaker_id"), F.col("risk_flags"))
    return (counts.join(picked, ["media_id", "speaker_id"], "left").withColumn("bank_status", status)
            .groupBy("media_id", "bank_status").agg(F.count(F.lit(1)).alias("speaker_count"), F.sum("reference_count").alias("reference_count")))


@query("composite_reference", BANK_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY media_id, speaker_id ORDER BY round(heuristic_score, 6) DESC, ord) AS rank,
  least(dur_ms, 3200) AS piece_ms FROM bank),
b AS (SELECT *, coalesce(sum(piece_ms) OVER (PARTITION BY media_id, speaker_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  + greatest(rank - 2, 0) * 250 AS before_ms FROM r WHERE rank <= 4)
SELECT media_id, speaker_id, reference_id, CAST(rank AS INTEGER) AS rank, piece_ms FROM (SELECT *, count(*) OVER (PARTITION BY media_id, speaker_id) AS n FROM b WHERE before_ms < 9000) WHERE n >= 2""")
def _(src):
    return vc.composite_members(_bank(src).withColumn("heuristic_score", F.round("heuristic_score", 6)))


@query("pitch_consistency", """
WITH p AS (SELECT media_id, segment_id, 90 + h % 200 AS hz, CASE WHEN h % 9 <> 0 THEN 90 + (h * 3) % 200 END AS ref FROM report),
c AS (SELECT *, CASE WHEN hz < 145 THEN 0 WHEN hz <= 215 THEN 1 ELSE 2 END AS a, CASE WHEN ref IS NULL THEN NULL WHEN ref < 145 THEN 0 WHEN ref <= 215 THEN 1 ELSE 2 END AS b FROM p)
SELECT media_id, segment_id, ['low', 'mid', 'high'][a + 1] AS pitch_class, coalesce(['low', 'mid', 'high'][b + 1], 'unknown') AS expected_class,
  CASE WHEN abs(a - b) >= 2 THEN 'failed' WHEN abs(a - b) = 1 THEN 'review' WHEN b IS NULL THEN 'review' ELSE 'passed' END AS consistency FROM c""")
def _(src):
    hz = (90 + F.col("h") % 200)
    ref = F.when(F.col("h") % 9 != 0, 90 + (F.col("h") * 3) % 200)
    return src("report").select("media_id", "segment_id", vc.pitch_class(hz).alias("pitch_class"), vc.pitch_class(ref).alias("expected_class"),
                                vc.voice_consistency(ref, hz).alias("consistency"))


USABLE = "(d BETWEEN 1000 AND 6000 AND NOT too_short_flag)"


@query("line_usability", f"""WITH t AS (SELECT *, end_ms - start_ms AS d FROM translations)
SELECT media_id, segment_id, {USABLE} AS usable, {USABLE} AND NOT duration_risky AND d BETWEEN 1500 AND 4500 AS preferred FROM t""")
def _(src):
    dur = F.col("end_ms") - F.col("start_ms")
    return src("translations").select("media_id", "segment_id", vc.usable(dur, F.col("too_short_flag")).alias("usable"),
                                      vc.preferred(dur, F.col("too_short_flag"), F.col("duration_risky")).alias("preferred"))


@query("rank_speakers", f"""WITH t AS (SELECT *, end_ms - start_ms AS d FROM translations),
c AS (SELECT media_id, speaker_id, count(*) FILTER {USABLE.replace('(d', '(WHERE d', 1)} AS usable_count,
  count(*) FILTER (d BETWEEN 1000 AND 4000 AND NOT too_short_flag) AS short_count FROM t GROUP BY ALL),
p AS (SELECT media_id, speaker_id, speaker_id <> 'spk_6' AS cloneable, CAST(sum(source_ms) AS BIGINT) AS total_ms, max(quality_score) AS reference_score FROM report GROUP BY ALL)
SELECT p.*, usable_count, short_count, CAST(row_number() OVER (PARTITION BY media_id ORDER BY usable_count DESC, short_count DESC, reference_score DESC, total_ms DESC, speaker_id DESC) AS INTEGER) AS rank
FROM p JOIN c USING (media_id, speaker_id) WHERE cloneable AND usable_count > 0""")
def _(src):
    profiles = src("report").groupBy("media_id", "speaker_id").agg(F.sum("source_ms").alias("total_ms"), F.max("quality_score").alias("reference_score"))
    return vc.rank_speakers(src("translations"), profiles.withColumn("cloneable", F.col("speaker_id") != "spk_6"))


@query("pick_lines", f"""WITH t AS (SELECT *, end_ms - start_ms AS d FROM translations),
s AS (SELECT *, CASE WHEN {USABLE} AND NOT duration_risky AND d BETWEEN 1500 AND 4500 THEN 0 WHEN {USABLE} THEN 1 ELSE 2 END AS tier FROM t)
SELECT media_id, speaker_id, segment_id, tier FROM s QUALIFY row_number() OVER (PARTITION BY media_id, speaker_id ORDER BY tier, start_ms, segment_id) <= 5""")
def _(src):
    return vc.pick_lines(src("translations"), 5).select("media_id", "speaker_id", "segment_id", "tier")


@query("first_lines", """SELECT media_id, speaker_id, segment_id FROM translations
QUALIFY row_number() OVER (PARTITION BY media_id, speaker_id ORDER BY start_ms, segment_id) <= 3""")
def _(src):
    return vc.first_lines(src("translations"), 3).select("media_id", "speaker_id", "segment_id")


# ---- repair ----------------------------------------------------------------------------------------------------

ITEMS_SQL = """WITH j AS (SELECT r.*, t.end_ms - t.start_ms AS line_ms, t.source_text, coalesce(t.too_short_flag, false) AS too_short, r.h % 3 = 0 AS forced,
  round(generated_ms / source_ms, 6) AS ratio FROM report r LEFT JOIN translations t USING (media_id, segment_id)),
f AS (SELECT *, concat_ws('|', CASE WHEN overall_status = 'failed' THEN 'task_d_overall_failed' END, CASE WHEN duration_status = 'failed' THEN 'duration_failed' END,
  CASE WHEN speaker_status = 'failed' THEN 'speaker_failed' END, CASE WHEN intelligibility_status = 'failed' THEN 'intelligibility_failed' END,
  CASE WHEN coalesce(nullif(source_ms, 0), line_ms, 0) < 1200 OR too_short THEN 'too_short_source' END, CASE WHEN ratio > 1.65 THEN 'generated_too_long' END,
  CASE WHEN ratio > 0 AND ratio < 0.55 THEN 'generated_too_short' END, CASE WHEN audio_path = '' THEN 'missing_audio_path' END) AS r0 FROM j),
g AS (SELECT *, CASE WHEN r0 = '' THEN 'qa_flagged' ELSE r0 END AS reasons FROM f WHERE r0 <> '' OR forced),
a0 AS (SELECT *, contains(reasons, 'duration_failed') AS df, contains(reasons, 'speaker_failed') AS sf, contains(reasons, 'intelligibility_failed') AS if_,
  contains(reasons, 'too_short_source') AS ts, contains(reasons, 'qa_flagged') AS qf, contains(reasons, 'missing_audio_path') AS ma FROM g),
a1 AS (SELECT *, CASE WHEN qf THEN 'regenerate_candidates|rewrite_for_dubbing|switch_reference_audio' ELSE concat_ws('|',
  CASE WHEN ts AND df THEN 'merge_short_segments' END, CASE WHEN df OR if_ THEN 'rewrite_for_dubbing|regenerate_candidates' END,
  CASE WHEN sf THEN 'switch_reference_audio' END, CASE WHEN df AND sf AND if_ THEN 'switch_tts_backend' END, CASE WHEN ma THEN 'manual_review' END) END AS act,
  contains(reasons, 'task_d_overall_failed') OR ma AS strict_blocker,
  (CASE WHEN ratio >= 2.5 OR (ratio > 0 AND ratio <= 0.35) THEN 14 ELSE 0 END) + (CASE WHEN df THEN 15 ELSE 0 END) + (CASE WHEN sf THEN 14 ELSE 0 END)
  + (CASE WHEN if_ THEN 14 ELSE 0 END) + (CASE WHEN ts THEN 7 ELSE 0 END) + (CASE WHEN qf THEN 8 ELSE 0 END) AS priority_tenths FROM a0),
items AS (SELECT *, CASE WHEN act = '' THEN 'manual_review' ELSE act END AS actions,
  CASE WHEN priority_tenths >= 50 THEN 'high' WHEN priority_tenths >= 30 THEN 'medium' ELSE 'low' END AS priority FROM a1),
queued AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY NOT strict_blocker, priority_tenths DESC, segment_id) - 1 AS queue_pos FROM items)
"""


def _items(src):
    report = src("report")
    return rp.repair_items(report, src("translations"), report.filter("h % 3 = 0"))


@query("repair_queue", ITEMS_SQL + "SELECT media_id, segment_id, reasons, actions, strict_blocker, priority_tenths, priority, queue_pos FROM queued")
def _(src):
    return rp.queue(_items(src)).select(
        "media_id", "segment_id", joined(F.col("reasons")).alias("reasons"), joined(F.col("actions")).alias("actions"),
        "strict_blocker", "priority_tenths", "priority", "queue_pos")


@query("repair_selection", ITEMS_SQL + """SELECT media_id, segment_id, queue_pos FROM queued WHERE strict_blocker AND (media_id, segment_id) IN
  (SELECT (media_id, segment_id) FROM translations WHERE duration_risky OR segment_id NOT LIKE '%9') QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY queue_pos) <= 10""")
def _(src):
    allowed = src("translations").filter(F.col("duration_risky") | ~F.col("segment_id").endswith("9"))
    return rp.choose_items(rp.queue(_items(src)), False, allowed, 10).select("media_id", "segment_id", "queue_pos")


@query("repair_stats", ITEMS_SQL + """SELECT media_id, kind, name, count(*) AS cnt FROM (
  SELECT media_id, 'priority' AS kind, priority AS name FROM items UNION ALL
  SELECT media_id, 'queue_class', CASE WHEN strict_blocker THEN 'strict_blocker' ELSE 'risk_only' END FROM items UNION ALL
  SELECT media_id, 'reason', unnest(string_split(reasons, '|')) FROM items UNION ALL
  SELECT media_id, 'action', unnest(string_split(actions, '|')) FROM items) GROUP BY ALL""")
def _(src):
    return rp.repair_stats(_items(src))


@query("attempt_stats", "WITH " + LINE_ATTEMPTS + f""",
r AS (SELECT media_id, line_id, count(*) AS n, max(CASE WHEN selected THEN attempt_id END) AS sel FROM line_attempts GROUP BY ALL)
SELECT media_id, count(*) AS input_count, CAST(sum(n) AS BIGINT) AS attempt_count, count(sel) AS selected_count, count(*) - count(sel) AS manual_required_count
FROM r GROUP BY media_id""")
def _(src):
    lines = _line_attempts(src).groupBy("media_id", "segment_id").agg(
        F.count(F.lit(1)).alias("attempt_count"), F.max(F.when(F.col("selected"), F.col("attempt_id"))).alias("selected_attempt_id"))
    return rp.attempt_stats(lines)


REFS_SQL = """refs AS (SELECT media_id, speaker_id, coalesce(reference_path, 'clip_none') AS path, row_number() OVER (PARTITION BY media_id, speaker_id
  ORDER BY max(quality_score) DESC, coalesce(reference_path, 'clip_none')) AS ref_rank FROM report GROUP BY media_id, speaker_id, coalesce(reference_path, 'clip_none')),
cur AS (SELECT media_id, speaker_id, arg_min(reference_path, (start_ms, segment_id)) AS current_path FROM report WHERE reference_path IS NOT NULL GROUP BY ALL)"""


def _references(src):
    from pyspark.sql import Window

    report = src("report")
    clips = report.groupBy("media_id", "speaker_id", F.coalesce("reference_path", F.lit("clip_none")).alias("path")).agg(F.max("quality_score").alias("q"))
    order = Window.partitionBy("media_id", "speaker_id").orderBy(F.desc("q"), "path")
    refs = clips.withColumn("ref_rank", F.row_number().over(order).cast("long")).drop("q")
    cur = report.filter("reference_path IS NOT NULL").groupBy("media_id", "speaker_id").agg(
        F.min_by("reference_path", F.struct("start_ms", "segment_id")).alias("current_path"))
    return refs, cur


@query("reference_plans", ITEMS_SQL + ", " + REFS_SQL + """,
qd AS (SELECT media_id, speaker_id, count(*) AS item_count, count(*) FILTER (contains(reasons, 'speaker_failed')) AS speaker_failed_count FROM items
  WHERE contains(actions, 'switch_reference_audio') GROUP BY ALL),
b AS (SELECT r.media_id, r.speaker_id, arg_min(path, ref_rank) AS best, arg_min(path, ref_rank) FILTER (path IS DISTINCT FROM current_path) AS other,
  any_value(current_path) AS cp, count(*) AS candidate_count FROM refs r LEFT JOIN cur USING (media_id, speaker_id) GROUP BY ALL)
SELECT media_id, speaker_id, item_count, speaker_failed_count, candidate_count, CASE WHEN best = cp THEN coalesce(other, best) ELSE best END AS recommended_path
FROM qd JOIN b USING (media_id, speaker_id)""")
def _(src):
    refs, cur = _references(src)
    return rp.reference_plans(_items(src), refs, cur)


@query("attempt_grid", ITEMS_SQL + ", " + REFS_SQL + """,
texts0 AS (SELECT media_id, segment_id, h % 3 AS ord, trim(target_text || ' ' || CAST(h % 2 AS STRING)) AS text, 'short' AS variant FROM items
    WHERE contains(actions, 'rewrite_for_dubbing') OR contains(actions, 'merge_short_segments')
  UNION ALL SELECT media_id, segment_id, 3, trim(target_text), 'same' FROM items WHERE contains(actions, 'rewrite_for_dubbing') OR contains(actions, 'merge_short_segments')
  UNION ALL SELECT media_id, segment_id, 1000000, trim(target_text), 'current' FROM items),
texts1 AS (SELECT * FROM texts0 WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY media_id, segment_id, lower(text) ORDER BY ord) = 1),
texts AS (SELECT *, row_number() OVER (PARTITION BY media_id, segment_id ORDER BY ord) AS text_rank FROM texts1),
pr AS (SELECT i.media_id, i.segment_id, r.path, row_number() OVER (PARTITION BY i.media_id, i.segment_id ORDER BY CASE WHEN ref_rank = 2 THEN 0
  WHEN r.path = i.reference_path THEN 1 ELSE 2 END, ref_rank) AS ref_order FROM items i JOIN refs r USING (media_id, speaker_id)),
grid AS (SELECT t.*, p.path, p.ref_order, k.backend_rank, k.backend FROM texts t JOIN pr p USING (media_id, segment_id),
  (VALUES (0, 'backend_a'), (1, 'backend_b')) k(backend_rank, backend))
SELECT media_id, segment_id, text, variant, path, backend, CAST(n AS INTEGER) AS attempt_no FROM (SELECT *, row_number() OVER (PARTITION BY media_id, segment_id ORDER BY text_rank, ref_order, backend_rank) AS n FROM grid) WHERE n <= 3""")
def _(src):
    items = as_table(_items(src).select("media_id", "segment_id", (F.col("h") % 3).cast("int").alias("ord"), (F.col("h") % 2).cast("string").alias("digit"),
                                       "may_rewrite", "speaker_id", "reference_path", "target_text"))
    refs = as_table(_references(src)[0])
    extra = F.struct("ord", F.concat_ws(" ", "target_text", "digit").alias("rewrite_text"), F.lit("short").alias("variant"))
    same = F.struct(F.lit(3).alias("ord"), F.col("target_text").alias("rewrite_text"), F.lit("same").alias("variant"))
    rewrites = items.filter("may_rewrite").select("media_id", "segment_id", F.inline(F.array(extra, same)))
    grid = rp.attempt_grid(items, rewrites, refs.withColumn("recommended", F.col("ref_rank") == 2), ["backend_a", "backend_b"], 3)
    return grid.select("media_id", "segment_id", "text", "variant", "path", "backend", "attempt_no")


@query("accumulate_rounds", """
WITH r AS (SELECT media_id, segment_id, h % 3 AS round, audio_path FROM report WHERE h % 5 <> 0
  UNION ALL SELECT media_id, segment_id, 5, 'fresh' FROM report WHERE h % 4 = 0)
SELECT media_id, segment_id, max(round) AS round, arg_max(audio_path, round) AS audio_path FROM r GROUP BY ALL""")
def _(src):
    report = src("report")
    base = report.filter("h % 5 <> 0").select("media_id", "segment_id", (F.col("h") % 3).alias("round"), "audio_path")
    fresh = report.filter("h % 4 = 0").select("media_id", "segment_id", F.lit(5).cast("long").alias("round"), F.lit("fresh").alias("audio_path"))
    return rp.accumulate_rounds(base, fresh)


@query("round_acceptance", """
WITH r AS (SELECT media_id, CAST(substring(speaker_id, 5) AS INTEGER) AS round, CASE WHEN sum(h) % 5 <> 0 THEN round(avg(quality_score) * 100, 3) END AS score, count(*) FILTER (overall_status = 'failed') AS problems
  FROM report GROUP BY ALL), l AS (SELECT *, lag(score) OVER w AS bs, lag(problems) OVER w AS bp FROM r WINDOW w AS (PARTITION BY media_id ORDER BY round))
SELECT media_id, round, score, problems, CASE WHEN score >= bs + 0.5 THEN true WHEN score <= bs - 0.5 THEN false ELSE problems < bp END AS accepted FROM l WHERE bp IS NOT NULL""")
def _(src):
    rounds = src("report").groupBy("media_id", F.substring("speaker_id", 5, 9).cast("int").alias("round")).agg(
        F.when(F.sum("h") % 5 != 0, F.round(F.avg("quality_score") * 100, 3)).alias("score"),
        F.count(F.when(F.col("overall_status") == "failed", 1)).alias("problems"))
    return rp.round_acceptance(rounds)


EDITOR_SQL = """WITH m AS (SELECT *, has_window AND coalesce(coverage, 0) < 0.5 AS audible_failed, h % 37 = 0 AS drift FROM report),
x AS (SELECT *, [CASE WHEN speaker_status = 'failed' THEN 'speaker_similarity_failed/P1' END, CASE WHEN duration_status = 'failed' THEN 'duration_fit_failed/P1' END,
  CASE WHEN drift THEN 'voice_gender_mismatch/P0' END, CASE WHEN audible_failed THEN 'silent_with_subtitle/P0' END,
  CASE WHEN starts_with(mix_status, 'skipped') OR h % 41 = 0 THEN 'render_skipped/P0' END, CASE WHEN intelligibility_status = 'failed' THEN 'translation_untrusted/P2' END] AS l FROM m),
y AS (SELECT media_id, segment_id, CASE WHEN len(list_filter(l, lambda z: z IS NOT NULL)) = 0 AND overall_status = 'failed' THEN ['quality_gate_failed/P2'] ELSE list_filter(l, lambda z: z IS NOT NULL) END AS l FROM x),
issues AS (SELECT media_id, segment_id, split_part(i, '/', 1) AS issue, split_part(i, '/', 2) AS severity FROM (SELECT media_id, segment_id, unnest(l) AS i FROM y))
"""


def _issues(src):
    rows = src("report").withColumn("audible_failed", F.col("has_window") & (F.coalesce("coverage", F.lit(0.0)) < 0.5)).withColumn(
        "audible_status", F.lit(None).cast("string")).withColumn("pitch_class_drift", F.col("h") % 37 == 0).withColumn(
        "notes", F.when(F.col("h") % 41 == 0, F.array(F.lit("subtitle_window_not_rendered"))).otherwise(F.array().cast("array<string>")))
    return rp.editor_issues(rows)


@query("editor_issues", EDITOR_SQL + "SELECT * FROM issues")
def _(src):
    return _issues(src)


@query("editor_units", """
SELECT t.media_id, t.segment_id, t.speaker_id, c.character_id, coalesce(m.overall_status, l.overall_status) AS overall_status,
  coalesce(m.fit_strategy, l.fit_strategy) AS fit_strategy, coalesce(m.mix_status, l.mix_status) AS mix_status, coalesce(m.audio_path, l.audio_path) AS audio_path
FROM translations t LEFT JOIN (SELECT * REPLACE ('timeline' AS mix_status) FROM report WHERE h % 2 = 0) l USING (media_id, segment_id)
LEFT JOIN (SELECT * REPLACE (CASE WHEN h % 9 <> 0 THEN fit_strategy END AS fit_strategy) FROM report WHERE h % 3 = 0) m USING (media_id, segment_id)
LEFT JOIN (SELECT DISTINCT media_id, speaker_id, 'char_' || speaker_id AS character_id FROM report WHERE speaker_id <> 'spk_2') c ON c.media_id = t.media_id AND c.speaker_id = t.speaker_id""")
def _(src):
    report = src("report")
    characters = report.filter("speaker_id <> 'spk_2'").select("media_id", "speaker_id", F.concat(F.lit("char_"), "speaker_id").alias("character_id")).distinct()
    timeline = report.filter("h % 2 = 0").withColumn("mix_status", F.lit("timeline"))
    mix = report.filter("h % 3 = 0").withColumn("fit_strategy", F.when(F.col("h") % 9 != 0, F.col("fit_strategy")))
    return rp.editor_units(src("translations"), timeline, mix, characters)


# ---- timeline --------------------------------------------------------------------------------------------------

ANCHOR_SQL = """WITH raw AS (SELECT media_id, segment_id, h, start_ms AS asr_start, start_ms + source_ms AS asr_end, generated_ms, fitted_ms, overall_status, placed,
  speaker_similarity, text_similarity, source_ms AS fallback_ms, CASE WHEN h % 4 = 0 THEN start_ms + h % 300 END AS dub_start, CASE WHEN h % 4 = 0 THEN start_ms + h % 300 + h % 2000 END AS dub_end,
  CASE WHEN h % 3 <> 0 THEN start_ms - 500 + h % 900 END AS sub_start, CASE WHEN h % 3 <> 0 THEN start_ms + h % 2500 END AS sub_end FROM report),
a AS (SELECT *, dub_start IS NOT NULL AND dub_start <> dub_end AS dok, sub_start IS NOT NULL AND sub_start <> sub_end AS sok FROM raw),
b AS (SELECT *, CASE WHEN dok THEN least(dub_start, dub_end) ELSE asr_start END AS anchor_start, CASE WHEN dok THEN greatest(dub_start, dub_end) ELSE asr_end END AS anchor_end,
  CASE WHEN sok THEN least(sub_start, sub_end) END AS subtitle_start, CASE WHEN sok THEN greatest(sub_start, sub_end) END AS subtitle_end, CASE WHEN dok THEN 'dubbing_window' ELSE 'asr_window' END AS anchor_source FROM a),
c AS (SELECT *, CASE WHEN anchor_end > anchor_start THEN anchor_end - anchor_start ELSE fallback_ms END AS source_ms FROM b),
d AS (SELECT *, coalesce(lead(anchor_start) OVER (PARTITION BY media_id ORDER BY anchor_start, anchor_end, segment_id), anchor_end + 1500) AS nx FROM c),
fit AS (SELECT *, greatest(source_ms, nx - anchor_start - 80) AS available_ms FROM d)
"""


def _anchored(src):
    start, h = F.col("start_ms"), F.col("h")
    raw = src("report").select(
        "media_id", "segment_id", "h", start.alias("asr_start"), (start + F.col("source_ms")).alias("asr_end"), "generated_ms", "fitted_ms",
        "overall_status", "placed", "speaker_similarity", "text_similarity", F.col("source_ms").alias("fallback_ms"),
        F.when(h % 4 == 0, start + h % 300).alias("dub_start"), F.when(h % 4 == 0, start + h % 300 + h % 2000).alias("dub_end"),
        F.when(h % 3 != 0, start - 500 + h % 900).alias("sub_start"), F.when(h % 3 != 0, start + h % 2500).alias("sub_end"))
    return tl.resolve_anchor(raw)


@query("timeline_fit", ANCHOR_SQL + """SELECT media_id, segment_id, anchor_start, anchor_end, anchor_source, source_ms, available_ms,
  CASE WHEN source_ms <= 0 OR generated_ms <= 0 THEN 'invalid_duration'
    WHEN generated_ms / source_ms < 0.6 THEN CASE WHEN generated_ms / source_ms >= 0.35 AND source_ms <= 2500 AND subtitle_start IS NOT NULL THEN 'stretch' ELSE 'underflow_unfitted' END
    WHEN generated_ms / source_ms < 0.85 THEN 'pad' WHEN generated_ms <= available_ms + 1 THEN 'direct' WHEN generated_ms / available_ms <= 1.45 THEN 'compress'
    WHEN source_ms <= 1500 AND generated_ms - available_ms <= 750 AND generated_ms / available_ms <= 1.75 THEN 'compress' ELSE 'overflow_unfitted' END AS strategy FROM fit""")
def _(src):
    rows = tl.available_time(_anchored(src), F.lit(0))
    return rows.select("media_id", "segment_id", "anchor_start", "anchor_end", "anchor_source", "source_ms", "available_ms", tl.fit_strategy().alias("strategy"))


@query("subtitle_coverage", ANCHOR_SQL + """, p AS (SELECT *, CASE WHEN anchor_start - subtitle_start > 0 AND anchor_start - subtitle_start <= 1500 THEN greatest(0, subtitle_start) ELSE anchor_start END AS placement_start FROM fit),
v AS (SELECT *, CASE WHEN subtitle_start IS NOT NULL THEN CASE WHEN placed THEN least(1.0::DOUBLE, greatest(0, least(subtitle_end, placement_start + fitted_ms) - greatest(subtitle_start, placement_start)) / greatest(1, subtitle_end - subtitle_start)) ELSE 0.0 END END AS coverage FROM p)
SELECT media_id, segment_id, placement_start, coverage, CASE WHEN subtitle_start IS NULL THEN '' ELSE concat_ws('|', CASE WHEN NOT placed THEN 'subtitle_window_not_rendered' END,
  CASE WHEN coverage <= 0 THEN 'subtitle_window_not_covered' WHEN coverage < 0.5 THEN 'subtitle_window_low_coverage' END) END AS notes FROM v""")
def _(src):
    rows = _anchored(src).withColumn("placement_start", tl.placement_start()).withColumn(
        "placement_end", F.col("placement_start") + F.col("fitted_ms")).withColumn("mix_status", F.when(F.col("placed"), "placed").otherwise("skipped_overlap"))
    return tl.subtitle_coverage(rows).select("media_id", "segment_id", "placement_start", "coverage", joined(F.col("notes")).alias("notes"))


@query("timeline_quality_score", ANCHOR_SQL + """SELECT media_id, segment_id, (CASE overall_status WHEN 'passed' THEN 2.0::DOUBLE WHEN 'review' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + greatest(0.0::DOUBLE, coalesce(text_similarity, 0.0::DOUBLE))
  + greatest(0.0::DOUBLE, coalesce(speaker_similarity, 0.0::DOUBLE)) * 0.5::DOUBLE + greatest(0.0::DOUBLE, 1.0::DOUBLE - abs(1.0::DOUBLE - (CASE WHEN source_ms > 0 THEN generated_ms / source_ms ELSE 0.0::DOUBLE END))) * 0.25::DOUBLE) AS score FROM fit""")
def _(src):
    return _anchored(src).select("media_id", "segment_id", tl.quality_score().alias("score"))


@query("resolve_overlaps")
def _(src):
    rows = _anchored(src).withColumn("quality_score", tl.quality_score()).withColumn("placement_start", tl.placement_start()).withColumn(
        "placement_end", F.col("placement_start") + F.col("fitted_ms")).withColumn("has_window", F.col("subtitle_start").isNotNull())
    return tl.resolve_overlaps(rows)
