"""Registered queries: evaluation runs and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueloom.functions.cols import joined
from cueloom.operators import catalog as ct
from cueloom.operators import evaluation as ev
from cueloom.plans.registry import query

AGG_SQL = """WITH s AS (SELECT *, CASE WHEN status = 'succeeded' THEN primary_metric END AS v FROM results),
agg AS (SELECT run_id, scenario, arm, count(*) AS total, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed,
  count(*) FILTER (status = 'skipped') AS skipped, count(v) AS scored, round(avg(v), 10) AS mean, round(stddev_pop(v), 9) AS std, min(v) AS min, max(v) AS max,
  bool_or(higher_is_better) AS higher_is_better, round(quantile_cont(v, 0.5), 10) AS median, round(quantile_cont(v, 0.9), 10) AS p90 FROM s GROUP BY ALL)
"""


def _aggregates(src):
    out = ev.run_aggregates(src("results"))
    for name, digits in (("mean", 10), ("std", 9), ("median", 10), ("p90", 10)):
        out = out.withColumn(name, F.round(name, digits))
    return out


@query("run_aggregates", AGG_SQL + "SELECT * FROM agg")
def _(src):
    return _aggregates(src)


@query("sweep_winners", AGG_SQL + """SELECT run_id, scenario, arg_max(arm, (CASE WHEN higher_is_better THEN mean ELSE -mean END, arm)) AS winner,
  CASE WHEN any_value(higher_is_better) THEN max(mean) ELSE min(mean) END AS mean FROM agg WHERE mean IS NOT NULL GROUP BY ALL""")
def _(src):
    return ev.sweep_winners(_aggregates(src))


@query("compare_runs", AGG_SQL + """, b AS (SELECT * FROM agg WHERE run_id = 'run_1997' AND NOT (scenario = 'A' AND arm = 'O')), c AS (SELECT * FROM agg WHERE run_id = 'run_1998' AND scenario <> 'N'),
j AS (SELECT scenario, arm, b.mean AS baseline_mean, c.mean AS candidate_mean, coalesce(c.higher_is_better, b.higher_is_better) AS higher_is_better FROM b FULL OUTER JOIN c USING (scenario, arm)),
d AS (SELECT *, round(candidate_mean - baseline_mean, 4) AS delta FROM j) SELECT *, CASE WHEN higher_is_better THEN delta < 0 ELSE delta > 0 END AS regressed FROM d""")
def _(src):
    agg = _aggregates(src)
    base = agg.filter("run_id = 'run_1997' AND NOT (scenario = 'A' AND arm = 'O')")
    return ev.compare_runs(base, agg.filter("run_id = 'run_1998' AND scenario <> 'N'"), ["scenario", "arm"])


@query("micro_cer", """SELECT scenario, arm, CAST(sum(ref_chars) AS BIGINT) AS ref_chars, CAST(sum(edits) AS BIGINT) AS edits,
  sum(edits) / sum(ref_chars) AS cer_micro FROM results GROUP BY ALL""")
def _(src):
    return ev.micro_cer(src("results"), ["scenario", "arm"])


@query("micro_der", """SELECT scenario, CAST(sum(tp) AS BIGINT) AS miss, CAST(sum(fp) AS BIGINT) AS false_alarm, CAST(sum(fn) AS BIGINT) AS confusion,
  CAST(sum(ref_chars) AS BIGINT) AS ref_speech, (sum(tp) + sum(fp) + sum(fn)) / sum(ref_chars) AS der_micro FROM results GROUP BY ALL""")
def _(src):
    rows = src("results").select("scenario", F.col("tp").alias("miss"), F.col("fp").alias("false_alarm"), F.col("fn").alias("confusion"), F.col("ref_chars").alias("ref_speech"))
    return ev.micro_der(rows, ["scenario"])


@query("micro_prf", """WITH s AS (SELECT run_id, scenario, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM results GROUP BY ALL),
p AS (SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM s) SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM p""")
def _(src):
    return ev.micro_prf(src("results"), ["run_id", "scenario"])


@query("clone_corpus", """SELECT scenario, CAST(sum(ref_chars) AS BIGINT) AS ref_chars, CAST(sum(edits) AS BIGINT) AS edits, sum(edits) / sum(ref_chars) AS cer_micro,
  round(avg(sim), 10) AS sim_mean FROM results GROUP BY ALL""")
def _(src):
    return ev.clone_corpus(src("results"), ["scenario"]).withColumn("sim_mean", F.round("sim_mean", 10))


@query("rank_runs", """SELECT scenario, run_id || arm AS slug, round(avg(sim), 8) AS similarity, sum(edits) / sum(ref_chars) AS cer, CAST(sum(tp) AS BIGINT) AS elapsed,
  CAST(row_number() OVER (PARTITION BY scenario ORDER BY round(avg(sim), 8) DESC, sum(edits) / sum(ref_chars), sum(tp), run_id || arm) AS INTEGER) AS rank FROM results GROUP BY scenario, run_id, arm""")
def _(src):
    scores = src("results").groupBy("scenario", F.concat("run_id", "arm").alias("slug")).agg(
        F.round(F.avg("sim"), 8).alias("similarity"), (F.sum("edits") / F.sum("ref_chars")).alias("cer"), F.sum("tp").alias("elapsed"))
    return ev.rank_runs(scores, ["scenario"])


@query("work_list", """SELECT DISTINCT sample_id, s.scenario AS task, a.arm AS variant, a.cfg AS config FROM results,
  (VALUES ('asr'), ('diarization')) s(scenario), (VALUES ('default', 'beam=5;model=small'), ('large', 'beam=5;model=large')) a(arm, cfg)""")
def _(src):
    samples = src("results").select("sample_id").distinct()
    rows = ev.work_list(samples, ["asr", "diarization"], {"default": {}, "large": {"model": "large"}}, {"model": "small", "beam": "5"})
    config = F.array_join(F.transform(F.array_sort(F.map_entries("config")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return rows.select("sample_id", F.col("scenario").alias("task"), F.col("arm").alias("variant"), config.alias("config"))


@query("scenario_eligibility", """WITH d AS (SELECT CAST(doc_id AS STRING) AS sample_id, CASE WHEN n_chars > 400 THEN text END AS transcript, CASE WHEN lang = 'en' THEN lang END AS rttm FROM documents)
SELECT sample_id, 'asr' AS scenario, CASE WHEN transcript IS NULL THEN 'transcript' ELSE '' END AS missing, transcript IS NOT NULL AS eligible FROM d
UNION ALL SELECT sample_id, 'joint', concat_ws('|', CASE WHEN transcript IS NULL THEN 'transcript' END, CASE WHEN rttm IS NULL THEN 'rttm' END), transcript IS NOT NULL AND rttm IS NOT NULL FROM d""")
def _(src):
    samples = src("documents").select(F.col("doc_id").cast("string").alias("sample_id"), F.when(F.col("n_chars") > 400, F.col("text")).alias("transcript"), F.when(F.col("lang") == "en", F.col("lang")).alias("rttm"))
    return ev.eligibility(samples, {"asr": ["transcript"], "joint": ["transcript", "rttm"]}).withColumn("missing", joined(F.col("missing")))


@query("pending_work", """WITH w AS (SELECT DISTINCT sample_id, scenario, arm, sha256('{"_epoch":"e1","arm":"' || arm || '","sample_id":"' || sample_id || '","scenario":"' || scenario || '"}') AS work_key FROM results)
SELECT sample_id, scenario, arm, work_key FROM w WHERE (sample_id, scenario, arm) NOT IN (SELECT (sample_id, scenario, arm) FROM results WHERE status = 'succeeded')""")
def _(src):
    keyed = src("results").withColumn("work_key", ev.content_key(["sample_id", "scenario", "arm"], "e1"))
    work = keyed.select("sample_id", "scenario", "arm", "work_key").distinct()
    return ev.pending(work, keyed.select("work_key", "status"))


@query("run_catalog", """SELECT run_id, count(*) AS results, count(*) FILTER (status = 'succeeded') AS succeeded, CAST(row_number() OVER (ORDER BY run_id DESC) AS INTEGER) AS newest_rank FROM results GROUP BY run_id""")
def _(src):
    from pyspark.sql import Window

    runs = src("results").groupBy("run_id").agg(F.count(F.lit(1)).alias("results"), F.count(F.when(F.col("status") == "succeeded", 1)).alias("succeeded"))
    return runs.withColumn("newest_rank", F.row_number().over(Window.orderBy(F.desc("run_id"))))


# ---- listings --------------------------------------------------------------------------------------------------


@query("filter_tasks", """SELECT task_id, name, status FROM tasks WHERE status = 'succeeded' AND target_lang = 'en' AND contains(name, 'HIGH')
  AND coalesce(json_extract_string(config, '$.output_intent'), '') <> 'commentary_recap' AND coalesce(json_extract_string(config, '$.template'), '') <> 'asr-commentary'""")
def _(src):
    return ct.filter_tasks(src("tasks"), "succeeded", "en", "HIGH", "dub").select("task_id", "name", "status")


@query("task_page", "SELECT task_id, name, created_ms FROM tasks WHERE status = 'running' ORDER BY created_ms DESC, task_id LIMIT 20 OFFSET 20")
def _(src):
    return ct.page(ct.filter_tasks(src("tasks"), "running"), 2, 20).select("task_id", "name", "created_ms")


@query("run_page", "SELECT task_id, name FROM tasks WHERE contains(lower(name), 'urgent') OR contains(CAST(owner_id AS STRING), 'urgent') ORDER BY created_ms DESC, task_id LIMIT 15")
def _(src):
    return ct.page(ct.text_search(src("tasks"), "URGENT", "name", "owner_id"), 1, 15).select("task_id", "name")


@query("job_search", """WITH j AS (SELECT *, CASE WHEN task_id % 3 = 0 THEN 'jobs-evil/' ELSE 'jobs/' END || CAST(task_id AS STRING) AS job_root FROM tasks)
SELECT task_id FROM j WHERE starts_with(job_root, 'jobs/') AND (contains(lower(name), '#1_') OR contains(lower(coalesce(config, '')), 'bilingual'))""")
def _(src):
    jobs = src("tasks").withColumn("job_root", F.concat(F.when(F.col("task_id") % 3 == 0, "jobs-evil/").otherwise("jobs/"), F.col("task_id").cast("string")))
    return ct.text_search(ct.owned_by(jobs, "jobs"), "#1_", "name").select("task_id").union(
        ct.text_search(ct.owned_by(jobs, "jobs"), "bilingual", "config").select("task_id")).distinct()


@query("stages_of_page", """SELECT task_id, stage, status FROM stages WHERE task_id IN (SELECT task_id FROM tasks ORDER BY created_ms DESC, task_id LIMIT 25)""")
def _(src):
    return ct.stages_of_page(ct.page(src("tasks"), 1, 25), src("stages")).select("task_id", "stage", "status")


@query("stage_report", """SELECT task_id, count(*) AS node_count, count(*) FILTER (status = 'cached') AS cached_count,
  arg_min(stage, stage_ord) FILTER (status = 'failed') AS first_failed_stage FROM stages GROUP BY task_id""")
def _(src):
    return ct.stage_report(src("stages"))


LATEST_SQL = "latest AS (SELECT task_id, stage, arg_max(status, (ts_ms, l_partkey, l_suppkey)) AS status, arg_max(progress, (ts_ms, l_partkey, l_suppkey)) AS progress FROM stages GROUP BY ALL)"


@query("latest_stage", "WITH " + LATEST_SQL + " SELECT * FROM latest")
def _(src):
    return ct.latest_stage(src("stages"))


@query("weighted_progress", "WITH " + LATEST_SQL + """ SELECT task_id, round(sum(CAST(stage[7:] AS INTEGER) / 28.0::DOUBLE * (progress / 100.0::DOUBLE)) * 100.0::DOUBLE, 9) AS overall_progress FROM latest GROUP BY task_id""")
def _(src):
    weights = {f"stage_{i}": float(i) for i in range(1, 8)}
    return ct.weighted_progress(ct.latest_stage(src("stages")), weights).withColumn("overall_progress", F.round("overall_progress", 9))


@query("artifact_counts", "SELECT l_suppkey AS job_id, count(*) AS cnt FROM lineitem GROUP BY l_suppkey")
def _(src):
    return src("lineitem").groupBy(F.col("l_suppkey").alias("job_id")).agg(F.count(F.lit(1)).alias("cnt"))


@query("persona_counts", "SELECT coalesce(nullif(trim(work_id), ''), '__unassigned__') AS bucket, count(*) AS cnt FROM personas GROUP BY ALL")
def _(src):
    return ct.count_by_bucket(src("personas"), "work_id")


READY = ", ".join(f"task_id % {m} <> 0 AS {n}" for n, m in (("has_original", 11), ("has_clean", 5), ("has_preview_audio", 3), ("has_dub_audio", 2), ("has_ocr", 7), ("has_asr", 4), ("has_final", 6), ("has_recap", 8)))


@query("export_readiness", f"""WITH t AS (SELECT task_id, status, ['english_subtitle', 'bilingual_review', 'fast_validation', 'dub_final'][CAST(task_id % 4 AS INTEGER) + 1] AS intent, task_id % 9 = 0 AS commentary, {READY} FROM tasks),
b AS (SELECT *, CASE WHEN status IN ('pending', 'running') THEN '' WHEN status = 'failed' THEN 'task_failed' WHEN commentary THEN CASE WHEN has_recap THEN '' ELSE 'missing_recap' END ELSE
  concat_ws('|', CASE WHEN intent = 'english_subtitle' AND NOT has_clean THEN 'missing_clean_video' END, CASE WHEN intent = 'bilingual_review' AND NOT has_original THEN 'missing_original_video' END,
  CASE WHEN intent IN ('english_subtitle', 'bilingual_review') AND NOT (has_ocr OR has_asr) THEN 'missing_english_subtitles' END, CASE WHEN NOT (has_dub_audio OR has_preview_audio) THEN 'missing_audio_track' END) END AS blockers FROM t)
SELECT task_id, blockers, CASE WHEN status IN ('pending', 'running') THEN 'not_ready' WHEN blockers <> '' THEN 'blocked' WHEN commentary OR has_final THEN 'exported' ELSE 'ready' END AS readiness FROM b""")
def _(src):
    t = src("tasks").withColumn("intent", F.element_at(F.array(*[F.lit(x) for x in ("english_subtitle", "bilingual_review", "fast_validation", "dub_final")]), (F.col("task_id") % 4 + 1).cast("int"))).withColumn("commentary", F.col("task_id") % 9 == 0)
    for n, m in (("has_original", 11), ("has_clean", 5), ("has_preview_audio", 3), ("has_dub_audio", 2), ("has_ocr", 7), ("has_asr", 4), ("has_final", 6), ("has_recap", 8)):
        t = t.withColumn(n, F.col("task_id") % m != 0)
    return ct.export_readiness(t).select("task_id", joined(F.col("blockers")).alias("blockers"), "readiness")


@query("evict_oldest", """WITH o AS (SELECT task_id AS output_id, created_ms AS mtime_ms, size_bytes, task_id % 6 = 0 AS referenced FROM tasks),
c AS (SELECT *, coalesce(sum(size_bytes) OVER (ORDER BY mtime_ms, output_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (ORDER BY mtime_ms, output_id) - 1 AS n FROM o WHERE NOT referenced),
t AS (SELECT sum(size_bytes) AS b, count(*) AS k FROM o)
SELECT output_id, size_bytes FROM c, t WHERE b - before > 150000000000 OR k - n > 9000""")
def _(src):
    outputs = src("tasks").select(F.lit("store").alias("root"), F.col("task_id").alias("output_id"), F.col("created_ms").alias("mtime_ms"), "size_bytes", (F.col("task_id") % 6 == 0).alias("referenced"))
    return ct.evict_oldest(outputs, "root", 150_000_000_000, 9_000, slot_ms=30 * 86_400_000).select("output_id", "size_bytes")


@query("storage_breakdown", """WITH f AS (SELECT 'hub/model_' || CAST(l_suppkey % 7 AS STRING) || '/' || CAST(l_partkey AS STRING) AS path, CAST(floor(l_extendedprice) AS BIGINT) AS size_bytes FROM lineitem),
g AS (SELECT CASE WHEN starts_with(path, 'hub/model_1/') THEN 'asr' WHEN starts_with(path, 'hub/model_2/') THEN 'tts' ELSE 'hub' END AS grp, size_bytes FROM f)
SELECT grp, CAST(sum(size_bytes) AS BIGINT) AS bytes, count(*) AS files FROM g GROUP BY grp UNION ALL SELECT 'total', CAST(sum(size_bytes) AS BIGINT), count(*) FROM g""")
def _(src):
    files = src("lineitem").select(F.concat(F.lit("hub/model_"), (F.col("l_suppkey") % 7).cast("string"), F.lit("/"), F.col("l_partkey").cast("string")).alias("path"), F.floor("l_extendedprice").cast("long").alias("size_bytes"))
    return ct.storage_breakdown(files, [("asr", "hub/model_1/"), ("tts", "hub/model_2/")], "hub")


@query("latest_decision", """SELECT target_id, arg_max(op, seq) AS op, arg_max(payload, seq) AS payload, max(seq) AS seq FROM oplog GROUP BY target_id""")
def _(src):
    return ct.latest_by_key(src("oplog").select("target_id", "op", "payload", "seq"), ["target_id"], ["seq"])


OPS_SQL = """WITH w AS (SELECT media_id, target_id, seq, CASE op WHEN 'set_text' THEN 'text' WHEN 'set_speaker' THEN 'speaker' WHEN 'approve' THEN 'status' WHEN 'lock' THEN 'voice_lock' END AS field,
  CASE op WHEN 'approve' THEN 'approved' WHEN 'lock' THEN 'true' ELSE 'v' || json_extract_string(payload, '$.k') END AS value FROM oplog WHERE op <> 'malformed'),
state AS (SELECT media_id, target_id, field, arg_max(value, seq) AS value, max(seq) AS seq FROM w GROUP BY ALL)
"""


@query("op_log_state", OPS_SQL + "SELECT * FROM state")
def _(src):
    return ct.last_write_wins(ct.unpivot_ops(src("oplog")))


@query("editor_summary", OPS_SQL + """, issues AS (SELECT media_id, target_id, CASE WHEN value > 80 THEN 'P0' ELSE 'P1' END AS severity FROM oplog WHERE op = 'malformed'),
ap AS (SELECT media_id, target_id FROM state WHERE field = 'status' AND value = 'approved'),
o AS (SELECT media_id, count(*) AS open_issues, count(*) FILTER (severity = 'P0') AS p0_open FROM issues WHERE (media_id, target_id) NOT IN (SELECT (media_id, target_id) FROM ap) GROUP BY media_id),
a AS (SELECT media_id, count(*) AS approved FROM ap GROUP BY media_id)
SELECT media_id, coalesce(open_issues, 0) AS open_issues, coalesce(p0_open, 0) AS p0_open, coalesce(approved, 0) AS approved FROM o FULL OUTER JOIN a USING (media_id)""")
def _(src):
    issues = src("oplog").filter("op = 'malformed'").select("media_id", "target_id", F.when(F.col("value") > 80, "P0").otherwise("P1").alias("severity"))
    return ct.editor_summary(ct.last_write_wins(ct.unpivot_ops(src("oplog"))), issues)
