"""Registered queries: commentary plans and synthesis groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueloom.operators import commentary as cm
from cueloom.operators import repair as rp
from cueloom.operators import speakers as sp
from cueloom.plans.registry import query

# a window per cue: some with an unreadable start or end, some before 0, some past the limit of every third media, some too short
PLAN_SQL = """WITH raw AS (SELECT media_id, 'p' || CAST(ord AS STRING) AS plan_id, ord, CAST(ord % 3 = 0 AS INTEGER) AS ost, CAST(floor((start_ms - 2000) / 500) AS BIGINT) * 500 - 500 * (ord % 5) AS a,
  CAST(floor((start_ms - 2000) / 500) AS BIGINT) * 500 - 500 * (ord % 5) + CASE WHEN ord % 4 = 3 THEN 50 ELSE 1000 + end_ms - start_ms END AS b, CASE WHEN media_id % 3 = 0 THEN 9000 ELSE 0 END AS cap, ord % 7 = 5 OR ord % 11 = 4 AS broken, speaker_label, text FROM cues),
w0 AS (SELECT *, greatest(0, a) AS s, CASE WHEN cap > 0 THEN least(b, cap) ELSE b END AS e FROM raw WHERE NOT broken),
win AS (SELECT media_id, plan_id, ost, s AS start_ms, e AS end_ms, speaker_label AS story_role, row_number() OVER (PARTITION BY media_id ORDER BY s, ord) AS item_id FROM w0 WHERE e - s >= 100),
nar AS (SELECT media_id, plan_id, trim(text) AS narration, 'pic ' || plan_id AS picture FROM raw WHERE ord % 5 <> 2),
item AS (SELECT w.*, CASE WHEN ost = 1 THEN '' ELSE coalesce(narration, '') END AS narration, coalesce(picture, '') AS picture FROM win w LEFT JOIN nar USING (media_id, plan_id)),
est AS (SELECT *, CASE WHEN ost = 1 THEN (end_ms - start_ms) / 1000.0::DOUBLE WHEN narration = '' THEN 0.0::DOUBLE ELSE round(length(narration) / 6.5::DOUBLE, 2) END AS est_seconds FROM item)
"""


def _windows(src):
    a = F.floor((F.col("start_ms") - 2000) / 500) * 500 - 500 * (F.col("ord") % 5)
    rows = src("cues").withColumn("a", a).withColumn("b", F.col("a") + F.when(F.col("ord") % 4 == 3, 50).otherwise(1000 + F.col("end_ms") - F.col("start_ms")))
    text = F.when(F.col("ord") % 7 == 5, "soon").otherwise((F.col("a") / 1000.0).cast("decimal(18,3)").cast("string"))
    plan = rows.select("media_id", F.concat(F.lit("p"), F.col("ord").cast("string")).alias("plan_id"), "ord", (F.col("ord") % 3 == 0).cast("int").alias("ost"), text.alias("src_start"),
                       F.when(F.col("ord") % 11 == 4, "later").otherwise((F.col("b") / 1000.0).cast("decimal(18,3)").cast("string")).alias("src_end"), F.when(F.col("media_id") % 3 == 0, 9_000).otherwise(0).cast("long").alias("max_end_ms"), F.col("speaker_label").alias("story_role"))
    return cm.plan_windows(plan)


def _items(src):
    rows = src("cues").filter("ord % 5 <> 2").select("media_id", F.concat(F.lit("p"), F.col("ord").cast("string")).alias("plan_id"), "ord", F.concat(F.lit(" "), "text").alias("narration"))
    both = rows.withColumn("picture", F.concat(F.lit("pic "), "plan_id")).unionByName(rows.withColumn("narration", F.lit("older")).withColumn("picture", F.lit("x")).withColumn("ord", F.col("ord") - 1000))
    return cm.merge_narration(_windows(src), both, F.lit(6.5))


@query("plan_windows", PLAN_SQL + "SELECT * FROM win")
def _(src):
    return _windows(src)


@query("merge_narration", PLAN_SQL + "SELECT * FROM est")
def _(src):
    return _items(src)


@query("plan_clips", PLAN_SQL + """, d AS (SELECT media_id, item_id, CAST(round(est_seconds * 1000) AS BIGINT) AS narration_ms FROM est WHERE item_id % 6 <> 1), q AS (SELECT media_id, max(end_ms) - 3000 AS source_ms FROM cues GROUP BY media_id),
c AS (SELECT media_id, item_id, ost, start_ms, least(end_ms, source_ms) - start_ms AS win, narration_ms FROM est JOIN q USING (media_id) LEFT JOIN d USING (media_id, item_id) WHERE start_ms < source_ms),
v AS (SELECT *, CASE WHEN ost = 1 THEN win WHEN narration_ms > 0 THEN greatest(narration_ms, 500) END AS av_ms FROM c WHERE win > 0)
SELECT media_id, item_id, ost, start_ms, least(av_ms, win) AS take_ms, av_ms, row_number() OVER (PARTITION BY media_id ORDER BY item_id) - 1 AS index FROM v WHERE av_ms IS NOT NULL""")
def _(src):
    items = _items(src)
    spoken = items.filter("item_id % 6 <> 1").select("media_id", "item_id", F.round(F.col("est_seconds") * 1000).cast("long").alias("narration_ms"))
    return cm.plan_clips(items, spoken, src("cues").groupBy("media_id").agg((F.max("end_ms") - 3_000).alias("source_ms")))


@query("synthesis_groups", """WITH r AS (SELECT media_id, segment_id, start_ms, end_ms, dur_ms < 1500 AS need, CASE WHEN segment_id % 7 = 0 THEN '' ELSE 'c' || CAST(start_ms // 12000 AS STRING) END AS c, row_number() OVER w - 1 AS pos FROM segments WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, end_ms, segment_id)),
b AS (SELECT *, CASE WHEN c = '' OR lag(c) OVER w IS NULL OR c <> lag(c) OVER w THEN 1 ELSE 0 END AS brk FROM r WINDOW w AS (PARTITION BY media_id ORDER BY pos)), g AS (SELECT *, sum(brk) OVER (PARTITION BY media_id ORDER BY pos) AS grp FROM b),
u AS (SELECT media_id, grp, min(pos) AS first, count(*) BETWEEN 2 AND 4 AND arg_max(end_ms, pos) - arg_min(start_ms, pos) <= 8000 AND bool_or(need) AS whole FROM g GROUP BY ALL)
SELECT media_id, segment_id, pos, CASE WHEN whole THEN first ELSE pos END AS unit_pos FROM g JOIN u USING (media_id, grp)""")
def _(src):
    rows = sp.ordered(src("segments")).select("media_id", "segment_id", "pos", "start_ms", "end_ms", (F.col("dur_ms") < 1_500).alias("needs_unit"),
                                              F.when(F.col("segment_id") % 7 == 0, "").otherwise(F.concat(F.lit("c"), F.floor(F.col("start_ms") / 12_000).cast("string"))).alias("context_id"))
    return rp.synthesis_groups(rows).select("media_id", "segment_id", "pos", "unit_pos")
