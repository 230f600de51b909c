"""Registered queries: speaker embeddings and registry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cueloom.functions import vectors as vx
from cueloom.operators import detections as dt
from cueloom.operators import registry as rg
from cueloom.operators import speakers as sp
from cueloom.plans.detection_queries import GROUPS_SQL
from cueloom.plans.registry import query
from cueloom.session import cut_lineage

DIM = 64
V = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS vec FROM vectors)"


def _vectors(src):
    return src("vectors").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("vec"))


@query("vector_similarity", "WITH " + V + """ SELECT a.vec_id, round(list_dot_product(a.vec, b.vec), 6) AS dot_product, round(list_cosine_similarity(a.vec, b.vec), 6) AS cosine
FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""")
def _(src):
    a = _vectors(src)
    b = a.select((F.col("id") - 1).alias("id"), F.col("vec").alias("other"))
    return a.join(b, "id").select(F.col("id").alias("vec_id"), F.round(vx.dot(F.col("vec"), F.col("other")), 6).alias("dot_product"), F.round(vx.cosine(F.col("vec"), F.col("other")), 6).alias("cosine"))


PROTO_SQL = "WITH " + V + """, p AS (SELECT a.label, a.vec_id, any_value(a.vec) AS vec, avg(list_dot_product(a.vec, b.vec)) AS s FROM v a JOIN v b USING (label) GROUP BY ALL),
m AS (SELECT label, arg_max(vec, (round(s, 9), -vec_id)) AS medoid FROM p GROUP BY label),
k AS (SELECT v.label, v.vec FROM v JOIN m USING (label) WHERE list_dot_product(vec, medoid) >= 0.6),
e AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(vec) AS x, unnest(range(64)) AS i FROM k) GROUP BY ALL),
proto AS (SELECT label, list(x ORDER BY i) AS c FROM e GROUP BY label), n AS (SELECT label, count(*) AS kept FROM k GROUP BY label)
"""


@query("speaker_prototypes", PROTO_SQL + """SELECT CAST(label AS BIGINT) AS label, kept, round(c[1] / sqrt(list_dot_product(c, c)), 6) AS first_value, round(list_dot_product(c, c) / list_dot_product(c, c), 6) AS squared_norm FROM proto JOIN n USING (label)""")
def _(src):
    out = rg.prototypes(_vectors(src), ["label"], DIM)
    p = F.col("prototype")
    return out.select("label", "kept", F.round(p[0], 6).alias("first_value"), F.round(vx.dot(p, p), 6).alias("squared_norm"))


REG_SQL = "WITH " + V + """, reg AS (SELECT 'spk_' || lpad(CAST(label * 10 + vec_id % 10 AS STRING), 4, '0') AS speaker_id, vec_id, vec FROM v WHERE vec_id % 5 <> 0),
proto AS (SELECT speaker_id, arg_min(vec, vec_id) AS vec FROM reg GROUP BY speaker_id),
fl AS (SELECT max(round(list_dot_product(a.vec, b.vec), 6)) AS floor FROM proto a JOIN proto b ON a.speaker_id < b.speaker_id)
"""


def _registry(src):
    rows = _vectors(src).filter("id % 5 <> 0").withColumn("speaker_id", F.concat(F.lit("spk_"), F.lpad((F.col("label") * 10 + F.col("id") % 10).cast("string"), 4, "0")))
    protos = rows.groupBy("speaker_id").agg(F.min_by("vec", "id").alias("prototype"))
    return rows, protos


@query("registry_floor", REG_SQL + "SELECT CASE WHEN floor >= 0 THEN floor ELSE 0.25::DOUBLE END AS floor FROM fl")
def _(src):
    return rg.registry_floor(_registry(src)[1])


MATCH_SQL = REG_SQL + """, s AS (SELECT p.vec_id AS profile_id, r.speaker_id, max(round(list_dot_product(p.vec, r.vec), 6)) AS score FROM v p, reg r WHERE p.vec_id % 5 = 0 AND p.vec_id % 15 <> 0 GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, speaker_id) AS rank FROM s),
b AS (SELECT profile_id, max(score) FILTER (rank = 1) AS score, max(speaker_id) FILTER (rank = 1) AS sp, round(max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2), 6) AS margin FROM t GROUP BY profile_id),
d AS (SELECT b.*, CASE WHEN score >= greatest(0.55::DOUBLE, floor + 0.15::DOUBLE) AND margin >= 0.05::DOUBLE THEN 'matched' WHEN score >= greatest(0.35::DOUBLE, floor + 0.05::DOUBLE) THEN 'review' ELSE 'new_speaker' END AS decision FROM b, fl),
matches AS (SELECT v.vec_id AS profile_id, v.vec_id % 15 <> 0 AS cloneable, score, margin, CASE WHEN v.vec_id % 15 = 0 THEN 'non_cloneable' ELSE decision END AS decision, CASE WHEN decision = 'matched' THEN sp END AS matched_speaker
  FROM v LEFT JOIN d ON d.profile_id = v.vec_id WHERE v.vec_id % 5 = 0)
"""


def _matches(src):
    rows, protos = _registry(src)
    profiles = _vectors(src).filter("id % 5 = 0").select(F.col("id").alias("profile_id"), "vec", (F.col("id") % 15 != 0).alias("cloneable"))
    return profiles, rg.match_profiles(profiles, rows.select("speaker_id", "vec"), rg.registry_floor(protos))


@query("registry_top_candidates", MATCH_SQL + "SELECT profile_id, speaker_id, score, CAST(rank AS INTEGER) AS rank FROM t WHERE rank <= 3")
def _(src):
    rows, _ = _registry(src)
    profiles = _vectors(src).filter("id % 5 = 0 AND id % 15 <> 0")
    top = vx.best_matches(profiles.select("id", "vec"), rows.select(F.col("speaker_id").alias("group_id"), "vec"), 3, 8, 2)
    return top.select(F.col("id").alias("profile_id"), F.col("group_id").alias("speaker_id"), "score", "rank")


@query("registry_match", MATCH_SQL + "SELECT * FROM matches")
def _(src):
    return _matches(src)[1]


@query("registry_update")
def _(src):
    rows, protos = _registry(src)
    exemplars = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("speaker_id").orderBy(F.desc("id")))).filter("_rn <= 12")
    kept = exemplars.groupBy("speaker_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "vec"))), lambda s: s["vec"]).alias("exemplars"))
    registry = kept.join(protos.withColumn("prototype", F.transform("prototype", lambda x: x.cast("double"))), "speaker_id")
    profiles, matches = _matches(src)
    out = rg.update_registry(registry, profiles, matches)
    return out.select("speaker_id", F.size("exemplars").alias("exemplar_count"), F.round(F.col("prototype")[0], 6).alias("first_value"))


@query("clear_non_cloneable", """SELECT vec_id AS profile_id, 'L' || CAST(label AS STRING) AS speaker_label, CASE WHEN label % 3 <> 0 THEN CAST(len(embedding) AS INTEGER) END AS dim, CASE WHEN label % 3 = 0 THEN 0 ELSE 4 END AS clip_count, label % 3 <> 0 AS cloneable FROM vectors""")
def _(src):
    profiles = _vectors(src).select(F.col("id").alias("profile_id"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("speaker_label"), "vec", F.lit(4).alias("clip_count"))
    listed = profiles.filter(F.substring("speaker_label", 2, 9).cast("int") % 3 == 0)
    out = rg.clear_non_cloneable(profiles, listed)
    return out.select("profile_id", "speaker_label", F.when(F.col("vec").isNotNull(), F.size("vec")).alias("dim"), "clip_count", "cloneable")


AUDIT_SQL = PROTO_SQL + """, pm AS (SELECT label, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c FROM proto),
sg AS (SELECT vec_id % 7 AS media_id, vec_id AS segment_id, CASE WHEN vec_id % 9 = 0 THEN (label + 1) % 10 ELSE label END AS assigned, vec FROM v WHERE 100 + vec_id * 37 % 2000 >= 400),
pr AS (SELECT DISTINCT m AS media_id, label AS speaker_id, c AS prototype FROM pm, range(7) r(m) WHERE (label + m) % 4 <> 0),
x AS (SELECT sg.*, pr.speaker_id, round(list_dot_product(vec, prototype), 6) AS cos FROM sg JOIN pr USING (media_id) WHERE (sg.media_id, sg.assigned) IN (SELECT (media_id, speaker_id) FROM pr)),
au AS (SELECT media_id, segment_id, assigned, max(cos) FILTER (speaker_id = assigned) AS assigned_cos, arg_max(speaker_id, (cos, speaker_id)) AS best, max(cos) AS best_cos, coalesce(round(max(cos) FILTER (speaker_id = assigned) - max(cos) FILTER (speaker_id <> assigned), 6), 1.0::DOUBLE) AS confidence FROM x GROUP BY ALL),
audit AS (SELECT *, best <> assigned AND round(best_cos - assigned_cos, 6) > 0.06::DOUBLE AS suspect FROM au)
"""


def _audit(src):
    rows = _vectors(src)
    protos = rg.prototypes(rows, ["label"], DIM).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("media_id"), F.col("label").alias("speaker_id"), "prototype").filter("(speaker_id + media_id) % 4 <> 0")
    segments = rows.select((F.col("id") % 7).alias("media_id"), F.col("id").alias("segment_id"), F.when(F.col("id") % 9 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("assigned"), "vec", (F.col("id") * 37 % 2000 + 100).alias("dur_ms"))
    return rg.attribution_audit(segments, protos)


@query("attribution_audit", AUDIT_SQL + "SELECT media_id, segment_id, CAST(assigned AS BIGINT) AS assigned, assigned_cos, CAST(best AS BIGINT) AS best, best_cos, confidence, suspect FROM audit")
def _(src):
    return _audit(src)


@query("audit_summary", AUDIT_SQL + "SELECT media_id, count(*) AS checked, count(*) FILTER (suspect) AS suspects, round(quantile_cont(confidence, 0.5), 6) AS median_confidence, min(confidence) AS min_confidence FROM audit GROUP BY media_id")
def _(src):
    return rg.audit_summary(_audit(src)).withColumn("median_confidence", F.round("median_confidence", 6))


def clusters_sql(p: str, rows: str) -> str:
    """CTEs ending in `p` (media_id, id, c): average-link clusters of `rows` (media_id, id, vec) by merging the nearest two, one at a time, c being the smallest id."""
    return f"""{p}_v AS ({rows}), {p}_d AS (SELECT a.media_id, a.id AS i, b.id AS j, list_dot_product(a.vec, b.vec) AS dot, list_cosine_similarity(a.vec, b.vec) AS sim FROM {p}_v a JOIN {p}_v b ON a.media_id = b.media_id AND a.id < b.id),
{p}_r AS (SELECT media_id, id, id AS c, 0 AS step, 0.0::DOUBLE AS height FROM {p}_v UNION ALL SELECT r.media_id, r.id, CASE WHEN r.c = m.b THEN m.a ELSE r.c END, r.step + 1, m.h FROM {p}_r r JOIN (
    SELECT media_id, min(h) AS h, arg_min(a, h) AS a, arg_min(b, h) AS b FROM (SELECT media_id, least(x.c, y.c) AS a, greatest(x.c, y.c) AS b, 1 - avg(sim) AS h FROM {p}_d JOIN {p}_r x USING (media_id) JOIN {p}_r y USING (media_id) WHERE x.id = i AND y.id = j AND x.c <> y.c GROUP BY ALL) GROUP BY media_id) m ON m.media_id = r.media_id),
{p}_n AS (SELECT media_id, count(DISTINCT id) AS n, count(DISTINCT step) FILTER (step > 0 AND height < 1 - 0.62::DOUBLE) AS near FROM {p}_r GROUP BY media_id),
{p}_o AS (SELECT media_id, quantile_cont(dot, 0.2) >= 0.52 AS one FROM {p}_d GROUP BY media_id),
{p} AS (SELECT r.media_id, r.id, r.c FROM {p}_r r JOIN {p}_n n USING (media_id) LEFT JOIN {p}_o USING (media_id) WHERE r.step = CASE WHEN coalesce(one, true) THEN n.n - 1 ELSE greatest(near, n.n - CASE WHEN n.n <= 6 THEN n.n ELSE greatest(2, least(8, n.n // 6 + 1)) END) END)"""


MEDIA_VECTORS = "SELECT vec_id // 25 AS media_id, vec_id AS id, vec FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM vectors)"


@query("speaker_clusters", f"WITH RECURSIVE {clusters_sql('k', MEDIA_VECTORS)} SELECT media_id, id, 'SPEAKER_' || lpad(CAST(dense_rank() OVER (PARTITION BY media_id ORDER BY c) - 1 AS STRING), 2, '0') AS stable_label FROM k")
def _(src):
    found = rg.cluster_media(_vectors(src).select(F.floor(F.col("id") / 25).alias("media_id"), "id", "vec"))
    return rg.stable_relabel(found, "cluster", "id").select("media_id", "id", "stable_label")


#: A group's vector: one of 400 by media and group, none for every sixth group and for every ninth media.
GROUP_VECTORS = """SELECT g.media_id, g.grp AS id, v.vec FROM gr g JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM vectors) v ON v.vec_id = (g.media_id * 13 + g.grp % 3 * 101 + g.grp) % 400 WHERE g.grp % 6 <> 4 AND g.media_id % 9 <> 5"""
ASSIGN_SQL = f"""WITH RECURSIVE {GROUPS_SQL}, gr AS (SELECT media_id, session, row_number() OVER (PARTITION BY media_id ORDER BY session) - 1 AS grp FROM (SELECT DISTINCT media_id, session FROM u)),
{clusters_sql('k', GROUP_VECTORS)},
nearest AS (SELECT g.media_id, g.session, coalesce(arg_min(k.c, (abs(k.id - g.grp), k.id)), 0) AS c FROM gr g LEFT JOIN k ON k.media_id = g.media_id GROUP BY g.media_id, g.session),
rows AS (SELECT u.media_id, u.segment_id, u.pos, u.session, c, s.end_ms - s.start_ms AS dur, lead(c) OVER (PARTITION BY u.media_id ORDER BY u.pos) AS nx FROM u JOIN nearest USING (media_id, session) JOIN segments s ON s.media_id = u.media_id AND s.segment_id = u.segment_id),
sm AS (SELECT media_id, segment_id, pos, session, c AS l FROM rows WHERE pos = 0 UNION ALL SELECT d.media_id, d.segment_id, d.pos, d.session, CASE WHEN d.dur <= 1500 AND d.nx IS NOT NULL AND sm.l = d.nx THEN sm.l ELSE d.c END FROM sm JOIN rows d ON d.media_id = sm.media_id AND d.pos = sm.pos + 1),
f AS (SELECT media_id, l, row_number() OVER (PARTITION BY media_id ORDER BY min(pos)) - 1 AS k FROM sm GROUP BY media_id, l)
SELECT media_id, segment_id, session, 'SPEAKER_' || lpad(CAST(k AS STRING), 2, '0') AS stable_label FROM sm JOIN f USING (media_id, l)"""


@query("assign_speakers", ASSIGN_SQL)
def _assigned(src):
    units = cut_lineage(dt.embedding_groups(src("segments")).select("media_id", "segment_id", "pos", "session"))
    groups = units.select("media_id", "session").distinct().withColumn("grp", F.row_number().over(Window.partitionBy("media_id").orderBy("session")) - 1)
    picked = groups.filter("grp % 6 <> 4 AND media_id % 9 <> 5").withColumn("id", (F.col("media_id") * 13 + F.col("grp") % 3 * 101 + F.col("grp")) % 400)
    vectors = picked.join(_vectors(src).select("id", "vec"), "id")
    return rg.assign_speakers(src("segments"), units, vectors).select("media_id", "segment_id", "session", "stable_label")


@query("stable_relabel", """WITH c AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, end_ms, segment_id) - 1 AS pos FROM segments), f AS (SELECT media_id, event_type, min(pos) AS first FROM c GROUP BY ALL),
n AS (SELECT media_id, event_type, 'SPEAKER_' || lpad(CAST(row_number() OVER (PARTITION BY media_id ORDER BY first) - 1 AS STRING), 2, '0') AS stable_label FROM f) SELECT media_id, segment_id, stable_label FROM c JOIN n USING (media_id, event_type)""")
def _(src):
    return rg.stable_relabel(sp.ordered(src("segments")), "event_type").select("media_id", "segment_id", "stable_label")


@query("smooth_labels", """WITH RECURSIVE p AS (SELECT media_id, segment_id, speaker_label AS l, dur_ms, row_number() OVER w - 1 AS pos, lead(speaker_label) OVER w AS nx FROM segments WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, end_ms, segment_id)),
r AS (SELECT media_id, segment_id, pos, l AS o FROM p WHERE pos = 0 UNION ALL SELECT p.media_id, p.segment_id, p.pos, CASE WHEN dur_ms <= 1500 AND nx IS NOT NULL AND r.o = nx THEN r.o ELSE l END FROM r JOIN p ON p.media_id = r.media_id AND p.pos = r.pos + 1)
SELECT media_id, segment_id, pos, o AS smoothed FROM r""")
def _(src):
    return rg.smooth_labels(sp.ordered(src("segments")), "speaker_label").select("media_id", "segment_id", "pos", "smoothed")
