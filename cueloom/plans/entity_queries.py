"""Registered queries: personas, works and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueloom.operators import entities as en
from cueloom.operators import speakers as sp
from cueloom.plans.registry import query
from cueloom.session import cut_lineage


@query("name_similarity", """WITH n AS (SELECT s_suppkey AS id, lower(trim(s_name)) AS x, CASE s_suppkey % 5 WHEN 0 THEN lower(s_name) WHEN 1 THEN substring(lower(s_name), 1, 8) WHEN 2 THEN substring(lower(s_name), 3, 6) WHEN 3 THEN 'zz' ELSE '' END AS y FROM supplier)
SELECT id, CASE WHEN x = '' OR y = '' THEN 0.0::DOUBLE WHEN x = y THEN 1.0::DOUBLE WHEN starts_with(x, y) OR starts_with(y, x) OR ends_with(x, y) OR ends_with(y, x) THEN 0.7::DOUBLE WHEN contains(x, y) OR contains(y, x) THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS similarity FROM n""")
def _(src):
    k = F.col("s_suppkey") % 5
    other = F.when(k == 0, F.upper("s_name")).when(k == 1, F.substring("s_name", 1, 8)).when(k == 2, F.substring("s_name", 3, 6)).when(k == 3, F.lit("zz")).otherwise(F.lit(" "))
    return src("supplier").select(F.col("s_suppkey").alias("id"), en.name_similarity(F.col("s_name"), other).alias("similarity"))


BIND_SQL = """WITH bind AS (SELECT media_id, 'SPEAKER_0' || CAST(persona_id % 4 AS STRING) AS speaker_label, min(persona_id) AS persona_id, arg_min(name, persona_id) AS name FROM personas GROUP BY ALL)
"""


def _bindings(src):
    rows = src("personas").withColumn("speaker_label", F.concat(F.lit("SPEAKER_0"), (F.col("persona_id") % 4).cast("string")))
    return en.first_binding(rows)


@query("speaker_ids", BIND_SQL + "SELECT s.media_id, s.segment_id, b.persona_id AS speaker_id FROM segments s LEFT JOIN bind b USING (media_id, speaker_label)")
def _(src):
    profiles = _bindings(src).select("media_id", "speaker_label", F.col("persona_id").alias("speaker_id"))
    segs = src("segments").withColumn("media_id", F.col("media_id"))
    return en.speaker_ids(segs, profiles.withColumn("media_id", F.col("media_id").cast("long"))).select("media_id", "segment_id", "speaker_id")


@query("persona_columns", BIND_SQL + """, c AS (SELECT media_id, segment_id, speaker_label, lag(speaker_label) OVER w AS pl, lead(speaker_label) OVER w AS nl FROM segments WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, end_ms, segment_id))
SELECT c.media_id, c.segment_id, a.persona_id, a.name AS persona_name, p.persona_id AS previous_persona_id, n.persona_id AS next_persona_id FROM c LEFT JOIN bind a ON a.media_id = c.media_id AND a.speaker_label = c.speaker_label LEFT JOIN bind p ON p.media_id = c.media_id AND p.speaker_label = pl LEFT JOIN bind n ON n.media_id = c.media_id AND n.speaker_label = nl""")
def _(src):
    rows = sp.boundary_context(src("segments"))
    out = en.persona_columns(rows, _bindings(src).withColumn("media_id", F.col("media_id").cast("long")))
    return out.select("media_id", "segment_id", "persona_id", "persona_name", "previous_persona_id", "next_persona_id")


@query("unassigned_speakers", BIND_SQL + "SELECT DISTINCT media_id, speaker_label FROM segments WHERE (media_id, speaker_label) NOT IN (SELECT (media_id, speaker_label) FROM bind WHERE persona_id % 3 <> 0)")
def _(src):
    bound = _bindings(src).filter("persona_id % 3 <> 0").withColumn("media_id", F.col("media_id").cast("long"))
    return en.unassigned(src("segments"), bound)


@query("bulk_create", BIND_SQL + """, f AS (SELECT DISTINCT media_id, speaker_label FROM segments WHERE (media_id, speaker_label) NOT IN (SELECT (media_id, speaker_label) FROM bind WHERE persona_id % 3 <> 0)), r AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY speaker_label) - 1 AS pos FROM f)
SELECT media_id, speaker_label, CASE pos WHEN 0 THEN 'Lead' WHEN 1 THEN 'Guest' ELSE 'Guest ' || CAST(pos AS STRING) END AS name FROM r""")
def _(src):
    bound = _bindings(src).filter("persona_id % 3 <> 0").withColumn("media_id", F.col("media_id").cast("long"))
    return en.bulk_create(en.unassigned(src("segments"), bound), ["Lead", "Guest"])


WORKS_SQL = "WITH w AS (SELECT p_partkey AS work_id, p_name AS title, [p_type || ' ' || p_name, p_brand || CAST(p_partkey AS STRING)] AS aliases FROM part)"


def _works(src):
    return src("part").select(F.col("p_partkey").alias("work_id"), F.col("p_name").alias("title"), F.array(F.concat_ws(" ", "p_type", "p_name"), F.concat("p_brand", F.col("p_partkey").cast("string"))).alias("aliases"))


@query("lookup_by_name", WORKS_SQL + """, n AS (SELECT lower(trim(x)) AS n, min(work_id) AS work_id FROM (SELECT work_id, unnest(list_concat([title], aliases)) AS x FROM w) GROUP BY ALL),
q AS (SELECT p_partkey AS qid, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN ' ' || p_type || ' ' || p_name || ' ' WHEN 2 THEN p_brand || CAST(p_partkey AS STRING) ELSE 'nothing' END AS name FROM part) SELECT qid, work_id FROM q LEFT JOIN n ON n.n = lower(trim(q.name))""")
def _(src):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.upper("p_name")).when(k == 1, F.concat(F.lit(" "), "p_type", F.lit(" "), "p_name", F.lit(" "))).when(k == 2, F.concat("p_brand", F.col("p_partkey").cast("string"))).otherwise("nothing")
    return en.lookup_by_name(src("part").select(F.col("p_partkey").alias("qid"), name.alias("name")), _works(src)).select("qid", "work_id")


@query("name_conflicts", "WITH f AS (SELECT media_id, lower(name) AS n, min(persona_id) AS conflict_id FROM personas GROUP BY ALL) SELECT p.media_id, persona_id, conflict_id FROM personas p JOIN f ON f.media_id = p.media_id AND f.n = lower(p.name) WHERE persona_id <> conflict_id")
def _(src):
    return en.name_conflicts(src("personas"))


@query("search_works", WORKS_SQL + " SELECT work_id FROM w WHERE contains(lower(title), 'red') OR len(list_filter(aliases, lambda a: contains(lower(a), 'red'))) > 0")
def _(src):
    return en.search_works(_works(src), "RED").select("work_id")


INFER_SQL = r"""WITH src AS (SELECT task_id, 0 AS source, name AS raw FROM work_tasks WHERE name <> '' UNION ALL SELECT task_id, 1, b FROM (SELECT task_id, regexp_replace(regexp_replace(path, '^.*/', ''), '^(\.*[^.].*)\.[^.]*$', '\1') AS b FROM work_tasks) WHERE b <> ''),
h AS (SELECT DISTINCT task_id, trim(lower(regexp_replace(raw, '[._\-]+', ' ', 'g'))) AS hay FROM src), nm AS (SELECT work_id, lower(trim(title)) AS n FROM work_titles UNION SELECT work_id, lower(trim(alias)) FROM work_titles),
hn AS (SELECT hay, n FROM (SELECT DISTINCT hay FROM h) a, (SELECT DISTINCT n FROM nm) b WHERE contains(hay, n) OR contains(n, hay)), tn AS (SELECT DISTINCT task_id, n FROM h JOIN hn USING (hay)),
p1 AS (SELECT DISTINCT task_id, work_id, 0.9::DOUBLE AS score, 0 AS pass FROM tn JOIN nm USING (n)),
tok AS (SELECT DISTINCT task_id, unnest(string_split(hay, ' ')) AS tok FROM h), tt AS (SELECT DISTINCT trim(lower(regexp_replace(title, '[._\-]+', ' ', 'g'))) AS t FROM work_titles),
near AS (SELECT tok, t, levenshtein(translate(tok, '风起', 'XY'), translate(t, '风起', 'XY')) AS d FROM (SELECT DISTINCT tok FROM tok WHERE tok <> '') a, tt WHERE abs(length(tok) - length(t)) <= 4 AND levenshtein(translate(tok, '风起', 'XY'), translate(t, '风起', 'XY')) <= greatest(1, length(t) // 4)),
nt AS (SELECT task_id, t, round(0.6::DOUBLE + (1 - min(d) / any_value(length(t))) * 0.1::DOUBLE, 3) AS score FROM tok JOIN near USING (tok) GROUP BY task_id, t),
p2 AS (SELECT task_id, work_id, score, 1 AS pass FROM nt JOIN work_titles w ON trim(lower(regexp_replace(w.title, '[._\-]+', ' ', 'g'))) = t ANTI JOIN p1 USING (task_id, work_id)),
m AS (SELECT p.*, title FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2) p JOIN work_titles USING (work_id)),
g AS (SELECT task_id, source, raw, nullif(trim(regexp_replace(coalesce(nullif(regexp_extract(raw, '(?i)^(.+?)[._\s-]+S\d{1,2}E\d{1,3}', 1), ''), nullif(regexp_extract(raw, '(?i)^(.+?)[._\s-]+(?:EP?|第)\s*\d{1,3}', 1), ''), nullif(regexp_extract(raw, '^(.+?)[._\s-]+(?:19|20)\d{2}\b', 1), '')), '[._\-]+', ' ', 'g')), '') AS title,
  CAST(nullif(regexp_extract(raw, '^.+?[._\s-]+((?:19|20)\d{2})\b', 1), '') AS INTEGER) AS year FROM src),
s AS (SELECT task_id, lower(title) AS t, arg_min(title, source) AS title, arg_min(coalesce(year, -1), source) AS year, min(source) AS source FROM g WHERE title IS NOT NULL GROUP BY task_id, lower(title)),
u AS (SELECT task_id, work_id, score, pass, title, NULL::INTEGER AS year, 0 AS source FROM m UNION ALL SELECT task_id, NULL, 0.5::DOUBLE, 2, title, nullif(year, -1), source FROM s WHERE (task_id, t) NOT IN (SELECT (task_id, lower(trim(title))) FROM m)),
e AS (SELECT task_id, arg_min(episode, source) AS episode FROM (SELECT task_id, source, CASE WHEN regexp_matches(raw, '(?i).[._\s-]+S\d{1,2}E\d{1,3}') THEN 'S' || lpad(regexp_extract(raw, '(?i).[._\s-]+S(\d{1,2})E(\d{1,3})', 1), 2, '0') || 'E' || lpad(regexp_extract(raw, '(?i).[._\s-]+S(\d{1,2})E(\d{1,3})', 2), 2, '0')
  WHEN regexp_matches(raw, '(?i).[._\s-]+(?:EP?|第)\s*\d{1,3}') THEN 'E' || lpad(regexp_extract(raw, '(?i).[._\s-]+(?:EP?|第)\s*(\d{1,3})', 1), 2, '0') END AS episode FROM src) WHERE episode IS NOT NULL GROUP BY task_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY task_id ORDER BY score DESC, pass, work_id, source) AS INTEGER) AS rank FROM u QUALIFY rank <= 3)
SELECT task_id, work_id, score, title, year, rank, episode FROM r LEFT JOIN e USING (task_id)"""


@query("infer_works", INFER_SQL)
def _(src):
    works = src("work_titles").select("work_id", "title", F.array("alias").alias("aliases"))
    return en.infer_works(src("work_tasks"), works)


# speakers that know a part of a persona's name, its role, gender or work, or little of it
HINTS = """SELECT s_nationkey AS media_id, 'S' || CAST(s_suppkey AS STRING) AS speaker_label, CASE s_suppkey % 5 WHEN 0 THEN lower(name) WHEN 1 THEN substring(name, 3, 5) WHEN 2 THEN ' ' WHEN 3 THEN 'zz ' || name || ' zz' END AS name,
  CASE WHEN s_suppkey % 3 = 0 THEN lower(role) WHEN s_suppkey % 3 = 1 THEN 'nobody' END AS role, CASE WHEN s_suppkey % 4 <> 0 THEN upper(gender) END AS gender, CASE WHEN s_suppkey % 2 = 0 THEN work_id END AS work_id FROM supplier JOIN personas ON persona_id = s_suppkey * 7 % 150"""
LIBRARY = "SELECT persona_id, name, CASE WHEN persona_id % 4 = 0 THEN ['the ' || name, NULL, role] ELSE [] END AS aliases, role, gender, work_id FROM personas"
MATCH_SQL = f"""WITH hints AS ({HINTS}), lib AS ({LIBRARY}),
h AS (SELECT media_id, speaker_label, lower(trim(coalesce(name, ''))) AS n, lower(trim(coalesce(role, ''))) AS r, lower(trim(coalesce(gender, ''))) AS g, trim(coalesce(work_id, '')) AS w FROM hints),
l AS (SELECT persona_id, list_filter(list_transform(list_prepend(name, aliases), lambda x: lower(trim(coalesce(x, '')))), lambda x: x <> '') AS ts, lower(trim(coalesce(role, ''))) AS pr, lower(trim(coalesce(gender, ''))) AS pg, trim(coalesce(work_id, '')) AS pw FROM lib),
p AS (SELECT *, coalesce(list_max(list_transform(ts, lambda y: CASE WHEN n = '' THEN 0.0::DOUBLE WHEN n = y THEN 1.0::DOUBLE WHEN starts_with(n, y) OR starts_with(y, n) OR ends_with(n, y) OR ends_with(y, n) THEN 0.7::DOUBLE WHEN contains(n, y) OR contains(y, n) THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END)), 0.0) AS sim FROM h, l WHERE w = '' OR pw = '' OR w = pw),
s AS (SELECT media_id, speaker_label, persona_id, round(CASE WHEN w <> '' AND w = pw THEN 0.45::DOUBLE ELSE 0.0::DOUBLE END + sim * 0.8::DOUBLE + CASE WHEN r <> '' AND r = pr THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN g <> '' AND g = pg THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END, 3) AS score,
  array_to_string(list_filter([CASE WHEN w <> '' AND w = pw THEN 'work' END, CASE WHEN sim > 0 THEN 'name' END, CASE WHEN r <> '' AND r = pr THEN 'role' END, CASE WHEN g <> '' AND g = pg THEN 'gender' END], lambda x: x IS NOT NULL), '|') AS reasons FROM p)
SELECT media_id, speaker_label, CAST(row_number() OVER (PARTITION BY media_id, speaker_label ORDER BY score DESC, persona_id) AS INTEGER) AS rank, persona_id, score, reasons FROM s WHERE score > 0 QUALIFY rank <= 5"""


@query("match_personas", MATCH_SQL)
def _(src):
    p, k = src("personas"), F.col("s_suppkey")
    rows = src("supplier").join(p, F.col("persona_id") == k * 7 % 150)
    name = F.when(k % 5 == 0, F.lower("name")).when(k % 5 == 1, F.substring("name", 3, 5)).when(k % 5 == 2, " ").when(k % 5 == 3, F.concat(F.lit("zz "), "name", F.lit(" zz")))
    hints = rows.select(F.col("s_nationkey").alias("media_id"), F.concat(F.lit("S"), k.cast("string")).alias("speaker_label"), name.alias("name"), F.when(k % 3 == 0, F.lower("role")).when(k % 3 == 1, "nobody").alias("role"),
                        F.when(k % 4 != 0, F.upper("gender")).alias("gender"), F.when(k % 2 == 0, F.col("work_id")).alias("work_id"))
    aliases = F.when(F.col("persona_id") % 4 == 0, F.array(F.concat(F.lit("the "), "name"), F.lit(None).cast("string"), F.col("role"))).otherwise(F.array().cast("array<string>"))
    library = p.select("persona_id", "name", aliases.alias("aliases"), "role", "gender", "work_id")
    return en.match_personas(hints, library).withColumn("reasons", F.array_join("reasons", "|")).drop("scored")


@query("upsert_personas", """WITH l AS (SELECT lower(name) || '|' || coalesce(gender, '') || '|' || lower(role) AS f, min(persona_id) AS persona_id, arg_min({'name': name, 'gender': gender, 'role': role}, persona_id) AS s, 'old' AS note FROM personas WHERE persona_id % 2 = 0 GROUP BY f),
n AS (SELECT lower(name) || '|' || coalesce(gender, '') || '|' || lower(role) AS f, max(persona_id) AS persona_id, arg_max({'name': name, 'gender': gender, 'role': role}, persona_id) AS s, 'new' AS note FROM personas WHERE persona_id % 2 = 1 GROUP BY f)
SELECT coalesce(l.persona_id, n.persona_id) AS persona_id, coalesce(n.s.name, l.s.name) AS name, coalesce(n.s.gender, l.s.gender) AS gender, coalesce(n.s.role, l.s.role) AS role, coalesce(n.note, l.note) AS note FROM l FULL OUTER JOIN n USING (f)""")
def _(src):
    rows = src("personas").select("persona_id", "name", "gender", "role")
    return en.upsert_personas(rows.filter("persona_id % 2 = 0").withColumn("note", F.lit("old")), rows.filter("persona_id % 2 = 1").withColumn("note", F.lit("new")))


@query("overlay_metadata", """SELECT p_partkey, p_type AS genre, CASE WHEN p_size % 2 = 0 THEN 'patched' ELSE p_brand END AS overview, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS STRING) END AS year_text FROM part""")
def _(src):
    base = F.create_map(F.lit("genre"), F.col("p_type"), F.lit("overview"), F.col("p_brand"))
    patch = F.map_filter(F.create_map(F.lit("overview"), F.when(F.col("p_size") % 2 == 0, F.lit("patched")), F.lit("year"), F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("string"))), lambda _, v: v.isNotNull())
    rows = src("part").withColumn("m", en.overlay_map(base, patch))
    return rows.select("p_partkey", F.col("m")["genre"].alias("genre"), F.col("m")["overview"].alias("overview"), F.col("m")["year"].alias("year_text"))


@query("merge_bindings", """WITH b AS (SELECT media_id, speaker_label, min(persona_id) AS persona_id FROM personas GROUP BY ALL), m AS (SELECT DISTINCT media_id, speaker_label AS s, 'SPEAKER_' || CAST(CAST(speaker_label[9:] AS INTEGER) // 2 AS STRING) AS t FROM personas WHERE persona_id % 3 = 0)
SELECT DISTINCT b.media_id, b.speaker_label, CASE WHEN m.t IS NOT NULL AND m.t <> b.speaker_label THEN o.persona_id ELSE b.persona_id END AS persona_id FROM b LEFT JOIN m ON m.media_id = b.media_id AND m.s = b.speaker_label LEFT JOIN b o ON o.media_id = b.media_id AND o.speaker_label = m.t WHERE m.t IS NULL OR m.t = b.speaker_label OR o.persona_id IS NOT NULL""")
def _(src):
    b = src("personas").groupBy("media_id", "speaker_label").agg(F.min("persona_id").alias("persona_id"))
    target = F.concat(F.lit("SPEAKER_"), F.floor(F.substring("speaker_label", 9, 9).cast("int") / 2).cast("string"))
    merges = src("personas").filter("persona_id % 3 = 0").select("media_id", F.col("speaker_label").alias("source_label"), target.alias("target_label")).distinct()
    return en.merge_bindings(b, merges)


@query("remove_works", "SELECT persona_id, CASE WHEN work_id IN ('work_3', 'work_7') THEN 'work_1' WHEN work_id = 'work_9' THEN NULL ELSE work_id END AS work_id FROM personas")
def _(src):
    removed = src("personas").filter("work_id IN ('work_3', 'work_7', 'work_9')").select("work_id").distinct().withColumn("reassign_to", F.when(F.col("work_id") != "work_9", "work_1"))
    return en.remove_works(src("personas"), removed, False).select("persona_id", "work_id")


@query("remove_works_cascade", "SELECT persona_id FROM personas WHERE work_id IS NULL OR work_id NOT IN ('work_3', 'work_7')")
def _(src):
    removed = src("personas").filter("work_id IN ('work_3', 'work_7')").select("work_id").distinct().withColumn("reassign_to", F.lit(None).cast("string"))
    return en.remove_works(src("personas"), removed, True).select("persona_id")


@query("move_personas", "SELECT persona_id, CASE WHEN persona_id % 10 = 1 THEN NULL WHEN persona_id % 10 = 2 THEN 'work_new' ELSE work_id END AS work_id FROM personas")
def _(src):
    k = F.col("persona_id") % 10
    moves = src("personas").filter(k.isin(1, 2)).select("persona_id", F.when(k == 1, "").otherwise("work_new").alias("target_work"))
    return en.move_personas(src("personas"), moves).select("persona_id", "work_id")


DECISION_SQL = """WITH c AS (SELECT *, row_number() OVER w AS pos, lag(speaker_label) OVER w AS pl, lead(speaker_label) OVER w AS nl FROM segments WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, end_ms, segment_id)),
o AS (SELECT media_id, segment_id, segment_id * 10 + 1 AS seq, CASE segment_id % 4 WHEN 0 THEN pl WHEN 1 THEN nl WHEN 2 THEN coalesce(pl, nl) ELSE 'SPEAKER_09' END AS target FROM c WHERE segment_id % 11 = 0),
wide AS (SELECT media_id, 5000 AS seq FROM segments WHERE media_id % 3 = 0 GROUP BY media_id),
f AS (SELECT c.media_id, c.segment_id, c.speaker_label AS original_label, o.target, o.seq < coalesce(w.seq, -1) AS first_own, w.seq IS NOT NULL AS has_wide FROM c LEFT JOIN o ON o.media_id = c.media_id AND o.segment_id = c.segment_id AND o.target IS NOT NULL LEFT JOIN wide w ON w.media_id = c.media_id),
g AS (SELECT *, CASE WHEN target IS NULL THEN CASE WHEN has_wide AND original_label = 'SPEAKER_02' THEN 'SPEAKER_00' ELSE original_label END WHEN has_wide AND first_own THEN CASE WHEN target = 'SPEAKER_02' THEN 'SPEAKER_00' ELSE target END ELSE target END AS speaker_label FROM f)
"""


def _decisions(src):
    k = F.col("segment_id")
    action = F.when(k % 4 == 0, "relabel_to_previous_speaker").when(k % 4 == 1, "relabel_to_next_speaker").when(k % 4 == 2, "merge_to_surrounding_speaker").otherwise("relabel")
    base = src("segments").filter("segment_id % 11 = 0")

    def own(seq_col, act, target):
        return base.select("media_id", F.concat(F.lit("segment:"), k.cast("string")).alias("item_id"), seq_col.alias("seq"), act.alias("action"), F.array("segment_id").alias("segment_ids"), F.lit(None).cast("string").alias("source_label"), target.alias("target_label"))

    stale = own(k * 10, F.lit("relabel"), F.lit("SPEAKER_77"))
    fresh = own(k * 10 + 1, action, F.when(k % 4 == 3, "SPEAKER_09"))
    wide = src("segments").filter("media_id % 3 = 0").select("media_id").distinct().select(
        "media_id", F.lit("speaker:SPEAKER_02").alias("item_id"), F.lit(5000).cast("long").alias("seq"), F.lit("merge_speaker").alias("action"), F.array().cast("array<bigint>").alias("segment_ids"),
        F.lit("SPEAKER_02").alias("source_label"), F.lit("SPEAKER_00").alias("target_label"))
    barred = src("segments").filter("media_id % 5 = 0").select("media_id").distinct().select(
        "media_id", F.lit("speaker:SPEAKER_01").alias("item_id"), F.lit(6000).cast("long").alias("seq"), F.lit("mark_non_cloneable").alias("action"), F.array().cast("array<bigint>").alias("segment_ids"),
        F.lit(None).cast("string").alias("source_label"), F.lit(None).cast("string").alias("target_label"))
    return stale.unionByName(fresh).unionByName(wide).unionByName(barred)


@query("apply_decisions", DECISION_SQL + "SELECT media_id, segment_id, original_label, speaker_label, speaker_label <> original_label AS changed FROM g")
def _(src):
    return en.apply_decisions(src("segments"), _decisions(src))


@query("non_cloneable_speakers", "SELECT DISTINCT media_id, 'SPEAKER_01' AS speaker_label FROM segments WHERE media_id % 5 = 0")
def _(src):
    return en.non_cloneable(_decisions(src))


@query("decision_neighbours", """WITH c AS (SELECT *, row_number() OVER w AS pos, lag(speaker_label) OVER w AS pl, lead(speaker_label) OVER w AS nl FROM segments WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, end_ms, segment_id)), i AS (SELECT media_id, segment_id // 500 AS item_id, segment_id FROM segments),
s AS (SELECT i.media_id, item_id, min(pos) AS a, max(pos) AS b FROM i JOIN c USING (media_id, segment_id) GROUP BY ALL) SELECT s.media_id, s.item_id, x.pl AS previous_label, y.nl AS next_label FROM s JOIN c x ON x.media_id = s.media_id AND x.pos = a JOIN c y ON y.media_id = s.media_id AND y.pos = b""")
def _(src):
    ids = src("segments").select("media_id", F.floor(F.col("segment_id") / 500).alias("item_id"), "segment_id")
    return en.decision_neighbours(ids, sp.ordered(src("segments")))
