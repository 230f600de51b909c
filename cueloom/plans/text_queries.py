"""Registered queries: transcripts and text rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueloom.functions import text as tx
from cueloom.functions.cols import joined
from cueloom.operators import transcripts as tr
from cueloom.plans.registry import query
from cueloom.session import spread

NORM = "regexp_replace(regexp_replace(lower(trim({0})), '\\s+', '', 'g'), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}_]+', '', 'g')"
LOW = "lower(regexp_replace({0}, '\\s+', '', 'g'))"
R, H = LOW.format("ref_text"), LOW.format("hyp_text")


def EDITS(a, b, chars):
    """Edit distance in characters; the check engine counts bytes, so the `chars` of both sides become characters of one byte."""
    one = "(SELECT string_agg(chr(CAST(i AS INTEGER)), '' ORDER BY i) FROM range(1, 128) t(i))"
    plain = [f"translate({x}, array_to_string({chars}, ''), substring({one}, 1, CAST(len({chars}) AS BIGINT)))" for x in (a, b)]
    return f"levenshtein({plain[0]}, {plain[1]})"


def CHARS(a, b):
    return f"list_distinct(string_split({a} || {b}, ''))"


def SIM(a, b, chars):
    return f"(CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0::DOUBLE WHEN least(length({a}), length({b})) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - {EDITS(a, b, chars)} / greatest(length({a}), length({b})) END)"


@query("pair_scores", f"""WITH n AS (SELECT *, {NORM.format('ref_text')} AS r, {NORM.format('hyp_text')} AS h, {R} AS rl, {H} AS hl FROM text_pairs), m AS (SELECT *, {CHARS('r', 'h')} AS dn, {CHARS('rl', 'hl')} AS dl FROM n)
SELECT media_id, ord, CAST(length(r) AS INTEGER) AS ref_chars, CAST(length(h) AS INTEGER) AS hyp_chars, CASE WHEN length(rl) = 0 THEN CASE WHEN length(hl) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END
  ELSE {EDITS('rl', 'hl', 'dl')} / length(rl) END AS cer, {SIM('r', 'h', 'dn')} AS similarity FROM m""")
def _(src):
    return tr.score_pairs(src("text_pairs"))


@query("word_error_rate")
def _(src):
    return tr.word_errors(src("text_pairs"))


@query("transcript_scores", f"""WITH d AS (SELECT media_id, string_agg(ref_text, '' ORDER BY ord) AS r0, string_agg(hyp_text, '' ORDER BY ord) AS h0 FROM text_pairs GROUP BY media_id),
n AS (SELECT media_id, r, h, {CHARS('r', 'h')} AS dn FROM (SELECT media_id, {NORM.format('r0')} AS r, {NORM.format('h0')} AS h FROM d)),
l AS (SELECT *, lag(speaker_label) OVER (PARTITION BY media_id ORDER BY ord) AS p, end_ms - start_ms AS dur FROM cues),
s AS (SELECT media_id, count(*) AS segment_count, quantile_cont(dur, 0.5) AS median_ms, count(*) FILTER (dur <= 1000) / count(*) AS short_ratio, count(DISTINCT speaker_label) AS speakers,
  CASE WHEN count(*) > 1 THEN count(*) FILTER (p <> speaker_label) / (count(*) - 1) ELSE 0.0 END AS switch_rate FROM l GROUP BY media_id)
SELECT n.media_id, CAST(length(r) AS INTEGER) AS ref_chars, CAST(length(h) AS INTEGER) AS hyp_chars, CAST({EDITS('r', 'h', 'dn')} AS INTEGER) AS edits, {EDITS('r', 'h', 'dn')} / length(r) AS cer, {SIM('r', 'h', 'dn')} AS similarity,
  s.* EXCLUDE (media_id) FROM n JOIN s USING (media_id)""")
def _(src):
    segments = src("cues").withColumn("dur_ms", F.col("end_ms") - F.col("start_ms"))
    return tr.transcript_scores(src("text_pairs"), segments)


@query("multiset_similarity", """WITH c AS (SELECT media_id, ord, lower(regexp_replace(ref_text, '[\\s\\[\\]()\\-,.!?:;"''_]+', '', 'g')) AS a, lower(regexp_replace(hyp_text, '[\\s\\[\\]()\\-,.!?:;"''_]+', '', 'g')) AS b FROM text_pairs),
x AS (SELECT media_id, ord, c, count(*) AS n FROM (SELECT media_id, ord, unnest(string_split(a, '')) AS c FROM c) GROUP BY ALL), y AS (SELECT media_id, ord, c, count(*) AS n FROM (SELECT media_id, ord, unnest(string_split(b, '')) AS c FROM c) GROUP BY ALL),
s AS (SELECT media_id, ord, CAST(sum(least(x.n, y.n)) AS BIGINT) AS shared FROM x JOIN y USING (media_id, ord, c) GROUP BY ALL)
SELECT media_id, ord, coalesce(shared, 0) / greatest(length(a), length(b)) AS similarity, length(b) / length(a) AS length_ratio FROM c LEFT JOIN s USING (media_id, ord)""")
def _(src):
    return tr.character_overlap(src("text_pairs"))


@query("arbitration", """WITH v AS (SELECT media_id, ord, ref_text AS asr, hyp_text AS ocr, CASE (media_id + ord) % 5 WHEN 0 THEN 'use_asr' WHEN 1 THEN 'use_ocr' WHEN 2 THEN 'merge' WHEN 3 THEN 'merge' END AS verdict,
  CASE WHEN (media_id + ord) % 5 = 3 THEN ' zz#9 ' || ref_text ELSE ' ' || hyp_text END AS vt FROM text_pairs),
f AS (SELECT *, len(list_filter(list_distinct(string_split(lower(regexp_replace(vt, '[\\s\\[\\]()\\-,.!?:;"''_]+', '', 'g')), '')), lambda c: NOT contains(lower(regexp_replace(asr || ocr, '[\\s\\[\\]()\\-,.!?:;"''_]+', '', 'g')), c))) = 0 AS ok FROM v)
SELECT media_id, ord, CASE WHEN verdict = 'use_asr' THEN 'llm_use_asr' WHEN verdict = 'use_ocr' THEN 'llm_use_ocr' WHEN verdict = 'merge' AND ok THEN 'llm_merge' END AS decision,
  CASE WHEN verdict = 'use_asr' THEN asr WHEN verdict = 'use_ocr' THEN ocr WHEN verdict = 'merge' AND ok THEN trim(vt) END AS text FROM f""")
def _(src):
    k = (F.col("media_id") + F.col("ord")) % 5
    verdict = F.when(k == 0, "use_asr").when(k == 1, "use_ocr").when(k.isin(2, 3), "merge")
    vt = F.when(k == 3, F.concat(F.lit(" zz#9 "), "ref_text")).otherwise(F.concat(F.lit(" "), "hyp_text"))
    out = tx.arbitrate(verdict, vt, F.col("ref_text"), F.col("hyp_text"))
    return src("text_pairs").withColumn("a", out).select("media_id", "ord", F.col("a.decision").alias("decision"), F.col("a.text").alias("text"))


@query("dropped_tokens", """WITH a AS (SELECT media_id, ord, regexp_extract_all(lower(ref_text), '[a-z0-9]+') AS w, regexp_extract_all(lower(hyp_text), '[a-z0-9]+') AS h FROM text_pairs),
x AS (SELECT media_id, ord, t, count(*) AS n FROM (SELECT media_id, ord, unnest(w) AS t FROM a) GROUP BY ALL), y AS (SELECT media_id, ord, t, count(*) AS n FROM (SELECT media_id, ord, unnest(h) AS t FROM a) GROUP BY ALL),
d AS (SELECT media_id, ord, CAST(sum(greatest(0, x.n - coalesce(y.n, 0))) AS BIGINT) AS missing FROM x LEFT JOIN y USING (media_id, ord, t) GROUP BY ALL)
SELECT media_id, ord, coalesce(missing, 0) AS missing, len(w) AS total FROM a LEFT JOIN d USING (media_id, ord)""")
def _(src):
    return tr.token_dropout(src("text_pairs"))


@query("matching_block_similarity")
def _(src):
    return spread(src("text_pairs"), "media_id", "ord").select(
        "media_id", "ord", tx.block_ratio("ref_text", "hyp_text").alias("ratio"), tx.block_coverage("ref_text", "hyp_text").alias("coverage"),
        tx.dropped_tokens_exact("ref_text", "hyp_text").alias("missing"))


LINES_SQL = """WITH l AS (SELECT doc_id, text, lang, n_chars, source, CASE lang WHEN 'en' THEN greatest(1, len(regexp_extract_all(trim(text), '[A-Za-z0-9'']+'))) * 0.34::DOUBLE
   ELSE greatest(1, len(regexp_extract_all(trim(text), '\\S+'))) * 0.28::DOUBLE END AS base, len(regexp_extract_all(trim(text), '[,.!?;:，。！？；：、]')) AS p, n_chars % 900 / 10.0::DOUBLE AS sec FROM documents),
e AS (SELECT *, CASE WHEN trim(text) = '' THEN 0.0::DOUBLE ELSE greatest(0.35::DOUBLE, base + p * 0.12::DOUBLE) END AS est FROM l),
f AS (SELECT *, CASE WHEN est / greatest(0.001::DOUBLE, sec) <= 1.1 THEN 'fit' WHEN est / greatest(0.001::DOUBLE, sec) <= 1.3 THEN 'review' ELSE 'risky' END AS fit_level FROM e)
"""


def _lines(src):
    rows = src("documents").withColumn("sec", (F.col("n_chars") % 900) / 10.0).withColumn("est", tx.speech_seconds(F.col("text"), F.col("lang")))
    return rows.withColumn("fit_level", tx.fit_level(F.col("est"), F.col("sec")))


@query("speech_budget", LINES_SQL + """SELECT doc_id, est, fit_level, greatest(10, CAST(round_even(sec * CASE lang WHEN 'en' THEN 17.0::DOUBLE ELSE 15.0::DOUBLE END, 0) AS INTEGER)) AS budget FROM f""")
def _(src):
    return _lines(src).select("doc_id", "est", "fit_level", tx.character_budget(F.col("sec"), F.col("lang")).alias("budget"))


@query("budget_summary", LINES_SQL + """SELECT source, CAST(sum(n_chars % 900 * 100) AS BIGINT) AS source_ms, CAST(sum(CAST(floor(est * 1000) AS BIGINT)) AS BIGINT) AS estimated_ms,
  sum(CAST(floor(est * 1000) AS BIGINT)) / greatest(1, sum(n_chars % 900 * 100)) AS ratio, CASE WHEN bool_or(fit_level = 'risky') THEN 'risky' WHEN bool_or(fit_level = 'review') THEN 'review' ELSE 'fit' END AS fit_level FROM f GROUP BY source""")
def _(src):
    rows = _lines(src).withColumn("source_ms", F.col("n_chars") % 900 * 100).withColumn("estimated_ms", F.floor(F.col("est") * 1000).cast("long"))
    return tr.budget_summary(rows, ["source"])


@query("script_flags", LINES_SQL + """SELECT doc_id, concat_ws('|', CASE WHEN regexp_matches(text, '[A-Za-z]') AND regexp_matches(text, '[\\x{3040}-\\x{30ff}\\x{3400}-\\x{9fff}]') THEN 'mixed_language' END,
  CASE WHEN length(trim(text)) <= 2 THEN 'too_short_source' END, CASE WHEN regexp_matches(text, '[0-9]') THEN 'contains_number' END, CASE WHEN contains(text, 'the') THEN 'contains_protected_term' END,
  CASE WHEN trim(text) = '' OR len(list_filter(range(5, len(l) + 1), lambda i: l[i] = l[i - 1] AND l[i] = l[i - 2] AND l[i] = l[i - 3] AND l[i] = l[i - 4] AND l[i] <> chr(10))) > 0 THEN 'source_maybe_asr_error' END,
  CASE fit_level WHEN 'review' THEN 'duration_may_overrun' WHEN 'risky' THEN 'duration_risky' END, CASE WHEN trim(text) = '' THEN 'empty_target' END) AS flags FROM (SELECT *, string_split(trim(text), '') AS l FROM f)""")
def _(src):
    flags = tx.script_flags(F.col("text"), F.col("text"), F.contains("text", F.lit("the")), F.col("fit_level"))
    return _lines(src).select("doc_id", joined(flags).alias("flags"))


@query("polish_flags", """SELECT media_id, ord, concat_ws('|', CASE WHEN NOT contains(lower(hyp_text), 'the') OR NOT contains(lower(hyp_text), 'an') THEN 'protected_term_missing' END,
  CASE WHEN length(ref_text) % 40 / 10.0 < 1.4 OR length(regexp_replace(ref_text, '\\s+', '', 'g')) <= 2 THEN 'needs_dubbing_unit' END,
  CASE WHEN trim(hyp_text) = '' OR (len(string_split_regex(trim(hyp_text), '\\s+')) <= 1 AND NOT regexp_matches(trim(hyp_text), '[.!?]$')) THEN 'target_fragment' END) AS flags FROM text_pairs""")
def _(src):
    terms = F.array(F.lit("The"), F.lit("an"))
    flags = tx.polish_flags(F.col("hyp_text"), F.col("ref_text"), F.length("ref_text") % 40 / 10.0, terms)
    return src("text_pairs").select("media_id", "ord", joined(flags).alias("flags"))


GLOSSARY = [("term-1", ["the", "the an"], "LE"), ("term-2", ["ou", "oui"], "OUI"), ("term-3", ["er"], "")]


@query("apply_glossary", """WITH a AS (SELECT doc_id, text AS t0 FROM documents), b AS (SELECT *, replace(t0, 'the an', 'LE') AS t1 FROM a), c AS (SELECT *, replace(t1, 'the', 'LE') AS t2 FROM b),
d AS (SELECT *, replace(t2, 'oui', 'OUI') AS t3 FROM c), e AS (SELECT *, replace(t3, 'ou', 'OUI') AS t4 FROM d)
SELECT doc_id, trim(regexp_replace(t4, '\\s+', ' ', 'g')) AS glossed, concat_ws('|', CASE WHEN contains(t0, 'the an') THEN 'term-1:the an' END, CASE WHEN contains(t1, 'the') THEN 'term-1:the' END,
  CASE WHEN contains(t2, 'oui') THEN 'term-2:oui' END, CASE WHEN contains(t3, 'ou') THEN 'term-2:ou' END) AS matches FROM e""")
def _(src):
    return tr.apply_glossary(src("documents"), GLOSSARY[:2]).select("doc_id", "glossed", joined(F.col("matches")).alias("matches"))


@query("merge_glossaries", """WITH u AS (SELECT CAST(p_partkey AS STRING) AS entry_id, p_name AS variant FROM part WHERE p_partkey % 7 = 0 AND p_size < 3), b AS (SELECT CAST(p_partkey AS STRING) AS entry_id, unnest([upper(p_name), p_type || CAST(p_partkey AS STRING)]) AS variant FROM part WHERE p_partkey % 3 = 0),
un AS (SELECT *, lower(replace(variant, ' ', '')) AS n FROM u), bn AS (SELECT *, lower(replace(variant, ' ', '')) AS n FROM b)
SELECT entry_id, variant FROM u UNION ALL SELECT entry_id, variant FROM b WHERE entry_id NOT IN (SELECT entry_id FROM u) AND entry_id NOT IN (SELECT entry_id FROM bn WHERE n IN (SELECT n FROM un))""")
def _(src):
    part = src("part")
    key = F.col("p_partkey").cast("string").alias("entry_id")
    user = part.filter("p_partkey % 7 = 0 AND p_size < 3").select(key, F.col("p_name").alias("variant"))
    built_in = part.filter("p_partkey % 3 = 0").select(key, F.explode(F.array(F.upper("p_name"), F.concat("p_type", F.col("p_partkey").cast("string")))).alias("variant"))
    return tr.merge_glossaries(user, built_in)


@query("glossary_target", """SELECT p_partkey, CASE WHEN p_size % 2 = 1 AND lower(replace(p_name, ' ', '')) = lower(replace(CASE WHEN p_size % 3 = 0 THEN upper(p_name) ELSE p_type END, ' ', '')) THEN p_brand ELSE trim(p_type || ' ' || p_name) END AS target FROM part""")
def _(src):
    matched = F.when(F.col("p_size") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_type"))
    target = tr.normalise_target(F.col("p_name"), F.concat_ws("  ", "p_type", "p_name"), matched, F.col("p_brand"), F.col("p_size") % 2)
    return src("part").select("p_partkey", target.alias("target"))


@query("judge_summary", "SELECT media_id, round(avg(judge_score), 10) AS mean, min(judge_score) AS min, count(*) FILTER (judge_score < 3.0) AS failed, count(judge_score) AS scored FROM report GROUP BY media_id")
def _(src):
    return tr.judge_summary(src("report")).withColumn("mean", F.round("mean", 10))


@query("split_regions", """WITH p AS (SELECT media_id, ord, start_ms, end_ms, list_filter(list_transform(string_split_regex(text, '[。！？!?]+'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS pieces FROM (SELECT * REPLACE (replace(text, '.', '!') AS text) FROM cues)),
e AS (SELECT *, unnest(pieces) AS sentence, unnest(range(len(pieces))) AS i, list_sum(list_transform(pieces, lambda s: length(s))) AS total FROM p),
c AS (SELECT *, list_sum(list_transform(pieces[1:i], lambda s: length(s))) AS c0, list_sum(list_transform(pieces[1:i + 1], lambda s: length(s))) AS c1 FROM e)
SELECT media_id, ord, CAST(i AS INTEGER) AS sentence_no, sentence, start_ms + CAST(floor((end_ms - start_ms) * coalesce(c0, 0) / total) AS BIGINT) AS start_ms,
  CASE WHEN i = len(pieces) - 1 THEN end_ms ELSE start_ms + CAST(floor((end_ms - start_ms) * c1 / total) AS BIGINT) END AS end_ms FROM c""")
def _(src):
    return tr.split_regions(src("cues").withColumn("text", F.replace("text", F.lit("."), F.lit("!"))))


@query("sentence_likeness", f"""WITH b AS (SELECT doc_id, regexp_replace(text || CASE WHEN doc_id % 3 = 0 THEN '的，' WHEN doc_id % 3 = 1 THEN '我是' ELSE '' END, '\\s+', '', 'g') AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, least(1.0::DOUBLE, (length(t) - length(regexp_replace(t, '[{tx.FUNCTION_CHARS}]', '', 'g'))) / greatest(1.0::DOUBLE, length(t) * 0.18::DOUBLE)) * 0.5::DOUBLE
  + CASE WHEN regexp_matches(t, '[{tx.DIALOGUE_PUNCTUATION}]') THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN regexp_matches(t, '[{tx.DIALOGUE_MARKERS}]') THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END)) END AS score FROM b""")
def _(src):
    tail = F.when(F.col("doc_id") % 3 == 0, "的，").when(F.col("doc_id") % 3 == 1, "我是").otherwise("")
    return spread(src("documents"), "doc_id").select("doc_id", tx.sentence_likeness(F.concat("text", tail)).alias("score"))


CREDIT_LINE = "p_name || CASE p_partkey % 6 WHEN 0 THEN ' 主演 张三 李四 张三' WHEN 1 THEN ' Media ' || p_type || ' ' || p_type WHEN 2 THEN chr(10) || '文化传媒有限公司' WHEN 3 THEN ' ' || p_type || ' ' || p_type || 'S' ELSE ' ' || p_brand END"


def _credit_lines(src):
    k = F.col("p_partkey") % 6
    tail = (F.when(k == 0, F.lit(" 主演 张三 李四 张三")).when(k == 1, F.concat(F.lit(" Media "), "p_type", F.lit(" "), "p_type"))
            .when(k == 2, F.lit("\n文化传媒有限公司")).when(k == 3, F.concat(F.lit(" "), "p_type", F.lit(" "), "p_type", F.lit("S"))).otherwise(F.concat(F.lit(" "), "p_brand")))
    return src("part").select("p_partkey", F.concat("p_name", tail).alias("text"))


@query("credit_score", f"""WITH l AS (SELECT p_partkey, {CREDIT_LINE} AS text FROM part), w AS (SELECT *, regexp_replace(text, '\\s+', '', 'g') AS j, list_filter(string_split_regex(text, '[\\s/|]+'), lambda t: t <> '') AS words FROM l),
n AS (SELECT *, list_filter(words, lambda t: regexp_full_match(t, '[\\x{{4e00}}-\\x{{9fff}}]{{1,4}}')) AS names, list_transform(list_filter(words, lambda t: regexp_full_match(t, '[A-Za-z]{{4,}}')), lambda t: lower(t)) AS latin FROM w),
tok AS (SELECT p_partkey, unnest(latin) AS t, unnest(range(len(latin))) AS i FROM n),
near AS (SELECT DISTINCT a.p_partkey FROM tok a JOIN tok b ON a.p_partkey = b.p_partkey AND a.i < b.i WHERE abs(length(a.t) - length(b.t)) <= greatest(length(a.t), length(b.t)) * 0.22::DOUBLE AND levenshtein(a.t, b.t) <= greatest(length(a.t), length(b.t)) * 0.22::DOUBLE),
f AS (SELECT n.*, regexp_matches(j, '{'|'.join(tx.ORGANISATION_TERMS)}') AS org, k.p_partkey IS NOT NULL AS rep FROM n LEFT JOIN near k USING (p_partkey)),
s AS (SELECT p_partkey, least(1.0::DOUBLE, 0.0::DOUBLE + CASE WHEN len(names) >= 3 AND len(words) >= 3 THEN 0.58::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN len(names) >= 3 AND len(list_distinct(names)) < len(names) THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN org AND length(j) >= 6 THEN 0.46::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN regexp_matches(j, '{'|'.join(tx.CREDIT_ROLE_TERMS)}') THEN 0.38::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN regexp_matches(lower(j), '{'|'.join(tx.LATIN_COMPANY_TERMS)}') AND len(latin) >= 1 THEN 0.34::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN rep THEN 0.44::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN contains(text, chr(10)) AND (org OR len(names) >= 2) THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END) AS score FROM f) SELECT p_partkey, score FROM s""")
def _(src):
    return _credit_lines(src).select("p_partkey", tx.credit_score(tx.credit_features(F.col("text"))).alias("score"))


FILE_NAME = "replace(p_name, ' ', '.') || CASE p_partkey % 4 WHEN 0 THEN '.S0' || CAST(p_size % 9 AS STRING) || 'E' || CAST(p_size AS STRING) WHEN 1 THEN ' EP ' || CAST(p_size AS STRING) WHEN 2 THEN '_' || CAST(1960 + p_size AS STRING) ELSE '' END || '.mkv'"


def _file_names(src):
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    tail = (F.when(k == 0, F.concat(F.lit(".S0"), (F.col("p_size") % 9).cast("string"), F.lit("E"), size)).when(k == 1, F.concat(F.lit(" EP "), size))
            .when(k == 2, F.concat(F.lit("_"), (F.col("p_size") + 1960).cast("string"))).otherwise(""))
    return src("part").select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit(".")), tail, F.lit(".mkv")).alias("file_name"))


@query("file_titles", f"""WITH f AS (SELECT p_partkey, p_size, p_name, {FILE_NAME} AS file_name FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'S' || lpad(CAST(p_size % 9 AS STRING), 2, '0') || 'E' || lpad(CAST(p_size AS STRING), 2, '0') WHEN 1 THEN 'E' || lpad(CAST(p_size AS STRING), 2, '0') END AS label,
  CASE WHEN p_partkey % 4 < 3 THEN p_name END AS title, CASE WHEN p_partkey % 4 = 2 THEN 1960 + p_size END AS year FROM f""")
def _(src):
    name = F.col("file_name")
    return _file_names(src).select("p_partkey", tx.episode_label(name).alias("label"), tx.file_title(name).alias("title"), tx.file_year(name).alias("year"))


@query("timestamps", """WITH t AS (SELECT media_id, segment_id, start_ms * 7 AS ms FROM segments)
SELECT media_id, segment_id, lpad(CAST(ms // 3600000 AS STRING), 2, '0') || ':' || lpad(CAST(ms // 60000 % 60 AS STRING), 2, '0') || ':' || lpad(CAST(ms // 1000 % 60 AS STRING), 2, '0') || ',' || lpad(CAST(ms % 1000 AS STRING), 3, '0') AS stamp,
  CASE WHEN segment_id % 3 = 0 THEN ms % 3600000 ELSE ms END AS parsed_ms FROM t""")
def _(src):
    rows = src("segments").select("media_id", "segment_id", tx.srt_time(F.col("start_ms") * 7).alias("stamp"))
    raw = F.when(F.col("segment_id") % 3 == 0, F.replace(F.substring("stamp", 4, 20), F.lit(","), F.lit("."))).otherwise(F.col("stamp"))
    return rows.withColumn("parsed_ms", tx.parse_timestamp_ms(raw))


@query("scene_answers", """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE event_type END AS scene, CASE WHEN event_id % 4 <> 3 THEN CAST(user_id % 5 AS INTEGER) END AS people_visible,
  CASE WHEN event_id % 4 <> 3 THEN CASE WHEN event_id % 4 = 2 THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE, value / 100.0::DOUBLE) END END AS confidence, CASE WHEN event_id % 4 = 3 THEN 'no_json' END AS error FROM events""")
def _(src):
    body = F.to_json(F.struct(F.col("event_type").alias("scene"), (F.col("user_id") % 5).alias("people_visible"),
                              F.when(F.col("event_id") % 4 == 2, F.lit("high")).otherwise((F.col("value") / 100.0).cast("string")).alias("confidence")))
    k = F.col("event_id") % 4
    answer = (F.when(k == 0, body).when(k == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here it is "), body, F.lit(" done")))
              .otherwise(F.lit("I cannot tell")))
    rows = src("events").select("event_id", tx.scene_answer(answer).alias("a"))
    return rows.select("event_id", F.col("a.scene").alias("scene"), F.col("a.people_visible").alias("people_visible"), F.col("a.confidence").alias("confidence"), F.col("a.error").alias("error"))


@query("suggest_names", """WITH s AS (SELECT media_id, speaker_label, CASE segment_id % 5 WHEN 0 THEN '我是' || chr(CAST(65 + segment_id % 7 AS INTEGER)) || 'bc。' WHEN 1 THEN 'Dd' || chr(CAST(97 + segment_id % 4 AS INTEGER)) || '，你好' ELSE text END AS text FROM segments),
i AS (SELECT media_id, speaker_label, text[3:5] AS name, count(*) * 12 AS w FROM s WHERE starts_with(text, '我是') GROUP BY ALL),
c AS (SELECT media_id, speaker_label, text[1:3] AS name, count(*) AS n FROM s WHERE contains(text, '，你') GROUP BY ALL), t AS (SELECT media_id, name, sum(n) AS total FROM c GROUP BY ALL), sp AS (SELECT DISTINCT media_id, speaker_label FROM s),
a AS (SELECT sp.media_id, sp.speaker_label, t.name, (total - coalesce(n, 0)) * 6 AS w FROM sp JOIN t USING (media_id) LEFT JOIN c ON c.media_id = sp.media_id AND c.speaker_label = sp.speaker_label AND c.name = t.name),
u AS (SELECT media_id, speaker_label, name, CAST(sum(w) AS BIGINT) AS tenths FROM (SELECT * FROM i UNION ALL SELECT * FROM a WHERE w > 0) GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY media_id, speaker_label ORDER BY tenths DESC, name) AS INTEGER) AS rank FROM u QUALIFY rank <= 3)
SELECT *, least(0.95::DOUBLE, tenths / greatest(10, sum(tenths) OVER (PARTITION BY media_id, speaker_label)) + 0.2::DOUBLE) AS confidence FROM r""")
def _(src):
    k = F.col("segment_id") % 5
    text = (F.when(k == 0, F.concat(F.lit("我是"), F.char(F.lit(65) + F.col("segment_id") % 7), F.lit("bc。")))
            .when(k == 1, F.concat(F.lit("Dd"), F.char(F.lit(97) + F.col("segment_id") % 4), F.lit("，你好"))).otherwise(F.col("text")))
    return tr.suggest_names(src("segments").withColumn("text", text))
