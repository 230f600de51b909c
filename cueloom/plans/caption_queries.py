"""Registered queries: caption text scores, detections to subtitles, collapse of near duplicates, attachment of prefixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueloom.functions import captions as cp
from cueloom.operators import captions as op
from cueloom.plans.registry import query

#: CJK signs of the check data, each with a letter of its own: the check engine counts edits in bytes.
SIGNS = "今天我们去看海你在那里等好的啊找"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"[: len(SIGNS)]
PREFIX = cp.NAME_PREFIX.replace("\\", "\\\\")


def norm(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '\\s+', '', 'g'), '[^\\p{{L}}\\p{{N}}_぀-ヿ]', '', 'g')"


def fold(x: str) -> str:
    return f"translate(coalesce({x}, ''), '{cp.WIDE}', '{cp.NARROW.replace(chr(39), chr(39) * 2)}')"


def edits(a: str, b: str) -> str:
    return f"levenshtein(translate({a}, '{SIGNS}', '{LETTERS}'), translate({b}, '{SIGNS}', '{LETTERS}'))"


def like(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - {edits(a, b)} / greatest(length({a}), length({b})) END"


def count(n: str, signs: str) -> str:
    return f"(length({n}) - length(regexp_replace({n}, '{signs}', '', 'g')))"


CJK, LATIN, DIGITS = "[一-鿿]", "[a-z]", "\\p{Nd}"


def noise(n: str, strong: str) -> str:
    return f"""(length({n}) = 0 OR ({strong} AND (({count(n, CJK)} = 0 AND length({n}) <= 10 AND {count(n, LATIN)} >= least(3, length({n})))
      OR ({count(n, CJK)} <= 1 AND length({n}) <= 4 AND {count(n, LATIN)} + {count(n, DIGITS)} >= greatest(2, length({n}) - 1)))))"""


def score(n: str, cjk: str, latin: str, bad: str, lines: str) -> str:
    return f"""greatest(0.0::DOUBLE, least(1.0::DOUBLE, least(1.0::DOUBLE, {n} / 14.0::DOUBLE) * 0.42::DOUBLE + {cjk} / greatest(1, {n}) * 0.36::DOUBLE + (1.0::DOUBLE - least(1.0::DOUBLE, {latin} / greatest(1, {n}))) * 0.16::DOUBLE
      + (1.0::DOUBLE - least(1.0::DOUBLE, {bad} / greatest(1, {lines}))) * 0.06::DOUBLE))"""


def captions_sql(p: str, rows: str) -> str:
    """CTEs that end in `p`: media_id, id, clean, norm, quality of `rows` (media_id, id, text); texts clean to at most two lines in the check data."""
    line_score = score("length(n)", count("n", CJK), count("n", LATIN), f"CASE WHEN {noise('n', 'true')} THEN 1 ELSE 0 END", "1")
    return f"""{p}_in AS ({rows}),
{p}_l AS (SELECT media_id, id, unnest(generate_series(1, len(ls))) AS k, unnest(ls) AS line FROM (SELECT media_id, id, list_filter(list_transform(string_split_regex({fold("text")}, '\\r\\n|[\\r\\n]'), lambda x: regexp_replace(regexp_replace(x, '\\s+', ' ', 'g'), '^ | $', '', 'g')), lambda x: x <> '') AS ls FROM {p}_in)),
{p}_s AS (SELECT media_id, id, k, bool_or({count(norm("line"), CJK)} >= 2) OVER (PARTITION BY media_id, id) AS strong, regexp_replace(line, '{cp.NAME_PREFIX}', '\\1') AS line FROM {p}_l),
{p}_n AS (SELECT *, {norm("line")} AS n FROM {p}_s), {p}_o AS (SELECT *, NOT {noise("n", "strong")} AS ok FROM {p}_n), {p}_a AS (SELECT *, bool_or(ok) OVER (PARTITION BY media_id, id) AS any_ok FROM {p}_o),
{p}_k AS (SELECT media_id, id, line, n, {line_score} AS q, row_number() OVER (PARTITION BY media_id, id ORDER BY k) AS r FROM {p}_a WHERE ok OR NOT any_ok),
{p}_c AS (SELECT a.media_id, a.id, CASE WHEN b.line IS NULL THEN a.line WHEN {like("a.n", "b.n")} >= 0.88 OR (a.n <> '' AND b.n <> '' AND (contains(a.n, b.n) OR contains(b.n, a.n))) THEN
    CASE WHEN b.q > a.q + 1e-6 THEN b.line WHEN a.q > b.q + 1e-6 THEN a.line WHEN length(b.n) > length(a.n) THEN b.line ELSE a.line END ELSE a.line || chr(10) || b.line END AS clean
  FROM (SELECT * FROM {p}_k WHERE r = 1) a LEFT JOIN (SELECT * FROM {p}_k WHERE r = 2) b ON a.media_id = b.media_id AND a.id = b.id),
{p}_x AS (SELECT media_id, id, unnest(string_split(clean, chr(10))) AS line FROM {p}_c), {p}_y AS (SELECT media_id, id, {norm("line")} AS n FROM {p}_x),
{p}_q AS (SELECT media_id, id, {score("sum(length(n))", f"sum({count('n', CJK)})", f"sum({count('n', LATIN)})", f"count(*) FILTER ({noise('n', 'true')})", "count(*)")} AS quality FROM {p}_y GROUP BY media_id, id),
{p} AS (SELECT i.media_id, i.id, coalesce(clean, '') AS clean, {norm("coalesce(clean, '')")} AS norm, coalesce(quality, 0.0) AS quality FROM {p}_in i LEFT JOIN {p}_c c ON i.media_id = c.media_id AND i.id = c.id LEFT JOIN {p}_q q ON i.media_id = q.media_id AND i.id = q.id)"""


ROWS_AS = "SELECT media_id, segment_id AS id, text FROM caption_rows"


@query("caption_scores", f"WITH {captions_sql('c', ROWS_AS)} SELECT media_id, id AS segment_id, clean, norm, round(quality, 9) AS quality FROM c")
def _(src):
    clean = cp.cleaned(F.col("text"))
    return src("caption_rows").select("media_id", "segment_id", clean.alias("clean")).select("media_id", "segment_id", "clean", cp.norm(F.col("clean")).alias("norm"), F.round(cp.quality(F.col("clean")), 9).alias("quality"))


def pad(lo: str, hi: str, least: float, share: float, side: int) -> str:
    at = f"{lo} - " if side < 0 else f"{hi} + "
    return f"CAST(round_even({at}greatest({least}::DOUBLE, greatest(1.0::DOUBLE, {hi} - {lo}) * {share}::DOUBLE), 0) AS BIGINT)"


def padded(p: str, x: str) -> str:
    edges = {f"{p}x1": pad(f"{x}x1", f"{x}x2", 5, 0.08, -1), f"{p}y1": pad(f"{x}y1", f"{x}y2", 4, 0.3, -1), f"{p}x2": pad(f"{x}x1", f"{x}x2", 5, 0.08, 1), f"{p}y2": pad(f"{x}y1", f"{x}y2", 4, 0.3, 1)}
    return ", ".join(f"{v} AS {k}" for k, v in edges.items())


DETS_AS = "SELECT media_id, det_id AS id, text FROM caption_dets"
MERGE_SQL = f"""WITH {captions_sql('c', DETS_AS)},
d AS (SELECT t.*, {norm(fold("t.text"))} AS raw, c.clean, c.quality, CASE WHEN c.clean = '' THEN trim(t.text) ELSE c.clean END AS shown FROM caption_dets t JOIN c ON c.media_id = t.media_id AND c.id = t.det_id),
b AS (SELECT *, {norm("shown")} AS norm, row_number() OVER w - 1 AS pos, CASE WHEN t_ms - lag(t_ms) OVER w <= 1000 AND {like("raw", "lag(raw) OVER w")} >= 0.8 THEN 0 ELSE 1 END AS brk FROM d WINDOW w AS (PARTITION BY media_id ORDER BY t_ms, det_id)),
g AS (SELECT *, CASE WHEN norm = '' THEN shown ELSE norm END AS key, max(CASE WHEN brk = 1 THEN pos END) OVER (PARTITION BY media_id ORDER BY pos) AS grp FROM b),
s AS (SELECT media_id, grp, count(*) AS total, min(t_ms) AS start_ms, max(t_ms) AS last_ms, sum(round_even(confidence * 1e6, 0)) / (count(*) * 1e6) AS confidence, arg_min(text, pos) AS first_text FROM g GROUP BY media_id, grp),
v AS (SELECT media_id, grp, key, count(*) AS n, sum(round_even(confidence * 1e6, 0)) / (count(*) * 1e6) AS sure, min(pos) AS first, arg_max({{'s': shown, 'n': norm, 'q': quality}}, (round_even(confidence * 0.58::DOUBLE + quality * 0.42::DOUBLE, 9), -pos)) AS best FROM g GROUP BY ALL),
o AS (SELECT v.media_id, v.grp, v.key, avg({like("v.best.n", "g.raw")}) AS similarity FROM v JOIN g ON g.media_id = v.media_id AND g.grp = v.grp GROUP BY ALL),
r AS (SELECT media_id, grp, arg_max(best.s, (round_even(n / total * 0.34::DOUBLE + sure * 0.2::DOUBLE + similarity * 0.18::DOUBLE + least(1.0::DOUBLE, length(best.n) / 12.0::DOUBLE) * 0.12::DOUBLE + best.q * 0.16::DOUBLE, 9), -first)) AS shown_text
  FROM v JOIN o USING (media_id, grp, key) JOIN (SELECT media_id, grp, total FROM s WHERE total > 1) USING (media_id, grp) GROUP BY media_id, grp),
t AS (SELECT s.*, coalesce(shown_text, first_text) AS best_text FROM s LEFT JOIN r USING (media_id, grp)),
u AS (SELECT g.media_id, g.grp, x1, y1, x2, y2, greatest(0.01, g.confidence) AS sure, clean = best_text AS own, bool_or(clean = best_text) OVER w AS has_own FROM g JOIN t ON t.media_id = g.media_id AND t.grp = g.grp WINDOW w AS (PARTITION BY g.media_id, g.grp)),
k AS (SELECT *, sure >= max(sure) OVER (PARTITION BY media_id, grp) * 0.8::DOUBLE AS ok FROM u WHERE own OR NOT has_own),
m AS (SELECT media_id, grp, {', '.join(f'quantile_cont({c}::DOUBLE, 0.5) FILTER (ok) AS m{c}' for c in op.BOX)}, min(x1)::DOUBLE AS hx1, min(y1)::DOUBLE AS hy1, max(x2)::DOUBLE AS hx2, max(y2)::DOUBLE AS hy2 FROM k GROUP BY media_id, grp),
e AS (SELECT media_id, grp, {padded("", "m")}, {padded("u", "h")} FROM m)
SELECT media_id, grp AS segment_id, start_ms, CASE WHEN total = 1 THEN start_ms + 500 ELSE last_ms END AS end_ms, best_text AS text, round(confidence, 9) AS confidence, total AS detections, x1, y1, x2, y2,
  least(ux1, x1) AS full_x1, least(uy1, y1) AS full_y1, greatest(ux2, x2) AS full_x2, greatest(uy2, y2) AS full_y2 FROM t JOIN e USING (media_id, grp)"""


@query("merge_captions", MERGE_SQL)
def _(src):
    return op.merge_captions(src("caption_dets")).withColumn("confidence", F.round("confidence", 9))


OVERLAP = """CASE WHEN least({a}x2, {b}x2) <= greatest({a}x1, {b}x1) OR least({a}y2, {b}y2) <= greatest({a}y1, {b}y1) THEN 0 ELSE (least({a}x2, {b}x2) - greatest({a}x1, {b}x1)) * (least({a}y2, {b}y2) - greatest({a}y1, {b}y1))
  / greatest(1, least(greatest(1, {a}x2 - {a}x1) * greatest(1, {a}y2 - {a}y1), greatest(1, {b}x2 - {b}x1) * greatest(1, {b}y2 - {b}y1))) END"""
WITHIN = "(d.norm <> '' AND r.norm <> '' AND (contains(d.norm, r.norm) OR contains(r.norm, d.norm)))"
LONGER = "greatest(length(d.norm), length(r.norm))"
COLLAPSE_SQL = f"""WITH RECURSIVE {captions_sql('c', ROWS_AS)},
o AS (SELECT t.*, c.clean, c.norm, c.quality, row_number() OVER (PARTITION BY t.media_id ORDER BY start_ms, end_ms, segment_id) AS k FROM caption_rows t JOIN c ON c.media_id = t.media_id AND c.id = t.segment_id),
d AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY k) - 1 AS pos FROM o WHERE k = 1 OR clean <> ''),
r AS (SELECT media_id, pos, pos AS chain, clean, norm, quality, confidence, x1, y1, x2, y2, end_ms FROM d WHERE pos = 0
  UNION ALL SELECT media_id, pos, CASE WHEN j THEN chain ELSE pos END, CASE WHEN j AND NOT taken THEN rclean ELSE clean END, CASE WHEN j AND NOT taken THEN rnorm ELSE norm END, CASE WHEN j AND NOT taken THEN rquality ELSE quality END,
    CASE WHEN j THEN greatest(rconf, confidence) ELSE confidence END, {', '.join(f'CASE WHEN j AND NOT boxed THEN r{c} ELSE {c} END' for c in op.BOX)}, end_ms FROM (
    SELECT d.*, r.chain, r.clean AS rclean, r.norm AS rnorm, r.quality AS rquality, r.confidence AS rconf, {', '.join(f'r.{c} AS r{c}' for c in op.BOX)},
      coalesce(({like("d.norm", "r.norm")} > 0.92 AND d.start_ms - r.end_ms < 500 AND d.norm <> '' AND r.norm <> '' AND ({WITHIN} OR {edits("d.norm", "r.norm")} <= CASE WHEN {LONGER} BETWEEN 9 AND 16 THEN 2 ELSE 1 END))
        OR ({WITHIN} AND d.start_ms - r.end_ms < 600) OR (d.x1 IS NOT NULL AND r.x1 IS NOT NULL AND d.start_ms - r.end_ms <= 250 AND {LONGER} BETWEEN 1 AND 8 AND {edits("d.norm", "r.norm")} <= 1 AND {OVERLAP.format(a="d.", b="r.")} >= 0.7), false) AS j,
      CASE WHEN abs(d.quality - r.quality) <= 0.02 THEN d.confidence >= r.confidence ELSE d.quality > r.quality END AS taken, d.x1 IS NOT NULL AND (r.x1 IS NULL OR d.confidence >= r.confidence) AS boxed
    FROM r JOIN d ON d.media_id = r.media_id AND d.pos = r.pos + 1) q),
l AS (SELECT media_id, chain, count(*) AS merged, arg_max({{'t': clean, 'c': confidence, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'e': end_ms}}, pos) AS s FROM r GROUP BY media_id, chain)
SELECT d.media_id, d.segment_id, d.start_ms, l.s.e AS end_ms, l.s.t AS text, l.s.c AS confidence, l.s.x1 AS x1, l.s.y1 AS y1, l.s.x2 AS x2, l.s.y2 AS y2, merged FROM l JOIN d ON d.media_id = l.media_id AND d.pos = l.chain"""


@query("collapse_duplicates", COLLAPSE_SQL)
def _(src):
    return op.collapse_duplicates(src("caption_rows"), slot_rows=32)


ATTACHES = "coalesce({a}x1 IS NOT NULL AND {b}x1 IS NOT NULL AND length({a}norm) BETWEEN 1 AND 4 AND length({b}norm) >= 6 AND NOT contains({a}text, chr(10)) AND {b}start_ms - {a}end_ms BETWEEN -50 AND 700 AND {overlap} >= 0.5, false)"
ATTACH_SQL = f"""WITH {captions_sql('c', ROWS_AS)},
d AS (SELECT t.*, c.clean, {norm(fold("t.text"))} AS norm FROM caption_rows t JOIN c ON c.media_id = t.media_id AND c.id = t.segment_id),
o AS (SELECT *, {', '.join(f'lag({c}) OVER w AS p{c}, lead({c}) OVER w AS n{c}' for c in ("start_ms", "end_ms", "text", "clean", "norm", "confidence", *op.BOX))} FROM d WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, end_ms, segment_id)),
m AS (SELECT *, {ATTACHES.format(a="", b="n", overlap=OVERLAP.format(a="", b="n"))} AS gone, {ATTACHES.format(a="p", b="", overlap=OVERLAP.format(a="p", b=""))} AS host FROM o)
SELECT media_id, segment_id, CASE WHEN host THEN pstart_ms ELSE start_ms END AS start_ms, end_ms, CASE WHEN NOT host THEN text WHEN pclean = '' THEN clean WHEN clean = '' THEN pclean
  ELSE pclean || CASE WHEN regexp_matches(pclean, '[A-Za-z0-9]$') AND regexp_matches(clean, '^[A-Za-z0-9]') THEN ' ' ELSE '' END || clean END AS text, CASE WHEN host THEN greatest(pconfidence, confidence) ELSE confidence END AS confidence, host AND pstart_ms <> start_ms AS attached FROM m WHERE NOT gone"""


@query("attach_prefixes", ATTACH_SQL)
def _(src):
    rows = src("caption_rows")
    out = op.attach_prefixes(rows.withColumn("own_start", F.col("start_ms")))
    return out.select("media_id", "segment_id", "start_ms", "end_ms", "text", "confidence", (F.col("start_ms") != F.col("own_start")).alias("attached"))
