"""Registered queries: trailing rows that are no dialogue."""

from __future__ import annotations

from cueloom.functions import text as tx
from cueloom.operators import tails
from cueloom.plans.registry import query


def likeness_sql(text: str) -> str:
    """The sentence score of a text expression, as SQL for the check engine."""
    t = f"regexp_replace({text}, '\\s+', '', 'g')"
    return f"""CASE WHEN length({t}) = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, least(1.0::DOUBLE, (length({t}) - length(regexp_replace({t}, '[{tx.FUNCTION_CHARS}]', '', 'g'))) / greatest(1.0::DOUBLE, length({t}) * 0.18::DOUBLE)) * 0.5::DOUBLE
  + CASE WHEN regexp_matches({t}, '[{tx.DIALOGUE_PUNCTUATION}]') THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN regexp_matches({t}, '[{tx.DIALOGUE_MARKERS}]') THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END)) END"""


CANDIDATE = "length(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_぀-ヿ]', '', 'g'))"
SHARES = ", ".join(f"sum({s}) / count(*) AS {s}" for s in ("low", "short", "very_short", "structural", "len", "dur"))

TAIL_SQL = f"""WITH f AS (SELECT media_id, segment_id, start_ms AS s, end_ms AS e, {likeness_sql("coalesce(text, '')")} AS sent, {CANDIDATE} AS len, greatest(0, end_ms - start_ms) AS dur, structural::INT AS structural,
  greatest(1.0::DOUBLE, (y2 - y1)::DOUBLE) AS h, y2::DOUBLE AS b, (x1 + x2) / 2.0::DOUBLE AS c, x1 IS NOT NULL AS boxed FROM tail_subtitles),
o AS (SELECT *, (sent <= 0.2::DOUBLE)::INT AS low, (len <= 8)::INT AS short, (dur <= 650)::INT AS very_short, row_number() OVER w - 1 AS pos, lag(e) OVER w AS pe, lead(sent) OVER w AS sent2 FROM f WINDOW w AS (PARTITION BY media_id ORDER BY s, e, segment_id)),
a AS (SELECT media_id, count(*) AS total, greatest(0.001::DOUBLE, arg_max(e, pos)) AS last_end, {SHARES} FROM o GROUP BY media_id),
every AS (SELECT media_id FROM a WHERE total >= 8 AND low >= 0.78 AND short >= 0.45 AND len <= 10 AND dur <= 1600 AND structural >= 0.45),
g AS (SELECT *, sum(CASE WHEN pe IS NULL OR s - pe > 2500 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY pos) AS grp FROM o),
gone AS (SELECT media_id, grp FROM (SELECT media_id, grp, count(*) AS n, min(s) AS first, arg_max(e, pos) AS last, {SHARES} FROM g GROUP BY media_id, grp) JOIN (SELECT media_id, last_end FROM a) USING (media_id)
  WHERE (first >= last_end * 0.82::DOUBLE OR last >= last_end * 0.82::DOUBLE) AND n >= 8 AND low >= 0.78 AND short >= 0.5 AND len <= 9 AND dur <= 1600),
k AS (SELECT media_id, pos AS cut, dur > 750 OR greatest(sent, coalesce(sent2, sent)) > 0.3 AS dialogue FROM o JOIN (SELECT media_id, last_end FROM a) USING (media_id) WHERE pos >= 1 AND s - pe >= 12000 AND s >= last_end * 0.96::DOUBLE),
m AS (SELECT media_id, cut, quantile_cont(h, 0.5) AS mh, quantile_cont(b, 0.5) AS mb, quantile_cont(c, 0.5) AS mc FROM k JOIN o USING (media_id) WHERE pos < cut AND boxed GROUP BY media_id, cut HAVING count(*) >= 8),
d AS (SELECT media_id, cut, any_value(mh) AS mh, any_value(mb) AS mb, any_value(mc) AS mc, quantile_cont(abs(h - mh), 0.5) AS dh, quantile_cont(abs(b - mb), 0.5) AS db, quantile_cont(abs(c - mc), 0.5) AS dc FROM m JOIN o USING (media_id) WHERE pos < cut AND boxed GROUP BY media_id, cut),
v AS (SELECT media_id, cut, mh IS NOT NULL AND boxed AND least(1, abs(h - mh) / greatest(1, greatest(8, mh * 0.55::DOUBLE, dh * 3))) * 0.42::DOUBLE + least(1, abs(b - mb) / greatest(1, greatest(18, mh * 1.2::DOUBLE, db * 3))) * 0.36::DOUBLE
    + least(1, abs(c - mc) / greatest(1, greatest(80, mh * 5, dc * 3))) * 0.22::DOUBLE >= 0.58::DOUBLE AS place,
  mh IS NOT NULL AND boxed AND (h / greatest(1, mh) <= 0.72 OR h / greatest(1, mh) >= 1.38 OR abs(h - greatest(1, mh)) >= greatest(12, greatest(1, mh) * 0.28::DOUBLE, greatest(8, mh * 0.55::DOUBLE, dh * 3) * 0.35::DOUBLE)) AS size, low, short, very_short, structural, len, dur
  FROM k JOIN o USING (media_id) LEFT JOIN d USING (media_id, cut) WHERE pos >= cut),
x AS (SELECT media_id, cut, count(*) AS n, greatest(count(*) FILTER (place), count(*) FILTER (size)) / count(*) >= 0.67 AS layout, {SHARES} FROM v GROUP BY media_id, cut),
z AS (SELECT media_id, min(cut) AS cut FROM x JOIN k USING (media_id, cut) WHERE layout AND very_short >= 0.67 AND dur <= 850
  OR NOT dialogue AND (n >= 6 AND low >= 0.78 AND short >= 0.55 AND very_short >= 0.7 AND len <= 10 AND dur <= 850 OR n BETWEEN 2 AND 5 AND very_short >= 0.67 AND dur <= 750 AND (layout OR structural >= 0.67 AND low >= 0.67)) GROUP BY media_id)
SELECT media_id, segment_id, s AS start_ms, e AS end_ms FROM g LEFT JOIN z USING (media_id) WHERE media_id NOT IN (SELECT media_id FROM every) AND (media_id, grp) NOT IN (SELECT (media_id, grp) FROM gone) AND (cut IS NULL OR pos < cut)"""


@query("drop_trailing_non_dialogue", TAIL_SQL)
def _(src):
    return tails.drop_trailing_non_dialogue(src("tail_subtitles")).select("media_id", "segment_id", "start_ms", "end_ms")


TRACK_SQL = f"""WITH f AS (SELECT *, greatest(1, y2 - y1) AS h, greatest(1, x2 - x1) AS w, (y1 + y2) / 2.0::DOUBLE AS cy, {CANDIDATE} AS n, {likeness_sql("text")} AS sent, segment_id % 5 IN (0, 1, 3) AS credit, count(*) OVER (PARTITION BY media_id) AS total FROM track_subtitles),
b AS (SELECT * FROM f WHERE x1 IS NOT NULL), m AS (SELECT media_id, quantile_cont(h, 0.5) AS raw, count(*) AS k FROM b GROUP BY media_id), c AS (SELECT b.*, h / raw BETWEEN 0.68 AND 1.45 AS core FROM b JOIN m USING (media_id) WHERE k >= 20 AND raw > 1 AND total >= 20),
e AS (SELECT *, count(*) FILTER (core) OVER (PARTITION BY media_id) >= 20 AS by_core FROM c), t AS (SELECT media_id, greatest(1.0::DOUBLE, quantile_cont(h, 0.5)) AS th, greatest(1.0::DOUBLE, quantile_cont(w, 0.5)) AS tw, quantile_cont(cy, 0.5) AS tc FROM e WHERE core OR NOT by_core GROUP BY media_id),
g AS (SELECT f.*, th, h / th AS ratio, cy - tc >= th * 0.14::DOUBLE AS lower_, frame_width_ratio >= 0.34 OR width_ratio >= 0.55 OR w >= tw * 1.45::DOUBLE AS wide, coalesce(edge_attachment, 0) >= 0.34 AS edge, line_count >= 2 OR component_count >= 3 AS parts, style_match > 0 AND style_match <= 0.55 AS weak, temporal_support <= 0.55 AS fleeting FROM f JOIN t USING (media_id) WHERE x1 IS NOT NULL),
d AS (SELECT *, sent >= 0.48 AND NOT credit AND NOT edge AND NOT weak AS talk FROM g),
o AS (SELECT media_id, segment_id, CASE WHEN n = 0 OR (n <= 4 AND NOT credit) OR ratio > 0.76 THEN false WHEN ratio <= 0.66 AND credit AND n >= 4 THEN true WHEN ratio <= 0.66 AND n >= 8 AND (wide OR edge OR parts) AND NOT talk THEN true
  WHEN n >= 14 AND wide AND (edge OR parts OR lower_ OR weak) THEN NOT talk WHEN n >= 14 AND edge AND (weak OR fleeting OR lower_) THEN NOT talk WHEN n >= 8 AND credit AND (lower_ OR fleeting OR end_ms - start_ms <= 1200) THEN true ELSE false END AS off FROM d)
SELECT media_id, segment_id FROM track_subtitles WHERE (media_id, segment_id) NOT IN (SELECT (media_id, segment_id) FROM o WHERE off)"""


@query("drop_off_track", TRACK_SQL)
def _(src):
    return tails.drop_off_track(src("track_subtitles")).select("media_id", "segment_id")
