"""Registered queries: text lines of frames and stable text regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueloom.operators import frames as fr
from cueloom.plans.registry import query

BOX_ORDER = "cy, x1, det_id, y1, x2, y2, h, text, confidence"
#: Overlap of two ranges by the shorter one, and the gap between them.
SHARE = "greatest(0, least({b}, {d}) - greatest({a}, {c})) / greatest(1, least({b} - {a}, {d} - {c}))"
GAP = "greatest(0, {c} - {b}, {a} - {d})"


def _of(form: str, a: str, b: str, c: str, d: str) -> str:
    return form.format(a=a, b=b, c=c, d=d)


LINES_SQL = f"""WITH RECURSIVE u AS (SELECT media_id, frame, det_id, x1, y1, x2, y2, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, confidence, (y1 + y2) / 2.0::DOUBLE AS cy, greatest(1, y2 - y1) AS h FROM frame_boxes),
d AS (SELECT *, row_number() OVER (PARTITION BY media_id, frame ORDER BY {BOX_ORDER}) AS k, greatest(8, floor(avg(h) OVER (PARTITION BY media_id, frame) * 0.75::DOUBLE)) AS line_gap FROM u WHERE text <> '' AND confidence >= 0.45),
r AS (SELECT media_id, frame, k, 1 AS line, [{{'cy': cy, 'h': h, 'x1': x1, 'x2': x2, 'y1': y1, 'y2': y2}}] AS cur FROM d WHERE k = 1
  UNION ALL SELECT media_id, frame, k, CASE WHEN same THEN line ELSE line + 1 END, CASE WHEN same THEN list_append(cur, box) ELSE [box] END FROM (
    SELECT media_id, frame, k, line, cur, {{'cy': cy, 'h': h, 'x1': x1, 'x2': x2, 'y1': y1, 'y2': y2}} AS box,
      away <= line_gap AND greatest(mh, h) / greatest(1.0, least(mh, h)) <= 1.8 AND ({_of(GAP, "lx1", "lx2", "x1", "x2")} <= greatest(36.0::DOUBLE, least(mh, h) * 3.4::DOUBLE) OR {_of(SHARE, "lx1", "lx2", "x1", "x2")} >= 0.08)
      AND (shared >= 0.18 OR away <= greatest(8.0::DOUBLE, least(mh, h) * 0.45::DOUBLE)) AS same
    FROM (SELECT d.*, r.line, r.cur, abs(d.cy - list_avg(list_transform(r.cur, lambda b: b.cy))) AS away, list_median(list_transform(r.cur, lambda b: b.h)) AS mh, list_min(list_transform(r.cur, lambda b: b.x1)) AS lx1, list_max(list_transform(r.cur, lambda b: b.x2)) AS lx2,
        list_max(list_transform(r.cur, lambda b: {_of(SHARE, "b.y1", "b.y2", "d.y1", "d.y2")})) AS shared FROM r JOIN d ON d.media_id = r.media_id AND d.frame = r.frame AND d.k = r.k + 1) j) s),
l AS (SELECT d.*, r.line, median(h) OVER (PARTITION BY media_id, frame, line) AS mh FROM d JOIN r USING (media_id, frame, k)),
p AS (SELECT *, lag(x1) OVER w AS px1, lag(x2) OVER w AS px2, lag(y1) OVER w AS py1, lag(y2) OVER w AS py2, lag(text) OVER w AS pt, row_number() OVER w AS o FROM l WINDOW w AS (PARTITION BY media_id, frame, line ORDER BY x1, k)),
c AS (SELECT *, px1 IS NULL OR ({_of(GAP, "px1", "px2", "x1", "x2")} > greatest(36.0::DOUBLE, mh * 3.4::DOUBLE, greatest(1, px2 - px1) * 0.85::DOUBLE) AND {_of(SHARE, "px1", "px2", "x1", "x2")} < 0.08) AS brk FROM p),
q AS (SELECT *, sum(brk::INT) OVER (PARTITION BY media_id, frame, line ORDER BY o) AS part,
  CASE WHEN brk THEN '' WHEN x1 - px2 >= greatest(6.0::DOUBLE, greatest(1.0::DOUBLE, least(py2 - py1, y2 - y1)) * 0.45::DOUBLE) OR (regexp_matches(pt, '[A-Za-z0-9]$') AND regexp_matches(text, '^[A-Za-z0-9]')) THEN ' ' ELSE '' END AS sep FROM c),
t AS (SELECT media_id, frame, line, part, regexp_replace(regexp_replace(string_agg(sep || text, '' ORDER BY o), '\\s+', ' ', 'g'), '^ | $', '', 'g') AS text FROM q GROUP BY ALL)
SELECT media_id, frame, (SELECT string_agg(text, chr(10) ORDER BY line, part) FROM t WHERE t.media_id = d.media_id AND t.frame = d.frame) AS text, (SELECT count(*) FROM t WHERE t.media_id = d.media_id AND t.frame = d.frame)::INT AS n_lines,
  count(*)::INT AS n_boxes, round(avg(confidence), 9) AS confidence, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM d GROUP BY media_id, frame"""


@query("frame_lines", LINES_SQL)
def _(src):
    return fr.frame_lines(src("frame_boxes")).withColumn("confidence", F.round("confidence", 9))


REGION_MEDIA = "SELECT media_id, 640 AS frame_width, 400 AS frame_height, count(DISTINCT frame) + media_id % 40 AS total_frames, CASE media_id % 4 WHEN 0 THEN 'middle' WHEN 1 THEN 'Top' WHEN 2 THEN NULL ELSE 'bottom' END AS mode FROM region_boxes GROUP BY media_id"
REGION_BOXES = "SELECT media_id, frame, x1, y1 - CASE WHEN media_id % 4 = 1 THEN 240 ELSE 0 END AS y1, x2, CASE WHEN det_id % 17 = 0 THEN y1 - 250 ELSE y2 - CASE WHEN media_id % 4 = 1 THEN 240 ELSE 0 END END AS y2, text, confidence FROM frame_boxes"
REGION_SQL = f"""WITH RECURSIVE region_boxes AS ({REGION_BOXES}), media AS ({REGION_MEDIA}), b AS (SELECT *, (y1 + y2) / 2.0::DOUBLE AS cy, (y2 - y1)::DOUBLE AS h FROM region_boxes WHERE y2 > y1),
d AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY cy, h) AS k FROM b),
r AS (SELECT media_id, k, 0 AS region, 1 AS n, cy AS sy, h AS sh FROM d WHERE k = 1 UNION ALL
  SELECT d.media_id, d.k, CASE WHEN fits THEN region ELSE region + 1 END, CASE WHEN fits THEN n + 1 ELSE 1 END, CASE WHEN fits THEN sy + d.cy ELSE d.cy END, CASE WHEN fits THEN sh + d.h ELSE d.h END
  FROM (SELECT r.*, d.cy, d.h, d.k AS dk, abs(d.cy - sy / n) < sh / n * 0.1::DOUBLE AS fits FROM r JOIN d ON d.media_id = r.media_id AND d.k = r.k + 1) j JOIN d ON d.media_id = j.media_id AND d.k = j.dk),
n AS (SELECT d.*, region, nullif(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_぀-ヿ]', '', 'g'), '') AS said FROM d JOIN r USING (media_id, k)),
a AS (SELECT media_id, region, count(*) AS samples, count(DISTINCT frame) AS frames, avg(confidence) AS confidence, count(DISTINCT said) / greatest(1, count(said)) AS text_variety, avg((x1 + x2) / 2.0::DOUBLE) / 640 AS center_x, avg(cy) / 400 AS center_y, avg(x2 - x1) / 640 AS width, avg(h) / 400 AS height
  FROM n GROUP BY ALL HAVING count(*) >= 2),
s AS (SELECT a.*, frames / greatest(1, total_frames) AS appearance, 1 - least(1, abs(center_x - 0.5) * 2) AS center_prior, lower(coalesce(mode, 'bottom')) AS mode FROM a JOIN media USING (media_id)),
x AS (SELECT *, confidence * 0.45::DOUBLE + appearance * 0.3::DOUBLE + text_variety * 0.15::DOUBLE + center_prior * 0.1::DOUBLE AS score, CASE mode WHEN 'top' THEN 0.02 WHEN 'middle' THEN 0.325 ELSE 0.63 END AS lo, CASE mode WHEN 'top' THEN 0.37 WHEN 'middle' THEN 0.675 ELSE 0.98 END AS hi FROM s)
SELECT media_id, region, samples, frames, appearance, text_variety, center_prior, center_x, center_y, width, height, round(confidence, 9) AS confidence, round(score, 9) AS score,
  array_to_string(list_filter([CASE WHEN center_y NOT BETWEEN lo AND hi THEN 'outside_position_band' END, CASE WHEN appearance < 0.2 THEN 'appearance_ratio_too_low' END, CASE WHEN width NOT BETWEEN 0.12 AND 0.98 THEN 'width_ratio_out_of_range' END,
    CASE WHEN height NOT BETWEEN 0.015 AND 0.25 THEN 'height_ratio_out_of_range' END, CASE WHEN score < 0.525 THEN 'score_below_threshold' END], lambda y: y IS NOT NULL), '|') AS reasons FROM x"""


@query("stable_regions", REGION_SQL)
def _(src):
    boxes = src("frame_boxes")
    up = F.when(F.col("media_id") % 4 == 1, 240).otherwise(0)
    boxes = boxes.withColumn("y2", F.when(F.col("det_id") % 17 == 0, F.col("y1") - 250).otherwise(F.col("y2") - up)).withColumn("y1", F.col("y1") - up)
    mode = F.when(F.col("media_id") % 4 == 0, "middle").when(F.col("media_id") % 4 == 1, "Top").when(F.col("media_id") % 4 == 3, "bottom")
    media = boxes.select("media_id", "frame").distinct().groupBy("media_id").agg((F.count(F.lit(1)) + F.col("media_id") % 40).alias("total_frames")).select("media_id", F.lit(640).alias("frame_width"), F.lit(400).alias("frame_height"), "total_frames", mode.alias("mode"))
    out = fr.stable_regions(boxes, media)
    exact = ("appearance", "text_variety", "center_prior", "center_x", "center_y", "width", "height")
    return out.select("media_id", "region", "samples", "frames", *exact, F.round("confidence", 9).alias("confidence"), F.round("score", 9).alias("score"), F.array_join("reject_reasons", "|").alias("reasons"))
