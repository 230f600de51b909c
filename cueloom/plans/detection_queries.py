"""Registered queries: units, frames, boxes, subtitle merging and dialogue filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueloom.functions import boxes as bx
from cueloom.functions import text as tx
from cueloom.operators import detections as dt
from cueloom.plans.registry import query


def _subtitles(src):
    """Segments with the fields of a subtitle: confidence and a box."""
    k = F.col("segment_id")
    return src("segments").select(
        "media_id", "segment_id", "start_ms", "end_ms", "text", "event_type", ((k * 13 % 41 + 60) / 100.0).alias("confidence"), (k * 7 % 400).alias("x1"), (k * 11 % 300).alias("y1"),
        (k * 7 % 400 + 20 + k % 90).alias("x2"), (k * 11 % 300 + 10 + k % 31).alias("y2"))


BOX = "segment_id * 7 % 400 AS x1, segment_id * 11 % 300 AS y1, segment_id * 7 % 400 + 20 + segment_id % 90 AS x2, segment_id * 11 % 300 + 10 + segment_id % 31 AS y2"


def sessions_sql(name: str, rows: str, key: str, breaks: str, cap_ms: int, max_rows: int | None = None, gap_ms: int | None = None) -> str:
    """Recursive CTEs ending in `name` (key, segment_id, pos, session): greedy sessions over `rows` with pos, start_ms, end_ms; `breaks` sees the row as d."""
    on = " AND ".join(f"d.{k} = r.{k}" for k in key.split(", "))
    keys = ", ".join(f"d.{k}" for k in key.split(", "))
    joins = f"NOT coalesce({breaks}, false) AND d.end_ms - r.st <= {cap_ms}" + (f" AND r.held < {max_rows}" if max_rows else "") + (f" AND d.start_ms - r.reach <= {gap_ms}" if gap_ms is not None else "")
    return f"""{name}_o AS ({rows}),
{name} AS (SELECT {key}, segment_id, pos, pos AS session, start_ms AS st, end_ms AS reach, 1 AS held FROM {name}_o WHERE pos = 0
  UNION ALL SELECT {keys}, d.segment_id, d.pos, CASE WHEN {joins} THEN r.session ELSE d.pos END, CASE WHEN {joins} THEN r.st ELSE d.start_ms END, CASE WHEN {joins} THEN greatest(r.reach, d.end_ms) ELSE d.end_ms END, CASE WHEN {joins} THEN r.held + 1 ELSE 1 END
  FROM {name} r JOIN {name}_o d ON {on} AND d.pos = r.pos + 1)"""


ORDERED = "SELECT *, row_number() OVER w - 1 AS pos, lag(end_ms) OVER w AS pe, lag(speaker_label) OVER w AS pl FROM segments {} WINDOW w AS (PARTITION BY {} ORDER BY {})"
BY_MEDIA = ORDERED.format("", "media_id", "start_ms, end_ms, segment_id")
GROUPS_SQL = sessions_sql("u", BY_MEDIA, "media_id", "d.start_ms - d.pe > 450", 8_000, 5)
UNITS = {
    "context_units": (dt.context_units, sessions_sql("u", BY_MEDIA, "media_id", "d.start_ms - d.pe > 800 OR d.pl <> d.speaker_label", 12_000, 6)), "embedding_groups": (dt.embedding_groups, GROUPS_SQL),
    "speech_regions": (dt.speech_regions, sessions_sql("u", BY_MEDIA, "media_id", "d.start_ms - d.pe > 500", 30_000)),
    "vision_units": (dt.vision_units, sessions_sql("u", ORDERED.format("WHERE end_ms > start_ms", "media_id", "start_ms, segment_id"), "media_id", "false", 12_000, 6, 2_000)),
}

for _name, (_op, _sql) in UNITS.items():
    def _build(src, op=_op):
        return op(src("segments")).select("media_id", "segment_id", "session")

    query(_name, f"WITH RECURSIVE {_sql} SELECT media_id, segment_id, session FROM u")(_build)


REFERENCE_SQL = sessions_sql("u", ORDERED.format("", "media_id, speaker_label", "start_ms, end_ms, segment_id"), "media_id, speaker_label", "d.start_ms - d.pe > 600", 15_000)


@query("reference_groups", f"""WITH RECURSIVE {REFERENCE_SQL},
g AS (SELECT u.media_id, u.speaker_label, session, min(s.start_ms) AS start_ms, arg_max(s.end_ms, u.pos) AS end_ms, count(*) AS segment_count, sum(s.value) AS energy FROM u JOIN segments s USING (media_id, segment_id) GROUP BY ALL),
l AS (SELECT *, greatest(0, end_ms - start_ms) AS dur_ms, bool_or(greatest(0, end_ms - start_ms) BETWEEN 1500 AND 15000) OVER (PARTITION BY media_id, speaker_label) AS some FROM g),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY media_id, speaker_label ORDER BY dur_ms DESC, energy DESC, start_ms) AS INTEGER) AS rank FROM l WHERE CASE WHEN "some" THEN dur_ms BETWEEN 1500 AND 15000 ELSE dur_ms > 0 END)
SELECT media_id, speaker_label, session, start_ms, end_ms, segment_count, dur_ms, rank FROM r WHERE rank <= 5""".replace("AS some FROM", 'AS "some" FROM'))
def _(src):
    return dt.top_reference_groups(dt.reference_groups(src("segments"))).select("media_id", "speaker_label", "session", "start_ms", "end_ms", "segment_count", "dur_ms", "rank")


@query("reference_clips", """WITH c AS (SELECT *, dur_ms BETWEEN 1500 AND 12000 AS ok, least(dur_ms / 1000, 8.0::DOUBLE) + least(length(regexp_replace(text, '\\s+', '', 'g')) / 10.0::DOUBLE, 1.5::DOUBLE) AS score FROM segments),
a AS (SELECT *, bool_or(ok) OVER (PARTITION BY media_id, speaker_label) AS anyok FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY media_id, speaker_label ORDER BY CASE WHEN anyok THEN score ELSE dur_ms END DESC, start_ms, segment_id) AS rank FROM a WHERE ok OR NOT anyok)
SELECT media_id, speaker_label, segment_id, CASE WHEN anyok THEN score ELSE 0.0 END AS score, CAST(rank AS INTEGER) AS rank, rank = 1 AS is_best FROM r WHERE rank <= CASE WHEN anyok THEN 3 ELSE 1 END""")
def _(src):
    from cueloom.operators import speakers as sp

    return sp.reference_clips(src("segments"))


@query("fixed_slices", """WITH m AS (SELECT o_orderkey AS media_id, o_custkey * 137 % 90000 AS duration_ms FROM orders), n AS (SELECT *, CAST(ceil(duration_ms / 12000) AS BIGINT) AS k0 FROM m WHERE duration_ms > 0),
k AS (SELECT *, CASE WHEN k0 > 1 AND duration_ms - (k0 - 1) * 12000 < 1000 THEN k0 - 1 ELSE k0 END AS k FROM n) SELECT media_id, s AS slice, s * 12000 AS start_ms, CASE WHEN s = k - 1 THEN duration_ms ELSE (s + 1) * 12000 END AS end_ms FROM k, LATERAL (SELECT unnest(range(k)) AS s)""")
def _(src):
    media = src("orders").select(F.col("o_orderkey").alias("media_id"), (F.col("o_custkey") * 137 % 90000).alias("duration_ms"))
    return dt.fixed_slices(media, 12_000).drop("duration_ms")


@query("sample_instants", """WITH u AS (SELECT media_id, segment_id, start_ms, end_ms, CASE WHEN end_ms - start_ms < 2000 THEN 1 ELSE 4 END AS n FROM segments)
SELECT media_id, segment_id, CAST(i AS INTEGER) AS sample, start_ms + (end_ms - start_ms) * (i + 0.5::DOUBLE) / n AS t_ms FROM u, LATERAL (SELECT unnest(range(n)) AS i)""")
def _(src):
    return dt.sample_instants(src("segments"), 4).select("media_id", "segment_id", "sample", "t_ms")


@query("event_units", "SELECT media_id, event_id FROM (SELECT media_id, event_id, CASE WHEN event_id % 9 <> 0 THEN start_ms END AS start_ms, CASE WHEN event_id % 8 = 0 THEN start_ms - 1 ELSE end_ms END AS end_ms FROM ocr_events) WHERE start_ms IS NOT NULL AND end_ms >= start_ms")
def _(src):
    rows = src("ocr_events").withColumn("end_ms", F.when(F.col("event_id") % 8 == 0, F.col("start_ms") - 1).otherwise(F.col("end_ms"))).withColumn(
        "start_ms", F.when(F.col("event_id") % 9 != 0, F.col("start_ms")))
    return dt.event_units(rows).select("media_id", "event_id")


SUBSAMPLE = """WITH r AS (SELECT media_id, segment_id, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, segment_id) - 1 AS pos, count(*) OVER (PARTITION BY media_id) AS n FROM segments {where})
SELECT media_id, segment_id FROM r WHERE n <= {k} OR list_contains(list_transform(range({k}), lambda i: CAST(floor(i * n / {k}) AS BIGINT)), pos)"""


@query("even_subsample", SUBSAMPLE.format(where="", k=20))
def _(src):
    from cueloom.operators import sequence as seq

    return dt.even_subsample(src("segments"), 20, ["start_ms", "segment_id"], seq.time_slot()).select("media_id", "segment_id")


@query("contour_downsample", SUBSAMPLE.format(where="WHERE start_ms BETWEEN 20000 AND 300000", k=12))
def _(src):
    points = src("segments").select("media_id", "segment_id", F.col("segment_id").alias("point_id"), F.col("start_ms").alias("t_ms"))
    return dt.downsample(points, 20_000, 300_000, 12).select("media_id", "segment_id")


FRAMES_SQL = f"""WITH e AS (SELECT media_id, start_ms // 40 AS sf, start_ms // 40 + segment_id % 12 AS ef, {BOX} FROM segments),
fr AS (SELECT DISTINCT media_id, x1, y1, x2, y2, unnest(range(sf, ef + 1)) AS frame FROM e WHERE NOT ((y2 - y1) - (x2 - x1) > 10)),
pm AS (SELECT media_id, frame, string_agg(x1 || ',' || y1 || ',' || x2 || ',' || y2, ';' ORDER BY x1, y1, x2, y2) AS mask FROM fr GROUP BY ALL),
b AS (SELECT *, CASE WHEN frame - lag(frame) OVER w = 1 AND mask = lag(mask) OVER w THEN 0 ELSE 1 END AS brk FROM pm WINDOW w AS (PARTITION BY media_id ORDER BY frame)),
g AS (SELECT media_id, sum(brk) OVER (PARTITION BY media_id ORDER BY frame) AS grp, frame FROM b),
ranges AS (SELECT media_id, min(frame) AS start_frame, max(frame) AS end_frame FROM g GROUP BY media_id, grp)
"""


def _frames(src):
    frame = F.floor(F.col("start_ms") / 40)
    return dt.event_frames(_subtitles(src).select("media_id", "x1", "y1", "x2", "y2", frame.alias("start_frame"), (frame + F.col("segment_id") % 12).alias("end_frame")))


def frame_totals(src):
    """Frames of each media at 25 per second, to the end of its last segment."""
    return src("segments").groupBy("media_id").agg((F.max(F.floor(F.col("end_ms") / 40)) + 1).alias("total_frames"))


@query("event_frames", FRAMES_SQL + "SELECT * FROM fr")
def _(src):
    return _frames(src)


@query("mask_ranges", FRAMES_SQL + "SELECT * FROM ranges")
def _(src):
    return dt.mask_ranges(_frames(src))


@query("plan_ranges", FRAMES_SQL + """, n AS (SELECT *, lead(start_frame) OVER w AS ns, lag(start_frame) OVER w AS ps, lag(end_frame) OVER w AS pe, max(end_frame) OVER (PARTITION BY media_id) + 1 AS total FROM ranges WINDOW w AS (PARTITION BY media_id ORDER BY start_frame)),
p AS (SELECT *, CASE WHEN ps = pe THEN least(pe + 4, start_frame - 1) ELSE pe END AS before FROM n),
w AS (SELECT media_id, total, CASE WHEN start_frame = end_frame THEN greatest(start_frame - 4, coalesce(before + 1, start_frame - 4)) ELSE start_frame END AS s, CASE WHEN start_frame = end_frame THEN least(start_frame + 4, coalesce(ns - 1, start_frame + 4)) ELSE end_frame END AS e FROM p),
a AS (SELECT *, lag(e) OVER (PARTITION BY media_id ORDER BY s) AS le FROM w), t AS (SELECT *, max(CASE WHEN le IS NULL OR s > le + 1 THEN s END) OVER (PARTITION BY media_id ORDER BY s) AS stretch FROM a),
q AS (SELECT *, sum(CASE WHEN s = stretch OR e - s + 1 >= 9 AND s - stretch >= 9 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY s) AS grp FROM t),
z AS (SELECT media_id, min(s) AS start_frame, least(max(e), max(total) - 1) AS end_frame FROM q GROUP BY media_id, grp) SELECT * FROM z WHERE end_frame >= start_frame""")
def _(src):
    ranges = dt.mask_ranges(_frames(src))
    return dt.plan_ranges(ranges.join(ranges.groupBy("media_id").agg((F.max("end_frame") + 1).alias("total_frames")), "media_id"), 9)


@query("boxes_in_ranges", FRAMES_SQL + "SELECT DISTINCT r.media_id, start_frame, end_frame, x1, y1, x2, y2 FROM ranges r JOIN fr USING (media_id) WHERE frame BETWEEN start_frame AND end_frame")
def _(src):
    frames = _frames(src)
    return dt.boxes_in_ranges(frames, dt.mask_ranges(frames))


@query("region_frames", """SELECT s_suppkey AS media_id, x1, y1, x2, y2, unnest(range(40 + s_suppkey % 7)) AS frame FROM supplier, LATERAL (SELECT CAST(round_even(a * (600 + s_nationkey), 0) AS INTEGER) AS x1, CAST(round_even(b * 400, 0) AS INTEGER) AS y1, CAST(round_even(c * (600 + s_nationkey), 0) AS INTEGER) AS x2, CAST(round_even(d * 400, 0) AS INTEGER) AS y2
  FROM (VALUES (0.1::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE, 0.95::DOUBLE), (0.25::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE, 0.125::DOUBLE)) v(a, b, c, d))""")
def _(src):
    media = src("supplier").select(F.col("s_suppkey").alias("media_id"), (F.col("s_nationkey") + 600).alias("width"), F.lit(400).alias("height"), (F.col("s_suppkey") % 7 + 40).alias("total_frames"))
    return dt.region_frames(media, [(0.9, 0.8, 0.1, 0.95), (0.25, 0.0, 0.5, 0.125)])


@query("frame_hits", f"""WITH tf AS (SELECT media_id, max(end_ms // 40) + 1 AS total FROM segments GROUP BY media_id), h AS (SELECT media_id, total, segment_id, start_ms // 40 AS frame, (segment_id * 13 % 41 + 60) / 100.0::DOUBLE AS confidence, {BOX} FROM segments JOIN tf USING (media_id)),
b AS (SELECT *, CASE WHEN frame <= least(total - 1, lag(frame) OVER w + 12 + 2) + 9 THEN 0 ELSE 1 END AS brk FROM h WINDOW w AS (PARTITION BY media_id ORDER BY frame, segment_id)),
g AS (SELECT *, sum(brk) OVER (PARTITION BY media_id ORDER BY frame, segment_id) AS grp FROM b)
SELECT media_id, greatest(0, min(frame) - 8 - 3) AS start_frame, least(max(total) - 1, max(frame) + 12 + 2) AS end_frame, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, round(avg(confidence), 10) AS confidence FROM g GROUP BY media_id, grp""")
def _(src):
    hits = _subtitles(src).withColumn("frame", F.floor(F.col("start_ms") / 40)).withColumnRenamed("segment_id", "hit_id")
    hits = hits.join(frame_totals(src), "media_id")
    return dt.frame_hits(hits, 25.0, 4, lead=3, trail=2).withColumn("confidence", F.round("confidence", 10))


HINT_SQL = f"""WITH e AS (SELECT media_id, segment_id, {BOX} FROM segments),
q AS (SELECT media_id, round(quantile_cont(x2 - x1, 0.05), 6) AS w05, round(quantile_cont(x2 - x1, 0.5), 6) AS w50, round(quantile_cont(x2 - x1, 0.95), 6) AS w95, round(quantile_cont(y2 - y1, 0.05), 6) AS h05, round(quantile_cont(y2 - y1, 0.5), 6) AS h50, round(quantile_cont(y2 - y1, 0.95), 6) AS h95,
  quantile_cont((x1 + x2) / 2, 0.5) AS center_x, quantile_cont((y1 + y2) / 2, 0.5) AS center_y, round(quantile_cont((y1 + y2) / 2, 0.9) - quantile_cont((y1 + y2) / 2, 0.1), 6) AS spread FROM e GROUP BY media_id),
hint AS (SELECT media_id, center_x, center_y, greatest(50, CAST(trunc(w05 * 0.75::DOUBLE) AS INTEGER)) AS min_width, greatest(10, CAST(trunc(h05 * 0.18::DOUBLE) AS INTEGER)) AS min_height,
  least(least(640, greatest(48, CAST(trunc(greatest(w95 * 1.3::DOUBLE, w50 * 1.8::DOUBLE)) AS INTEGER))), 384) AS max_width, least(least(400, greatest(18, CAST(trunc(greatest(h95 * 1.15::DOUBLE, h50 * 1.3::DOUBLE)) AS INTEGER))), 112) AS max_height,
  greatest(70, CAST(trunc(greatest(w95 * 0.5::DOUBLE, 76.8::DOUBLE)) AS INTEGER)) AS max_dx, greatest(26, CAST(trunc(greatest(spread * 3.0::DOUBLE + 18, 24.0::DOUBLE)) AS INTEGER)) AS max_dy FROM q)
"""


@query("geometry_hint", HINT_SQL + "SELECT media_id, round(center_x, 6) AS center_x, round(center_y, 6) AS center_y, min_width, min_height, max_width, max_height, max_dx, max_dy FROM hint")
def _(src):
    out = dt.geometry_hint(_subtitles(src), 640, 400)
    return out.select("media_id", F.round("center_x", 6).alias("center_x"), F.round("center_y", 6).alias("center_y"), "min_width", "min_height", "max_width", "max_height", "max_dx", "max_dy")


@query("canonical_box", f"""WITH e AS (SELECT media_id, {BOX} FROM segments) SELECT media_id, CAST(round_even(quantile_cont(x1, 0.5), 0) AS INTEGER) AS x1, CAST(round_even(quantile_cont(y1, 0.5), 0) AS INTEGER) AS y1, CAST(round_even(quantile_cont(x2, 0.5), 0) AS INTEGER) AS x2, CAST(round_even(quantile_cont(y2, 0.5), 0) AS INTEGER) AS y2 FROM e GROUP BY media_id""")
def _(src):
    return dt.geometry_hint(_subtitles(src), 640, 400).select("media_id", *[F.col(f"box_{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("geometry_match", HINT_SQL + """SELECT e.media_id, e.segment_id FROM e JOIN hint USING (media_id) WHERE x2 - x1 BETWEEN min_width AND max_width AND y2 - y1 BETWEEN min_height AND max_height AND abs((x1 + x2) / 2 - center_x) <= max_dx AND abs((y1 + y2) / 2 - center_y) <= max_dy""")
def _(src):
    boxes = _subtitles(src)
    return dt.matching_geometry(boxes, dt.geometry_hint(boxes, 640, 400)).select("media_id", "segment_id")


@query("box_iou", """WITH p AS (SELECT a.media_id, a.frame, a.box_id AS a_id, b.box_id AS b_id, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS s, (a.x2 - a.x1) * (a.y2 - a.y1) AS aa, (b.x2 - b.x1) * (b.y2 - b.y1) AS ba
  FROM boxes a JOIN boxes b ON a.media_id = b.media_id AND a.frame = b.frame AND b.box_id = a.box_id + 1) SELECT media_id, frame, a_id, b_id, s / (aa + ba - s) AS iou, s / least(aa, ba) AS smaller FROM p""")
def _(src):
    rows = src("boxes")
    a = rows.select("media_id", "frame", F.col("box_id").alias("a_id"), *[F.col(c).alias(f"a_{c}") for c in ("x1", "y1", "x2", "y2")])
    b = rows.select("media_id", "frame", (F.col("box_id") - 1).alias("a_id"), F.col("box_id").alias("b_id"), *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")])
    return a.join(b, ["media_id", "frame", "a_id"]).select("media_id", "frame", "a_id", "b_id", bx.iou("a_", "b_").alias("iou"), bx.overlap_of_smaller("a_", "b_").alias("smaller"))


def _tick_boxes(src):
    truth = src("boxes").select("media_id", F.floor(F.col("frame") / 8).alias("tick"), (F.col("frame") * 100 + F.col("box_id")).alias("box_id"), "x1", "y1", "x2", "y2", "l_linenumber")
    pred = truth.filter("l_linenumber <> 4").select("media_id", "tick", "box_id", (F.col("x1") + 3).alias("x1"), (F.col("y1") + 1).alias("y1"), (F.col("x2") + 5).alias("x2"), "y2")
    return pred, truth


@query("greedy_box_match", """WITH RECURSIVE t AS (SELECT media_id, CAST(floor(frame / 8) AS BIGINT) AS tick, frame * 100 + box_id AS box_id, x1, y1, x2, y2, l_linenumber FROM boxes),
p AS (SELECT media_id, tick, box_id, x1 + 3 AS x1, y1 + 1 AS y1, x2 + 5 AS x2, y2 FROM t WHERE l_linenumber <> 4),
i AS (SELECT p.media_id, p.tick, p.box_id AS a, t.box_id AS b, greatest(0, least(p.x2, t.x2) - greatest(p.x1, t.x1)) * greatest(0, least(p.y2, t.y2) - greatest(p.y1, t.y1)) AS s, (p.x2 - p.x1) * (p.y2 - p.y1) AS pa, (t.x2 - t.x1) * (t.y2 - t.y1) AS ta FROM p JOIN t ON p.media_id = t.media_id AND p.tick = t.tick),
c AS (SELECT media_id, tick, a, b, row_number() OVER (PARTITION BY media_id, tick ORDER BY s / (pa + ta - s) DESC, a, b) AS k FROM i WHERE s / (pa + ta - s) >= 0.5::DOUBLE),
r AS (SELECT media_id, tick, k, [a] AS u, [b] AS v FROM c WHERE k = 1 UNION ALL SELECT c.media_id, c.tick, c.k, CASE WHEN list_contains(u, a) OR list_contains(v, b) THEN u ELSE list_append(u, a) END, CASE WHEN list_contains(u, a) OR list_contains(v, b) THEN v ELSE list_append(v, b) END
  FROM r JOIN c ON c.media_id = r.media_id AND c.tick = r.tick AND c.k = r.k + 1),
m AS (SELECT media_id, CAST(sum(len(u)) AS BIGINT) AS tp FROM (SELECT media_id, tick, arg_max(u, k) AS u FROM r GROUP BY ALL) GROUP BY media_id),
n AS (SELECT coalesce(x.media_id, y.media_id) AS media_id, coalesce(np, 0) AS np, coalesce(nt, 0) AS nt FROM (SELECT media_id, count(*) AS np FROM p GROUP BY media_id) x FULL JOIN (SELECT media_id, count(*) AS nt FROM t GROUP BY media_id) y ON x.media_id = y.media_id)
SELECT media_id, coalesce(tp, 0) AS tp, np - coalesce(tp, 0) AS fp, nt - coalesce(tp, 0) AS fn FROM n LEFT JOIN m USING (media_id)""")
def _(src):
    return dt.greedy_box_match(*_tick_boxes(src))


@query("drop_classified", "SELECT media_id, event_id FROM ocr_events WHERE (media_id, event_id) NOT IN (SELECT (media_id, event_id) FROM ocr_events WHERE kind = 'scene_text')")
def _(src):
    events = src("ocr_events")
    return dt.drop_classified(events.drop("kind"), events.select("media_id", "event_id", "kind")).select("media_id", "event_id")


@query("drop_competing_anchors", """WITH a AS (SELECT media_id, bool_or(speaker_label = 'SPEAKER_00') AS bottom, count(*) AS n FROM (SELECT DISTINCT media_id, speaker_label FROM segments WHERE media_id % 3 <> 0 OR speaker_label <> 'SPEAKER_00') GROUP BY media_id)
SELECT media_id, segment_id FROM segments s LEFT JOIN a USING (media_id) WHERE NOT (coalesce(bottom AND n > 1, false) AND s.segment_id % 4 <> 0 AND s.speaker_label <> 'SPEAKER_00')""")
def _(src):
    s = src("segments")
    mode = F.when(F.col("speaker_label") == "SPEAKER_00", "Bottom").otherwise("top")
    anchors = s.filter("media_id % 3 <> 0 OR speaker_label <> 'SPEAKER_00'").select("media_id", "speaker_label", mode.alias("mode")).distinct()
    subs = s.select("media_id", "segment_id", F.when(F.col("segment_id") % 4 == 0, F.array(F.lit(""))).otherwise(F.array(mode, F.lit(""))).alias("modes"))
    return dt.drop_competing_anchors(subs, anchors).select("media_id", "segment_id")


@query("anchor_stats", """WITH d AS (SELECT user_id AS media_id, 'anchor_' || CAST(event_id % 3 AS STRING) AS anchor, CASE event_id % 3 WHEN 0 THEN 'bottom' ELSE 'top' END AS mode, event_id % 3 <> 2 AS weak, event_id % 10 < 7 AS short, CASE WHEN event_id % 8 = 0 THEN '' ELSE event_type END AS t,
  (event_id * 7 % 60) / 100.0::DOUBLE AS w, (event_id * 11 % 100) / 100.0::DOUBLE AS c, (event_id * 13 % 100) / 100.0::DOUBLE AS e FROM events),
x AS (SELECT media_id, anchor, max(c) AS top, sum(c) AS n, count(*) AS k FROM (SELECT media_id, anchor, t, count(*) AS c FROM d WHERE t <> '' GROUP BY ALL) GROUP BY ALL),
b AS (SELECT media_id, anchor, count(*) AS count, any_value(mode) AS mode, bool_or(weak) AS weak, count(*) FILTER (short) / count(*) AS short_share, quantile_cont(w, 0.5) AS width_ratio, quantile_cont(c, 0.5) AS center_prior, quantile_cont(e, 0.5) AS edge FROM d GROUP BY ALL),
s AS (SELECT b.*, coalesce(top / n, 0.0) AS repeat_share, coalesce(k / n, 1.0) AS unique_ratio, bool_or(mode = 'bottom') OVER (PARTITION BY b.media_id) AS hb FROM b LEFT JOIN x USING (media_id, anchor))
SELECT media_id, anchor, count, mode, weak, short_share, round(width_ratio, 8) AS width_ratio, round(center_prior, 8) AS center_prior, round(edge, 8) AS edge, repeat_share, unique_ratio, count >= 5 AND CASE WHEN mode = 'bottom' THEN weak AND repeat_share >= 0.5 AND unique_ratio <= 0.35 AND short_share >= 0.8 AND width_ratio < 0.18 AND edge > 0.82
  ELSE (hb AND repeat_share >= 0.55 AND unique_ratio <= 0.40 AND count <= 8 AND width_ratio <= 0.45) OR (repeat_share >= 0.34 AND unique_ratio <= 0.60 AND short_share >= 0.60 AND (center_prior < 0.78 OR width_ratio < 0.24 OR edge > 0.82)) OR (hb AND weak AND repeat_share >= 0.30 AND short_share >= 0.50 AND center_prior < 0.84) END AS drop_anchor FROM s""")
def _(src):
    k = F.col("event_id")
    rows = src("events").select(
        F.col("user_id").alias("media_id"), F.concat(F.lit("anchor_"), (k % 3).cast("string")).alias("anchor"), F.when(k % 3 == 0, "bottom").otherwise("top").alias("mode"), (k % 3 != 2).alias("weak"), (k % 10 < 7).alias("short"),
        F.when(k % 8 == 0, "").otherwise(F.col("event_type")).alias("norm_text"), (k * 7 % 60 / 100.0).alias("width_ratio"), (k * 11 % 100 / 100.0).alias("center_prior"), (k * 13 % 100 / 100.0).alias("edge"))
    out = dt.anchor_stats(rows)
    for c in ("width_ratio", "center_prior", "edge"):
        out = out.withColumn(c, F.round(c, 8))
    return out


@query("filter_confidence", "SELECT media_id, segment_id, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, end_ms, segment_id) AS index FROM segments WHERE (segment_id * 13 % 41 + 60) / 100.0 >= 0.7")
def _(src):
    return dt.filter_confidence(_subtitles(src), 0.7).select("media_id", "segment_id", "index")


MERGE_SQL = """WITH d AS (SELECT user_id AS media_id, event_id AS det_id, CAST(floor(TS_MS(ts) / 40000) AS BIGINT) AS t_ms, event_type AS text, event_type AS norm, (60 + event_id * 13 % 41) / 100.0::DOUBLE AS confidence FROM events),
b AS (SELECT *, CASE WHEN t_ms - lag(t_ms) OVER w <= 1000 AND (1.0::DOUBLE - levenshtein(norm, lag(norm) OVER w) / greatest(length(norm), length(lag(norm) OVER w))) >= 0.8 THEN 0 ELSE 1 END AS brk, row_number() OVER w - 1 AS pos FROM d WINDOW w AS (PARTITION BY media_id ORDER BY t_ms, det_id)),
g AS (SELECT *, max(CASE WHEN brk = 1 THEN pos END) OVER (PARTITION BY media_id ORDER BY pos) AS grp FROM b),
s AS (SELECT media_id, grp AS segment_id, min(t_ms) AS start_ms, CASE WHEN count(*) = 1 THEN min(t_ms) + 500 ELSE max(t_ms) END AS end_ms, any_value(text) AS text, round(avg(confidence), 10) AS confidence, count(*) AS detections FROM g GROUP BY ALL)
SELECT * FROM s""".replace("TS_MS(ts)", "(epoch_us(ts) // 1000 - 1704067200000)")


def _merged(src):
    rows = src("segments").select("media_id", F.col("segment_id").alias("det_id"), F.col("start_ms"), F.col("event_type").alias("text"))
    det = rows.select("media_id", "det_id", F.floor(F.col("start_ms") / 5).alias("t_ms"), "text", ((F.col("det_id") * 13 % 41 + 60) / 100.0).alias("confidence"))
    return dt.merge_detections(det)


@query("merge_detections", MERGE_SQL)
def _(src):
    return _merged(src).withColumn("confidence", F.round("confidence", 10))


def _clashing(src):
    """Merged subtitles whose starts fall together."""
    return _merged(src).withColumn("start_ms", F.floor(F.col("start_ms") / 1_500) * 1_500)


CLASHING_SQL = MERGE_SQL.replace("WITH d AS", "WITH RECURSIVE d AS").removesuffix("SELECT * FROM s").rstrip() + """,
q AS (SELECT * REPLACE (start_ms // 1500 * 1500 AS start_ms) FROM s),
"""


@query("adjust_boundaries", CLASHING_SQL + """o AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, end_ms, segment_id) - 1 AS pos FROM q),
r AS (SELECT media_id, segment_id, pos, start_ms AS s, end_ms AS e FROM o WHERE pos = 0 UNION ALL SELECT o.media_id, o.segment_id, o.pos, CASE WHEN o.start_ms <= r.s THEN r.s + 10 ELSE o.start_ms END, o.end_ms FROM r JOIN o ON o.media_id = r.media_id AND o.pos = r.pos + 1),
h AS (SELECT media_id, segment_id, s, CASE WHEN e <= s OR e - s < 500 THEN s + 500 ELSE e END AS e FROM r), n AS (SELECT *, lead(s) OVER (PARTITION BY media_id ORDER BY s, segment_id) AS nx FROM h)
SELECT media_id, segment_id, s AS start_ms, CASE WHEN nx < e THEN greatest(s + 50, nx - 10) ELSE e END AS end_ms FROM n""")
def _(src):
    return dt.adjust_boundaries(_clashing(src), slot_rows=16)


@query("merge_nearby", CLASHING_SQL + """o AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, end_ms, segment_id) - 1 AS pos FROM q),
r AS (SELECT media_id, pos, pos AS run, text AS norm, end_ms AS e FROM o WHERE pos = 0 UNION ALL SELECT o.media_id, o.pos, CASE WHEN j THEN run ELSE o.pos END, CASE WHEN j THEN norm ELSE o.text END, o.end_ms
  FROM (SELECT r.*, o.pos AS p, o.start_ms - r.e <= 1000 AND (o.text = r.norm OR 1.0::DOUBLE - levenshtein(o.text, r.norm) / greatest(length(o.text), length(r.norm)) > 0.95) AS j FROM r JOIN o ON o.media_id = r.media_id AND o.pos = r.pos + 1) x JOIN o ON o.media_id = x.media_id AND o.pos = x.p)
SELECT o.media_id, arg_min(o.segment_id, o.pos) AS segment_id, min(o.start_ms) AS start_ms, arg_max(o.end_ms, o.pos) AS end_ms, arg_min(o.text, o.pos) AS text, count(*) AS merged FROM o JOIN r ON r.media_id = o.media_id AND r.pos = o.pos GROUP BY o.media_id, run""")
def _(src):
    return dt.merge_nearby(_clashing(src), slot_rows=16)


CREDIT_TEXT = "CASE segment_id % 4 WHEN 0 THEN text WHEN 1 THEN '主演 张三' WHEN 2 THEN '我在这里，你的' ELSE '文化传媒有限公司' END"


def _credit_subtitles(src):
    k = F.col("segment_id") % 4
    text = F.when(k == 0, F.col("text")).when(k == 1, "主演 张三").when(k == 2, "我在这里，你的").otherwise("文化传媒有限公司")
    return src("segments").select("media_id", "segment_id", "start_ms", "end_ms", text.alias("text"))


@query("drop_credit_rolls", """WITH r AS (SELECT *, segment_id % 4 IN (1, 3) AS c, CASE segment_id % 4 WHEN 1 THEN 38 WHEN 3 THEN 46 ELSE 0 END AS credit, segment_id % 4 IN (0, 1) AS low, lag(end_ms) OVER w AS pe, row_number() OVER w - 1 AS pos FROM segments WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, end_ms, segment_id)),
g AS (SELECT *, sum(CASE WHEN pe IS NULL OR start_ms - pe > 2500 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY pos) AS grp, arg_max(end_ms, pos) OVER (PARTITION BY media_id) AS last_end, count(*) OVER (PARTITION BY media_id) AS total FROM r),
a AS (SELECT media_id, grp, count(*) AS n, count(*) FILTER (c) AS c, count(*) FILTER (low) AS low, sum(credit) / (count(*) * 100) AS mean, min(start_ms) >= any_value(last_end) * 0.88 AS tail, any_value(total) AS total FROM g GROUP BY ALL),
f AS (SELECT *, c >= 2 AND (c / n >= 0.45 OR c >= 2 OR mean >= 0.45) AS broad, low / n >= 0.7 AND (n - low) / n <= 0.3 AS flat FROM a),
dr AS (SELECT media_id, grp FROM f WHERE total >= 4 AND ((n >= 4 AND broad AND (c / n >= 0.55 OR flat OR c >= 3)) OR (n >= 6 AND broad AND flat) OR (tail AND c >= 2 AND flat AND (c >= 1 OR mean >= 0.35))))
SELECT media_id, segment_id FROM g WHERE (media_id, grp) NOT IN (SELECT (media_id, grp) FROM dr)""")
def _(src):
    return dt.drop_credit_rolls(_credit_subtitles(src)).select("media_id", "segment_id")


@query("main_window", """WITH b AS (SELECT media_id, segment_id, CASE WHEN start_ms < 40000 THEN start_ms // 4 WHEN start_ms > 310000 THEN start_ms * 2 ELSE start_ms + 30000 END AS s, dur_ms FROM segments),
o AS (SELECT media_id, segment_id, s, s + dur_ms AS e, row_number() OVER w - 1 AS pos, lag(s + dur_ms) OVER w AS pe, lead(s, 5) OVER w AS s5 FROM b WINDOW w AS (PARTITION BY media_id ORDER BY s, s + dur_ms, segment_id)),
w AS (SELECT media_id, count(*) AS n, min(s) AS first, arg_max(e, pos) AS last, max(e) + 5000 AS program, min(CASE WHEN s5 - s <= 30000 THEN pos END) AS dense FROM o GROUP BY media_id),
h AS (SELECT w.*, CASE WHEN pos > 0 AND pos < least(n, greatest(40, floor(n * 0.12::DOUBLE))) AND s - pe >= 18000 AND pos <= greatest(20, floor(n * 0.08::DOUBLE)) AND greatest(0, pe - first) <= greatest(180000.0::DOUBLE, greatest(1000, last - first) * 0.12::DOUBLE) THEN pos ELSE 0 END AS head
  FROM w LEFT JOIN o ON o.media_id = w.media_id AND o.pos = w.dense),
g AS (SELECT h.*, o.s AS begin, n >= 40 AND NOT (greatest(0, last - first) < 300000 AND program < 600000) AS active FROM h JOIN o ON o.media_id = h.media_id AND o.pos = h.head),
t AS (SELECT g.media_id, max(pos) AS tail FROM g JOIN o USING (media_id) WHERE pos > head AND n - head >= 40 AND s - pe >= 18000 AND s >= greatest(begin + greatest(0, last - begin) * 0.88::DOUBLE, greatest(program, last) * 0.88::DOUBLE)
  AND pos - head >= greatest(30, floor(n * 0.55::DOUBLE)) AND (n - pos) / greatest(1, pos - head) <= 0.08::DOUBLE AND (greatest(0, last - s) <= 120000 OR greatest(0, last - s) / greatest(1000, pe - begin) <= 0.06::DOUBLE) GROUP BY g.media_id)
SELECT o.media_id, o.segment_id FROM o JOIN g USING (media_id) LEFT JOIN t USING (media_id) WHERE NOT active OR head >= coalesce(tail, n) OR (pos >= head AND pos < coalesce(tail, n))""")
def _(src):
    s = src("segments").select("media_id", "segment_id", F.when(F.col("start_ms") < 40_000, F.col("start_ms") / 4).when(F.col("start_ms") > 310_000, F.col("start_ms") * 2).otherwise(F.col("start_ms") + 30_000).cast("long").alias("start_ms"), F.col("dur_ms"))
    subs = s.select("media_id", "segment_id", "start_ms", (F.col("start_ms") + F.col("dur_ms")).alias("end_ms"))
    durations = subs.groupBy("media_id").agg((F.max("end_ms") + 5_000).alias("duration_ms"))
    return dt.main_window(subs, durations).select("media_id", "segment_id")


@query("layout_profile", f"""WITH r AS (SELECT media_id, y2 - y1 AS height, x2 - x1 AS width, (x1 + x2) / 2 AS center_x, (y1 + y2) / 2 AS center_y, y2 AS bottom_y FROM (SELECT media_id, {BOX} FROM segments)), m AS (SELECT media_id, quantile_cont(height, 0.5) AS raw, count(*) AS n FROM r GROUP BY media_id),
c AS (SELECT r.*, height / raw BETWEEN 0.68 AND 1.45 AS core, n, raw FROM r JOIN m USING (media_id) WHERE n >= 20 AND raw > 1), k AS (SELECT *, count(*) FILTER (core) OVER (PARTITION BY media_id) >= 20 AS by_core FROM c)
SELECT media_id, count(*) AS count, round(quantile_cont(height, 0.5), 6) AS height, round(quantile_cont(width, 0.5), 6) AS width, round(quantile_cont(center_x, 0.5), 6) AS center_x, round(quantile_cont(center_y, 0.5), 6) AS center_y, round(quantile_cont(bottom_y, 0.5), 6) AS bottom_y FROM k WHERE core OR NOT by_core GROUP BY media_id""")
def _(src):
    rows = _subtitles(src).select("media_id", (F.col("y2") - F.col("y1")).alias("height"), (F.col("x2") - F.col("x1")).alias("width"), ((F.col("x1") + F.col("x2")) / 2).alias("center_x"), ((F.col("y1") + F.col("y2")) / 2).alias("center_y"), F.col("y2").alias("bottom_y"))
    out = dt.layout_profile(rows)
    return out.select("media_id", "count", *[F.round(c, 6).alias(c) for c in ("height", "width", "center_x", "center_y", "bottom_y")])


@query("reuse_neighbours", """WITH u AS (SELECT media_id, segment_id, start_ms, [segment_id % 5, segment_id % 3, segment_id % 2] AS sig, segment_id % 11 = 0 AS failed, 'p' || CAST(segment_id AS STRING) AS payload FROM segments),
l AS (SELECT *, lag(sig) OVER w AS ps, lag(failed) OVER w AS pf, row_number() OVER w AS pos FROM u WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, segment_id)),
d AS (SELECT *, NOT (ps IS NULL OR pf OR failed OR (abs(sig[1] - ps[1]) + abs(sig[2] - ps[2]) + abs(sig[3] - ps[3])) / 3 >= 0.9) AS reused FROM l)
SELECT media_id, segment_id, reused, last_value(CASE WHEN NOT reused THEN payload END IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY pos) AS source_payload FROM d""")
def _(src):
    k = F.col("segment_id")
    units = src("segments").select("media_id", "segment_id", k.alias("unit_id"), "start_ms", F.array(k % 5, k % 3, k % 2).alias("sig"), (k % 11 == 0).alias("failed"), F.concat(F.lit("p"), k.cast("string")).alias("payload"))
    return dt.reuse_neighbours(units, 0.9).select("media_id", "segment_id", "reused", "source_payload")
