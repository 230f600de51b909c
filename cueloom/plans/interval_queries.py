"""Registered queries: interval joins, clipping, diarization error."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueloom.functions.cols import joined
from cueloom.operators import evaluation as ev
from cueloom.operators import intervals as iv
from cueloom.plans.registry import query

PAIRS_SQL = """WITH ev AS (SELECT * FROM ocr_events WHERE kind IS NULL OR kind NOT IN ('scene_text', 'watermark', 'title_card')),
pairs AS (SELECT s.media_id, s.segment_id, e.event_id, s.start_ms AS ss, s.end_ms AS se, e.start_ms AS es, e.end_ms AS ee, e.confidence, greatest(0, least(s.end_ms, e.end_ms) - greatest(s.start_ms, e.start_ms)) AS overlap,
  s.start_ms * 2 <= e.start_ms + e.end_ms AND e.start_ms + e.end_ms <= s.end_ms * 2 AS mid_inside FROM segments s JOIN ev e ON s.media_id = e.media_id
  AND (least(s.end_ms, e.end_ms) > greatest(s.start_ms, e.start_ms) OR (s.start_ms * 2 <= e.start_ms + e.end_ms AND e.start_ms + e.end_ms <= s.end_ms * 2)))
"""


def _pairs(src):
    return iv.candidates(src("segments"), iv.dialogue_only(src("ocr_events")))


@query("candidate_events", PAIRS_SQL + "SELECT media_id, segment_id, event_id, overlap, mid_inside FROM pairs")
def _(src):
    return _pairs(src).select("media_id", F.col("l_segment_id").alias("segment_id"), F.col("r_event_id").alias("event_id"), "overlap", "mid_inside")


@query("dialogue_events", "SELECT media_id, event_id FROM ocr_events WHERE kind IS NULL OR kind = 'subtitle'")
def _(src):
    return iv.dialogue_only(src("ocr_events")).select("media_id", "event_id")


@query("alignment_score", PAIRS_SQL + """SELECT media_id, segment_id, count(*) AS events, CAST(sum(overlap) AS BIGINT) AS overlap, least(1.0::DOUBLE, greatest(sum(overlap) / greatest(1, max(se - ss)), sum(overlap) / greatest(1, sum(ee - es)))) AS score FROM pairs GROUP BY ALL""")
def _(src):
    return iv.alignment(_pairs(src))


@query("timing_policy", PAIRS_SQL + """, a AS (SELECT media_id, segment_id, min(ss) AS s, max(se) AS e, min(es) AS os, max(ee) AS oe FROM pairs GROUP BY ALL), b AS (SELECT *, os - s > 600 AS late, oe - e > 800 AS longer, greatest(oe, e) AS de, CASE WHEN os - s > 600 THEN greatest(s, os - 600) ELSE s END AS ds FROM a)
SELECT media_id, segment_id, os AS subtitle_start, oe AS subtitle_end, ds AS dubbing_start, CASE WHEN de <= ds THEN greatest(ds + 1, oe, e) ELSE de END AS dubbing_end,
  CASE WHEN late AND longer THEN 'late_ocr_anchor+ocr_extended_anchor' WHEN late THEN 'late_ocr_anchor' WHEN longer THEN 'ocr_extended_anchor' ELSE 'asr_anchor' END AS policy,
  concat_ws('|', CASE WHEN late THEN 'asr_start_precedes_ocr_window' END, CASE WHEN longer THEN 'ocr_window_extends_after_asr' END, CASE WHEN de <= ds THEN 'dubbing_window_clamped' END) AS warnings FROM b""")
def _(src):
    return iv.timing_policy(_pairs(src)).withColumn("warnings", joined(F.col("warnings")))


VERDICTS = """SELECT media_id, segment_id, CASE segment_id % 6 WHEN 0 THEN 'use_asr' WHEN 1 THEN 'use_ocr' WHEN 2 THEN 'merge' WHEN 3 THEN 'merge' WHEN 4 THEN 'unsure' END AS verdict,
  CASE WHEN segment_id % 6 = 3 THEN ' zz#9 ' || text ELSE ' ' || text END AS verdict_text FROM segments"""
CLEAN = "lower(regexp_replace({}, '[\\s\\[\\]()\\-,.!?:;\"''_]+', '', 'g'))"


def clean(x: str) -> str:
    return CLEAN.format(x)


CORRECT_SQL = PAIRS_SQL.replace("WITH ev", "WITH RECURSIVE ev").rstrip() + f""",
seg AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, end_ms, segment_id) - 1 AS pos, length({clean("text")}) AS chars FROM segments), verdicts AS ({VERDICTS}),
lst AS (SELECT p.media_id, p.segment_id, list({{'s': es, 'e': ee, 'id': p.event_id, 'o': overlap, 'c': p.confidence, 'n': length({clean("ev.text")}), 't': ev.text}} ORDER BY es, ee, p.event_id) AS events FROM pairs p JOIN ev ON ev.media_id = p.media_id AND ev.event_id = p.event_id GROUP BY p.media_id, p.segment_id),
w AS (SELECT seg.*, coalesce(events, []) AS events, verdict, verdict_text FROM seg LEFT JOIN lst USING (media_id, segment_id) LEFT JOIN verdicts USING (media_id, segment_id)),
r AS (SELECT media_id, -1::BIGINT AS pos, NULL::BIGINT AS segment_id, []::BIGINT[] AS gone, NULL::VARCHAR AS decision, NULL::VARCHAR AS reason, []::BIGINT[] AS used, 0.0::DOUBLE AS alignment, 0.0::DOUBLE AS quality, 0.0::DOUBLE AS ratio, ''::VARCHAR AS merged, ''::VARCHAR AS out, false AS arbitrated, ''::VARCHAR AS original FROM seg WHERE pos = 0
  UNION ALL SELECT media_id, pos, segment_id, CASE WHEN take OR coalesce(verdict_of IN ('llm_use_ocr', 'llm_merge'), false) THEN list_concat(gone, ids) ELSE gone END,
    CASE WHEN take THEN CASE WHEN n > 1 THEN 'merge_ocr' ELSE 'use_ocr' END WHEN n = 0 THEN 'use_asr' ELSE coalesce(verdict_of, 'review') END,
    CASE WHEN n = 0 THEN CASE WHEN some_free THEN 'low_ocr_confidence' ELSE 'no_ocr_candidate' END WHEN NOT take AND verdict_of IS NULL THEN 'weak_alignment_or_length_mismatch' END,
    ids, alignment, quality, ratio, merged, CASE WHEN take THEN merged WHEN verdict_of = 'llm_use_ocr' THEN merged WHEN verdict_of = 'llm_merge' THEN trim(verdict_text) ELSE text END, verdict_of IS NOT NULL, text FROM (
    SELECT *, CASE WHEN n = 0 OR take THEN NULL WHEN verdict = 'use_asr' THEN 'llm_use_asr' WHEN verdict = 'use_ocr' THEN 'llm_use_ocr'
        WHEN verdict = 'merge' AND len(list_filter(list_distinct(string_split({clean("verdict_text")}, '')), lambda c: NOT contains({clean("text || merged")}, c))) = 0 THEN 'llm_merge' END AS verdict_of FROM (
      SELECT *, coalesce(n > 0 AND alignment >= 0.55 AND ratio BETWEEN 0.5 AND 2, false) AS take FROM (
        SELECT *, len(strong) AS n, list_transform(strong, lambda e: e.id) AS ids, CASE WHEN len(strong) = 0 THEN 0.0::DOUBLE ELSE round(least(1.0::DOUBLE, greatest(list_sum(list_transform(strong, lambda e: e.o)) / greatest(1, end_ms - start_ms), list_sum(list_transform(strong, lambda e: e.o)) / greatest(1, list_sum(list_transform(strong, lambda e: e.e - e.s))))), 3) END AS alignment,
          CASE WHEN len(strong) = 0 THEN 0.0::DOUBLE ELSE round(list_sum(list_transform(strong, lambda e: e.c)) / len(strong), 3) END AS quality, coalesce(array_to_string(list_transform(strong, lambda e: e.t), ''), '') AS merged,
          CASE WHEN len(strong) = 0 OR array_to_string(list_transform(strong, lambda e: e.t), '') = '' THEN 0.0::DOUBLE WHEN chars > 0 THEN list_sum(list_transform(strong, lambda e: e.n)) / chars WHEN list_sum(list_transform(strong, lambda e: e.n)) = 0 THEN 1.0::DOUBLE END AS ratio FROM (
          SELECT *, list_filter(free, lambda e: e.c >= 0.85) AS strong, len(free) > 0 AS some_free FROM (
            SELECT w.*, r.gone, list_filter(w.events, lambda e: NOT list_contains(r.gone, e.id)) AS free FROM r JOIN w ON w.media_id = r.media_id AND w.pos = r.pos + 1) a) b) c) d) e),
c AS (SELECT * FROM r WHERE pos >= 0)
"""
SIMILAR = f"""x AS (SELECT media_id, segment_id, c, count(*) AS n FROM (SELECT media_id, segment_id, unnest(string_split({clean("original")}, '')) AS c FROM c) GROUP BY ALL), y AS (SELECT media_id, segment_id, c, count(*) AS n FROM (SELECT media_id, segment_id, unnest(string_split({clean("merged")}, '')) AS c FROM c) GROUP BY ALL),
z AS (SELECT media_id, segment_id, CAST(sum(least(x.n, y.n)) AS BIGINT) AS shared FROM x JOIN y USING (media_id, segment_id, c) GROUP BY ALL)
"""


def _correction(src):
    k, text = F.col("segment_id") % 6, F.col("text")
    verdict = F.when(k == 0, "use_asr").when(k == 1, "use_ocr").when(k.isin(2, 3), "merge").when(k == 4, "unsure")
    verdicts = src("segments").select("media_id", "segment_id", verdict.alias("verdict"), F.when(k == 3, F.concat(F.lit(" zz#9 "), text)).otherwise(F.concat(F.lit(" "), text)).alias("verdict_text"))
    return iv.correct(src("segments"), src("ocr_events"), verdicts, slot_rows=48)


@query("transcript_correction", CORRECT_SQL.rstrip() + ", " + SIMILAR + f"""SELECT media_id, segment_id, decision, reason, array_to_string(used, '|') AS used, alignment, quality, round(ratio, 9) AS ratio, CASE WHEN merged = '' THEN 0.0::DOUBLE ELSE round(coalesce(shared, 0) / greatest(length({clean("original")}), length({clean("merged")})), 3) END AS similarity,
  out AS text, arbitrated, decision = 'review' AS needs_review FROM c LEFT JOIN z USING (media_id, segment_id)""")
def _(src):
    return _correction(src).select("media_id", "segment_id", "decision", "reason", F.array_join(F.col("used").cast("array<string>"), "|").alias("used"), "alignment", "quality", F.round("ratio", 9).alias("ratio"), "similarity", "text", "arbitrated", "needs_review")


@query("correction_summary", CORRECT_SQL + """, u AS (SELECT media_id, unnest(used) AS event_id FROM c WHERE decision IN ('use_ocr', 'merge_ocr', 'llm_use_ocr', 'llm_merge')),
o AS (SELECT media_id, count(*) AS ocr_only FROM ev WHERE confidence >= 0.85 AND (media_id, event_id) NOT IN (SELECT (media_id, event_id) FROM u) AND (media_id, event_id) NOT IN (SELECT (media_id, event_id) FROM pairs WHERE mid_inside) GROUP BY media_id),
s AS (SELECT media_id, count(*) AS segments, count(*) FILTER (decision IN ('use_ocr', 'merge_ocr', 'llm_use_ocr', 'llm_merge')) AS corrected, count(*) FILTER (decision IN ('use_asr', 'llm_use_asr')) AS kept, count(*) FILTER (decision = 'review') AS review, count(*) FILTER (arbitrated) AS arbitrated FROM c GROUP BY media_id)
SELECT s.*, coalesce(ocr_only, 0) AS ocr_only, corrected / segments AS correction_rate, review / segments AS review_rate FROM s LEFT JOIN o USING (media_id)""")
def _(src):
    decisions = _correction(src)
    used = decisions.filter(F.col("decision").isin("use_ocr", "merge_ocr", "llm_use_ocr", "llm_merge")).select("media_id", F.explode("used").alias("event_id"))
    return iv.correction_summary(decisions, iv.unmatched_events(src("segments"), iv.dialogue_only(src("ocr_events")), used))


@query("unmatched_events", PAIRS_SQL + "SELECT media_id, event_id FROM ev WHERE confidence >= 0.85 AND event_id % 4 <> 0 AND (media_id, event_id) NOT IN (SELECT (media_id, event_id) FROM pairs WHERE mid_inside)")
def _(src):
    events = iv.dialogue_only(src("ocr_events"))
    return iv.unmatched_events(src("segments"), events, events.filter("event_id % 4 = 0")).select("media_id", "event_id")


OVERLAP_SQL = """WITH o AS (SELECT s.media_id, s.segment_id, t.turn_id, t.speaker, t.start_ms AS ts, t.end_ms AS te, s.start_ms AS ss, s.end_ms AS se, least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms) AS ov FROM segments s JOIN turns t USING (media_id)),
best AS (SELECT media_id, segment_id, arg_max(speaker, (ov, -ts, -te, -turn_id)) AS speaker, max(ov) AS overlap FROM o WHERE ov > 0 GROUP BY ALL),
near AS (SELECT media_id, segment_id, arg_min(speaker, (CASE WHEN te < ss THEN (ss - te) * 2 WHEN ts > se THEN (ts - se) * 2 ELSE abs(ss + se - ts - te) END, ts, turn_id)) AS speaker FROM o GROUP BY ALL)
"""


@query("best_overlap", OVERLAP_SQL + "SELECT * FROM best")
def _(src):
    return iv.best_overlap(src("segments"), src("turns"), "speaker")


@query("assign_labels", OVERLAP_SQL + "SELECT s.media_id, s.segment_id, coalesce(b.speaker, n.speaker, 'SPEAKER_00') AS speaker FROM segments s LEFT JOIN best b USING (media_id, segment_id) LEFT JOIN near n ON n.media_id = s.media_id AND n.segment_id = s.segment_id")
def _(src):
    return iv.assign_labels(src("segments"), src("turns"), "speaker")


COVER_SQL = """WITH c AS (SELECT media_id, segment_id AS cand_id, start_ms + (segment_id * 7) % 900 AS start_ms, end_ms + 900 + (segment_id * 13) % 400 AS end_ms FROM segments), x AS (SELECT media_id, start_ms, end_ms FROM turns),
cov AS (SELECT c.media_id, c.cand_id, c.start_ms, c.end_ms, CAST(coalesce(sum(CASE WHEN least(c.end_ms, x.end_ms) >= greatest(c.start_ms, x.start_ms) THEN least(c.end_ms, x.end_ms) - greatest(c.start_ms, x.start_ms) + 1 END), 0) AS BIGINT) AS covered,
  coalesce(bool_or(x.start_ms - 1500 <= c.end_ms AND x.end_ms + 1500 >= c.start_ms), false) AS near FROM c LEFT JOIN x USING (media_id) GROUP BY ALL),
share AS (SELECT *, covered / greatest(1, end_ms - start_ms + 1) AS share FROM cov)
"""


def _cover(src):
    s = src("segments")
    cands = s.select("media_id", F.col("segment_id").alias("cand_id"), (F.col("start_ms") + (F.col("segment_id") * 7) % 900).alias("start_ms"), (F.col("end_ms") + 900 + (F.col("segment_id") * 13) % 400).alias("end_ms"))
    return cands, src("turns").select("media_id", "start_ms", "end_ms")


@query("covered_share", COVER_SQL + "SELECT media_id, cand_id, covered, share FROM share")
def _(src):
    return iv.covered_share(*_cover(src)).select("media_id", "cand_id", "covered", "share")


@query("near_existing", COVER_SQL + "SELECT media_id, cand_id FROM share WHERE near")
def _(src):
    return iv.near_existing(*_cover(src), 1500).select("media_id", "cand_id")


@query("add_fallback_events", COVER_SQL + "SELECT media_id, start_ms, end_ms, 'ocr' AS source FROM x UNION ALL SELECT media_id, start_ms, end_ms, 'visual_fallback' FROM share WHERE near AND share < 0.5")
def _(src):
    cands, existing = _cover(src)
    return iv.add_fallback(existing, cands, 1500)


@query("clip_shift", "SELECT media_id, segment_id, greatest(0, start_ms - 60000) AS start_ms, least(end_ms, 180000) - 60000 AS end_ms FROM segments WHERE end_ms > 60000 AND start_ms < 180000")
def _(src):
    return iv.clip_shift(src("segments"), 60_000, 120_000).select("media_id", "segment_id", "start_ms", "end_ms")


@query("restrict_window", """WITH c AS (SELECT media_id, segment_id, start_ms < 50000 OR end_ms > 250000 AS clipped, greatest(start_ms, 50000) AS start_ms, least(end_ms, 250000) AS end_ms FROM segments)
SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, end_ms, segment_id) AS index FROM c WHERE end_ms > start_ms""")
def _(src):
    return iv.restrict(src("segments"), 50_000, 250_000).select("media_id", "segment_id", "clipped", "start_ms", "end_ms", "index")


TICK_SQL = """WITH g AS (SELECT media_id, tick, regexp_replace(text, '\\s+', '', 'g') AS t, count(*) AS g FROM (SELECT media_id, text, unnest(range(CAST(greatest(0, ceil((start_ms - 250) / 500)) AS BIGINT), CAST(ceil((end_ms - 250) / 500) AS BIGINT))) AS tick FROM segments) GROUP BY ALL),
p AS (SELECT media_id, tick, regexp_replace(text, '\\s+', '', 'g') AS t, count(*) AS p FROM (SELECT media_id, text, unnest(range(CAST(greatest(0, ceil((start_ms - 250) / 500)) AS BIGINT), CAST(floor((end_ms - 250) / 500) AS BIGINT) + 1)) AS tick FROM ocr_events) GROUP BY ALL),
j AS (SELECT media_id, CASE WHEN t <> '' THEN least(coalesce(g, 0), coalesce(p, 0)) ELSE 0 END AS hit, coalesce(g, 0) AS g, coalesce(p, 0) AS p FROM g FULL OUTER JOIN p USING (media_id, tick, t)),
s AS (SELECT media_id, CAST(sum(hit) AS BIGINT) AS tp, CAST(sum(p - hit) AS BIGINT) AS fp, CAST(sum(g - hit) AS BIGINT) AS fn FROM j GROUP BY media_id)
"""


@query("tick_text_match", TICK_SQL + "SELECT * FROM s")
def _(src):
    return iv.tick_text_counts(src("segments"), src("ocr_events"))


@query("detection_text_f1", TICK_SQL + """, q AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM s)
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM q""")
def _(src):
    return ev.micro_prf(iv.tick_text_counts(src("segments"), src("ocr_events")), ["media_id"])


@query("expand_events", """WITH tf AS (SELECT media_id, max(end_ms // 40) + 1 AS total FROM segments GROUP BY media_id), e AS (SELECT media_id, segment_id, total, start_ms // 40 AS sf, end_ms // 40 AS ef FROM segments JOIN tf USING (media_id)), x AS (SELECT *, greatest(0, sf - 5) AS start_frame, greatest(greatest(0, sf - 5), least(total - 1, ef + 8)) AS end_frame FROM e)
SELECT media_id, segment_id, start_frame, end_frame, start_frame / 25.0::DOUBLE AS start_sec, end_frame / 25.0::DOUBLE AS end_sec FROM x""")
def _(src):
    events = src("segments").select("media_id", "segment_id", F.floor(F.col("start_ms") / 40).alias("start_frame"), F.floor(F.col("end_ms") / 40).alias("end_frame"))
    events = events.join(events.groupBy("media_id").agg((F.max("end_frame") + 1).alias("total_frames")), "media_id")
    return iv.expand_events(events, 5, 8, 25.0).drop("total_frames")


def DER(extra_zone: str) -> str:
    return f"""WITH fr AS (SELECT media_id, 'r' AS side, speaker_label AS spk, greatest(0, CAST(round_even(start_ms / 10, 0) AS BIGINT)) AS s, CAST(round_even(end_ms / 10, 0) AS BIGINT) AS e FROM segments
  UNION ALL SELECT media_id, 'h', speaker, greatest(0, CAST(round_even(start_ms / 10, 0) AS BIGINT)), CAST(round_even(end_ms / 10, 0) AS BIGINT) FROM turns),
zone AS ({extra_zone}),
pts AS (SELECT DISTINCT media_id, t FROM (SELECT media_id, s AS t FROM fr WHERE e > s UNION ALL SELECT media_id, e FROM fr WHERE e > s UNION ALL SELECT media_id, zs FROM zone UNION ALL SELECT media_id, ze FROM zone)),
el AS (SELECT * FROM (SELECT media_id, t AS a, lead(t) OVER (PARTITION BY media_id ORDER BY t) AS b FROM pts) WHERE b IS NOT NULL AND media_id IN (SELECT media_id FROM segments)),
ok AS (SELECT * FROM el WHERE NOT EXISTS (SELECT 1 FROM zone z WHERE z.media_id = el.media_id AND z.zs <= el.a AND z.ze >= el.b)),
act AS (SELECT DISTINCT ok.media_id, a, b, side, spk FROM ok JOIN fr ON fr.media_id = ok.media_id AND fr.s <= a AND fr.e >= b),
n AS (SELECT media_id, a, b, count(*) FILTER (side = 'r') AS nr, count(*) FILTER (side = 'h') AS nh FROM act GROUP BY ALL),
tot AS (SELECT media_id, CAST(sum(greatest(0, nr - nh) * (b - a)) AS BIGINT) AS miss, CAST(sum(greatest(0, nh - nr) * (b - a)) AS BIGINT) AS false_alarm, CAST(sum(least(nr, nh) * (b - a)) AS BIGINT) AS bo, CAST(sum(nr * (b - a)) AS BIGINT) AS ref_speech FROM n GROUP BY media_id),
ov AS (SELECT x.media_id, x.spk AS r, y.spk AS h, sum(x.b - x.a) AS shared FROM act x JOIN act y ON x.media_id = y.media_id AND x.a = y.a AND x.side = 'r' AND y.side = 'h' GROUP BY ALL),
o1 AS (SELECT * FROM ov WHERE r = 'SPEAKER_00' UNION ALL SELECT media_id, 'SPEAKER_00', 'none1', 0 FROM tot), o2 AS (SELECT * FROM ov WHERE r = 'SPEAKER_01' UNION ALL SELECT media_id, 'SPEAKER_01', 'none2', 0 FROM tot), o3 AS (SELECT * FROM ov WHERE r = 'SPEAKER_02' UNION ALL SELECT media_id, 'SPEAKER_02', 'none3', 0 FROM tot),
asg AS (SELECT o1.media_id, CAST(max(o1.shared + o2.shared + o3.shared) AS BIGINT) AS correct FROM o1 JOIN o2 USING (media_id) JOIN o3 USING (media_id) WHERE o1.h <> o2.h AND o1.h <> o3.h AND o2.h <> o3.h GROUP BY o1.media_id)
SELECT media_id, miss, false_alarm, ref_speech, bo - coalesce(correct, 0) AS confusion, CASE WHEN ref_speech > 0 THEN (miss + false_alarm + bo - coalesce(correct, 0)) / ref_speech END AS der FROM tot LEFT JOIN asg USING (media_id)"""


def _turn_sides(src):
    return src("segments").select("media_id", "start_ms", "end_ms", F.col("speaker_label").alias("speaker")), src("turns")


@query("diarization_error", DER("SELECT 0 AS media_id, 0 AS zs, 0 AS ze WHERE false"))
def _(src):
    return iv.diarization_error(*_turn_sides(src))


@query("diarization_error_collar", DER("""SELECT media_id, greatest(0, CAST(round_even(t / 10, 0) AS BIGINT) - 25) AS zs, CAST(round_even(t / 10, 0) AS BIGINT) + 26 AS ze FROM (SELECT media_id, start_ms AS t FROM segments UNION ALL SELECT media_id, end_ms FROM segments)"""))
def _(src):
    return iv.diarization_error(*_turn_sides(src), collar_ms=250)
