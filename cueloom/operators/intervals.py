"""Interval algebra on (media_id, start_ms, end_ms): overlap joins, best / nearest assignment, coverage, clipping, ticks.

Range conditions become equi joins on (media, time bucket): both sides are repeated for the buckets they touch, the exact
predicate is a residual filter, and a pair is kept only in the first bucket the two sides share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueloom.functions import text as tx
from cueloom.functions.cols import count_if, flags
from cueloom.operators import sequence as seq
from cueloom.session import cut_lineage, spread

MEDIA = ["media_id"]
BUCKET_MS = 30_000

# fixed values
NON_DIALOGUE = ("scene_text", "watermark", "title_card")


def _bucketed(df: DataFrame, prefix: str, bucket: int) -> DataFrame:
    low = F.floor(F.least("start_ms", "end_ms") / bucket).cast("long")
    high = F.floor(F.greatest("start_ms", "end_ms") / bucket).cast("long")
    renamed = df.select(*[F.col(c).alias(c if c == "media_id" else f"{prefix}{c}") for c in df.columns],
                        low.alias(f"{prefix}_b"), F.explode(F.sequence(low, high)).alias("_bucket"))
    return renamed


def touching(left: DataFrame, right: DataFrame, bucket: int = BUCKET_MS) -> DataFrame:
    """Pairs whose closed intervals touch, columns prefixed l_ / r_, plus `overlap` in ms (0 when they only touch)."""
    a, b = _bucketed(left, "l_", bucket), _bucketed(right, "r_", bucket)
    pairs = a.join(b, ["media_id", "_bucket"]).filter(F.col("_bucket") == F.greatest("l__b", "r__b"))
    overlap = F.least("l_end_ms", "r_end_ms") - F.greatest("l_start_ms", "r_start_ms")
    return pairs.withColumn("overlap", overlap).filter("overlap >= 0").drop("_bucket", "l__b", "r__b")


def overlap_join(left: DataFrame, right: DataFrame, bucket: int = BUCKET_MS) -> DataFrame:
    return touching(left, right, bucket).filter("overlap > 0")


def merge_touching(df: DataFrame, key: list[str], gap_ms: int = 0) -> DataFrame:
    """Union of intervals per key: rows closer than `gap_ms` to the running end become one."""
    return seq.gap_islands(df, key, ["start_ms", "end_ms"], seq.time_slot(), gap_ms).groupBy(*key, "island").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("island")


# ---- screen-text alignment ----------------------------------------------------------------------------------------


def dialogue_only(events: DataFrame) -> DataFrame:
    return events.filter(F.col("kind").isNull() | ~F.col("kind").isin(*NON_DIALOGUE))


def candidates(segments: DataFrame, events: DataFrame) -> DataFrame:
    """Events that overlap a segment, or whose midpoint lies in its closed window."""
    pairs = touching(segments, events)
    mid2 = F.col("r_start_ms") + F.col("r_end_ms")
    inside = (F.col("l_start_ms") * 2 <= mid2) & (mid2 <= F.col("l_end_ms") * 2)
    return pairs.withColumn("mid_inside", inside).filter((F.col("overlap") > 0) | F.col("mid_inside"))


def alignment(pairs: DataFrame) -> DataFrame:
    """Per segment: candidate count, summed overlap and min(1, overlap / segment, overlap / events) as the better of both."""
    out = pairs.groupBy("media_id", "l_segment_id").agg(
        F.count(F.lit(1)).alias("events"), F.sum("overlap").alias("overlap"),
        F.sum(F.col("r_end_ms") - F.col("r_start_ms")).alias("_o"), F.max(F.col("l_end_ms") - F.col("l_start_ms")).alias("_s"))
    score = F.greatest(F.col("overlap") / F.greatest(F.lit(1), F.col("_s")), F.col("overlap") / F.greatest(F.lit(1), F.col("_o")))
    return out.withColumn("score", F.least(F.lit(1.0), score)).withColumnRenamed("l_segment_id", "segment_id").drop("_o", "_s")


CORRECTED = "decision string, reason string, used array<bigint>, alignment double, quality double, ratio double, merged string, text string, arbitrated boolean, gone array<struct<id:bigint,e:bigint>>"


def correct(segments: DataFrame, events: DataFrame, verdicts: DataFrame | None = None, min_confidence: float = 0.85, min_alignment: float = 0.55,
            min_ratio: float = 0.5, max_ratio: float = 2.0, slot_rows: int = seq.FOLD_ROWS) -> DataFrame:
    """Decision per segment in time order; an event used for one segment is gone for the later ones.

    Where confident events fail on alignment or length, a verdict (media_id, segment_id, verdict, verdict_text) on the segment's text and the
    joined text of its free events may settle it, and one for the screen text uses the events up, too.  `used` are the free confident
    events of the segment whatever the decision; `similarity` compares their text with the segment's.

    Candidate pairs, overlaps and cleaned lengths are joined first.  The consumption order is a native fold in slots (`sequence.slot_fold`)
    that carries the used events still in reach; a row whose events no earlier row shares opens anew.
    """
    rows = seq.positions(segments.withColumn("chars", F.length(tx.clean(F.col("text")))), MEDIA, ["start_ms", "end_ms", "segment_id"], seq.time_slot())
    rows = cut_lineage(rows.select("media_id", "segment_id", "pos", "start_ms", "end_ms", "text", "chars"))
    lean = dialogue_only(events).select("media_id", "event_id", "start_ms", "end_ms", "confidence", "text", F.length(tx.clean(F.col("text"))).alias("chars"))
    pairs = candidates(rows.select("media_id", "segment_id", "start_ms", "end_ms", "pos"), lean)
    event = F.struct(F.col("r_start_ms").alias("s"), F.col("r_end_ms").alias("e"), F.col("r_event_id").cast("bigint").alias("id"), "overlap", F.col("r_confidence").cast("double").alias("conf"), F.col("r_chars").alias("chars"), F.coalesce("r_text", F.lit("")).alias("text"))
    pairs = cut_lineage(pairs.select("media_id", F.col("l_pos").alias("pos"), event.alias("event")))
    listed = pairs.groupBy("media_id", "pos").agg(F.array_sort(F.collect_list("event")).alias("events"))
    shared = pairs.groupBy("media_id", F.col("event.id").alias("id")).agg(F.min("pos").alias("pos"), F.max("pos").alias("last")).groupBy("media_id", "pos").agg(F.max("last").alias("last"))
    work = rows.join(listed, ["media_id", "pos"], "left").join(shared, ["media_id", "pos"], "left")
    if verdicts is None:
        work = work.withColumns({"verdict": F.lit(None).cast("string"), "verdict_text": F.lit(None).cast("string")})
    else:
        work = work.join(verdicts.select("media_id", "segment_id", "verdict", "verdict_text"), ["media_id", "segment_id"], "left")
    work = seq.prefix(work, MEDIA, {"_reach": ("max_before", F.col("last"))}).withColumn("opens", F.coalesce(F.col("_reach") < F.col("pos"), F.lit(True)))
    work = work.withColumn("events", F.coalesce("events", F.array().cast(work.schema["events"].dataType)))

    def step(state: Column, r: Column) -> Column:
        gone = F.coalesce(F.transform(state["gone"], lambda g: g["id"]), F.array().cast("array<bigint>"))
        free = F.filter(r["events"], lambda e: ~F.array_contains(gone, e["id"]))
        return _let(_let(free, lambda f: F.struct(F.filter(f, lambda e: e["conf"] >= min_confidence).alias("strong"), (F.size(f) > 0).alias("some"))), lambda f: _let(_facts(f["strong"], r), lambda m: decide(state, r, f, m)))

    def _facts(strong: Column, r: Column) -> Column:
        def total(of):
            return F.aggregate(strong, F.lit(0).cast("long"), lambda s, e: s + of(e))

        overlap, chars = total(lambda e: e["overlap"]), total(lambda e: e["chars"])
        aligned = F.least(F.lit(1.0), F.greatest(overlap / F.greatest(F.lit(1), r["end_ms"] - r["start_ms"]), overlap / F.greatest(F.lit(1), total(lambda e: e["e"] - e["s"]))))
        ratio = F.when(r["chars"] > 0, chars / r["chars"]).when(chars == 0, 1.0)
        merged = F.array_join(F.transform(strong, lambda e: e["text"]), "")
        sure = F.aggregate(strong, F.lit(0.0), lambda s, e: s + e["conf"]) / F.size(strong)
        some = F.size(strong) > 0
        return F.struct(F.when(some, F.round(aligned, 3)).otherwise(0.0).alias("alignment"), F.when(some, F.round(sure, 3)).otherwise(0.0).alias("quality"), F.when(~some | (merged == ""), 0.0).otherwise(ratio).alias("ratio"), merged.alias("merged"))

    def decide(state: Column, r: Column, f: Column, m: Column) -> Column:
        strong, some = f["strong"], F.size(f["strong"]) > 0
        own = F.coalesce(r["text"], F.lit(""))
        replace = F.coalesce(some & (m["alignment"] >= min_alignment) & m["ratio"].between(min_ratio, max_ratio), F.lit(False))
        verdict = F.when(some & ~replace, tx.arbitrate(r["verdict"], r["verdict_text"], own, m["merged"]))

        def settle(v: Column) -> Column:
            decision = F.when(replace, F.when(F.size(strong) > 1, "merge_ocr").otherwise("use_ocr")).when(~some, "use_asr").otherwise(F.coalesce(v["decision"], F.lit("review")))
            reason = F.when(~some & f["some"], "low_ocr_confidence").when(~some, "no_ocr_candidate").when(~replace & v.isNull(), "weak_alignment_or_length_mismatch")
            text = F.when(replace, m["merged"]).when(v.isNotNull(), v["text"]).otherwise(own)
            taken = F.coalesce(replace | v["decision"].isin("llm_use_ocr", "llm_merge"), F.lit(False))
            held = F.filter(F.coalesce(state["gone"], F.array().cast("array<struct<id:bigint,e:bigint>>")), lambda g: g["e"] >= r["start_ms"])
            return F.struct(decision.alias("decision"), reason.alias("reason"), F.transform(strong, lambda e: e["id"]).alias("used"), m["alignment"].alias("alignment"), m["quality"].alias("quality"), m["ratio"].alias("ratio"), m["merged"].alias("merged"),
                            text.alias("text"), v.isNotNull().alias("arbitrated"), F.concat(held, F.when(taken, F.transform(strong, lambda e: F.struct(e["id"].alias("id"), e["e"].alias("e")))).otherwise(F.array().cast("array<struct<id:bigint,e:bigint>>"))).alias("gone"))

        return _let(verdict, settle)

    folded = seq.slot_fold(work, MEDIA, ["start_ms", "end_ms", "text", "chars", "events", "verdict", "verdict_text"], CORRECTED, step, slot_rows)
    out = folded.join(rows.select("media_id", "pos", "segment_id", F.col("text").alias("original_text")), ["media_id", "pos"])
    similar = F.when(F.col("merged") == "", 0.0).otherwise(F.round(tx.multiset_similarity(F.coalesce("original_text", F.lit("")), F.col("merged")), 3))
    return out.withColumn("similarity", similar).withColumn("needs_review", F.col("decision") == "review").drop("gone", "pos")


def _let(value: Column, then) -> Column:
    return F.transform(F.array(value), then)[0]


def correction_summary(decisions: DataFrame, ocr_only: DataFrame) -> DataFrame:
    d = F.col("decision")
    out = decisions.groupBy("media_id").agg(
        F.count(F.lit(1)).alias("segments"), count_if(d.isin("use_ocr", "merge_ocr", "llm_use_ocr", "llm_merge")).alias("corrected"), count_if(d.isin("use_asr", "llm_use_asr")).alias("kept"),
        count_if(d == "review").alias("review"), count_if(F.col("arbitrated")).alias("arbitrated"))
    extra = ocr_only.groupBy("media_id").agg(F.count(F.lit(1)).alias("ocr_only"))
    return out.join(extra, "media_id", "left").fillna(0, ["ocr_only"]).withColumn("correction_rate", F.col("corrected") / F.col("segments")).withColumn(
        "review_rate", F.col("review") / F.col("segments"))


def unmatched_events(segments: DataFrame, events: DataFrame, used: DataFrame, min_confidence: float = 0.85) -> DataFrame:
    """Confident events used by nothing whose midpoint lies in no segment window."""
    pairs = candidates(segments.select("media_id", "segment_id", "start_ms", "end_ms"), events.select("media_id", "event_id", "start_ms", "end_ms"))
    covered = pairs.filter("mid_inside").select("media_id", F.col("r_event_id").alias("event_id")).distinct()
    return (events.filter(F.col("confidence") >= min_confidence).join(used.select("media_id", "event_id").distinct(), ["media_id", "event_id"], "left_anti")
            .join(covered, ["media_id", "event_id"], "left_anti"))


def timing_policy(pairs: DataFrame, lead_ms: int = 600, lag_ms: int = 800) -> DataFrame:
    """Dubbing window of a replaced segment: a late subtitle pulls the start, a long one extends the end."""
    out = pairs.groupBy("media_id", F.col("l_segment_id").alias("segment_id")).agg(
        F.min("l_start_ms").alias("s"), F.max("l_end_ms").alias("e"), F.min("r_start_ms").alias("os"), F.max("r_end_ms").alias("oe"))
    late, longer = F.col("os") - F.col("s") > lead_ms, F.col("oe") - F.col("e") > lag_ms
    start = F.when(late, F.greatest(F.col("s"), F.col("os") - lead_ms)).otherwise(F.col("s"))
    end = F.greatest("oe", "e")
    clamped = end <= start
    policy = F.when(late & longer, "late_ocr_anchor+ocr_extended_anchor").when(late, "late_ocr_anchor").when(longer, "ocr_extended_anchor").otherwise("asr_anchor")
    return out.select(
        "media_id", "segment_id", F.col("os").alias("subtitle_start"), F.col("oe").alias("subtitle_end"), start.alias("dubbing_start"),
        F.when(clamped, F.greatest(start + 1, F.col("oe"), F.col("e"))).otherwise(end).alias("dubbing_end"), policy.alias("policy"),
        flags((late, "asr_start_precedes_ocr_window"), (longer, "ocr_window_extends_after_asr"), (clamped, "dubbing_window_clamped")).alias("warnings"))


# ---- best and nearest interval ------------------------------------------------------------------------------------


def best_overlap(segments: DataFrame, turns: DataFrame, label: str) -> DataFrame:
    """Label of the turn with the largest positive overlap per segment; the earliest turn wins ties."""
    pairs = overlap_join(segments.select("media_id", "segment_id", "start_ms", "end_ms"), turns.select("media_id", "turn_id", "start_ms", "end_ms", label))
    return pairs.groupBy("media_id", F.col("l_segment_id").alias("segment_id")).agg(
        F.max_by(f"r_{label}", F.struct("overlap", -F.col("r_start_ms"), -F.col("r_end_ms"), -F.col("r_turn_id"))).alias(label), F.max("overlap").alias("overlap"))


def _latest_before(segments: DataFrame, turns: DataFrame, label: str, backwards: bool) -> DataFrame:
    """As-of probe: the turn ending last strictly before each segment (or starting first strictly after it)."""
    sign = -1 if backwards else 1
    probe = F.col("end_ms") * sign if backwards else F.col("start_ms")
    edge = F.col("start_ms") * sign if backwards else F.col("end_ms")
    mid2 = F.col("start_ms") + F.col("end_ms")
    rows = segments.select("media_id", probe.alias("t"), F.lit(0).alias("kind"), F.col("segment_id").alias("id"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("ord"),
                           F.lit(None).cast("string").alias("label")).unionByName(
        turns.select("media_id", edge.alias("t"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("id"), (-F.col("start_ms")).alias("s"), (-F.col("turn_id")).alias("ord"), F.col(label).alias("label")))
    seen = F.when(F.col("kind") == 1, F.struct("t", "s", "ord", "label"))
    found = seq.scan(rows, MEDIA, ["t", "kind", "s", "ord", "id"], seq.time_slot("t"), {"_hit": ("last_before", seen)}).filter("kind = 0 AND _hit IS NOT NULL")
    return found.select("media_id", F.col("id").alias("segment_id"), (F.col("t") - F.col("_hit.t")).alias("gap2"), F.col("_hit.s").alias("s"), F.col("_hit.ord").alias("ord"), F.col("_hit.label").alias("label")).withColumn(
        "gap2", F.col("gap2") * 2)


def assign_labels(segments: DataFrame, turns: DataFrame, label: str, fallback: str = "SPEAKER_00") -> DataFrame:
    """Largest overlap; else the nearest turn by gap (touching turns compare midpoints); else the fallback label."""
    best = best_overlap(segments, turns, label)
    lonely = segments.join(best.select("media_id", "segment_id"), ["media_id", "segment_id"], "left_anti")
    touch = touching(lonely.select("media_id", "segment_id", "start_ms", "end_ms"), turns.select("media_id", "turn_id", "start_ms", "end_ms", label)).select(
        "media_id", F.col("l_segment_id").alias("segment_id"), F.abs(F.col("l_start_ms") + F.col("l_end_ms") - F.col("r_start_ms") - F.col("r_end_ms")).alias("gap2"),
        (-F.col("r_start_ms")).alias("s"), (-F.col("r_turn_id")).alias("ord"), F.col(f"r_{label}").alias("label"))
    near = _latest_before(lonely, turns, label, False).unionByName(_latest_before(lonely, turns, label, True)).unionByName(touch)
    nearest = near.groupBy("media_id", "segment_id").agg(F.max_by("label", F.struct(-F.col("gap2"), "s", "ord")).alias(label))
    chosen = best.select("media_id", "segment_id", label).unionByName(nearest.select("media_id", "segment_id", label))
    return segments.select("media_id", "segment_id").join(chosen, ["media_id", "segment_id"], "left").withColumn(label, F.coalesce(label, F.lit(fallback)))


# ---- coverage, clipping, ticks ------------------------------------------------------------------------------------


def covered_share(candidates_: DataFrame, existing: DataFrame) -> DataFrame:
    """Frames of each candidate covered by existing inclusive intervals (double coverage counts twice) over its length."""
    pairs = touching(candidates_.select("media_id", "cand_id", "start_ms", "end_ms"), existing.select("media_id", "start_ms", "end_ms"))
    sums = pairs.groupBy("media_id", F.col("l_cand_id").alias("cand_id")).agg(F.sum(F.col("overlap") + 1).alias("covered"))
    return candidates_.join(sums, ["media_id", "cand_id"], "left").withColumn("covered", F.coalesce("covered", F.lit(0))).withColumn(
        "share", F.col("covered") / F.greatest(F.lit(1), F.col("end_ms") - F.col("start_ms") + 1))


def near_existing(candidates_: DataFrame, existing: DataFrame, max_gap: int) -> DataFrame:
    """Candidates within `max_gap` of some existing interval."""
    padded = existing.select("media_id", (F.col("start_ms") - max_gap).alias("start_ms"), (F.col("end_ms") + max_gap).alias("end_ms"))
    hits = touching(candidates_.select("media_id", "cand_id", "start_ms", "end_ms"), padded).select("media_id", F.col("l_cand_id").alias("cand_id")).distinct()
    return candidates_.join(hits, ["media_id", "cand_id"], "left_semi")


def add_fallback(existing: DataFrame, candidates_: DataFrame, max_gap: int) -> DataFrame:
    """Existing intervals plus the candidates that are under half covered and near an existing one."""
    fresh = near_existing(covered_share(candidates_, existing).filter("share < 0.5"), existing, max_gap)
    return existing.select("media_id", "start_ms", "end_ms", F.lit("ocr").alias("source")).unionByName(
        fresh.select("media_id", "start_ms", "end_ms", F.lit("visual_fallback").alias("source")))


def clip_shift(rows: DataFrame, start: int, duration: int) -> DataFrame:
    """Keep what lies in [start, start + duration) and move it to zero."""
    end = start + duration
    kept = rows.filter((F.col("end_ms") > start) & (F.col("start_ms") < end))
    return kept.withColumn("start_ms", F.greatest(F.lit(0), F.col("start_ms") - start)).withColumn("end_ms", F.least(F.col("end_ms"), F.lit(end)) - start)


def restrict(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Clip to a window without moving it; empty rows drop and survivors are numbered again."""
    kept = rows.withColumn("clipped", (F.col("start_ms") < start) | (F.col("end_ms") > end)).withColumn(
        "start_ms", F.greatest(F.col("start_ms"), F.lit(start))).withColumn("end_ms", F.least(F.col("end_ms"), F.lit(end))).filter("end_ms > start_ms")
    return seq.positions(kept, MEDIA, ["start_ms", "end_ms", "segment_id"], seq.time_slot(), "index").withColumn("index", F.col("index") + 1)


def ticks(rows: DataFrame, step: int, closed_end: bool) -> DataFrame:
    """Sample instants t = step/2 + k*step active in [start, end) or [start, end], as tick numbers."""
    half = step // 2
    first = F.greatest(F.lit(0), F.ceil((F.col("start_ms") - half) / step)).cast("long")
    last = (F.floor((F.col("end_ms") - half) / step) if closed_end else F.ceil((F.col("end_ms") - half) / step) - 1).cast("long")
    return rows.withColumn("tick", F.explode(F.when(last >= first, F.sequence(first, last))))


def tick_text_counts(truth: DataFrame, pred: DataFrame, step: int = 500) -> DataFrame:
    """Multiset text matches per tick, summed per media; empty texts never match but still count."""
    def side(df: DataFrame, closed: bool, name: str) -> DataFrame:
        return ticks(df, step, closed).groupBy("media_id", "tick", F.regexp_replace("text", r"\s+", "").alias("t")).agg(F.count(F.lit(1)).alias(name))

    both = side(truth, False, "g").join(side(pred, True, "p"), ["media_id", "tick", "t"], "full_outer").fillna(0, ["g", "p"])
    hit = F.when(F.col("t") != "", F.least("g", "p")).otherwise(0)
    return both.groupBy("media_id").agg(F.sum(hit).alias("tp"), F.sum(F.col("p") - hit).alias("fp"), F.sum(F.col("g") - hit).alias("fn"))


def expand_events(events: DataFrame, lead: int, trail: int, fps: float) -> DataFrame:
    """Pad events by frames, clamp to the video, recompute seconds."""
    start = F.greatest(F.lit(0), F.col("start_frame") - lead)
    end = F.least(F.coalesce(F.col("total_frames") - 1, F.col("end_frame") + trail), F.col("end_frame") + trail)
    return events.withColumn("_s", start).withColumn("end_frame", F.greatest(F.col("_s"), end)).withColumn("start_frame", F.col("_s")).drop("_s").withColumn(
        "start_sec", F.col("start_frame") / fps).withColumn("end_sec", F.col("end_frame") / fps)


# ---- diarization error --------------------------------------------------------------------------------------------

ASSIGNED = T.StructType([T.StructField("media_id", T.LongType()), T.StructField("correct", T.LongType())])


def _assign(rows: pa.Table) -> pa.Table:
    """Largest total overlap of a one-to-one speaker mapping (speakers of one media, a small matrix)."""
    known = [(x, y, n) for x, y, n in zip(*(rows[c].to_pylist() for c in ("l_speaker", "r_speaker", "shared")), strict=True) if x is not None and y is not None]
    left, right = ({s: k for k, s in enumerate(dict.fromkeys(names))} for names in ([x for x, _, _ in known], [y for _, y, _ in known]))
    grid = np.zeros((len(left), len(right)), np.int64)
    for x, y, n in known:
        grid[left[x], right[y]] += n
    if grid.shape[0] > grid.shape[1]:
        grid = grid.T
    n, m = grid.shape
    cost = -grid.astype(float)
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], col = i, 0
        low, back, seen = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while match[col]:
            seen[col] = True
            row = match[col]
            gap = cost[row - 1] - u[row] - v[1:]
            better = ~seen[1:] & (gap < low[1:])
            low[1:][better], back[1:][better] = gap[better], col
            open_ = np.where(seen[1:], np.inf, low[1:])
            nxt = int(np.argmin(open_)) + 1
            step = open_[nxt - 1]
            u[match[seen]] += step
            v[seen] -= step
            low[~seen] -= step
            col = nxt
        while col:
            match[col] = match[back[col]]
            col = back[col]
    total = sum(int(grid[match[j] - 1, j - 1]) for j in range(1, m + 1) if match[j])
    return pa.table({"media_id": rows["media_id"][:1], "correct": pa.array([total], pa.int64())})


def _frames(turns: DataFrame, step: int) -> DataFrame:
    frame = turns.select("media_id", "speaker", F.greatest(F.lit(0), F.bround(F.col("start_ms") / step)).cast("long").alias("start_ms"),
                         F.bround(F.col("end_ms") / step).cast("long").alias("end_ms")).filter("end_ms > start_ms")
    return merge_touching(frame, ["media_id", "speaker"])


def diarization_error(ref: DataFrame, hyp: DataFrame, step: int = 10, collar_ms: int = 0, ignore_overlap: bool = False) -> DataFrame:
    """Missed, false-alarm and confused frames per media under the best one-to-one speaker mapping.

    No frame is materialised: speakers become disjoint frame intervals, the active-speaker counts are running sums over
    their boundaries, and unscored zones (collar, reference overlap) are a third kind of interval.
    """
    r = cut_lineage(_frames(ref, step))
    h = cut_lineage(_frames(hyp, step).join(r.select("media_id").distinct(), "media_id", "left_semi"))
    zones = None
    if collar_ms > 0:
        width = int(round(collar_ms / step))
        edges = ref.select("media_id", F.explode(F.array("start_ms", "end_ms")).alias("t"))
        at = F.bround(F.col("t") / step).cast("long")
        zones = edges.select("media_id", F.greatest(F.lit(0), at - width).alias("start_ms"), (at + width + 1).alias("end_ms"))
    if ignore_overlap:
        busy = _elementary(r.select("media_id", "start_ms", "end_ms", F.lit(1).alias("r"), F.lit(0).alias("h"), F.lit(0).alias("z"))).filter("nr > 1").select("media_id", "start_ms", "end_ms")
        zones = busy if zones is None else zones.unionByName(busy)
    if zones is not None:
        zones = cut_lineage(merge_touching(zones, MEDIA))
    sides = r.select("media_id", "start_ms", "end_ms", F.lit(1).alias("r"), F.lit(0).alias("h"), F.lit(0).alias("z")).unionByName(
        h.select("media_id", "start_ms", "end_ms", F.lit(0).alias("r"), F.lit(1).alias("h"), F.lit(0).alias("z")))
    if zones is not None:
        sides = sides.unionByName(zones.select("media_id", "start_ms", "end_ms", F.lit(0).alias("r"), F.lit(0).alias("h"), F.lit(1).alias("z")))
    scored = _elementary(sides).filter("nz = 0")
    length = F.col("end_ms") - F.col("start_ms")
    totals = scored.groupBy("media_id").agg(
        F.sum(F.greatest(F.lit(0), F.col("nr") - F.col("nh")) * length).alias("miss"),
        F.sum(F.greatest(F.lit(0), F.col("nh") - F.col("nr")) * length).alias("false_alarm"),
        F.sum(F.least("nr", "nh") * length).alias("_both"), F.sum(F.col("nr") * length).alias("ref_speech"))
    pairs = overlap_join(r, h, bucket=max(1, BUCKET_MS // step))
    shared = pairs.groupBy("media_id", "l_speaker", "r_speaker").agg(F.sum("overlap").alias("shared"))
    if zones is not None:
        spans = pairs.select("media_id", "l_speaker", "r_speaker", F.greatest("l_start_ms", "r_start_ms").alias("start_ms"), F.least("l_end_ms", "r_end_ms").alias("end_ms"))
        cut = overlap_join(spans, zones, bucket=max(1, BUCKET_MS // step)).groupBy(
            "media_id", F.col("l_l_speaker").alias("l_speaker"), F.col("l_r_speaker").alias("r_speaker")).agg(F.sum("overlap").alias("_cut"))
        shared = shared.join(cut, ["media_id", "l_speaker", "r_speaker"], "left").withColumn("shared", F.col("shared") - F.coalesce("_cut", F.lit(0))).drop("_cut")
    mapped = spread(shared, "media_id").groupBy("media_id").applyInArrow(_assign, ASSIGNED)
    out = totals.join(mapped, "media_id", "left").withColumn("confusion", F.col("_both") - F.coalesce("correct", F.lit(0))).drop("_both", "correct")
    errors = F.col("miss") + F.col("false_alarm") + F.col("confusion")
    return out.withColumn("der", F.when(F.col("ref_speech") > 0, errors / F.col("ref_speech")))


def _elementary(sides: DataFrame) -> DataFrame:
    """Pieces between consecutive boundaries with the number of active ref / hyp / zone intervals."""
    edges = sides.select("media_id", F.col("start_ms").alias("t"), "r", "h", "z").unionByName(
        sides.select("media_id", F.col("end_ms").alias("t"), (-F.col("r")).alias("r"), (-F.col("h")).alias("h"), (-F.col("z")).alias("z")))
    deltas = edges.groupBy("media_id", "t").agg(*[F.sum(c).alias(c) for c in ("r", "h", "z")])
    ahead = seq.scan(deltas, MEDIA, ["t"], seq.time_slot("t"), {
        "end_ms": ("lead", F.col("t")), **{f"n{c}": ("sum", F.col(c)) for c in ("r", "h", "z")}})
    return ahead.filter("end_ms IS NOT NULL").select("media_id", F.col("t").alias("start_ms"), "end_ms", "nr", "nh", "nz")
