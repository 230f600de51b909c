"""Timeline fitting: anchors, available time, fit strategy, subtitle coverage and overlap resolution."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cueloom.functions.cols import flags, lookup
from cueloom.operators import sequence as seq
from cueloom.session import cut_lineage, small_side, spread

MEDIA = ["media_id"]

# fixed values (milliseconds, decibels, fractions)
SAFETY_MARGIN = 80
TRAILING_ROOM = 1_500
MAX_SHIFT = 1_500
MIN_COVERAGE = 0.5
OVERLAP_TOLERANCE = 50
LAYER_MAX = 5_000
LAYER_ABSOLUTE = 2_500
LAYER_RELATIVE = 0.9
LAYER_GAIN = {"failed": -5.0, "review": -3.0}
MAX_TRIM = 0.30

CLUSTER_ROWS = 4_096


def resolve_anchor(rows: DataFrame) -> DataFrame:
    """Dubbing window if valid, else the transcript window; reversed windows are swapped, empty ones ignored."""
    def window(prefix: str) -> tuple[Column, Column, Column]:
        a, b = F.col(f"{prefix}_start"), F.col(f"{prefix}_end")
        return F.least(a, b), F.greatest(a, b), a.isNotNull() & b.isNotNull() & (a != b)

    dub_lo, dub_hi, dub_ok = window("dub")
    sub_lo, sub_hi, sub_ok = window("sub")
    asr_lo, asr_hi, _ = window("asr")
    anchor_start, anchor_end = F.when(dub_ok, dub_lo).otherwise(asr_lo), F.when(dub_ok, dub_hi).otherwise(asr_hi)
    span = F.greatest(F.lit(0), anchor_end - anchor_start)
    return (
        rows.withColumn("anchor_start", anchor_start).withColumn("anchor_end", anchor_end)
        .withColumn("source_ms", F.when(span > 0, span).otherwise(F.col("fallback_ms")))
        .withColumn("anchor_source", F.when(dub_ok, "dubbing_window").otherwise("asr_window"))
        .withColumn("subtitle_start", F.when(sub_ok, sub_lo)).withColumn("subtitle_end", F.when(sub_ok, sub_hi))
    )


def available_time(items: DataFrame, total_ms: Column) -> DataFrame:
    """Own slot plus the pause before the next line, less a safety margin; the last line may run past its end."""
    ahead = seq.scan(items, MEDIA, ["anchor_start", "anchor_end", "segment_id"], seq.time_slot("anchor_start"),
                     {"_next": ("lead", F.col("anchor_start"))}).drop("_slot")
    nxt = F.coalesce("_next", F.col("anchor_end") + TRAILING_ROOM)
    nxt = F.when(total_ms > 0, F.least(nxt, total_ms)).otherwise(nxt)
    return ahead.withColumn(
        "available_ms", F.greatest(F.col("source_ms"), nxt - F.col("anchor_start") - SAFETY_MARGIN)).drop("_next")


def fit_strategy(conservative: bool = True, max_compress: float = 1.45) -> Column:
    source, gen = F.col("source_ms"), F.col("generated_ms")
    room = F.coalesce(F.nullif("available_ms", F.lit(0)), source)
    ratio, tempo = gen / source, gen / room
    stretch = (ratio >= 0.35) & (source <= 2_500) & F.col("subtitle_start").isNotNull() & F.col("subtitle_end").isNotNull()
    squeeze = F.lit(conservative) & (source <= 1_500) & (gen - room <= 750) & (tempo <= 1.75)
    return (
        F.when((source <= 0) | (gen <= 0), "invalid_duration")
        .when(ratio < (0.60 if conservative else 0.55), F.when(stretch, "stretch").otherwise("underflow_unfitted"))
        .when(ratio < 0.85, "pad").when(gen <= room + 1, "direct").when(tempo <= max_compress, "compress")
        .when(squeeze, "compress").otherwise("overflow_unfitted")
    )


def placement_start() -> Column:
    shift = F.col("anchor_start") - F.col("subtitle_start")
    return F.when((shift > 0) & (shift <= MAX_SHIFT), F.greatest(F.lit(0), F.col("subtitle_start"))).otherwise(F.col("anchor_start"))


def subtitle_coverage(rows: DataFrame) -> DataFrame:
    """Share of the subtitle window covered by the placed audio, with notes."""
    has_window = F.col("subtitle_start").isNotNull() & F.col("subtitle_end").isNotNull()
    rendered = F.col("mix_status").isin("placed", "placed_overlap")
    length = F.greatest(F.lit(1), F.col("subtitle_end") - F.col("subtitle_start"))
    overlap = F.greatest(F.lit(0), F.least("subtitle_end", "placement_end") - F.greatest("subtitle_start", "placement_start"))
    ratio = F.when(rendered, F.coalesce(F.least(F.lit(1.0), overlap / length), F.lit(0.0))).otherwise(0.0)
    return rows.withColumn("coverage", F.when(has_window, ratio)).withColumn(
        "notes", F.when(has_window, flags(
            (~rendered, "subtitle_window_not_rendered"), (F.col("coverage") <= 0, "subtitle_window_not_covered"),
            ((F.col("coverage") > 0) & (F.col("coverage") < MIN_COVERAGE), "subtitle_window_low_coverage"),
        )).otherwise(F.array().cast("array<string>")))


def quality_score() -> Column:
    weight = F.coalesce(lookup(F.col("overall_status"), {"passed": 2.0, "review": 1.0}), F.lit(0.0))
    ratio = F.when(F.col("source_ms") > 0, F.col("generated_ms") / F.col("source_ms")).otherwise(0.0)
    return (
        weight + F.greatest(F.lit(0.0), F.coalesce("text_similarity", F.lit(0.0)))
        + F.greatest(F.lit(0.0), F.coalesce("speaker_similarity", F.lit(0.0))) * 0.5
        + F.greatest(F.lit(0.0), 1.0 - F.abs(1.0 - ratio)) * 0.25
    )


def overlap_slots(rows: DataFrame, width_ms: int) -> DataFrame:
    """(media, `_slot`, `_group`, `_base`): `_group` is the first of the slots that placements link, `_base` counts the rows before the slot.

    A slot is linked to those before it if a placement that starts in one of them reaches into it beyond the tolerance.
    """
    def begin(slot: Column) -> Column:  # division rounds towards zero: slot 0 is twice as long
        return F.when(slot > 0, slot * width_ms).otherwise((slot - 1) * width_ms + 1)

    slot, order = F.col("_slot"), Window.partitionBy(*MEDIA).orderBy("_slot")
    earlier, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    slots = rows.groupBy(*MEDIA, "_slot").agg(F.max("placement_end").alias("_end"), F.count("_slot").alias("_n"))
    reach = F.when(F.col("_end") - OVERLAP_TOLERANCE > begin(slot + 1), F.col("_end"))
    seen = slots.withColumns({"_reach": F.max(reach).over(earlier), "_base": F.coalesce(F.sum("_n").over(earlier), F.lit(0))})
    apart = F.coalesce(F.col("_reach") - OVERLAP_TOLERANCE <= begin(slot), F.lit(True))
    return seen.withColumn("_group", F.last(F.when(apart, slot), ignorenulls=True).over(upto)).select(*MEDIA, "_slot", "_group", "_base")


def overlap_clusters(items: DataFrame, width_ms: int = seq.SLOT_MS, ranked: bool = True) -> DataFrame:
    """Items whose placements touch (beyond the tolerance) share a cluster; different clusters never conflict.  `opens` marks a cluster's first row, `alone` clusters of one row.

    Linked slots of a media go to one task whole and in order, so the items are exchanged once; before that only a row a slot is.  `cluster` is the
    rank in its media of a cluster's first row; unless `ranked`, it is left out, and with it a join of one row a group.
    """
    rows = items.withColumn("_slot", F.expr(f"placement_start div {width_ms}"))
    slots = overlap_slots(rows, width_ms)
    linked = cut_lineage(slots.filter(F.col("_group") < F.col("_slot")).drop("_base"))
    known = rows.filter("media_id IS NOT NULL AND _slot IS NOT NULL")
    grouped = known.join(small_side(linked), [*MEDIA, "_slot"], "left").withColumn("_group", F.coalesce("_group", "_slot")).drop("_slot")
    inside = Window.partitionBy(*MEDIA, "_group").orderBy("placement_start", "placement_end", "segment_id")
    before = F.max("placement_end").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    placed = spread(grouped, *MEDIA, "_group").withColumn("opens", F.coalesce(F.col("placement_start") - before >= -OVERLAP_TOLERANCE, F.lit(True)))
    placed = placed.withColumn("alone", F.col("opens") & F.coalesce(F.lead("opens").over(inside), F.lit(True)))
    if not ranked:
        return placed.drop("_group")
    first = F.last(F.when(F.col("opens"), F.row_number().over(inside) - 1), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    groups = slots.filter(F.col("_group") == F.col("_slot")).select(*MEDIA, "_group", "_base")
    return placed.withColumn("cluster", first).join(groups, [*MEDIA, "_group"]).withColumn("cluster", F.col("cluster") + F.col("_base")).drop("_group", "_base")


RESOLVED = T.StructType([
    T.StructField("media_id", T.LongType()), T.StructField("segment_id", T.StringType()),
    T.StructField("mix_status", T.StringType()), T.StructField("placement_start", T.LongType()),
    T.StructField("placement_end", T.LongType()), T.StructField("gain_db", T.DoubleType()),
])


def _settle(bucket: pd.DataFrame) -> pd.DataFrame:
    """Resolve the overlap clusters of a frame in anchor order; earlier placements can be trimmed or replaced."""
    rows = bucket.sort_values(["cluster", "anchor_start", "anchor_end", "segment_id"]).to_dict("records")
    placed: list[dict] = []
    cluster = None
    for row in rows:
        row.update(status="placed", gain=0.0)

    def shared(a: dict, b: dict) -> int:
        return min(a["placement_end"], b["placement_end"]) - max(a["placement_start"], b["placement_start"])

    for row in rows:
        if row["cluster"] != cluster:
            cluster, placed = row["cluster"], []
        # placements ending before any later item can start are settled (a start moves at most MAX_SHIFT ahead of its anchor)
        placed = [p for p in placed if p["placement_end"] > row["anchor_start"] - MAX_SHIFT]
        clash = [p for p in placed if shared(row, p) > OVERLAP_TOLERANCE]
        if not clash:
            placed.append(row)
            continue
        owners = any(p["has_window"] for p in clash)
        allowed = max(LAYER_ABSOLUTE, min(row["fitted_ms"], row["source_ms"]) * LAYER_RELATIVE)
        layer = ((row["has_window"] or owners) and 0 < row["fitted_ms"] <= LAYER_MAX and len(clash) <= 2
                 and max(shared(row, p) for p in clash) <= allowed)
        cut = row["placement_start"] - OVERLAP_TOLERANCE
        kept = [cut - p["placement_start"] for p in clash]
        trim = all(k > 0 and (p["fitted_ms"] - k) <= MAX_TRIM * p["fitted_ms"] for k, p in zip(kept, clash))
        preserved = not row["has_window"] and owners
        if not preserved and trim:
            for p, k in zip(clash, kept):
                p["placement_end"], p["fitted_ms"] = cut, k
            placed.append(row)
        elif layer:
            row.update(status="placed_overlap", gain=LAYER_GAIN.get(row["overall_status"], -2.0))
            placed.append(row)
        elif not preserved and row["quality_score"] > max(p["quality_score"] for p in clash) + 0.05:
            for p in clash:
                p["status"] = "skipped_overlap"
                placed.remove(p)
            placed.append(row)
        else:
            row["status"] = "skipped_overlap"
    return pd.DataFrame({
        "media_id": [r["media_id"] for r in rows], "segment_id": [r["segment_id"] for r in rows],
        "mix_status": [r["status"] for r in rows], "placement_start": [r["placement_start"] for r in rows],
        "placement_end": [r["placement_end"] for r in rows], "gain_db": [r["gain"] for r in rows]})


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Clusters in stream order: rows alone pass as they are, the others are settled in frames of some `CLUSTER_ROWS` rows and whole clusters."""
    names = [f.name for f in RESOLVED]
    kinds = to_arrow_schema(RESOLVED)

    def settle(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        frame = pa.Table.from_batches(parts).to_pandas()
        return pa.RecordBatch.from_pandas(_settle(frame.assign(cluster=frame["opens"].cumsum())), schema=kinds, preserve_index=False)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        alone = batch.column("alone")
        single, crowd = batch.filter(alone), batch.filter(pc.invert(alone))
        given = {"mix_status": pa.array(["placed"] * len(single), pa.string()), "gain_db": pa.array(np.zeros(len(single)))}
        yield pa.RecordBatch.from_arrays([given[n] if n in given else single.column(n) for n in names], schema=kinds)
        first = np.flatnonzero(crowd.column("opens").to_numpy(zero_copy_only=False))
        if len(first) and sum(map(len, held)) + first[-1] >= CLUSTER_ROWS:
            yield settle([*held, crowd.slice(0, first[-1])])
            held, crowd = [], crowd.slice(first[-1])
        if len(crowd):
            held.append(crowd)
    if held:
        yield settle(held)


def resolve_overlaps(items: DataFrame, width_ms: int = seq.SLOT_MS) -> DataFrame:
    """Keep, trim, layer, replace or skip conflicting placements.  Rows are exchanged once; a row alone in its cluster passes its task unchanged."""
    kinds = {f.name: f.dataType for f in RESOLVED}
    wanted = [*MEDIA, "segment_id", "anchor_start", "anchor_end", "placement_start", "placement_end", "fitted_ms", "source_ms", "has_window", "overall_status", "quality_score"]
    rows = items.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in wanted])
    return overlap_clusters(rows, width_ms, ranked=False).mapInArrow(_settled, RESOLVED)
