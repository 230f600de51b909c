"""Commentary plans: valid windows, narration per window, clip durations.  Times are integer milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.operators import sequence as seq

MEDIA = ["media_id"]
# fixed values
MIN_WINDOW_MS = 100
MIN_CLIP_MS = 500


def _seconds_to_ms(raw: Column) -> Column:
    return F.round(F.trim(raw).try_cast("decimal(18,6)") * 1000).cast("long")


def plan_windows(plan: DataFrame) -> DataFrame:
    """Planned windows as given (text seconds `src_start`, `src_end`, and `max_end_ms`, NULL or 0 for no limit), valid ones numbered by start.

    Unreadable bounds drop the window, a negative start counts as 0, the end is held to the limit, what is then shorter than
    a tenth of a second drops.  `item_id` counts from 1; windows with one start keep the plan's order.
    """
    start, end = F.greatest(F.lit(0), _seconds_to_ms(F.col("src_start"))), _seconds_to_ms(F.col("src_end"))
    rows = plan.filter(_seconds_to_ms(F.col("src_start")).isNotNull() & _seconds_to_ms(F.col("src_end")).isNotNull()).withColumn("start_ms", start).withColumn(
        "end_ms", F.when(F.col("max_end_ms") > 0, F.least(end, F.col("max_end_ms"))).otherwise(end))
    rows = rows.filter(F.col("end_ms") - F.col("start_ms") >= MIN_WINDOW_MS).withColumn("ost", F.when(F.col("ost") == 1, 1).otherwise(0)).withColumn("story_role", F.coalesce("story_role", F.lit("")))
    ranked = seq.positions(rows.select("media_id", "plan_id", "ord", "ost", "start_ms", "end_ms", "story_role"), MEDIA, ["start_ms", "ord"], seq.time_slot(), "_n")
    return ranked.withColumn("item_id", F.col("_n") + 1).drop("_n", "ord")


def merge_narration(windows: DataFrame, narration: DataFrame, chars_per_second: Column) -> DataFrame:
    """Windows with their narration and picture (the last entry of a plan id counts) and the estimated seconds.

    A window that keeps the original sound (`ost` 1) has no narration and lasts as long as it is.
    """
    last = narration.groupBy("media_id", "plan_id").agg(F.max_by(F.struct(F.trim(F.coalesce("narration", F.lit(""))).alias("n"), F.trim(F.coalesce("picture", F.lit(""))).alias("p")), "ord").alias("_e"))
    rows = windows.join(last, ["media_id", "plan_id"], "left").withColumn("picture", F.coalesce("_e.p", F.lit("")))
    rows = rows.withColumn("narration", F.when(F.col("ost") == 1, "").otherwise(F.coalesce("_e.n", F.lit(""))))
    spoken = F.when(F.col("narration") != "", F.round(F.length("narration") / chars_per_second, 2)).otherwise(0.0)
    return rows.withColumn("est_seconds", F.when(F.col("ost") == 1, (F.col("end_ms") - F.col("start_ms")) / 1000.0).otherwise(spoken)).drop("_e")


def plan_clips(items: DataFrame, narration_ms: DataFrame, sources: DataFrame) -> DataFrame:
    """Clips that can be cut: source taken and audio length per item, `index` counting the survivors of a media from 0.

    Items past the end of the source, or narrated ones without a measured narration, drop.
    """
    rows = items.join(sources, "media_id").join(narration_ms, ["media_id", "item_id"], "left").filter("start_ms < source_ms")
    window = F.least("end_ms", "source_ms") - F.col("start_ms")
    audio = F.when(F.col("ost") == 1, F.col("window")).when(F.col("narration_ms") > 0, F.greatest("narration_ms", F.lit(MIN_CLIP_MS)))
    rows = rows.withColumn("window", window).filter("window > 0").withColumn("av_ms", audio).filter("av_ms IS NOT NULL").withColumn("take_ms", F.least("av_ms", "window"))
    return seq.positions(rows.select("media_id", "item_id", "ost", "start_ms", "take_ms", "av_ms"), MEDIA, ["item_id"], seq.block_slot("item_id"), "index")
