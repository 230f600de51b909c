"""Text and table sinks.  Rows stay rows: a media's file is written by `partitionBy`, never gathered into one value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.functions import text as tx
from cueloom.operators import sequence as seq


def srt_blocks(segments: DataFrame, personas: DataFrame | None = None, prefix: bool = True) -> DataFrame:
    """(media_id, index, value): one SRT block per segment, numbered in time order, with the speaker or persona name."""
    rows = seq.positions(segments, ["media_id"], ["start_ms", "end_ms", "segment_id"], seq.time_slot(), "index").withColumn("index", F.col("index") + 1)
    shown = F.col("speaker_label")
    if personas is not None:
        rows = rows.join(personas.select("media_id", "speaker_label", F.col("name").alias("_name")), ["media_id", "speaker_label"], "left")
        shown = F.coalesce("_name", "speaker_label")
    line = F.concat(F.lit("["), shown, F.lit("] "), F.col("text")) if prefix else F.col("text")
    block = F.concat_ws("\n", F.col("index").cast("string"), F.concat(tx.srt_time(F.col("start_ms")), F.lit(" --> "), tx.srt_time(F.col("end_ms"))), line, F.lit(""))
    return rows.select("media_id", "index", block.alias("value"))


def rttm_lines(turns: DataFrame) -> DataFrame:
    """(media_id, start_ms, value): one RTTM line per turn."""
    line = F.format_string("SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>", F.col("media_id").cast("string"), F.col("start_ms") / 1000.0, (F.col("end_ms") - F.col("start_ms")) / 1000.0, F.col("speaker"))
    return turns.select("media_id", "start_ms", line.alias("value"))


def write_text(rows: DataFrame, path: str, order: str) -> None:
    """One folder per media with its lines in order; a media larger than a task becomes several ordered part files."""
    (rows.repartitionByRange("media_id", order).sortWithinPartitions("media_id", order).select("media_id", "value")
     .write.mode("overwrite").partitionBy("media_id").text(path))


def write_table(df: DataFrame, path: str, by: list[str] | None = None, fmt: str = "parquet") -> None:
    """Reports and manifests: Parquet first, JSON rows for consumers that need them."""
    writer = df.write.mode("overwrite").format(fmt)
    (writer.partitionBy(*by) if by else writer).save(path)
