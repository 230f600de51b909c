"""Corpus ingest: subtitle, RTTM, TextGrid, transcript, JSON, JSONL and manifest files to tables.

Each reader is a Spark text / JSON scan plus a parser that works on a plain DataFrame, so the same parser serves files,
tables and streams.  Whole-text reads hold one file per row; nothing is gathered across files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueloom.functions import text as tx
from cueloom.operators import sequence as seq

STRIP = r"^[\s\x{FEFF}]+|[\s\x{FEFF}]+$"


def media_of(path: Column) -> Column:
    """File stem as the media id."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]+)?$", 1)


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(media_id, value) with one row per file."""
    return spark.read.text(path, wholetext=True).select(media_of(F.col("_metadata.file_path")).alias("media_id"), "value")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(media_of(F.col("_metadata.file_path")).alias("media_id"), "value")


# ---- subtitles (SRT, WebVTT) ---------------------------------------------------------------------------------------


def parse_subtitles(docs: DataFrame) -> DataFrame:
    """Cues of whole SRT / WebVTT texts: blocks without a timing line and empty cues drop, survivors are numbered."""
    blocks = docs.select("media_id", F.posexplode(F.split(F.regexp_replace("value", STRIP, ""), r"\r?\n\s*\r?\n")).alias("block", "body"))
    lines = F.filter(F.transform(F.split("body", r"\r?\n"), lambda x: F.regexp_replace(x, STRIP, "")), lambda x: x != "")
    rows = blocks.withColumn("lines", lines).withColumn("at", F.array_position(F.transform("lines", lambda x: F.contains(x, F.lit("-->"))), True)).filter("at > 0")
    timing = F.element_at("lines", F.col("at").cast("int"))
    start, rest = F.substring_index(timing, "-->", 1), F.regexp_replace(F.regexp_extract(timing, r"-->(.*)$", 1), STRIP, "")
    raw = F.regexp_replace(F.array_join(F.slice("lines", F.col("at").cast("int") + 1, F.size("lines")), " "), STRIP, "")
    rows = rows.select("media_id", "block", tx.parse_timestamp_ms(start).alias("start_ms"), F.when(rest == "", tx.parse_timestamp_ms(start)).otherwise(
        tx.parse_timestamp_ms(F.split(rest, r"\s+")[0])).alias("end_ms"), raw.alias("raw"))
    prefix, voice = r"(?s)^\[([^\]]+)\]\s*(.*)$", r"(?s)^<v\s+([^>]+)>\s*(.*?)(?:</v>)?\s*$"
    label = F.coalesce(F.nullif(F.trim(F.regexp_extract("raw", prefix, 1)), F.lit("")), F.nullif(F.trim(F.regexp_extract("raw", voice, 1)), F.lit("")))
    text = F.when(F.col("raw").rlike(prefix), F.trim(F.regexp_extract("raw", prefix, 2))).when(F.col("raw").rlike(voice), F.trim(F.regexp_extract("raw", voice, 2))).otherwise(F.col("raw"))
    cues = rows.select("media_id", "block", "start_ms", F.greatest("start_ms", "end_ms").alias("end_ms"), label.alias("speaker_label"), text.alias("text")).filter("text <> ''")
    return seq.positions(cues, ["media_id"], ["block"], F.floor(F.col("block") / seq.BLOCK_ROWS), "index").withColumn("index", F.col("index") + 1).drop("block")


# ---- diarization and transcripts -----------------------------------------------------------------------------------


def parse_rttm(lines: DataFrame) -> DataFrame:
    """SPEAKER rows with eight or more fields and a positive duration; comments and malformed rows drop."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.filter(~F.trim("value").startswith(";;")).withColumn("p", parts).filter((F.size("p") >= 8) & (F.upper(F.col("p")[0]) == "SPEAKER"))
    start, dur = F.col("p")[3].try_cast("decimal(18,6)"), F.col("p")[4].try_cast("decimal(18,6)")
    return rows.select("media_id", F.round(start * 1000).cast("long").alias("start_ms"), F.round((start + dur) * 1000).cast("long").alias("end_ms"), F.col("p")[7].alias("speaker")).filter("end_ms > start_ms")


def _ms(number: Column) -> Column:
    return F.round(number.try_cast("decimal(18,6)") * 1000).cast("long")


def _value(text: str, key: str) -> Column:
    """What stands behind `key =`: a quoted string with its quotes, or a bare word; empty if the key is absent."""
    return F.regexp_extract(text, rf'\b{key}\s*=\s*("[^"\\]*+(?:\\.[^"\\]*+)*+"|\S+)', 1)


def _unquoted(value: Column) -> Column:
    return F.replace(F.when(F.startswith(value, F.lit('"')), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value), F.lit('\\"'), F.lit('"'))


def parse_textgrid(docs: DataFrame) -> DataFrame:
    """Non-empty intervals of every tier of long-form TextGrid texts (lines of `key = value` under `item [n]:` and `intervals [n]:`)."""
    tiers = docs.select("media_id", F.posexplode(F.split("value", r"item\s*\[\d+\]\s*:")).alias("tier_no", "body")).filter("tier_no > 0")
    name = F.when(_value("body", "name") == "", "speaker").otherwise(F.trim(_unquoted(_value("body", "name"))))
    rows = tiers.select("media_id", name.alias("speaker"), F.posexplode(F.split("body", r"intervals\s*\[\d+\]\s*:")).alias("no", "part")).filter("no > 0")
    return rows.select("media_id", _ms(_value("part", "xmin")).alias("start_ms"), _ms(_value("part", "xmax")).alias("end_ms"), "speaker",
                       F.regexp_replace(_unquoted(_value("part", "text")), STRIP, "").alias("text")).filter("text <> '' AND end_ms > start_ms")


TIME_MARK = r"\[\s*[0-9.]+\s*,\s*[0-9.]+\s*\]"


def parse_conversations(docs: DataFrame) -> DataFrame:
    """`[start,end] speaker [gender,dialect] text` transcripts: the attribute token drops, spaces in the text collapse.

    A turn reaches to the next complete time mark (two numbers and a comma in brackets); other brackets belong to the text.
    """
    turns = docs.select("media_id", F.explode(F.split("value", f"(?={TIME_MARK})")).alias("turn")).filter(F.col("turn").rlike(f"^{TIME_MARK}"))
    mark, tail = F.substring_index("turn", "]", 1), F.regexp_replace("turn", f"^{TIME_MARK}", "")
    times = F.split(F.regexp_replace(mark, r"[\[\s]", ""), ",")
    rows = turns.select("media_id", _ms(times[0]).alias("start_ms"), _ms(times[1]).alias("end_ms"), F.filter(F.split(tail, r"\s+"), lambda x: x != "").alias("w")).filter(F.size("w") >= 2)
    second = F.col("w")[1]
    attributed = F.substring(second, 1, 1).isin("男", "女") & F.locate(",", second).between(2, F.length(second) - 1)
    body = F.slice("w", F.when(attributed, 3).otherwise(2), F.size("w"))
    return rows.select("media_id", "start_ms", "end_ms", F.col("w")[0].alias("speaker"), F.array_join(body, "").alias("text")).filter("text <> '' AND end_ms > start_ms")


# ---- JSON payloads -------------------------------------------------------------------------------------------------

SEGMENT_ITEM = "id STRING, segment_id STRING, start DOUBLE, end DOUBLE, duration DOUBLE, text STRING, source_text STRING, speaker_label STRING, language STRING"
EVENT_ITEM = ("event_id STRING, id STRING, start DOUBLE, start_time DOUBLE, end DOUBLE, end_time DOUBLE, text STRING, confidence DOUBLE, kind STRING, "
              "box ARRAY<INT>, start_frame INT, end_frame INT")


def _items(docs: DataFrame, schema: str, *lists: str) -> DataFrame:
    parsed = docs.withColumn("_j", F.from_json("value", schema))
    return parsed.select("media_id", F.posexplode(F.coalesce(*[F.col(f"_j.{n}") for n in lists])).alias("at", "r"))


def _to_ms(seconds: Column) -> Column:
    return F.round(seconds * 1000).cast("long")


def parse_segments(docs: DataFrame) -> DataFrame:
    """`segments[]` payloads: raw rows for `speakers.normalise`."""
    r = _items(docs, f"segments ARRAY<STRUCT<{SEGMENT_ITEM}>>", "segments")
    return r.select(
        "media_id", F.coalesce(F.nullif("r.id", F.lit("")), "r.segment_id").alias("segment_id"), (F.col("at") + 1).alias("ord"), _to_ms(F.col("r.start")).alias("start_ms"), _to_ms(F.col("r.end")).alias("end_ms"),
        _to_ms(F.col("r.duration")).alias("dur_ms"), F.coalesce(F.nullif("r.text", F.lit("")), "r.source_text").alias("text"), F.col("r.speaker_label").alias("speaker_label"))


def parse_events(docs: DataFrame) -> DataFrame:
    """`events[]` or `results[]` payloads with key aliases; empty texts drop, reversed times swap, confidence defaults to 1."""
    r = _items(docs, f"events ARRAY<STRUCT<{EVENT_ITEM}>>, results ARRAY<STRUCT<{EVENT_ITEM}>>", "events", "results")
    start = F.coalesce("r.start", "r.start_time", F.lit(0.0))
    end = F.coalesce("r.end", "r.end_time", start)
    return r.select(
        "media_id", F.coalesce(F.nullif("r.event_id", F.lit("")), F.nullif("r.id", F.lit("")), F.format_string("evt-%04d", F.col("at") + 1)).alias("event_id"), _to_ms(F.least(start, end)).alias("start_ms"),
        _to_ms(F.greatest(start, end)).alias("end_ms"), F.trim("r.text").alias("text"), F.coalesce("r.confidence", F.lit(1.0)).alias("confidence"), F.col("r.kind").alias("kind")).filter("text <> ''")


def parse_glossary(docs: DataFrame) -> DataFrame:
    """One row per (entry, variant) with the target languages as a map; entries without a variant drop."""
    item = "entry_id STRING, source_variants ARRAY<STRING>, targets MAP<STRING, STRING>, normalized_source STRING"
    r = _items(docs, f"entries ARRAY<STRUCT<{item}>>", "entries")
    return r.select(F.coalesce("r.entry_id", F.format_string("term-%04d", F.col("at") + 1)).alias("entry_id"), F.explode("r.source_variants").alias("variant"), F.col("r.targets").alias("targets"),
                    F.col("r.normalized_source").alias("normalized_source")).withColumn("variant", F.trim("variant")).filter("variant <> ''")


def parse_manifest(docs: DataFrame, subset: str = "D", max_samples: int | None = None) -> DataFrame:
    """Corpus manifest entries with an id, audio, the subset tag and a reference; the first `max_samples` by id."""
    item = "sid STRING, audio STRING, subsets ARRAY<STRING>, text STRING, reference STRING"
    r = _items(docs, f"segments ARRAY<STRUCT<{item}>>", "segments").select("r.*")
    kept = r.filter((F.coalesce("sid", F.lit("")) != "") & (F.coalesce("audio", F.lit("")) != "") & F.array_contains("subsets", subset)).withColumn(
        "reference", F.coalesce(F.nullif("reference", F.lit("")), F.nullif("text", F.lit("")))).filter("reference IS NOT NULL")
    rows = kept.select(F.col("sid").alias("sample_id"), "audio", "reference")
    return rows if max_samples is None else rows.orderBy("sample_id").limit(max_samples)


def parse_jsonl(lines: DataFrame, schema: str, required: str) -> DataFrame:
    """Append-only JSON lines; unreadable lines and rows without the required field drop.  Works on streams as well."""
    return lines.select("media_id", F.from_json(F.trim("value"), schema, {"mode": "PERMISSIVE"}).alias("r")).select("media_id", "r.*").filter(F.col(required).isNotNull())


def pair_files(listing: DataFrame, media: tuple[str, ...], truth: dict[str, tuple[str, ...]]) -> DataFrame:
    """Media files joined to their sidecar truth files by directory and stem; missing kinds stay NULL."""
    stem = F.regexp_extract("path", r"^(.*?)(?:\.[^./]+)?$", 1)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    rows = listing.select("path", stem.alias("stem"), ext.alias("ext"))
    kinds = None
    for kind, extensions in truth.items():
        cond = F.col("ext").isin(*extensions)
        kinds = F.when(cond, kind) if kinds is None else kinds.when(cond, kind)
    side = rows.withColumn("kind", kinds).filter("kind IS NOT NULL").groupBy("stem").pivot("kind", list(truth)).agg(F.min("path"))
    return rows.filter(F.col("ext").isin(*media)).select("stem", F.col("path").alias("media_path")).join(side, "stem", "left")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Recursive listing without reading contents (the binary column is pruned)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def read_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """Stored relational tables (tasks, stages, jobs, artifacts, runs) of one folder."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, parts: int, **options: str) -> DataFrame:
    """The same tables from a database, read in `parts` ranges of a numeric column."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=parts, **options).load()


def run_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Stored runs, newest first, from partition folders `run_id=*`."""
    return spark.read.parquet(path).groupBy("run_id").agg(F.count(F.lit(1)).alias("results")).orderBy(F.desc("run_id"))


# ---- dataset registry ----------------------------------------------------------------------------------------------

DATASETS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "subtitles": lambda spark, path: parse_subtitles(read_whole(spark, path)),
    "rttm": lambda spark, path: parse_rttm(read_lines(spark, path)),
    "textgrid": lambda spark, path: parse_textgrid(read_whole(spark, path)),
    "conversation": lambda spark, path: parse_conversations(read_whole(spark, path)),
    "segments": lambda spark, path: parse_segments(read_whole(spark, path)),
    "ocr_events": lambda spark, path: parse_events(read_whole(spark, path)),
    "glossary": lambda spark, path: parse_glossary(read_whole(spark, path)),
    "manifest": lambda spark, path: parse_manifest(read_whole(spark, path)),
}


def register_dataset(name: str, load: Callable[[SparkSession, str], DataFrame]) -> None:
    DATASETS[name] = load


def load_dataset(spark: SparkSession, name: str, path: str) -> DataFrame:
    return DATASETS[name](spark, path)
