"""Helpers shared by the operators: table reads, the held-out rule, Arrow maps over (id, text) rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.session import shared_dir

__all__ = ["cut_lineage", "drop_table", "id_text", "is_held_out", "keep_texts", "map_texts", "read_table", "rows_of", "small_side", "text_bytes"]


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cut_lineage(df: DataFrame, max_rows_per_file: int = 0) -> DataFrame:
    """The rows as a table written to the shared folder and read again: what is read twice is computed once, and a lost executor costs a read.

    Tables stay until the folder that `spark.checkpoint.dir` names is cleared.  Tables of long rows take few rows a file, since a reader
    holds a batch of up to 4,096 rows of one file at once.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4()}"
    df.write.option("maxRecordsPerFile", max_rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(*tables: DataFrame) -> None:
    """Delete what `cut_lineage` wrote for these tables, once nothing reads it any more."""
    for df in tables:
        session = df.sparkSession
        for file in df.inputFiles()[:1]:
            folder = session._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if folder.getName().startswith("table-"):
                folder.getFileSystem(session._jsc.hadoopConfiguration()).delete(folder, True)


#: Rows of two or three numbers that may be broadcast: some 32 MB.
BROADCAST_ROWS = 1 << 20


def small_side(df: DataFrame) -> DataFrame:
    """The side of a join, marked for broadcast if it has at most `BROADCAST_ROWS` rows (of a few numbers each), else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def is_held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 on division by 3; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (as `doc_id` long) and the text's UTF-8 bytes (as `text`, null stays null): other columns, whatever their names, do not travel."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(id, UTF-8 bytes or None) of a batch, one text at a time, so no second copy of the batch is made."""
    ids = batch.column(0).to_pylist()
    texts = batch.column(1)
    for i, doc in enumerate(ids):
        yield doc, texts[i].as_py()


def text_bytes(value: bytes | None) -> bytes:
    return value if value is not None else b""


def map_texts(docs: DataFrame, each: Callable, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Run `each()` once per task to get a function (id, bytes or None) -> tuple of the schema's values, and apply it to every row.

    Rows leave in batches of at most 1,000 to bound the worker's memory.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        row = each()
        for batch in batches:
            out = []
            for doc, text in rows_of(batch):
                out.append(row(doc, text))
                if len(out) == 1000:
                    yield _batch(out, arrow)
                    out = []
            if out:
                yield _batch(out, arrow)

    return id_text(docs, id_col, text_col).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def keep_texts(docs: DataFrame, each: Callable, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text's bytes (or None) the function made by `each()` in every task accepts."""

    def run(batches):
        accept = each()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary())
            yield batch.filter(pa.array([accept(t.as_py()) for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
