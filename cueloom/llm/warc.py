"""WARC archives written index first and read back by coalesced byte ranges.

Which record a payload becomes is decided on (page, digest, size) rows only: digests are grouped before anything meets, and
pages join their decision by page.  Every batch of a task's rows is written as gzip members to a file of its own in the shared
folder (a retried task writes others; only the committed index names files that count), then its index rows leave, one per
record: file, offset, length, URL, digest.  Reading takes any selection of index rows, deals it by stretches of a file, sorts the offsets, and
reads neighbouring records, with gaps up to `gap`, in one go.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.llm.common import read_table
from cueloom.session import shared_dir

INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
LEAST = 1000


def decide(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, payload_digest, refers_to) of the pages that revisit another: distinct, so a join adds no rows."""
    narrow = pages.where(F.octet_length("payload") >= least).select("page_id", F.sha1("payload").alias("payload_digest"))
    met = narrow.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("low")).where("low < refers_to or low is null")
    return narrow.distinct().join(met.drop("low"), "payload_digest").where("page_id < refers_to").select("page_id", "payload_digest", "refers_to")


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record, compressed on its own.  A revisit carries the HTTP header, whose length is the full payload's, and no payload."""
    name = lambda page: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page}:{digest}')}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"Page-Refers-To: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=1, mtime=0)


def parse(member: bytes) -> tuple:
    """The record's values, taken from its own bytes."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(lines["Content-Length"])].partition(b"\r\n\r\n")
    kind = lines["WARC-Type"]
    if kind == "response":
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    else:
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        digest = base64.b32decode(lines["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    number = lambda key: int(lines[key]) if key in lines else None
    return number("Page-Id"), lines.get("WARC-Target-URI"), kind, number("Page-Refers-To"), size, digest, payload


def to_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, type=kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, date: str = "2000-01-01T00:00:00Z", file_bytes: int = 1 << 30) -> DataFrame:
    """Write the pages (page_id, url, html) under `folder` and return the index, itself a table in `folder`.

    Null html is an empty payload.  Among equal payloads of at least `least` bytes the largest page_id is the response (rows
    that repeat it are responses too), a null page_id or url is left out of the record.  Other columns are not read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    marked = rows.withColumn("payload_digest", F.sha1("payload")).join(decide(rows, least), ["page_id", "payload_digest"], "left")

    def write(batches):
        from pyarrow import fs

        place, top = fs.FileSystem.from_uri(folder)
        place.create_dir(top, recursive=True)
        for batch in batches:
            found, at, out, path = [], 0, None, None
            try:
                for page, url, digest, refers, payload in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                    data = record(page, url, payload.as_py(), digest, refers, date)
                    if out is None or at + len(data) > file_bytes:
                        if out is not None:
                            out.close()
                        path, at = f"part-{uuid.uuid4()}.warc.gz", 0
                        out = place.open_output_stream(f"{top}/{path}", compression=None)
                    out.write(data)
                    found.append((path, at, len(data), url, digest, page, "response" if refers is None else "revisit"))
                    at += len(data)
            finally:
                if out is not None:
                    out.close()
            yield to_batch(found, INDEX)  # a file is whole before its index rows leave

    marked.select("page_id", "url", "payload_digest", "refers_to", "payload").mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def read_records(index: DataFrame, folder: str, stretch: int = 16 << 20, gap: int = 64 << 10, payloads: bool = True, task_bytes: int = 32 << 20) -> DataFrame:
    """The records of the selected index rows, one row each.

    Index rows are a few bytes for records of any size, so the number of tasks follows from the bytes to be read.
    """

    def fetch(key, group):
        from pyarrow import fs

        place, top = fs.FileSystem.from_uri(folder)
        want = sorted(zip(group.column("offset").to_pylist(), group.column("length").to_pylist(), strict=True))
        rows, i = [], 0
        with place.open_input_file(f"{top}/{key[0].as_py()}") as source:
            while i < len(want):
                j, start, end = i, want[i][0], want[i][0] + want[i][1]
                while j + 1 < len(want) and want[j + 1][0] - end <= gap:
                    j += 1
                    end = max(end, want[j][0] + want[j][1])
                data = source.read_at(end - start, start)
                for offset, length in want[i : j + 1]:
                    values = parse(data[offset - start : offset - start + length])
                    rows.append(values if payloads else (*values[:-1], None))
                i = j + 1
        return pa.Table.from_batches([to_batch(rows, RECORD)])

    tasks = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // task_bytes))
    wanted = index.withColumn("stretch", F.floor(F.col("offset") / stretch)).select("file", "stretch", "offset", "length")
    return wanted.repartition(tasks, "file", "stretch").groupBy("file", "stretch").applyInArrow(fetch, RECORD)


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    place = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4()}"
    index = write_archives(read_table(spark, folder, "pages"), place)
    return read_records(index, place, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
     d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
     m AS (SELECT payload_digest, payload_bytes, max(page_id) AS last FROM d GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM d JOIN m USING (payload_digest, payload_bytes)
"""
