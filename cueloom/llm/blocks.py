"""Exchange of sorted hash entries between blocks of documents.

Documents are dealt into blocks of about `block_bytes` of text by the hash of their row.  A block turns its texts into sorted,
distinct entries (the map-side combine: a string that stands in a thousand documents of a block leaves it once), cut into
ranges of the hash.  A range meets the entries of all blocks and answers each with one bit or number per entry, in the entry's
order; the block, grouped with its answers, goes on from there.  Texts are shuffled once (the later passes reuse that exchange),
entries are packed byte plane by byte plane, and no group grows with the number of copies of a string: it grows with the
number of distinct entries and blocks only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.llm.common import id_text

ENTRIES = "bucket int, block int, n int, keys binary, more binary, docs binary, texts binary"
ANSWERS = "block int, level int, bucket int, n int, bits binary, masks binary"
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def rolling(h: np.ndarray, length: int, base: np.uint64 = BASE) -> np.ndarray:
    """Polynomial hash (mod 2^64) of every window of `length` values, by doubling."""
    if len(h) < length:
        return np.zeros(0, np.uint64)
    out, done, part, size, power = None, 0, h, 1, base
    while True:
        if length & size:
            if out is None:
                out = part
            else:  # append the part behind what is done
                m = len(h) - done - size + 1
                out = out[:m] * power + part[done : done + m]
            done += size
        if done == length:
            return out[: len(h) - length + 1]
        m = len(part) - size
        part, size = part[:m] * power + part[size:], size * 2
        power = np.uint64(int(power) ** 2 & 0xFFFFFFFFFFFFFFFF)


def window_minimum(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` values in a row, by doubling."""
    size = 1
    while size * 2 <= width:
        keys, size = np.minimum(keys[:-size], keys[size:]), size * 2
    rest = width - size
    return np.minimum(keys[:-rest], keys[rest:]) if rest else keys


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """For every `width` grams in a row the place of the least one (by scrambled value, leftmost among equals): the same in every copy."""
    keys = (mix(grams) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    return (window_minimum(keys, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def keys_of(grams: np.ndarray) -> np.ndarray:
    """Keys of chosen grams, spread evenly: the least of many by `mix` would crowd the low end of its own order."""
    return mix(grams ^ np.uint64(0x5851F42D4C957F2D))


def planes(values: np.ndarray) -> bytes:
    """Bytes of 64-bit values, all lowest bytes first: equal high bytes then compress."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def signed(data: bytes) -> np.ndarray:
    return unplanes(data).view(np.int64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def cuts(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the stretches of sorted keys."""
    at = bucket_of(keys, buckets)
    edges = np.flatnonzero(np.diff(at)) + 1
    if not len(at):
        return []
    starts = [0, *edges.tolist()]
    return [(int(at[a]), a, b) for a, b in zip(starts, [*starts[1:], len(at)], strict=True)]


def table(rows: list[tuple], schema: str) -> pa.Table:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[x.split()[1]] for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.table([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=names)


def texts_of(group: pa.Table):
    """(doc_id or None, bytes or None) of a block, one text at a time."""
    ids = group.column("doc_id").to_pylist()
    for doc, text in zip(ids, group.column("text"), strict=True):
        yield doc, text.as_py()


def dealt(docs: DataFrame, block_bytes: int, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> tuple[DataFrame, int, int]:
    """(doc_id, text, block, rest: the carried columns), number of blocks, number of hash ranges; both numbers follow the bytes of the whole table."""
    rows = id_text(docs, id_col, text_col)
    if carry:
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"), F.struct(*carry).alias("rest"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")), blocks, max(1, math.ceil(blocks / 2))


def answers_in(group: pa.Table, level: int) -> list[dict]:
    """This block's answers of a level in the order of its entries."""
    return sorted((r for r in group.to_pylist() if r["level"] == level), key=lambda r: r["bucket"])


def bits_of(group: pa.Table, level: int) -> np.ndarray:
    parts = [np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]) for r in answers_in(group, level)]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def firsts(*keys: np.ndarray) -> np.ndarray:
    """True where a new run of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def answer_shared(entries: DataFrame, level: int) -> DataFrame:
    """Bit 1 for an entry that another block holds too, or that its own block has in more than one document (`more`)."""

    def resolve(group: pa.Table) -> pa.Table:
        rows = group.select(["block", "bucket", "n", "keys", "more"]).to_pylist()
        keys = np.concatenate([unplanes(r["keys"]) for r in rows])
        many = np.concatenate([np.unpackbits(np.frombuffer(r["more"], np.uint8), count=r["n"]) for r in rows])
        order = np.argsort(keys, kind="stable")
        start = np.flatnonzero(firsts(keys[order]))
        size = np.diff(np.append(start, len(keys)))
        shared = np.zeros(len(keys), bool)
        shared[order] = np.repeat((size > 1) | (np.maximum.reduceat(many[order], start) > 0), size)
        out, at = [], 0
        for r in rows:
            out.append((r["block"], level, r["bucket"], r["n"], np.packbits(shared[at : at + r["n"]]).tobytes(), None))
            at += r["n"]
        return table(out, ANSWERS)

    return entries.groupBy("bucket").applyInArrow(resolve, ANSWERS)


def answer_smaller(entries: DataFrame, level: int) -> DataFrame:
    """Bit 1 for an entry that some block holds with a smaller document; masks: bit 1 for one that more than one document holds."""

    def resolve(group: pa.Table) -> pa.Table:
        rows = group.select(["block", "bucket", "n", "keys", "more", "docs"]).to_pylist()
        keys, more, docs = (np.concatenate([f(r[c]) for r in rows]) for c, f in (("keys", unplanes), ("more", unplanes), ("docs", signed)))
        order = np.lexsort((more, keys))
        start = np.flatnonzero(firsts(keys[order], more[order]))
        size = np.diff(np.append(start, len(keys)))
        least = np.empty(len(keys), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(docs[order], start), size)
        shared = np.empty(len(keys), bool)
        shared[order] = np.repeat(size > 1, size)
        out, at = [], 0
        for r in rows:
            own = slice(at, at + r["n"])
            out.append((r["block"], level, r["bucket"], r["n"], np.packbits(least[own] < docs[own]).tobytes(), np.packbits(shared[own]).tobytes()))
            at += r["n"]
        return table(out, ANSWERS)

    return entries.groupBy("bucket").applyInArrow(resolve, ANSWERS)
