"""Ranked lexical search over bit-sliced Bloom signatures.

Index (`build_index`, one pass, no shuffle): documents of like size are collected in blocks.  A block is a bit matrix whose rows are
hash places and whose columns are its documents: a document sets, for each of its terms, `HASHES` places, and once more for each of
`LEVELS` that the term's frequency reaches.  Rows are as many as `2**class * 8`, where a document of class c sets below 2**c entries, so
about one bit in four is set whatever a document's length.  The block keeps its documents' ids, lengths, largest frequencies and
texts, and the pass counts in how many documents each term stands.

Search (`search`): in every block, the rows of a query term's places are and-ed into one bitmap per level, which can only show too many
documents.  A document's upper bound is the sum over the levels of (its gain from reaching the level) x (sum of the weights of the terms
whose bitmaps show it there).  Documents are scored exactly, from their texts, in falling order of their bounds until a bound cannot
reach the ten best of the task so far; everything else is provably no better.  Tasks return at most `k` rows an item, and the best of
those are the best of all.

Scores are integers (weights and divisions as in `exact_score`), so results do not depend on blocks, tasks or their order.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueloom.llm.common import cut_lineage, id_text, read_table, rows_of

#: Upper case A-Z to lower case; everything up to 0x7F that is no letter or digit to a blank.  Bytes above belong to terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
HASHES = 3
LEVELS = (1, 2, 3, 5, 9)
BLOCK_BITS = 1 << 23
BLOCK_BYTES = 1 << 21
BLOCK_DOCS = 1024
HELD_TERMS = 200_000
FILE_BLOCKS = 32
SHARD_BYTES = 1 << 22
ITEM_STEP = 256
BLOCKS = "size_class int, doc_ids array<long>, lengths array<long>, tops array<long>, bits binary, texts array<binary>, terms array<binary>, term_docs array<long>"


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class Places(dict):
    """term -> 64-bit hash, kept for short terms while there is room."""

    def __missing__(self, term: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(term)
        if len(term) <= 32:
            if len(self) >= HELD_TERMS:
                self.clear()
            self[term] = found
        return found


def rows_at(hashes: np.ndarray, level: int, rows: int) -> np.ndarray:
    """HASHES row numbers per hash at one level; rows is a power of two."""
    mixed = (hashes ^ np.uint64((level * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xFF51AFD7ED558CCD)
    mixed ^= mixed >> np.uint64(29)
    step = (mixed >> np.uint64(40)) | np.uint64(1)
    return np.stack([(mixed + np.uint64(i) * step) & np.uint64(rows - 1) for i in range(HASHES)], axis=-1).astype(np.int64)


def row_count(size_class: int) -> int:
    """Rows of a class's matrices; documents of over 2**19 entries share the widest one, with looser bounds."""
    return 8 << min(size_class, 19)


class _Block:
    def __init__(self, size_class: int):
        self.size_class, self.rows, self.bytes = size_class, row_count(size_class), 0
        self.ids, self.lengths, self.tops, self.set, self.texts = [], [], [], [], []

    def add(self, doc, text: bytes, hashes: np.ndarray, often: np.ndarray) -> bool:
        """True when the block is full."""
        self.set.append(np.concatenate([rows_at(hashes[often >= least], i, self.rows).ravel() for i, least in enumerate(LEVELS)]))
        self.ids.append(doc), self.lengths.append(int(often.sum())), self.tops.append(int(often.max())), self.texts.append(text)
        self.bytes += len(text)
        return self.bytes >= BLOCK_BYTES or len(self.ids) >= min(BLOCK_DOCS, max(8, BLOCK_BITS // self.rows))

    def bits(self) -> bytes:
        width = -(-len(self.ids) // 8) * 8
        matrix = np.zeros((self.rows, width), bool)
        matrix[np.concatenate(self.set), np.repeat(np.arange(len(self.ids)), list(map(len, self.set)))] = True
        return np.packbits(matrix, axis=1).tobytes()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of documents and partial document counts of terms, as one table in the shared folder.

    Every row with at least one term is in exactly one block; null, empty and term-free texts can match nothing and are left out.
    Repeated rows and null ids are documents of their own.  Other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(BLOCKS))

    def record(block: _Block | None, terms: Counter | None) -> pa.RecordBatch:
        values = [block.size_class, block.ids, block.lengths, block.tops, block.bits(), block.texts, None, None] if block else [None] * 6 + [list(terms), list(terms.values())]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    def run(batches):
        places, found, blocks = Places(), Counter(), {}
        for batch in batches:
            for doc, text in rows_of(batch):
                counts = Counter(terms_of(text))
                if not counts:
                    continue
                found.update(counts.keys())
                hashes = np.fromiter(map(places.__getitem__, counts), np.uint64, len(counts))
                often = np.fromiter(counts.values(), np.int64, len(counts))
                size_class = int(sum((often >= least).sum() for least in LEVELS)).bit_length()
                block = blocks.get(size_class) or blocks.setdefault(size_class, _Block(size_class))
                if block.add(doc, text, hashes, often):
                    yield record(blocks.pop(size_class), None)
                if len(found) >= HELD_TERMS:
                    yield record(None, found)
                    found.clear()
        for block in blocks.values():
            yield record(block, None)
        if found:
            yield record(None, found)

    return cut_lineage(id_text(docs, id_col, text_col).mapInArrow(run, BLOCKS), max_rows_per_file=FILE_BLOCKS)


def weight(n_docs: int, docs_with_term: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * docs_with_term + 1)))


def length_norm(length, n_docs: int, all_terms: int):
    """100 at the mean length, never below 10; takes integers or arrays of them."""
    return 10 + (90 * length * n_docs) // all_terms


def gain(often, norm):
    return (1_000_000_000 * often) // (1000 * often + 8 * norm)


def exact_score(counts: Counter, query: dict[bytes, int], norm: int) -> int:
    return sum(w * gain(counts[t], norm) for t, w in query.items() if t in counts)


def query_shards(items: DataFrame, index: DataFrame, n_docs: int, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """Items as (item number, item id, {term: weight}), in lists of bounded text size; items without a term of any document are left out."""
    from pyspark.sql.types import ArrayType, BinaryType

    distinct = F.udf(lambda text: sorted(set(terms_of(bytes(text) if text is not None else None))), ArrayType(BinaryType()))
    texts = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    texts = cut_lineage(texts.withColumn("item", F.monotonically_increasing_id()).withColumn("terms", distinct("text")).drop("text"))
    asked = texts.select(F.explode("terms").alias("term")).distinct()
    counted = index.where("terms is not null").select(F.explode(F.arrays_zip("terms", "term_docs")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.term_docs").alias("docs"))
    counted = counted.join(asked, "term", "left_semi").groupBy("term").agg(F.sum("docs").alias("docs"))
    weighed = texts.select("item", "item_id", F.explode("terms").alias("term")).join(counted, "term").groupBy("item", "item_id").agg(F.collect_list(F.struct("term", "docs")).alias("terms"))
    shard, held = [], 0
    for r in weighed.orderBy("item").toLocalIterator():
        query = {bytes(t["term"]): w for t in sorted(r["terms"]) if (w := weight(n_docs, t["docs"])) > 0}
        if query:
            shard.append((r["item"], r["item_id"], query))
            held += sum(map(len, query))
        if held >= SHARD_BYTES:
            yield shard
            shard, held = [], 0
    if shard:
        yield shard


class Best:
    """The k best (score, -doc) of one item so far; `floor` is what a document must reach to enter."""

    def __init__(self, k: int):
        self.k, self.rows, self.floor = k, [], 1

    def offer(self, score: int, doc: int | None) -> None:
        if score > 0:
            bisect.insort(self.rows, (-score, doc is None, doc if doc is not None else 0))
            del self.rows[self.k :]
            if len(self.rows) == self.k:
                self.floor = -self.rows[-1][0]


def upper_bounds(bits: np.ndarray, docs: int, gains: np.ndarray, hashes: np.ndarray, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """One row per query: bounds of the documents' scores.  `gains` holds per level what reaching it adds at most; a query is (places in hashes, weights)."""
    total = np.zeros((len(queries), docs), np.float64)
    for level in range(len(LEVELS)):
        sliced = np.bitwise_and.reduce(bits[rows_at(hashes, level, len(bits))], axis=1)
        seen = np.flatnonzero(sliced.any(axis=1))
        row_of = np.full(len(hashes), -1)
        row_of[seen] = np.arange(len(seen))
        shown = np.unpackbits(sliced[seen], axis=1, count=docs).astype(np.float64)
        for q, (at, weights) in enumerate(queries):
            rows = row_of[at]
            if (rows >= 0).any():
                total[q] += (weights[rows >= 0] @ shown[rows[rows >= 0]]) * gains[level]
    return total


def search_shard(blocks: DataFrame, shard: list[tuple], n_docs: int, all_terms: int, k: int) -> DataFrame:
    """item (number within all items), item_id, doc_id, score: the k best of every task for the shard's items."""
    steps = []
    for lo in range(0, len(shard), ITEM_STEP):
        part = shard[lo : lo + ITEM_STEP]
        terms = sorted({t for _, _, query in part for t in query})
        place = {t: i for i, t in enumerate(terms)}
        hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in terms], np.uint64)
        steps.append((lo, hashes, [(np.array([place[t] for t in q]), np.array(list(q.values()), np.float64)) for _, _, q in part]))

    def run(batches):
        best = [Best(k) for _ in shard]
        for batch in batches:
            for b in range(batch.num_rows):
                size_class, ids, lengths, tops, bits = (batch.column(i)[b].as_py() for i in range(5))
                texts, docs, counts = batch.column(5)[b].values, len(ids), {}
                rows = np.frombuffer(bits, np.uint8).reshape(row_count(size_class), -1)
                norm, top = length_norm(np.array(lengths), n_docs, all_terms), np.array(tops)
                reach = np.stack([gain(np.minimum(top, ends), norm) for ends in [*(x - 1 for x in LEVELS[1:]), 1 << 62]])
                gains = np.diff(reach, axis=0, prepend=0)
                for lo, hashes, queries in steps:
                    bounds = upper_bounds(rows, docs, gains, hashes, queries)
                    for q in range(len(queries)):
                        mine, bound = best[lo + q], bounds[q]
                        may = np.flatnonzero(bound >= mine.floor)
                        for d in may[np.argsort(-bound[may], kind="stable")].tolist():
                            if bound[d] < mine.floor:
                                break
                            if d not in counts:
                                counts[d] = Counter(terms_of(texts[d].as_py()))
                            mine.offer(exact_score(counts[d], shard[lo + q][2], int(norm[d])), ids[d])
        out = [(shard[i][0], shard[i][1], None if none else doc, -low) for i, b in enumerate(best) for low, none, doc in b.rows]
        for at in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[at : at + 10_000])], names=["item", "item_id", "doc_id", "score"])

    return blocks.mapInArrow(run, "item long, item_id long, doc_id long, score long")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item, ranked.  Rows of many tasks are thinned in 64 parts of an item before they meet."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    thin = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64))).withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= k)
    return thin.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(index: DataFrame, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k best documents of the index with a score above 0.

    Equal scores rank by ascending doc_id, a null id last.  Every row of `items` is an item: repeated ones have results each, a null
    id stays null, null and empty texts have none.  An empty table on either side gives no rows.
    """
    blocks = index.where("size_class is not null")
    n_docs, all_terms = blocks.select(F.sum(F.size("lengths")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    found = index.sparkSession.createDataFrame([], "item long, item_id long, doc_id long, score long")
    if n_docs:
        for shard in query_shards(items, index, n_docs, id_col, text_col):
            found = found.unionByName(search_shard(blocks.select(*(c.split()[0] for c in BLOCKS.split(", ")[:6])), shard, n_docs, all_terms, k))
    return best_of(found, k)


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return search(build_index(read_table(spark, folder, "documents")), read_table(spark, folder, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH w AS (SELECT row_number() OVER () AS d, doc_id, {_TERMS} AS l FROM documents),
c AS (SELECT count(*) AS n_docs, CAST(sum(len(l)) AS BIGINT) AS n_terms FROM w WHERE len(l) > 0),
t AS (SELECT d, doc_id, term, count(*) AS tf, any_value(len(l)) AS n FROM (SELECT d, doc_id, l, unnest(l) AS term FROM w) GROUP BY d, doc_id, term),
f AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, c GROUP BY term, n_docs),
q AS (SELECT row_number() OVER () AS i, item_id, list_distinct({_TERMS}) AS l FROM benchmark),
s AS (SELECT i, item_id, d, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM (SELECT i, item_id, unnest(l) AS term FROM q) JOIN f USING (term) JOIN t USING (term), c GROUP BY i, item_id, d, doc_id)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS r FROM s WHERE score > 0) WHERE r <= 10"""
