"""Vector code compression: product codes over integer parts, found by walking lexicographic tries of distinct parts.

Vectors become integers and are cut into equal consecutive parts.  Every task turns its vectors, `BLOCK` at a time, into one trie per
part position: the block's distinct parts in lexicographic order, each with the number of its copies, so equal parts (copies of
vectors, constant stretches) are one leaf however often they occur.  The tries are written once; nothing else of the vectors is
needed until the end, and no vector is shuffled.

A round walks each trie depth first.  A node holds the squared distances to all codebook entries over the components on its path,
one addition per entry to its parent's, so vectors with a common prefix of components share that work.  Subtrees of at most `LEAVES`
leaves are walked level by level as arrays.  At a leaf the smallest entry (lowest index on ties) takes the part, weighted by its copies.
A task sends one partial sum per (part position, entry); the driver holds the codebooks alone (parts x entries x width integers).

The last assignment walks tries of the vectors at hand, so codes meet their rows without a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.llm.common import cut_lineage, read_table

BLOCK = 1 << 16
LEAVES = 4096
#: Larger components count as this much: sums of squares stay within 64 bits for 512 dimensions, and sums for 6e10 rows.
LARGEST = 1 << 26
#: Labels with more than this share of the rows are joined by broadcast: at most 256 of them exist.
HOT_SHARE = 256


def integer_vectors(vector: Column, scale: int) -> Column:
    """floor(scale * x) per component in double precision; null where the vector is null or a component is null or not finite."""
    whole = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    bounded = F.transform(vector, lambda x: F.floor(F.greatest(F.lit(float(-LARGEST)), F.least(F.lit(float(LARGEST)), x * scale))).cast("int"))
    return F.when(vector.isNotNull() & whole, bounded)


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of an Arrow list column as rows, zero components added up to `width`."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    rows = flat.reshape(len(column), len(flat) // max(1, len(column)))
    return np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def trie(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order, how often each occurs, and for every row given its place among them."""
    if parts.shape[1] == 0:
        return parts[:1], np.array([len(parts)]), np.zeros(len(parts), np.int64)
    order = np.lexsort(parts.T[::-1])
    ordered = parts[order]
    fresh = np.ones(len(parts), bool)
    fresh[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    place = np.empty(len(parts), np.int64)
    place[order] = np.cumsum(fresh) - 1
    return ordered[fresh], np.diff(np.append(np.flatnonzero(fresh), len(parts))), place


def walk(leaves: np.ndarray, entries: np.ndarray, at_most: int = LEAVES) -> Iterator[tuple[int, int, np.ndarray]]:
    """Depth-first walk: (first leaf, last leaf + 1, their squared distances to each entry), covering every leaf once."""
    n, width = leaves.shape
    leaves, entries = leaves.astype(np.int64), entries.astype(np.int64)
    forks = np.zeros(n, np.int64)  # the depth at which a leaf's path leaves that of the one before it
    if width and n > 1:
        forks[1:] = (leaves[1:] != leaves[:-1]).argmax(axis=1)
    stack = [(0, n, 0, np.zeros(len(entries), np.int64))]
    while stack:
        lo, hi, depth, held = stack.pop()
        if hi - lo <= at_most:
            yield lo, hi, _subtree(leaves[lo:hi], forks[lo:hi], depth, held, entries)
            continue
        first = np.flatnonzero(forks[lo:hi] <= depth)
        first = lo + (first if len(first) and first[0] == 0 else np.concatenate([[0], first]))
        bounds, below = np.append(first, hi), []
        i = 0
        while i < len(first):
            j = int(np.searchsorted(bounds, bounds[i] + at_most, "right")) - 1
            if j > i:  # children that fit together are one step
                below.append((int(bounds[i]), int(bounds[j]), depth, held))
                i = j
            else:
                value = leaves[bounds[i], depth]
                below.append((int(bounds[i]), int(bounds[i + 1]), depth + 1, held + (value - entries[:, depth]) ** 2))
                i += 1
        stack.extend(reversed(below))


def _subtree(leaves: np.ndarray, forks: np.ndarray, depth: int, held: np.ndarray, entries: np.ndarray) -> np.ndarray:
    nodes, sums = np.zeros(1, np.int64), held[None, :]
    for d in range(depth, leaves.shape[1]):
        mask = forks <= d
        mask[0] = True
        below = np.flatnonzero(mask)
        sums = sums[np.searchsorted(nodes, below, "right") - 1] + (leaves[below, d][:, None] - entries[None, :, d]) ** 2
        nodes = below
    return sums


def tries_of(vectors: DataFrame, parts: int, width: int) -> DataFrame:
    """One row per block and part position: leaves (int32, row by row) and their copies (int64)."""

    def run(batches):
        held: list[np.ndarray] = []

        def flush():
            rows = np.concatenate(held)
            held.clear()
            for p in range(parts):
                leaves, copies, _ = trie(rows[:, p * width : (p + 1) * width])
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([leaves.tobytes()], pa.binary()), pa.array([copies.astype(np.int64).tobytes()], pa.binary())], names=["part", "leaves", "copies"])

        for batch in batches:
            rows = matrix_of(batch.column(0), parts * width)
            for at in range(0, len(rows), BLOCK):
                held.append(rows[at : at + BLOCK])
                if sum(map(len, held)) >= BLOCK:
                    yield from flush()
        if sum(map(len, held)):
            yield from flush()

    return vectors.select("v").mapInArrow(run, "part int, leaves binary, copies binary")


def round_sums(tries: DataFrame, books: np.ndarray) -> DataFrame:
    """part, entry, n and per component s0, s1, ...: the weighted sums of the parts that each entry takes."""
    parts, entries, width = books.shape
    names = ["part", "entry", "n", *[f"s{d}" for d in range(width)]]

    def run(batches):
        total = np.zeros((parts, entries, 1 + width), np.int64)
        for batch in batches:
            for p, leaves, copies in zip(*(batch.column(i).to_pylist() for i in range(3))):
                counts = np.frombuffer(copies, np.int64)
                rows = np.frombuffer(leaves, np.int32).reshape(len(counts), width)
                for lo, hi, far in walk(rows, books[p]):
                    taken, weight = far.argmin(axis=1), counts[lo:hi]
                    for at, column in enumerate([weight, *(weight * rows[lo:hi, d] for d in range(width))]):
                        total[p, :, at] += np.bincount(taken, weights=column, minlength=entries).astype(np.int64)
        part, entry = np.nonzero(total[:, :, 0])
        sums = total[part, entry]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), *(pa.array(sums[:, i], pa.int64()) for i in range(1 + width))], names=names)

    partial = tries.mapInArrow(run, "part int, entry int, " + ", ".join(f"{n} long" for n in names[2:]))
    return partial.groupBy("part", "entry").agg(*(F.sum(n).alias(n) for n in names[2:]))


def assign(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error (squared distances summed over the parts)."""
    parts, entries, width = books.shape
    digits = np.array([f"{e:02x}" for e in range(entries)], dtype="U2")

    def run(batches):
        for batch in batches:
            rows = matrix_of(batch.column(2), parts * width)
            codes, errors = np.zeros(len(rows), f"U{2 * parts}"), np.zeros(len(rows), np.int64)
            for p in range(parts):
                leaves, _, place = trie(rows[:, p * width : (p + 1) * width])
                taken, least = np.zeros(len(leaves), np.int64), np.zeros(len(leaves), np.int64)
                for lo, hi, far in walk(leaves, books[p]) if len(rows) else ():
                    taken[lo:hi], least[lo:hi] = far.argmin(axis=1), far.min(axis=1)
                codes, errors = np.char.add(codes, digits[taken[place]]), errors + least[place]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes.tolist(), pa.string()), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"])

    return vectors.select("vec_id", "label", "v").mapInArrow(run, "vec_id long, label string, code string, error long")


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, label, code, error) per usable vector, and the codebooks (parts x entries x width; None without a usable vector).

    Vectors that are null or hold null or non-finite components are dropped, and so are those whose length is not that of the usable
    vector with the smallest id.  Lengths that `parts` does not divide are filled with zeros.  Components beyond `LARGEST` after scaling
    count as that.  With fewer than `entries` vectors the codebooks are as small.  Repeated ids are rows of their own, ordered by
    their vectors; a null id comes last; an empty table gives no rows; other columns are not read.
    """
    usable = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), integer_vectors(F.col(vector_col).cast("array<double>"), scale).alias("v")).where("v is not null")
    first = usable.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    if not first:
        return usable.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), None
    length = len(first[0]["v"])
    usable = usable.where(F.size("v") == length)
    if any(len(r["v"]) != length for r in first):
        first = usable.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    width = -(-length // parts)
    start = np.zeros((len(first), parts * width), np.int64)
    start[:, :length] = np.array([r["v"] for r in first], np.int64).reshape(len(first), length)
    books = start.reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    tries = cut_lineage(tries_of(usable, parts, width))
    for _ in range(rounds):
        for r in round_sums(tries, books).collect():  # at most parts x entries rows
            books[r["part"], r["entry"]] = [r[f"s{d}"] // r["n"] for d in range(width)]
    return assign(usable, books), books


def with_group_error(codes: DataFrame) -> DataFrame:
    """Adds label_error, the error summed over equal labels (nulls together).  Frequent labels meet their sum by broadcast, the others by a join."""
    codes = cut_lineage(codes.withColumn("key", F.struct(F.col("label").isNull().alias("none"), F.coalesce("label", F.lit("")).alias("name"))))
    sums = cut_lineage(codes.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows")))
    total = sums.agg(F.sum("rows")).first()[0] or 0
    hot = sums.where(F.col("rows") * HOT_SHARE > total)  # fewer than HOT_SHARE rows, whatever the input
    marked = codes.join(F.broadcast(hot.select("key", F.col("label_error").alias("hot_error"))), "key", "left")
    frequent = marked.where("hot_error is not null").withColumnRenamed("hot_error", "label_error")
    others = marked.where("hot_error is null").drop("hot_error").join(sums.select("key", "label_error"), "key")
    return frequent.unionByName(others).drop("key")


def codebooks_digest(books: np.ndarray | None) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist() if books is not None else [])).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    codes, books = compress(read_table(spark, folder, "embeddings"))
    return with_group_error(codes).select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def op12_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The same codes by comparing every part with every entry."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
d{r} AS (SELECT p.rid, p.part, c.entry, CAST(list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS far FROM p JOIN c{r} AS c USING (part)),
a{r} AS (SELECT rid, part, entry, far FROM d{r} QUALIFY row_number() OVER (PARTITION BY rid, part ORDER BY far, entry) = 1)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (SELECT part, entry, place, CAST(floor_sum AS BIGINT) AS x FROM (SELECT part, entry, place, (s - ((s % n) + n) % n) // n AS floor_sum FROM (SELECT part, entry, place, CAST(sum(v[place]) AS BIGINT) AS s, count(*) AS n FROM a{r} JOIN p USING (rid, part), unnest(range(1, len(v) + 1)) AS u(place) GROUP BY part, entry, place))),
c{r + 1} AS (SELECT part, entry, coalesce(n.v, c{r}.v) AS v FROM c{r} LEFT JOIN (SELECT part, entry, list(x ORDER BY place) AS v FROM m{r} GROUP BY part, entry) AS n USING (part, entry))""")
    return f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT rid, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS v FROM k, unnest(range({parts})) AS u(part)),
c0 AS (SELECT part, rid - 1 AS entry, v FROM p WHERE rid <= {entries}),
{','.join(steps)},
code AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{rounds} GROUP BY rid),
book AS (SELECT sha256(string_agg(CAST(v[place] AS VARCHAR), ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM c{rounds}, unnest(range(1, len(v) + 1)) AS u(place))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN code USING (rid), book"""
