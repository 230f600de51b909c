"""Embedding near-dedup by randomised-rotation binary codes.

A vector is stored as the signs of its randomly rotated unit vector (several rotations side by side) with its correction
factor, the inner product of the rotated vector and its code.  Dividing by the factor makes the estimate of an inner product
with another rotated vector unbiased, and the factor also bounds the estimate's spread; a pair whose upper confidence bound
stays below the threshold is dropped, every other candidate is recomputed exactly in double precision.  Candidates share one of
several stretches of the code; their length grows with the logarithm of the largest label, so chance candidates per
vector stay constant, and their number gives a pair at the threshold `recall`.

Equal vectors of a label are one class with a count.  Stretches shared by many classes are cut into pairs of bounded pieces;
a piece returns link counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.llm.common import cut_lineage, read_table
from cueloom.llm.graph import components

PIECE = 256


def rotation(dims: int, length: int, seed: int) -> np.ndarray:
    """dims x length: random orthogonal matrices side by side, scaled to keep lengths."""
    rng, parts = np.random.default_rng(seed), []
    for _ in range(length // dims):
        q, r = np.linalg.qr(rng.standard_normal((dims, dims)))
        parts.append(q * np.sign(np.diag(r)))
    return np.concatenate(parts, axis=1) / math.sqrt(len(parts))


def band_shape(largest: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits of a stretch, number of stretches)."""
    bits = min(60, max(8, math.ceil(math.log2(max(2, largest)))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def band_keys(signs: np.ndarray, bits: int, bands: int) -> np.ndarray:
    weights = 1 << np.arange(bits, dtype=np.int64)
    return signs[:, : bits * bands].reshape(len(signs), bands, bits).astype(np.int64) @ weights


def pair_up(a, b, same: bool, turn: np.ndarray, bits: int, bands: int, band: int, threshold: float, spread: float):
    """Links of two pieces of one stretch as (index in a, index in b); a pair that an earlier stretch holds too is left to that one.

    A piece is (unit vectors, rotated vectors, signs, factors, keys).
    """
    ua, ra, _, _, ka = a
    ub, _, sb, fb, kb = b
    length = turn.shape[1]
    estimate = (ra @ (2.0 * sb.astype(np.float32).T - 1.0)) / (math.sqrt(length) * fb)
    bound = spread * np.sqrt(np.maximum(1 / fb**2 - 1, 0)) / math.sqrt(max(1, turn.shape[0] - 1))
    i, j = np.nonzero(estimate + bound >= threshold)
    if same:
        i, j = i[i < j], j[i < j]
    for t in range(band):
        fresh = ka[i, t] != kb[j, t]
        i, j = i[fresh], j[fresh]
    near = np.einsum("ij,ij->i", ua[i], ub[j]) >= threshold
    return i[near], j[near]


def forest(i: np.ndarray, j: np.ndarray):
    """Pairs of a spanning forest of the links."""
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        a, b = find(x), find(y)
        if a != b:
            parent[max(a, b)] = min(a, b)
            yield x, y


def embedding_links(classes: DataFrame, dims: int, threshold: float, recall: float, spread: float, seed: int) -> DataFrame:
    """(class, links, other) of the classes (label, vector, class, n): link counts weighted by class sizes, and forest edges to `other`."""
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    bits, bands = band_shape(largest, threshold, recall)
    length = math.ceil(bits * bands / dims) * dims

    def stretches(batches):
        turn = rotation(dims, length, seed)
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            if len(x):
                keys = band_keys(unit(x) @ turn > 0, bits, bands)
                n = len(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), bands)), pa.array(np.tile(np.arange(bands, dtype=np.int32), n)), pa.array(keys.reshape(-1))], names=["class", "band", "key"])

    narrow = classes.select("class", "vector").mapInArrow(stretches, "class long, band int, key long").join(classes.select("class", "label"), "class")
    met = narrow.groupBy("label", "band", "key").count().where("count > 1")
    narrow = narrow.join(met, ["label", "band", "key"]).withColumn("parts", F.ceil(F.col("count") / PIECE))
    narrow = narrow.withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")))
    paired = narrow.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    paired = paired.select("class", "band", F.xxhash64("label", "band", "key", F.least("part", "other"), F.greatest("part", "other")).alias("piece"), (F.col("part") <= F.col("other")).alias("left"), (F.col("part") >= F.col("other")).alias("right"))
    total = paired.count()
    full = paired.join(classes.select("class", "vector", "n"), "class").withColumn("pack", F.pmod("piece", F.lit(max(1, total // 4000))).cast("int"))

    def compare(group: pa.Table) -> pa.Table:
        turn = rotation(dims, length, seed)
        cls, piece, n = (group.column(c).to_numpy() for c in ("class", "piece", "n"))
        left, right, band = (group.column(c).to_numpy(zero_copy_only=False) for c in ("left", "right", "band"))
        u = unit(group.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims))
        turned = u @ turn
        signs = turned > 0
        factor = np.abs(turned).sum(axis=1) / math.sqrt(length)
        keys = band_keys(signs, bits, bands)
        turned = turned.astype(np.float32)
        order = np.lexsort((cls, piece))
        edge = np.flatnonzero(np.concatenate([[True], piece[order][1:] != piece[order][:-1]]))
        counts, ends = np.zeros(len(cls), np.int64), []
        for rows in np.split(order, edge[1:]):
            a, b = rows[left[rows]], rows[right[rows]]
            if not len(a) or not len(b):
                continue
            same = bool(left[rows[0]] and right[rows[0]])
            i, j = pair_up(*[(u[x], turned[x], signs[x], factor[x], keys[x]) for x in (a, b)], same, turn, bits, bands, int(band[rows[0]]), threshold, spread)
            i, j = a[i], b[j]
            np.add.at(counts, i, n[j])
            np.add.at(counts, j, n[i])
            ends.extend((cls[x], cls[y]) for x, y in forest(i, j))
        some = np.flatnonzero(counts)
        return pa.table({"class": pa.array([*cls[some].tolist(), *(int(a) for a, _ in ends)], pa.int64()), "links": pa.array([*counts[some].tolist(), *([0] * len(ends))], pa.int64()), "other": pa.array([*([None] * len(some)), *(int(b) for _, b in ends)], pa.int64())})

    return full.groupBy("pack").applyInArrow(compare, "class long, links long, other long")


def embedding_dedup(vectors: DataFrame, threshold: float = 0.98, recall: float = 0.9995, spread: float = 4.0, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row.

    Rows link only within a label (null: none) and with the same number of dimensions.  Null, empty and zero vectors and those
    with null or non-finite components have no links and are their own component.  Rows that repeat an id count as
    vectors of their own; an empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    fine = F.expr("vector is not null and label is not null and vec_id is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(vector, x -> x != 0)")
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    good = rows.where("fine")
    classes = cut_lineage(good.groupBy("label", "vector").agg(F.min("vec_id").alias("class"), F.count("*").alias("n")))
    sizes = [r[0] for r in classes.select(F.size("vector").alias("d")).distinct().collect()]
    found = None
    for d in sorted(sizes):
        part = embedding_links(classes.where(F.size("vector") == d), d, threshold, recall, spread, seed)
        found = part if found is None else found.unionByName(part)
    single = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if found is not None:
        found = cut_lineage(found)
        linked = found.groupBy("class").agg(F.sum("links").alias("links"))
        roots = components(found.where("other is not null").select(F.col("class").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "class")
        told = classes.join(linked, "class", "left").join(roots, "class", "left")
        told = told.select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "class").alias("component_id"))
        single = good.join(told, ["label", "vector"]).select("vec_id", "n_links", "component_id").unionByName(single)
    return single.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op10_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup(read_table(spark, folder, "embeddings"))


OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
     l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
     reach AS (SELECT vec_id AS v, vec_id AS u FROM embeddings UNION SELECT r.v, l.b FROM reach r JOIN l ON l.a = r.u),
     n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a), c AS (SELECT v AS vec_id, min(u) AS component_id FROM reach GROUP BY v)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
