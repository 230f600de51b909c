"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints are taken in one pass over the whole texts.  Of the distinct fingerprints, bit correlations (from sums over all
of them) decide which bits share a partition, and dynamic programming on estimated candidate counts gives each of the m
partitions its own threshold, possibly -1 (not probed), with sum `distance` - m + 1: a pair within `distance` bits is within
the threshold of some partition.  Fingerprints probe the projections within the threshold and candidates are verified.
Probing groups of more than `group` distinct fingerprints are not paired out: their members are linked through the values at
half the distance (two fingerprints share such a value exactly if they are within the distance), which grows with the
members, not their pairs, and loses no link.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.llm.common import cut_lineage, map_texts, read_table, text_bytes
from cueloom.llm.graph import components

BITS = 64


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Majority bits of the shingles' XXH64 (seed 42), as a signed 64-bit number; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxh64_intdigest(joined, 42)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-shingle] + 1]).tolist()
        hashes = np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    value = sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist())
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return map_texts(docs, lambda: lambda doc, text: (doc, fingerprint(text_bytes(text), shingle)), "doc_id long, fp long", id_col, text_col)


def bit_sums(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how often each two bits are both set, summed over all of them."""

    def add_up(batches):
        total = np.zeros((BITS, BITS))
        n = 0
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(fp)
        yield pa.RecordBatch.from_arrays([pa.array([*range(BITS), BITS], pa.int32()), pa.array([*total.tolist(), [float(n)] * BITS])], names=["bit", "v"])

    rows = prints.select("fp").mapInArrow(add_up, "bit int, v array<double>").groupBy("bit").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(BITS)]).collect()
    total = np.zeros((BITS + 1, BITS))
    for r in rows:
        total[r["bit"]] = list(r)[1:]
    return int(total[BITS, 0]), total[:BITS]


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of nearly equal size, each grown around the bit most correlated with the rest by the strongest mean correlation."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    free, groups = list(range(BITS)), []
    for i in range(parts):
        size = (BITS - sum(map(len, groups))) // (parts - i)
        mine = [max(free, key=lambda b: (corr[b][free].sum(), -b))]
        free.remove(mine[0])
        while len(mine) < size:
            nearest = max(free, key=lambda b: (corr[b][mine].sum(), -b))
            mine.append(nearest)
            free.remove(nearest)
        groups.append(sorted(mine))
    return groups


@dataclass(frozen=True)
class Plan:
    masks: tuple[int, ...]  # signed 64-bit
    bits: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]


def allocate(costs: list[list[float]], distance: int) -> tuple[float, tuple[int, ...]]:
    """Thresholds with the least total cost whose sum is distance - m + 1; costs[i][t + 1] is partition i's cost at threshold t."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}  # used sum of (t + 1) -> cost, thresholds
    for cost in costs:
        step: dict[int, tuple[float, tuple[int, ...]]] = {}
        for used, (total, chosen) in best.items():
            for t in range(-1, distance + 1):
                if used + t + 1 <= distance + 1:
                    new = (total + cost[t + 1], (*chosen, t))
                    step[used + t + 1] = min(step.get(used + t + 1, (float("inf"), ())), new)
        best = step
    return best[distance + 1]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def make_plan(prints: DataFrame, distance: int, parts=(2, 3, 4)) -> Plan:
    """The partitions and thresholds with the fewest expected probes and candidates."""
    n, both = bit_sums(prints)
    groups = [(m, i, g) for m in parts for i, g in enumerate(group_bits(n, both, m))]
    masks = {(m, i): signed(sum(1 << b for b in g)) for m, i, g in groups}
    keys = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(k)).alias("key")) for (m, i), k in masks.items()])).alias("s")
    equal = prints.select(keys).groupBy("s.m", "s.i", "s.key").count().groupBy("m", "i").agg(F.sum(F.expr("count * (count - 1) / 2")).alias("pairs"))
    pairs = {(r["m"], r["i"]): float(r["pairs"]) for r in equal.collect()}
    p = np.diag(both) / max(n, 1)
    differ = np.clip(2 * p * (1 - p), 1e-6, 0.999)
    plans = []
    for m in parts:
        own = [g for k, _, g in groups if k == m]
        costs = []
        for i, g in enumerate(own):
            odds = differ[g] / (1 - differ[g])
            near = [1.0, odds.sum(), (odds.sum() ** 2 - (odds**2).sum()) / 2, *[comb(len(g), t) for t in range(3, distance + 1)]]
            costs.append([0.0, *[pairs.get((m, i), 0.0) * sum(near[: t + 1]) + n * sum(comb(len(g), k) for k in range(t + 1)) for t in range(distance + 1)]])
        total, chosen = allocate(costs, distance)
        plans.append((total, m, Plan(tuple(masks[m, i] for i in range(m)), tuple(map(tuple, own)), chosen)))
    return min(plans, key=lambda x: x[:2])[2]


def flips(bits, most: int) -> list[int]:
    """Values that differ in at most `most` of the bits from 0."""
    found = [0]
    for _ in range(most):
        found = list(dict.fromkeys([*found, *(v ^ (1 << b) for v in found for b in bits if not v >> b & 1)]))
    return [signed(v) for v in found]


def links(prints: DataFrame, distance: int = 2, group: int = 64) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp`, all within `distance` bits, that connect every two within `distance` bits."""
    plan = make_plan(prints, distance)
    sides = []
    for i, (mask, bits, t) in enumerate(zip(plan.masks, plan.bits, plan.thresholds, strict=True)):
        if t >= 0:
            key = F.col("fp").bitwiseAND(F.lit(mask))
            probes = F.explode(F.array(*[F.lit(v) for v in flips(bits, t)])).alias("v")
            sides.append(prints.select("fp", F.lit(i).alias("i"), key.alias("own"), probes).select("fp", "i", F.col("own").bitwiseXOR(F.col("v")).alias("key"), (F.col("v") == 0).alias("home")))
    probes = sides[0]
    for s in sides[1:]:
        probes = probes.unionByName(s)
    size = probes.groupBy("i", "key").agg(F.count("*").alias("n"), F.max(F.col("home").cast("int")).alias("met")).where("n > 1 and met = 1")
    probes = cut_lineage(probes.join(size, ["i", "key"]).select("i", "key", "fp", "home", "n"))
    listed = probes.where(F.col("n") <= group).groupBy("i", "key").agg(F.collect_list("fp").alias("all"), F.collect_list(F.when(F.col("home"), F.col("fp"))).alias("homes"))
    near = listed.select(F.explode("homes").alias("a"), "all").select("a", F.explode(F.expr(f"filter(all, x -> x != a and bit_count(x ^ a) <= {distance})")).alias("b"))
    crowd = probes.where(F.col("n") > group).select("fp").distinct()
    inner, outer = set(flips(range(BITS), distance // 2)), flips(range(BITS), (distance + 1) // 2)
    values = F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.lit(v in inner).alias("inner")) for v in outer])).alias("s")
    spokes = crowd.select("fp", values).select("fp", F.col("fp").bitwiseXOR(F.col("s.v")).alias("key"), "s.inner")
    hubs = spokes.groupBy("key").agg(F.min(F.when(F.col("inner"), F.col("fp"))).alias("hub"), F.count("*").alias("n")).where("n > 1 and hub is not null")
    starred = spokes.join(hubs, "key").select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(starred).where("a != b").distinct()


def simhash_groups(docs: DataFrame, distance: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per input row.

    Null texts are empty; documents without words have fingerprint 0, which links like any other.  Null ids get their group's
    smallest id (null if it has none); repeated rows and ids give repeated rows; an empty table gives none.
    """
    prints = cut_lineage(fingerprints(docs, shingle, id_col, text_col))
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp"), distance)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    whole = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.join(whole, "root").select("fp", "component_id")
    return prints.join(found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_groups(read_table(spark, folder, "documents"))
