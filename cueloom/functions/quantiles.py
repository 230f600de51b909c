"""Exact linear-interpolated quantiles that never buffer a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.operators import sequence as seq


def exact_quantiles(df: DataFrame, key: Sequence[str], value: Column, probs: dict[str, float], width: float) -> DataFrame:
    """One row per key with a column per probability; `width` is the value range of one slot (a shuffle key)."""
    key = list(key)
    counted = (
        df.select(*key, value.cast("double").alias("_v")).filter("_v IS NOT NULL")
        .groupBy(*key, "_v").agg(F.count(F.lit(1)).alias("_c"))
    )
    running = seq.scan(counted, key, ["_v"], F.floor(F.col("_v") / width), {"_cum": ("sum", F.col("_c"))})
    totals = counted.groupBy(*key).agg(F.sum("_c").alias("_n"))
    rows = running.join(totals, key)
    picks = []
    for name, p in probs.items():
        low = F.floor((F.col("_n") - 1) * p)
        high = F.least(low + 1, F.col("_n") - 1)
        picks += [
            F.min(F.when(F.col("_cum") > low, F.col("_v"))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("_cum") > high, F.col("_v"))).alias(f"_hi_{name}"),
        ]
    found = rows.groupBy(*key, "_n").agg(*picks)
    out = []
    for name, p in probs.items():
        rank = (F.col("_n") - 1) * p
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (rank - F.floor(rank))).alias(name))
    return found.select(*key, *out)
