"""Small column helpers shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flags(*rules: tuple[Column, str]) -> Column:
    """Names of the rules that hold, in rule order; an unknown (NULL) condition does not raise its flag."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in rules]))


def has(array: Column, *names: str) -> Column:
    return F.arrays_overlap(array, F.array(*[F.lit(n) for n in names]))


def joined(array: Column, sep: str = "|") -> Column:
    return F.array_join(array, sep)


def safe_div(num: Column, den: Column, empty=None) -> Column:
    out = F.when(den != 0, num / den)
    return out if empty is None else out.otherwise(F.lit(empty))


def ranked(*levels: tuple[str, int]) -> dict[str, int]:
    return dict(levels)


def lookup(col: Column, table: dict, default=None) -> Column:
    """Literal map lookup as a CASE expression (stays inside codegen)."""
    out = None
    for key, value in table.items():
        out = F.when(col == F.lit(key), F.lit(value)) if out is None else out.when(col == F.lit(key), F.lit(value))
    return out.otherwise(F.lit(default))


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))
