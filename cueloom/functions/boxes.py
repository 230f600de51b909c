"""Axis-aligned boxes as four columns (x1, y1, x2, y2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _box(prefix: str) -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def area(prefix: str = "") -> Column:
    x1, y1, x2, y2 = _box(prefix)
    return F.greatest(F.lit(0), x2 - x1) * F.greatest(F.lit(0), y2 - y1)


def intersection(a: str, b: str) -> Column:
    ax1, ay1, ax2, ay2 = _box(a)
    bx1, by1, bx2, by2 = _box(b)
    return F.greatest(F.lit(0), F.least(ax2, bx2) - F.greatest(ax1, bx1)) * F.greatest(F.lit(0), F.least(ay2, by2) - F.greatest(ay1, by1))


def iou(a: str, b: str) -> Column:
    shared = intersection(a, b)
    union = area(a) + area(b) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def overlap_of_smaller(a: str, b: str) -> Column:
    return intersection(a, b) / F.greatest(F.lit(1), F.least(F.greatest(F.lit(1), area(a)), F.greatest(F.lit(1), area(b))))


def hull(polygon: Column) -> Column:
    """Bounding struct of an array of (x, y) points."""
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))
