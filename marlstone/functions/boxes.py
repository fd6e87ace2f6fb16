"""Geometry of boxes: structs of x0, y0, x1, y1, y growing downwards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*[v.cast("double").alias(n) for v, n in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"), strict=True)])


def is_valid(b: Column) -> Column:
    return (b["x0"] <= b["x1"]) & (b["y0"] <= b["y1"])


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def merge(a: Column, b: Column) -> Column:
    return box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def intersection(a: Column, b: Column) -> Column:
    """Area that both cover."""
    wide = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    high = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union <= 0, F.lit(0.0)).otherwise(both / union)


def contained(a: Column, b: Column) -> Column:
    """The share of a that b covers."""
    return F.when(area(a) <= 0, F.lit(0.0)).otherwise(intersection(a, b) / area(a))


def vertical_overlap(a: Column, b: Column) -> Column:
    """Common height over the smaller height; boxes without height count as overlapping where one lies in the other."""
    common = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    least = F.least(a["y1"] - a["y0"], b["y1"] - b["y0"])
    return F.when(least <= 0, F.when(common >= 0, 1.0).otherwise(0.0)).otherwise(F.greatest(common, F.lit(0.0)) / least)
