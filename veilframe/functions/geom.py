"""Rectangles as STRUCT<x, y, width, height>: areas, overlaps, clipping, padding, scaling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(x, y, width, height) -> Column:
    as_double = lambda v, name: (v if isinstance(v, Column) else F.lit(v)).cast("double").alias(name)
    return F.struct(as_double(x, "x"), as_double(y, "y"), as_double(width, "width"), as_double(height, "height"))


def area(r: Column) -> Column:
    return F.greatest(r["width"], F.lit(0.0)) * F.greatest(r["height"], F.lit(0.0))


def _span(a: Column, b: Column, at: str, size: str) -> Column:
    return F.greatest(F.lit(0.0), F.least(a[at] + a[size], b[at] + b[size]) - F.greatest(a[at], b[at]))


def intersection(a: Column, b: Column) -> Column:
    return _span(a, b, "x", "width") * _span(a, b, "y", "height")


def overlaps(a: Column, b: Column) -> Column:
    """Whether both share a positive area."""
    return (a["x"] < b["x"] + b["width"]) & (b["x"] < a["x"] + a["width"]) & (a["y"] < b["y"] + b["height"]) & (b["y"] < a["y"] + a["height"])


def iou(a: Column, b: Column) -> Column:
    union = area(a) + area(b) - intersection(a, b)
    return F.when(union > 0, intersection(a, b) / union).otherwise(0.0)


def overlap_share(a: Column, b: Column) -> Column:
    """Intersection over the smaller area; 0 if that is 0."""
    least = F.least(area(a), area(b))
    return F.when(least > 0, intersection(a, b) / least).otherwise(0.0)


def clip(r: Column, to: Column) -> Column:
    x, y = F.greatest(r["x"], to["x"]), F.greatest(r["y"], to["y"])
    return rect(x, y, F.least(r["x"] + r["width"], to["x"] + to["width"]) - x, F.least(r["y"] + r["height"], to["y"] + to["height"]) - y)


def pad(r: Column, by: Column) -> Column:
    return rect(r["x"] - by, r["y"] - by, r["width"] + 2 * by, r["height"] + 2 * by)


def scale(r: Column, sx: Column, sy: Column) -> Column:
    return rect(r["x"] * sx, r["y"] * sy, r["width"] * sx, r["height"] * sy)


def moved(r: Column, dx: Column, dy: Column) -> Column:
    return rect(r["x"] + dx, r["y"] + dy, r["width"], r["height"])
