"""Boxes as arrays of points (x, y). Points with fewer than two numbers are passed over; a box without points has measures 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _along(bbox: Column, axis: int) -> Column:
    points = F.filter(F.coalesce(bbox, F.array().cast("array<array<double>>")), lambda p: F.size(p) >= 2)
    return F.transform(points, lambda p: F.get(p, F.lit(axis)))


def top(bbox: Column) -> Column:
    return F.coalesce(F.array_min(_along(bbox, 1)), F.lit(0.0))


def bottom(bbox: Column) -> Column:
    return F.coalesce(F.array_max(_along(bbox, 1)), F.lit(0.0))


def left(bbox: Column) -> Column:
    return F.coalesce(F.array_min(_along(bbox, 0)), F.lit(0.0))


def right(bbox: Column) -> Column:
    return F.coalesce(F.array_max(_along(bbox, 0)), F.lit(0.0))


def height(bbox: Column) -> Column:
    return F.greatest(F.lit(0.0), bottom(bbox) - top(bbox))


def width(bbox: Column) -> Column:
    return F.greatest(F.lit(0.0), right(bbox) - left(bbox))


def center_y(bbox: Column) -> Column:
    ys = _along(bbox, 1)
    return F.when(F.size(ys) == 0, 0.0).otherwise(F.aggregate(ys, F.lit(0.0), lambda a, y: a + y) / F.size(ys))


def gap(upper: Column, lower: Column) -> Column:
    return F.greatest(F.lit(0.0), top(lower) - bottom(upper))


def box(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """The four corners, clockwise from the top left."""
    return F.array(F.array(left, top), F.array(right, top), F.array(right, bottom), F.array(left, bottom))
