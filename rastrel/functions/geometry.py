"""Expressions on windows, boxes and drawn paths."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def ordered_bounds(x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Window or rectangle corners in any order as min/max; all NULL when one is missing."""
    known = x0.isNotNull() & x1.isNotNull() & y0.isNotNull() & y1.isNotNull()
    return F.struct(
        F.when(known, F.least(x0, x1)).alias("x_min"),
        F.when(known, F.greatest(x0, x1)).alias("x_max"),
        F.when(known, F.least(y0, y1)).alias("y_min"),
        F.when(known, F.greatest(y0, y1)).alias("y_max"),
    )


def path_vertices(path: Column) -> Column:
    """'M x,y L x,y ... Z' to integer vertices, rounded half to even."""
    def vertex(point: Column) -> Column:
        xy = F.split(F.trim(point), ",")
        whole = lambda i: F.rint(F.get(xy, F.lit(i)).cast("double")).cast("int")
        return F.struct(whole(0).alias("x"), whole(1).alias("y"))

    return F.transform(F.split(F.regexp_replace(path, "[MZ]", ""), "L"), vertex)


def vertex_bounds(vertices: Column) -> Column:
    xs = F.transform(vertices, lambda v: v["x"])
    ys = F.transform(vertices, lambda v: v["y"])
    return F.struct(
        F.array_min(xs).alias("x_min"), F.array_max(xs).alias("x_max"),
        F.array_min(ys).alias("y_min"), F.array_max(ys).alias("y_max"),
    )


def recentre_window(x_low: Column, x_high: Column, y_low: Column, y_high: Column,
                    x: Column, y: Column) -> Column:
    """A window of the same size around a requested point."""
    half_x = F.abs(x_high - x_low) / 2
    half_y = F.abs(y_high - y_low) / 2
    return F.struct(
        (x - half_x).alias("x_low"), (x + half_x).alias("x_high"),
        (y - half_y).alias("y_low"), (y + half_y).alias("y_high"),
    )


def affine_window(x_low: Column, x_high: Column, y_low: Column, y_high: Column,
                  x_offset: Column, y_offset: Column, matrix: Sequence[Sequence[float]],
                  scale: float = 0.21) -> Column:
    """Canvas window to slide coordinates through the inverse of a 3x3 affine matrix.

    Negative scaled corners become 0.1 before the transform; width and height are truncated.
    """
    inverse = np.linalg.inv(np.asarray(matrix, dtype=float)).tolist()

    def corner(x: Column, y: Column) -> tuple[Column, Column]:
        px, py = (x + x_offset) / scale, (y + y_offset) / scale
        px = F.when(px < 0, F.lit(0.1)).otherwise(px)
        py = F.when(py < 0, F.lit(0.1)).otherwise(py)
        return tuple(px * row[0] + py * row[1] + row[2] for row in inverse[:2])

    low, high = corner(x_low, y_low), corner(x_high, y_high)
    x_min, x_max = F.least(low[0], high[0]), F.greatest(low[0], high[0])
    y_min, y_max = F.least(low[1], high[1]), F.greatest(low[1], high[1])
    return F.struct(
        x_min.alias("x"), y_min.alias("y"),
        (x_max - x_min).cast("bigint").alias("width"),
        (y_max - y_min).cast("bigint").alias("height"),
    )


def grid_positions(size: Column, dim: int = 100) -> Column:
    """Grid line positions along an axis of ``size`` pixels; empty below two grid cells."""
    count = F.floor(size / dim).cast("int")
    last = size - 1
    # same two-step product as an evenly spaced range, whose end point is exact
    step = F.try_divide(last.cast("double"), (count - 1).cast("double"))
    spaced = F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.when(i == count - 1, last).otherwise(F.floor(i * step)).cast("int"),
    )
    return F.when(size >= 2 * dim, spaced).otherwise(F.array().cast("array<int>"))
