"""Algebra of runs: sets of pixels as rows (roi, y, x0, x1), both ends included, so that work follows outlines and not areas.

Runs are cut at the borders of tiles of a row first, so no group holds more than the runs of one short stretch, however large an image is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rastrel.schema import q

#: Pixels of a stretch; runs are cut at its borders.
STRETCH = 256


def cut_runs(runs: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """The same pixels in runs that lie in one stretch of a row each: all columns, and the stretch ``_t``."""
    first, last = F.floor(F.col("x0") / stretch).cast("int"), F.floor(F.col("x1") / stretch).cast("int")
    cut = runs.where("x0 <= x1").withColumn("_t", F.explode(F.sequence(first, last)))
    return cut.withColumns({
        "x0": F.greatest("x0", F.col("_t") * stretch).cast("int"), "x1": F.least("x1", (F.col("_t") + 1) * stretch - 1).cast("int")})


def union_runs(runs: DataFrame, keys: Sequence[str] = ("roi",), stretch: int = STRETCH) -> DataFrame:
    """(keys, y, x0, x1): every pixel of the runs once, in as few runs as the stretches allow.

    A run begins an island unless an earlier one of its stretch reaches it.
    """
    ks = [*[q(k) for k in keys], F.col("y"), F.col("_t")]
    rows = cut_runs(runs.select(*[q(k) for k in keys], "y", "x0", "x1"), stretch).distinct()
    order = Window.partitionBy(*ks).orderBy("x0", "x1")
    reach = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = rows.withColumn("_new", F.coalesce((F.col("x0") > reach + 1).cast("int"), F.lit(1)))
    islands = begins.withColumn("_n", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy(*ks, "_n").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    return merged.select(*[q(k) for k in keys], "y", "x0", "x1")


def _segments(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, y, _t, _s, _e): the stretches between neighbouring ends of runs, each covered wholly or not at all by any run."""
    ks = [*[q(k) for k in keys], F.col("y"), F.col("_t")]
    ends = runs.select(*ks, F.explode(F.array(F.col("x0"), F.col("x1") + 1)).alias("_s")).distinct()
    following = F.lead("_s").over(Window.partitionBy(*ks).orderBy("_s"))
    return ends.withColumn("_e", following - 1).where("_e IS NOT NULL")


def layered_runs(runs: DataFrame, more: Sequence[str], keys: Sequence[str] = ("roi",), stretch: int = STRETCH) -> DataFrame:
    """(keys, y, x0, x1, more): runs cut where others of their row begin or end, so that two pieces are one place or don't meet."""
    rows = cut_runs(runs.select(*[q(k) for k in keys], "y", "x0", "x1", *[q(c) for c in more]), stretch)
    covered = _segments(rows, keys).join(rows, [*keys, "y", "_t"]).where("x0 <= _s AND _e <= x1")
    return covered.select(*[q(k) for k in keys], "y", F.col("_s").alias("x0"), F.col("_e").alias("x1"), *[q(c) for c in more])


def last_wins(runs: DataFrame, order: str, keys: Sequence[str] = ("roi",), stretch: int = STRETCH) -> DataFrame:
    """(keys, y, x0, x1, order): of runs that overlap the one with the largest ``order``; covered parts are cut off."""
    place = [*[q(k) for k in keys], "y", "x0", "x1"]
    return layered_runs(runs, [order], keys, stretch).groupBy(*place).agg(F.max(q(order)).alias(order))


def intersect_runs(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("roi",), stretch: int = STRETCH) -> DataFrame:
    """(keys, y, x0, x1): pixels in runs of both sides."""
    ks = [q(k) for k in keys]
    left = cut_runs(union_runs(a, keys, stretch), stretch)
    right = cut_runs(union_runs(b, keys, stretch), stretch).withColumnsRenamed({"x0": "_x0", "x1": "_x1"})
    both = left.join(right, [*keys, "y", "_t"])
    return both.select(*ks, "y", F.greatest("x0", "_x0").alias("x0"), F.least("x1", "_x1").alias("x1")).where("x0 <= x1")


def subtract_runs(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("roi",), stretch: int = STRETCH) -> DataFrame:
    """(keys, y, x0, x1): pixels in runs of the first side and of none of the second."""
    ks = [q(k) for k in keys]
    sides = a.select(*ks, "y", "x0", "x1", F.lit(0).alias("_side")).unionByName(b.select(*ks, "y", "x0", "x1", F.lit(1).alias("_side")))
    return last_wins(sides, "_side", keys, stretch).where("_side = 0").drop("_side")


def run_pixels(runs: DataFrame, *more: str) -> DataFrame:
    """Every pixel of the runs: (roi, more, y, x)."""
    return runs.select("roi", *[q(c) for c in more], "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def run_area(runs: DataFrame, keys: Sequence[str] = ("roi",)) -> DataFrame:
    """(keys, pixels): pixels that at least one run covers, counted without unrolling any."""
    return union_runs(runs, keys).groupBy(*[q(k) for k in keys]).agg(F.sum(F.col("x1") - F.col("x0") + 1).cast("bigint").alias("pixels"))
