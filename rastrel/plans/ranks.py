"""Exact ranks, percentiles and fixed-size selections without sorting a group in one task.

Each function first counts rows per (group, bucket), where a bucket is a monotone function of
the ordering value, finds by a running sum over the few buckets which ones matter, and only
sorts inside those. Buckets are computed from the value alone, so a recomputed task after an
executor loss gives the same answer.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastrel.schema import q


NAN_BUCKET = (1 << 63) - 1


def magnitude_bucket(value: Column, parts: int = 4096) -> Column:
    """Monotone bucket number: every power of two is cut into ``parts`` equal pieces.

    Heavy-tailed intensities spread over many buckets; 32-bit floats leave at most 2048
    different values per bucket. Infinities have the outermost buckets, NaN one above them.
    """
    size = F.abs(value)
    exponent = F.floor(F.log2(size)).cast("int")
    piece = F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * parts)
    number = ((exponent + 1100) * parts + piece).cast("bigint")
    return (
        F.when(F.isnan(value), F.lit(NAN_BUCKET))
        .when(size == F.lit(float("inf")), F.when(value > 0, F.lit(NAN_BUCKET - 1)).otherwise(F.lit(1 - NAN_BUCKET)))
        .when(value == 0, F.lit(0).cast("bigint"))
        .when(value > 0, number).otherwise(-number)
    )


def percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    points: Mapping[str, float],
    zeros: DataFrame | None = None,
) -> DataFrame:
    """Exact linear-interpolated percentiles of ``value`` per group (numpy's default rule).

    ``points`` maps an output column to a fraction in 0..1. NULL values are ignored; a group with a
    NaN gives NaN. Equal values are counted before anything else is shuffled by group. ``zeros``
    (keys, zeros) adds that many values 0 to a group without storing them.
    """
    counted = (
        df.where(q(value).isNotNull())
        .groupBy(*[q(k) for k in keys], q(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return percentiles_of_counts(counted, keys, points, zeros)


def percentiles_of_counts(
    counted: DataFrame, keys: Sequence[str], points: Mapping[str, float], zeros: DataFrame | None = None,
) -> DataFrame:
    """The same from rows (keys, _v, _n): how often each value, none of them NULL, occurs in a group."""
    ks = [q(k) for k in keys]
    if zeros is not None:
        more = zeros.where(F.col("zeros") > 0).select(*ks, F.lit(0.0).alias("_v"), F.col("zeros").cast("bigint").alias("_n"))
        counted = counted.union(more).groupBy(*ks, "_v").agg(F.sum("_n").alias("_n"))
    counted = counted.withColumn("_b", magnitude_bucket(F.col("_v")))
    group = Window.partitionBy(*ks)
    buckets = (
        counted.groupBy(*ks, "_b").agg(F.sum("_n").alias("_n"))
        .withColumn("_end", F.sum("_n").over(group.orderBy("_b")))
        .withColumn("_total", F.sum("_n").over(group))
        .withColumn("_start", F.col("_end") - F.col("_n"))
        .withColumn("_nan", F.max(F.col("_b") == F.lit(NAN_BUCKET)).over(group))
    )
    targets = F.array(*[
        F.struct(
            F.lit(name).alias("name"),
            (F.lit(float(p)) * (F.col("_total") - 1)).alias("pos"),
        )
        for name, p in points.items()
    ])
    low, high = F.floor("_t.pos"), F.ceil("_t.pos")
    inside = lambda rank, a, b: (rank >= F.col(a)) & (rank < F.col(b))
    wanted = (
        buckets.withColumn("_t", F.explode(targets))
        .where(inside(low, "_start", "_end") | inside(high, "_start", "_end"))
        .select(*ks, "_b", "_start", "_nan", "_t")
    )
    cells = Window.partitionBy(*ks, "_b", "_t.name").orderBy("_v")
    ranked = (
        counted.join(wanted, [*keys, "_b"])
        .withColumn("_to", F.col("_start") + F.sum("_n").over(cells))
        .withColumn("_from", F.col("_to") - F.col("_n"))
    )
    columns = []
    for name in points:
        here = F.col("_t.name") == name
        lo = F.max(F.when(here & inside(low, "_from", "_to"), F.col("_v")))
        hi = F.max(F.when(here & inside(high, "_from", "_to"), F.col("_v")))
        part = F.max(F.when(here, F.col("_t.pos") - low))
        between = F.when((part == 0) | (lo == hi), lo).otherwise(lo + (hi - lo) * part)
        columns.append(F.when(F.max("_nan"), F.lit(float("nan"))).otherwise(between).alias(name))
    return ranked.groupBy(*ks).agg(*columns)


def rank_within(
    df: DataFrame, keys: Sequence[str], order: str, name: str, rows: int = 65536
) -> DataFrame:
    """1-based position of a row among its group by an integer column unique in the group.

    Rows are numbered inside stretches of order values and shifted by the number of rows in earlier
    stretches. Stretches are as wide as holds ``rows`` of all rows on average, from the measured range and
    count, so sparse order values (hashes, times) don't make a stretch of every row.
    """
    ks = [q(k) for k in keys]
    value = q(order).cast("double")
    wide = F.greatest(F.lit(1.0), (F.max(value) - F.min(value) + 1) / F.count(F.lit(1)) * rows)
    stats = df.agg(F.struct(F.min(value).alias("low"), wide.alias("wide")).alias("s")).scalar()
    cut = df.withColumn("_m", stats).withColumn("_s", F.floor((value - F.col("_m.low")) / F.col("_m.wide"))).drop("_m")
    sizes = cut.groupBy(*ks, "_s").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*ks).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*ks, "_s").orderBy(q(order))
    return (
        cut.join(starts, [*keys, "_s"])
        .withColumn(name, (F.col("_before") + F.row_number().over(inside)).cast("bigint"))
        .drop("_s", "_before")
    )


def take_smallest(
    df: DataFrame, keys: Sequence[str], order: str, count: int, shift: int = 48
) -> DataFrame:
    """The ``count`` rows with the smallest 64-bit ``order`` value per group, exactly.

    Meant for hash orders (sampling): the top bits of the hash give the buckets, and rows are
    numbered inside the buckets up to the one in which the count is reached.
    """
    ks = [q(k) for k in keys]
    cut = df.withColumn("_s", F.shiftright(q(order), shift))
    sizes = cut.groupBy(*ks, "_s").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(*ks).orderBy("_s")
    useful = (
        sizes.withColumn("_end", F.sum("_n").over(running))
        .withColumn("_room", F.lit(count) - (F.col("_end") - F.col("_n")))
        .where(F.col("_room") > 0)
        .drop("_n")
    )
    kept = cut.join(useful, [*keys, "_s"])
    # only rows of useful buckets are left, about as many as are wanted
    inside = Window.partitionBy(*ks, "_s").orderBy(q(order))
    ranked = kept.withColumn("_r", F.row_number().over(inside))
    return ranked.where((F.col("_end") <= count) | (F.col("_r") <= F.col("_room"))).drop("_s", "_end", "_room", "_r")
