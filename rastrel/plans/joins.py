"""Join shapes that stay even when one image holds a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 64


def unrolled(df: DataFrame) -> DataFrame:
    """Marks a table made longer by unrolling, whose size the planner underestimates.

    Such a side is never broadcast on that estimate; both sides are shuffled and skewed parts are
    split at run time.
    """
    return df.hint("merge")


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows spread over as many tasks as a shuffle has before they are unrolled: their size says nothing of that of the result,
    and by it they would be put together in one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


#: Rows of an unrolled side that may be broadcast; a row of a tiled box takes about 100 bytes.
MOST_BROADCAST = 100_000


def measured(df: DataFrame, rows: int) -> DataFrame:
    """An unrolled side with its counted size: broadcast when that is small, so that the other side need not
    be shuffled, else marked as ``unrolled``."""
    return F.broadcast(df) if rows <= MOST_BROADCAST else unrolled(df)


def lookup_join(
    rows: DataFrame,
    groups: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    spread: int = 8,
    spread_by: Sequence[str] | None = None,
) -> DataFrame:
    """Attach a one-row-per-group table to a row table whose groups are uneven.

    When the planner finds ``groups`` small it broadcasts it; when it is not, the salt cuts a hot
    group into ``spread`` parts so no reducer gets a whole image.
    """
    by = list(spread_by) if spread_by else [c for c in rows.columns if c not in on]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(spread)).cast("int"))
    copies = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def tile_of(coordinate: Column, tile: int = TILE) -> Column:
    return F.floor(coordinate / tile).cast("int")


def fitting_tile(boxes: DataFrame, largest: int = 256) -> int:
    """Tile side of one to two times the average box side: a box is copied to few tiles, and its tiles hold few times its own points.

    One averaged row comes to the driver. Any side gives right results.
    """
    side = F.least(F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min"))
    mean = boxes.agg(F.avg(side.cast("double")).alias("s")).first()["s"] or 1.0
    tile = 1
    while tile < mean and tile < largest:
        tile *= 2
    return tile


def over_tiles(df: DataFrame, low: Column, high: Column, name: str, tile: int = TILE) -> DataFrame:
    """One row per tile that the interval [low, high] touches."""
    return df.withColumn(
        name, F.explode(F.sequence(tile_of(low, tile), tile_of(high, tile)))
    )


def points_in_boxes(
    points: DataFrame,
    boxes: DataFrame,
    on: Sequence[str],
    x: str = "x",
    y: str = "y",
    tile: int = TILE,
    closed: bool = True,
) -> DataFrame:
    """Range join as an equi join on tiles, followed by the exact test.

    ``boxes`` carries x_min, x_max, y_min, y_max. Points keep one row each; only boxes are
    copied, once per tile touched, which is at most 1/tile**2 of the area they select. The number of
    copies is counted first: few are broadcast, many are shuffled with the points.
    """
    tiled_boxes = over_tiles(
        over_tiles(boxes, F.col("x_min"), F.col("x_max"), "_tx", tile),
        F.col("y_min"), F.col("y_max"), "_ty", tile,
    )
    tiled_points = points.withColumn("_tx", tile_of(F.col(x), tile)).withColumn(
        "_ty", tile_of(F.col(y), tile)
    )
    upper = (lambda c, hi: c <= hi) if closed else (lambda c, hi: c < hi)
    tiles = lambda low, high: (tile_of(F.col(high), tile) - tile_of(F.col(low), tile) + 1).cast("bigint")
    rows = boxes.agg(F.sum(tiles("x_min", "x_max") * tiles("y_min", "y_max")).alias("n")).first()["n"] or 0
    joined = tiled_points.join(measured(tiled_boxes, rows), [*on, "_ty", "_tx"])
    return joined.where(
        (F.col(x) >= F.col("x_min")) & upper(F.col(x), F.col("x_max"))
        & (F.col(y) >= F.col("y_min")) & upper(F.col(y), F.col("y_max"))
    ).drop("_tx", "_ty")
