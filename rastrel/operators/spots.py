"""Spatial expression: spots or cells with coordinates and sparse gene counts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastrel.plans.joins import lookup_join
from rastrel.plans.ranks import rank_within

#: Side of the arrays that spots are painted on.
TILE = 128

# Default marker radii and the numerator of the spot array scale.
SPOT_RADIUS = 55
OTHER_RADIUS = 1
CAPTURE_SIZE = 65
BORDER = 0.03


def with_spot_scale(meta: DataFrame, radius: int | None = None, downscale: bool = True) -> DataFrame:
    """Marker radius and coordinate scale of each image.

    ``meta`` carries roi, spot_based (array of round spots) and spot_diameter (NULL when unknown).
    Spot arrays use half their diameter, truncated; others a given radius. Only spot arrays scale.
    """
    based = F.coalesce("spot_based", F.lit(False))
    own = F.floor(F.col("spot_diameter") / 2).cast("int")
    fallback = F.when(based, F.lit(SPOT_RADIUS)).otherwise(F.lit(radius or OTHER_RADIUS))
    chosen = F.coalesce(F.when(~based & F.lit(radius is not None), F.lit(radius)), own, fallback)
    scaled = F.when(based & F.lit(downscale), F.try_divide(F.lit(float(CAPTURE_SIZE)), F.col("radius") * 2.0)).otherwise(F.lit(1.0))
    return meta.withColumn("radius", chosen.cast("int")).withColumn("scale", scaled)


def _single(value: Column) -> Column:
    return value.cast("float")


def spatial_extent(spots: DataFrame, scales: DataFrame, border: float = BORDER) -> DataFrame:
    """Canvas of each image: (roi, grid_width, grid_height, x_min, y_min).

    Spot arrays get a border of 3 %; the upper border is measured from the already lowered minimum.
    """
    place = lambda c: _single(_single(F.col(c)) * F.col("scale"))
    ranges = lookup_join(spots.select("roi", "x", "y"), scales.select("roi", "scale", "spot_based"), ["roi"])
    box = ranges.groupBy("roi").agg(
        *[f(place(c)).cast("double").alias(f"{c}{n}") for c in ("x", "y") for f, n in ((F.min, 0), (F.max, 1))],
        F.max("spot_based").alias("based"),
    )
    cut = lambda c: c.cast("bigint").cast("double")
    bordered = F.coalesce("based", F.lit(False))
    for axis in ("x", "y"):
        low, high = F.col(f"{axis}0"), F.col(f"{axis}1")
        box = box.withColumn(f"{axis}0", F.when(bordered, cut(low - cut(border * (high - low)))).otherwise(low))
        low = F.col(f"{axis}0")
        box = box.withColumn(f"{axis}1", F.when(bordered, cut(high + cut(border * (high - low)))).otherwise(high))
    return box.select(
        "roi", cut(F.col("x1") - F.col("x0")).cast("bigint").alias("grid_width"),
        cut(F.col("y1") - F.col("y0")).cast("bigint").alias("grid_height"),
        F.col("x0").alias("x_min"), F.col("y0").alias("y_min"),
    )


@cache
def disk(size: int) -> np.ndarray:
    """Pixels (dy, dx) with dy*dy + dx*dx < size*size, around the middle of a (2*size - 1)-sided square."""
    d = np.arange(1 - size, size, dtype=np.int64) ** 2
    return d[:, None] + d[None, :] < size * size


#: Cells of the arrays that are painted together, and of disks that are raised at once.
CELLS = 1 << 20


@cache
def _offsets(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a disk's pixels, from its middle."""
    dy, dx = np.nonzero(disk(size))
    return dy - (size - 1), dx - (size - 1)


def _painted_tiles(rows: dict[str, np.ndarray], at: np.ndarray, n: int, tile: int) -> np.ndarray:
    """Stack of ``n`` tiles; spot i of ``rows`` raises the pixels under its disk in tile ``at[i]`` to its value."""
    canvas = np.zeros(n * tile * tile, dtype=rows["value"].dtype)
    for size in np.unique(rows["_size"]).tolist():
        dy, dx = _offsets(size)
        own = np.flatnonzero(rows["_size"] == size)
        step = max(1, CELLS // len(dy))
        for part in (own[i:i + step] for i in range(0, len(own), step)):
            one = {c: a[part, None] for c, a in rows.items()}
            ys, xs = one["fy"] + dy, one["fx"] + dx
            # positions are cut towards zero, so those between -1 and 0 land on the first row or column as well
            ys, xs = np.where((ys == -1) & one["oy"], 0, ys), np.where((xs == -1) & one["ox"], 0, xs)
            y, x = ys - one["ty"] * tile, xs - one["tx"] * tile
            seen = (y >= 0) & (y < tile) & (x >= 0) & (x < tile) & (ys < one["_h"]) & (xs < one["_w"])
            value = np.broadcast_to(one["value"], seen.shape)[seen]
            np.maximum.at(canvas, (at[part, None] * (tile * tile) + y * tile + x)[seen], value)
    return canvas.reshape(n, tile, tile)


def rasterize_spots(values: DataFrame, scales: DataFrame, extents: DataFrame,
                    downscale: bool = True, tile: int = TILE) -> DataFrame:
    """Markers as disks on a raster; where disks meet, the largest value stays.

    ``values`` is (roi, gene, x, y, value); only values above 0 are drawn. Result is sparse:
    (roi, channel, y, x, value). Spots at one place are reduced to their largest value first, which bounds
    what a tile can hold; then each spot goes to the tiles it touches, and a tile is painted as one array.
    """
    frame = extents.join(scales.select("roi", "scale", "radius"), "roi")
    size = F.floor(F.col("radius") * F.col("scale")).cast("int") if downscale else F.col("radius").cast("int")
    placed = lookup_join(values.where(F.col("value") > 0), frame.withColumn("_size", size), ["roi"]).where(F.col("_size") > 0)
    at = lambda c, low: _single(_single(_single(F.col(c)) * F.col("scale")).cast("double") - F.col(low)).cast("double")
    spots = placed.select(
        "roi", F.col("gene").alias("channel"), "value", at("y", "y_min").alias("_y"), at("x", "x_min").alias("_x"),
        F.col("grid_width").cast("int").alias("_w"), F.col("grid_height").cast("int").alias("_h"), "_size",
    ).withColumns({"fy": F.floor("_y").cast("int"), "fx": F.floor("_x").cast("int")})
    spots = spots.withColumns({"oy": F.col("_y") != F.col("fy"), "ox": F.col("_x") != F.col("fx")})
    once = spots.groupBy("roi", "channel", "_w", "_h", "_size", "fy", "oy", "fx", "ox").agg(F.max("value").alias("value"))

    def touched(place: str, off: str, length: str) -> Column:
        low = F.greatest(F.col(place) - F.col("_size") + 1, F.lit(0))
        end = F.col(place) + F.col("_size") - 1
        end = F.when((end == -1) & F.col(off), F.lit(0)).otherwise(end)
        high = F.least(end, F.col(length) - 1)
        # a disk beside the raster touches no tile
        return F.when(low <= high, F.sequence(F.floor(low / tile).cast("int"), F.floor(high / tile).cast("int"))).otherwise(F.array().cast("array<int>"))

    key = ["roi", "channel", "ty", "tx"]
    tiled = once.withColumn("ty", F.explode(touched("fy", "oy", "_h"))).withColumn("tx", F.explode(touched("fx", "ox", "_w")))
    dealt = tiled.repartition(*key).sortWithinPartitions(*key)
    kinds = {c: dealt.schema[c].dataType.simpleString() for c in ("roi", "channel", "value")}

    def finished(rows: dict[str, np.ndarray], starts: np.ndarray) -> Iterator[pd.DataFrame]:
        ends = np.r_[starts[1:], len(rows["value"])]
        step = max(1, CELLS // (tile * tile))
        for i in range(0, len(starts), step):
            low, high, own = starts[i], ends[min(i + step, len(starts)) - 1], starts[i:i + step]
            at = np.repeat(np.arange(len(own)), ends[i:i + step] - own)
            canvas = _painted_tiles({c: rows[c][low:high] for c in painted}, at, len(own), tile)
            n, y, x = np.nonzero(canvas)
            yield pd.DataFrame({
                "roi": rows["roi"][own[n]], "channel": rows["channel"][own[n]], "y": (y + rows["ty"][own[n]] * tile).astype(np.int32),
                "x": (x + rows["tx"][own[n]] * tile).astype(np.int32), "value": canvas[n, y, x],
            })

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            if batch.empty:
                continue
            new = {c: batch[c].to_numpy() for c in columns}
            rows = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in columns}
            changed = np.zeros(len(batch) + (0 if held is None else len(held["value"])) - 1, dtype=bool)
            for k in key:
                changed |= (rows[k][1:] != rows[k][:-1]).astype(bool)
            starts = np.r_[0, np.flatnonzero(changed) + 1]
            # the last tile may go on in the next batch; its spots are at different places, a bounded number
            cut = int(starts[-1])
            if cut:
                yield from finished({c: v[:cut] for c, v in rows.items()}, starts[:-1])
            held = {c: v[cut:] for c, v in rows.items()}
        if held is not None:
            yield from finished(held, np.zeros(1, dtype=np.int64))

    painted = ("value", "_size", "fy", "oy", "fx", "ox", "ty", "tx", "_h", "_w")
    columns = ["roi", "channel", *painted]
    return dealt.select(*columns).mapInPandas(run, f"roi {kinds['roi']}, channel {kinds['channel']}, y int, x int, value {kinds['value']}")


def number_spots(spots: DataFrame, order: str = "spot_id") -> DataFrame:
    """Spots with an object id 1..n per image in the order of an integer column."""
    return rank_within(spots, ["roi"], order, "object_id")


def spot_mask(spots: DataFrame, scales: DataFrame, extents: DataFrame) -> DataFrame:
    """Label mask of spots: each spot paints its number, the highest number stays."""
    numbered = number_spots(spots).select(
        "roi", F.lit("mask").alias("gene"), "x", "y", F.col("object_id").alias("value")
    )
    return rasterize_spots(numbered, scales, extents).select("roi", "y", "x", F.col("value").alias("object_id"))


def obs_projection(spots: DataFrame, order: str = "spot_id") -> DataFrame:
    """Metadata of spots with an object id that matches the spot mask; any cell_id is dropped."""
    return number_spots(spots.drop("cell_id"), order)


def scale_bins(spots: DataFrame, bin_size: int | Column) -> DataFrame:
    """Coordinates of square bins divided by the bin size, which is kept as ``bin``."""
    size = bin_size if isinstance(bin_size, Column) else F.lit(int(bin_size))
    return spots.withColumn("bin", size).withColumns({
        "x": F.col("x") / F.col("bin").cast("double"), "y": F.col("y") / F.col("bin").cast("double"),
    })


def unique_genes(genes: DataFrame) -> DataFrame:
    """Gene names made unique by -1, -2, ... on repeats. ``genes`` is (position, gene)."""
    numbered = rank_within(genes, ["gene"], "position", "_n")
    return numbered.withColumn(
        "gene", F.when(F.col("_n") == 1, F.col("gene")).otherwise(
            F.concat("gene", F.lit("-"), (F.col("_n") - 1).cast("string"))
        ),
    ).drop("_n")


def shape_scales(shapes: DataFrame) -> DataFrame:
    """Spot diameter of each region whose shapes all have one radius: (region, spot_diameter)."""
    return shapes.groupBy("region").agg(
        F.min("radius").alias("low"), F.max("radius").alias("high"), F.count("radius").alias("n"),
        F.count(F.lit(1)).alias("rows"),
    ).select(
        "region",
        F.when((F.col("low") == F.col("high")) & (F.col("n") == F.col("rows")), F.col("low") * 2).alias("spot_diameter"),
    )


def split_by_region(spots: DataFrame, shapes: DataFrame, region: str = "region") -> DataFrame:
    """Spots of known regions as images of their own, with the region's spot diameter."""
    scales = shape_scales(shapes).withColumnRenamed("region", "_region")
    joined = lookup_join(spots.withColumn("_region", F.col(region)), scales, ["_region"])
    return joined.withColumn("roi", F.concat("_region", F.lit("+++slideNA+++acq"))).drop("_region")


def technology(columns: list[str], tables: list[str] = (), shapes: list[str] = ()) -> str | None:
    """Kind of a spatial set by its columns, tables and shapes.

    Returns 'cells', 'bins', 'spots', 'points' or None for a set without coordinates.
    """
    # Identifiers of square-bin tables and of cell-boundary shapes.
    bins = ["square_002um", "square_008um", "square_016um"]
    cells = ["cell_boundaries", "nucleus_boundaries", "cell_circles"]
    if any(s in shapes for s in cells):
        return "cells"
    if any(t in tables for t in bins):
        return "bins"
    if not {"x", "y"} <= set(columns):
        return None
    if {"array_row", "array_col", "spot_diameter"} <= set(columns):
        return "spots"
    return "points"


def window_to_slide(spots: DataFrame, scales: DataFrame, extents: DataFrame,
                    windows: DataFrame) -> DataFrame:
    """Slide rectangle (x, y, width, height) of the spots seen in a canvas window of each image.

    ``windows`` is (roi, x_low, x_high, y_low, y_high); bins multiply by their size.
    """
    frame = (
        windows.join(scales.select("roi", "scale"), "roi")
        .join(extents.select("roi", "x_min", "y_min"), "roi")
    )
    placed = lookup_join(spots, frame, ["roi"])
    px = F.col("x") * F.col("scale") - F.col("x_min")
    py = F.col("y") * F.col("scale") - F.col("y_min")
    seen = placed.where(px.between(F.col("x_low"), F.col("x_high")) & py.between(F.col("y_low"), F.col("y_high")))
    size = F.coalesce(F.max("bin"), F.lit(1)) if "bin" in spots.columns else F.lit(1)
    whole = lambda c: (F.max(c) - F.min(c)).cast("bigint")
    return seen.groupBy("roi").agg(
        (F.min("x") * size).alias("x"), (F.min("y") * size).alias("y"),
        (whole("x") * size).alias("width"), (whole("y") * size).alias("height"),
    )
