"""Stored display settings applied to pixels: bounds, then filters, then colours, then the filter of the whole blend."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastrel.functions.colour import recolour, scale_intensity
from rastrel.operators.raster import filled_lines, with_channel_params
from rastrel.operators.stencils import channel_filter, global_filter
from rastrel.plans.joins import lookup_join
from rastrel.session import stored

#: A preset is applied only if it has all of these.
PRESET = ("x_lower_bound", "x_upper_bound", "filter_type", "filter_val")


def filled(pixels: DataFrame, extent: DataFrame, channels: Sequence[str], zero: DataFrame) -> DataFrame:
    """Pixels of all places: absent ones take their channel's value of ``zero`` (channel, zero)."""
    panel = zero.where(F.col("channel").isin(list(channels))).select("channel", "zero")
    names = F.explode(F.array(*[F.lit(c) for c in channels])).alias("channel")
    images = extent.select("roi", "width", "height", names).join(F.broadcast(panel), "channel", "left")
    return filled_lines(pixels.select("roi", "channel", "y", "x", F.col("value").cast("double").alias("value")), images, F.coalesce("zero", F.lit(0.0)))


def filtered_channels(pixels: DataFrame, extent: DataFrame, params: DataFrame) -> DataFrame:
    """Each channel filtered as its parameters say (filter_type, filter_val, filter_sigma).

    Channels with equal settings go through one filter together; the panel's settings come to the driver.
    """
    groups: dict[tuple, list[str]] = {}
    for r in params.select("channel", "filter_type", "filter_val", "filter_sigma").collect():
        on = r["filter_type"] is not None and r["filter_val"] is not None
        key = (r["filter_type"], int(r["filter_val"]), float(r["filter_sigma"] if r["filter_sigma"] is not None else 1.0)) if on else ()
        groups.setdefault(key, []).append(r["channel"])
    parts = []
    for key, channels in sorted(groups.items(), key=str):
        own = pixels.where(F.col("channel").isin(channels)).select("roi", "channel", "y", "x", F.col("value").cast("double").alias("value"))
        done = channel_filter(own, extent, *key) if key else own
        parts.append(done.select("roi", "channel", "y", "x", "value"))
    return reduce(DataFrame.unionByName, parts) if parts else pixels


def preset_pixels(pixels: DataFrame, extent: DataFrame, preset: Mapping | None) -> DataFrame:
    """Dense pixels stretched by a preset's bounds and filtered as it says; unchanged by an incomplete preset."""
    if not preset or any(k not in preset for k in PRESET):
        return pixels
    number = lambda k: F.lit(preset[k]).cast("double")
    scaled = pixels.withColumn("value", scale_intensity(F.col("value"), number("x_lower_bound"), number("x_upper_bound")))
    sigma = preset.get("filter_sigma")
    return channel_filter(scaled, extent, preset["filter_type"], preset["filter_val"], 1.0 if sigma is None else sigma, preset=True)


def blend_filtered(pixels: DataFrame, extent: DataFrame, params: DataFrame, kind: str | None = None,
                   size: int | None = None, sigma: float = 1.0) -> DataFrame:
    """Additive image (roi, y, x, r, g, b) of stretched, filtered and recoloured channels, then filtered as a whole.

    Pixels may be stored sparsely. ``kind``, ``size`` and ``sigma`` are the global filter; a filtered blend is
    rounded to whole numbers again.
    """
    channels = [r["channel"] for r in params.select("channel").collect()]
    scaled = with_channel_params(pixels, params).select("roi", "channel", "y", "x", F.col("scaled").alias("value"))
    nothing = scale_intensity(F.lit(0.0), F.col("x_lower_bound"), F.col("x_upper_bound"))
    whole = filled(scaled, extent, channels, params.select("channel", nothing.alias("zero")))
    done = filtered_channels(whole, extent, params)
    coloured = with_channel_params(done, params).select("roi", "y", "x", recolour(F.col("value"), F.col("weights")).alias("c"))
    total = lambda n: F.least(F.sum(F.col(f"c.{n}").cast("bigint")), F.lit(255)).alias(n)
    image = coloured.groupBy("roi", "y", "x").agg(*[total(n) for n in "rgb"])
    if kind is None or size is None or int(size) % 2 == 0:
        return image
    image = stored(image)  # its shuffles go before those of the global filter come
    long = image.unpivot(["roi", "y", "x"], ["r", "g", "b"], "channel", "value")
    smooth = global_filter(long, extent, kind, size, sigma)
    part = lambda n: F.max(F.when(F.col("channel") == n, F.rint("value"))).cast("bigint").alias(n)
    return smooth.groupBy("roi", "y", "x").agg(*[part(n) for n in "rgb"])


def crop_or_whole(pixels: DataFrame, extent: DataFrame, x0: int, x1: int, y0: int, y1: int) -> DataFrame:
    """The half-open window of each image, or the whole image where the window reaches beyond it."""
    if x1 < x0 or y1 < y0:
        raise ValueError("the window's upper bounds lie below its lower ones")
    sized = lookup_join(pixels, extent.select("roi", F.col("width").alias("_w"), F.col("height").alias("_h")), ["roi"], spread_by=["y", "x"])
    fits = (F.col("_w") >= x1) & (F.col("_h") >= y1)
    inside = F.col("x").between(x0, x1 - 1) & F.col("y").between(y0, y1 - 1)
    return sized.where(~fits | inside).drop("_w", "_h")


def channel_order(current: Column, chosen: Column) -> Column:
    """Blend order after channels were added or removed: those still chosen in their order, new ones behind."""
    kept = F.filter(current, lambda c: F.array_contains(chosen, c))
    return F.concat(kept, F.filter(chosen, lambda c: ~F.array_contains(current, c)))


def channels_by_label(labels: Column, order: Column) -> Column:
    """Keys of channels (a map of key to label) in the order in which a user has put their labels."""
    back = F.map_from_entries(F.transform(F.map_entries(labels), lambda e: F.struct(e["value"], e["key"])))
    return F.transform(order, lambda name: F.try_element_at(back, name))


def sorted_channels(channels: Column) -> Column:
    """Channels (structs of key and label) sorted by label without regard to case; equal labels keep their order."""
    marked = F.transform(channels, lambda c, i: F.struct(F.lower(c["label"]).alias("low"), i.alias("i"), c.alias("c")))
    return F.transform(F.array_sort(marked), lambda m: m["c"]["key"])


def save_blend(saved: DataFrame, name: str | None, channels: Sequence[str]) -> DataFrame:
    """Named channel lists (name, channels) with one list added or replaced; nothing changes without name or channels."""
    if not name or not channels:
        return saved
    new = saved.sparkSession.createDataFrame([(name, list(channels))], "name string, channels array<string>")
    return saved.where(F.col("name") != name).unionByName(new)


def saved_pixels(pixels: DataFrame, saved: DataFrame, name: str) -> DataFrame:
    """Pixels of the channels in a saved list."""
    wanted = saved.where(F.col("name") == name).select(F.explode("channels").alias("channel")).distinct()
    return pixels.join(wanted, "channel", "left_semi")
