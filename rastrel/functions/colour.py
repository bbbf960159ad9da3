"""Expressions that turn intensities into colours."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from rastrel.functions.names import hex_to_rgb

# Gradient stops as (position, red, green, blue) with 0..255 components.
GRADIENT_STOPS = {
    "blue_gold": [
        (0.0, 0, 0, 0), (1e-6, 0, 0, 255), (0.5, 255, 255, 255), (1.0, 255, 215, 0),
    ],
    "jet": [
        (0.0, 0, 0, 0), (1e-6, 255, 0, 0), (0.25, 255, 255, 0), (0.5, 0, 128, 0),
        (0.75, 0, 255, 255), (1.0, 0, 0, 255),
    ],
}


def scale_intensity(value: Column, lower: Column, upper: Column) -> Column:
    """Clip to the upper bound, subtract the lower, floor at 0 and stretch to 0..255.

    Without an upper bound only the lower one is subtracted. Equal bounds leave the factor at 1,
    an upper bound below the lower one leaves values unscaled.
    """
    low = F.coalesce(lower.cast("double"), F.lit(0.0))
    high = upper.cast("double")
    raw = value.cast("double")
    moved = F.greatest(F.when(high.isNull(), raw).otherwise(F.least(raw, high)) - low, F.lit(0.0))
    span = high - low
    factor = F.when(span > 0, F.lit(255.0) / F.nullif(span, F.lit(0.0))).otherwise(F.lit(1.0))
    return F.when(high.isNull(), moved).otherwise(moved * factor)


def colour_weights(colour: Column) -> Column:
    """Per-component weights of a colour in 32-bit arithmetic; NULL for white, which is only clipped."""
    rgb = hex_to_rgb(colour)

    def weight(name: str) -> Column:
        unit = (rgb[name].cast("float") / F.lit(255.0)).cast("float")
        return unit * F.lit(255.0).cast("float")

    parts = F.struct(*[weight(n).alias(n) for n in ("r", "g", "b")])
    return F.when(F.upper(colour) != "#FFFFFF", parts)


def recolour(value: Column, weights: Column) -> Column:
    """Grey 0..255 to RGB with the weights of a colour, truncated."""
    grey = F.least(F.greatest(value.cast("double"), F.lit(0.0)), F.lit(255.0))
    share = (grey.cast("float") / F.lit(255.0)).cast("float")
    part = lambda n: F.when(weights.isNull(), F.floor(grey)).otherwise(F.floor(share * weights[n])).cast("int")
    return F.struct(*[part(n).alias(n) for n in ("r", "g", "b")])


def rgb_to_grey(r: Column, g: Column, b: Column) -> Column:
    """Luma of 8-bit RGB in fixed-point ITU-R 601-2 weights."""
    total = r.cast("int") * 19595 + g.cast("int") * 38470 + b.cast("int") * 7471 + 32768
    return F.shiftright(total, 16)


def gradient_table(name: str) -> list[tuple[int, int, int]]:
    """256 colours of a gradient, truncated to 8 bits."""
    place = np.linspace(0.0, 1.0, 256)
    if name == "rainbow":
        parts = [np.abs(2 * place - 0.5), np.sin(place * np.pi), np.cos(place * np.pi / 2)]
    elif name in GRADIENT_STOPS:
        stops = np.array(GRADIENT_STOPS[name], dtype=float)
        parts = [np.interp(place, stops[:, 0], stops[:, i] / 255.0) for i in (1, 2, 3)]
    else:
        raise ValueError(f"{name} is not a gradient; use rainbow, blue_gold, jet or greyscale")
    table = (np.clip(np.stack(parts, axis=1), 0, 1) * 255).astype(int)
    return [tuple(int(c) for c in row) for row in table]


def gradient_colour(value: Column, low: Column, high: Column, name: str) -> Column:
    """Colour of a value after min-max scaling; zero intensity stays black."""
    table = F.array(*[
        F.struct(F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b"))
        for r, g, b in gradient_table(name)
    ])
    place = F.coalesce(F.try_divide(value - low, high - low), F.lit(0.0))
    index = F.least(F.floor(place * 256).cast("int"), F.lit(255))
    black = F.struct(F.lit(0).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"))
    return F.when(value == 0, black).otherwise(F.element_at(table, index + 1))
