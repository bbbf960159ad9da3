"""Painted spots against drawing every pixel of every disk."""

from __future__ import annotations

import random

import numpy as np
import pytest

from rastrel.operators import spots as sp


@pytest.mark.parametrize("tile", [16, 128])
def test_disks_match_brute_force(spark, tile):
    rng = random.Random(2)
    values = [(f"r{rng.randint(0, 1)}", rng.choice("gh"), rng.uniform(-30, 130), rng.uniform(-30, 90), float(rng.randint(-1, 9))) for _ in range(120)]
    values += [("r0", "g", -6.5, -6.5, 3.0), ("r0", "h", 400.0, 400.0, 3.0)]
    scale, extent = {"r0": (1.0, 7), "r1": (0.53, 21)}, {"r0": (0, 0, 100, 60), "r1": (3, 1, 60, 40)}
    found = sp.rasterize_spots(
        spark.createDataFrame(values, "roi string, gene string, x double, y double, value double"),
        spark.createDataFrame([(r, *s) for r, s in scale.items()], "roi string, scale double, radius int"),
        spark.createDataFrame([(r, *e) for r, e in extent.items()], "roi string, x_min int, y_min int, grid_width int, grid_height int"), tile=tile)
    want: dict = {}
    for roi, gene, x, y, value in values:
        (factor, radius), (x_min, y_min, width, height) = scale[roi], extent[roi]
        size = int(radius * factor)
        at = lambda v, low: float(np.float32(np.float32(v) * np.float32(factor))) - low
        for dy in range(1 - size, size):
            for dx in range(1 - size, size):
                py, px = int(at(y, y_min) + dy), int(at(x, x_min) + dx)
                if value > 0 and dy * dy + dx * dx < size * size and 0 <= py < height and 0 <= px < width:
                    want[roi, gene, py, px] = max(value, want.get((roi, gene, py, px), 0))
    rows = found.collect()
    assert {(r.roi, r.channel, r.y, r.x): r.value for r in rows} == want and len(rows) == len(want)


def test_tiles_are_painted_as_one_stack():
    """Two tiles, overlapping disks and one position cut towards zero in one call."""
    rows = {"value": [2, 5, 3], "_size": [2, 2, 1], "fy": [3, 4, -1], "oy": [False, False, True], "fx": [3, 3, 9], "ox": [False] * 3,
            "ty": [0, 0, 0], "tx": [0, 0, 1], "_h": [8] * 3, "_w": [16] * 3}
    found = sp._painted_tiles({c: np.array(v) for c, v in rows.items()}, np.array([0, 0, 1]), 2, 8)
    assert found.shape == (2, 8, 8) and found[0, 3, 3] == 5 and found[0, 2, 3] == 2 and found[1, 0, 1] == 3 and (found > 0).sum() == 13
