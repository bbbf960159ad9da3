"""Drawn paths and polygons as row spans.

A polygon becomes runs (y, x0, x1) of covered pixels, so its size in rows follows its outline,
not its area; joins with pixels or masks then go through (roi, y, x tile).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rastrel.functions.geometry import path_vertices
from rastrel.operators.raster import pixels_in_spans
from rastrel.plans.joins import lookup_join
from rastrel.plans.ranks import rank_within
from rastrel.plans.runs import last_wins, layered_runs, run_pixels, union_runs
from rastrel.session import stored


def _merge(row: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Union of closed integer intervals per row number."""
    if len(row) == 0:
        return row, a, b
    stride = int(b.max()) + 3
    order = np.lexsort((a, row))
    start, end = (a + row * stride)[order], (b + row * stride)[order]
    reach = np.maximum.accumulate(end)
    first = np.flatnonzero(np.r_[True, start[1:] > reach[:-1] + 1])
    last = np.r_[first[1:] - 1, len(start) - 1]
    kept = row[order][first]
    return kept, start[first] - kept * stride, reach[last] - kept * stride


def _enclosed_gaps(row: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Gaps between runs that no 4-connected way links to the outside.

    Rows of different polygons are never neighbours, as each polygon has its own row numbers.
    """
    same = np.flatnonzero(row[1:] == row[:-1])
    if len(same) == 0:
        return None
    gaps = [(int(row[i]), int(b[i]) + 1, int(a[i + 1]) - 1) for i in same]
    by_row: dict[int, list[int]] = {}
    for i, (r, _, _) in enumerate(gaps):
        by_row.setdefault(r, []).append(i)
    first, last = np.searchsorted(row, row, "left"), np.searchsorted(row, row, "right") - 1

    def limits(r: int):
        at = int(np.searchsorted(row, r))
        if at == len(row) or row[at] != r:
            return None
        return int(a[first[at]]), int(b[last[at]])

    def open_to_outside(r: int, lo: int, hi: int) -> bool:
        for other in (r - 1, r + 1):
            edge = limits(other)
            if edge is None or lo < edge[0] or hi > edge[1]:
                return True
        return False

    leaking = [i for i, g in enumerate(gaps) if open_to_outside(*g)]
    outside = set(leaking)
    while leaking:
        r, lo, hi = gaps[leaking.pop()]
        for other in (r - 1, r + 1):
            for j in by_row.get(other, ()):
                if j not in outside and gaps[j][1] <= hi and gaps[j][2] >= lo:
                    outside.add(j)
                    leaking.append(j)
    closed = [g for i, g in enumerate(gaps) if i not in outside]
    return np.array(closed, dtype=np.int64).T if closed else None


def spans_of_polygons(xs: list, ys: list, width: np.ndarray, height: np.ndarray, fill: bool = True):
    """Covered pixel runs (polygon, y, x0, x1) of a batch of integer polygons, clipped to their images.

    A pixel is covered when its centre is inside by the even-odd rule or lies on the outline;
    with ``fill``, enclosed holes are covered too. Work and memory follow the outlines.
    """
    sizes = np.array([len(x) for x in xs], dtype=np.int64)
    owner = np.repeat(np.arange(len(xs)), sizes)
    x1, y1 = np.concatenate(xs).astype(np.int64), np.concatenate(ys).astype(np.int64)
    following = np.arange(1, len(x1) + 1)
    ends = np.cumsum(sizes)[sizes > 0] - 1
    following[ends] = ends + 1 - sizes[sizes > 0]
    x2, y2 = x1[following], y1[following]
    up = y2 < y1
    ax, ay, bx = np.where(up, x2, x1), np.where(up, y2, y1), np.where(up, x1, x2)
    rise = np.abs(y2 - y1)
    # one entry per sloped edge and row inside the image, the upper end row included
    low, high = np.maximum(ay, 0), np.minimum(ay + rise, height[owner] - 1)
    steps = np.where(rise > 0, np.maximum(high - low + 1, 0), 0)
    edge = np.repeat(np.arange(len(x1)), steps)
    y = low[edge] + np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)
    top = ax[edge] * rise[edge] + (y - ay[edge]) * (bx[edge] - ax[edge])
    down = rise[edge]
    # row numbers: a block of rows per polygon with an empty row between blocks
    block = int(height.max()) + 2
    line = owner[edge] * block + y
    half_open = y < ay[edge] + rise[edge]
    hline, htop, hdown = line[half_open], top[half_open], down[half_open]
    order = np.lexsort((htop / hdown, hline))
    hline, htop, hdown = hline[order], htop[order], hdown[order]
    on = top % down == 0
    flat = np.flatnonzero((rise == 0) & (ay >= 0) & (ay < height[owner]))
    row = np.r_[hline[0::2], line[on], owner[flat] * block + ay[flat]]
    a = np.r_[-((-htop[0::2]) // hdown[0::2]), top[on] // down[on], np.minimum(x1, x2)[flat]]
    b = np.r_[htop[1::2] // hdown[1::2], top[on] // down[on], np.maximum(x1, x2)[flat]]
    a, b = np.maximum(a, 0), np.minimum(b, width[row // block] - 1)
    keep = a <= b
    row, a, b = _merge(row[keep], a[keep], b[keep])
    if fill and len(row):
        holes = _enclosed_gaps(row, a, b)
        if holes is not None:
            row, a, b = _merge(np.r_[row, holes[0]], np.r_[a, holes[1]], np.r_[b, holes[2]])
    return row // block, row % block, a, b


def polygon_spans(polygons: DataFrame, extent: DataFrame, fill: bool = True) -> DataFrame:
    """(region, roi, y, x0, x1) of polygons with integer ``vertices``.

    Polygons are spread by their own key first: unrolling an outline costs far more than its row.
    """
    region, roi = polygons.schema["region"].dataType, polygons.schema["roi"].dataType
    sized = lookup_join(
        polygons.select("region", "roi", "vertices"), extent.select("roi", "width", "height"), ["roi"], spread_by=["region"]
    ).select(
        "region", "roi", F.col("vertices.x").alias("xs"), F.col("vertices.y").alias("ys"),
        "width", "height",
    ).repartition("roi", "region")

    def unroll(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            owner, y, a, b = spans_of_polygons(
                batch["xs"].to_list(), batch["ys"].to_list(),
                batch["width"].to_numpy().astype(np.int64), batch["height"].to_numpy().astype(np.int64), fill,
            )
            yield pd.DataFrame({
                "region": batch["region"].to_numpy()[owner], "roi": batch["roi"].to_numpy()[owner],
                "y": y, "x0": a, "x1": b,
            })

    return sized.mapInPandas(
        unroll, f"region {region.simpleString()}, roi {roi.simpleString()}, y int, x0 int, x1 int"
    )


def path_spans(paths: DataFrame, extent: DataFrame) -> DataFrame:
    """Spans of drawn paths in 'M x,y L ... Z' form."""
    return polygon_spans(
        paths.withColumn("vertices", path_vertices(F.col("path"))).select("region", "roi", "vertices"),
        extent,
    )


def spans_to_pixels(spans: DataFrame) -> DataFrame:
    """Every covered pixel of every region."""
    return spans.select(
        "region", "roi", "y", F.explode(F.sequence("x0", "x1")).alias("x")
    )


def union_of_regions(spans: DataFrame) -> DataFrame:
    """Pixels covered by at least one region; runs are merged before they are unrolled."""
    return run_pixels(union_runs(spans))


def objects_in_regions(mask: DataFrame, spans: DataFrame, threshold: float = 0.85,
                       use_partial: bool = True) -> DataFrame:
    """(region, roi, object_id, share) of objects lying in drawn regions.

    Partial: share of the object's pixels inside, kept from ``threshold`` on. Otherwise every
    object touched, with share 100.
    """
    objects = mask.where(F.col("object_id") != 0)
    inside = pixels_in_spans(objects.select("roi", "y", "x", "object_id"), spans)
    counts = inside.groupBy("region", "roi", "object_id").agg(F.count(F.lit(1)).alias("n_in"))
    if not use_partial:
        return counts.select("region", "roi", "object_id", F.lit(100.0).alias("share"))
    sizes = objects.groupBy("roi", "object_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.join(sizes, ["roi", "object_id"])
        .withColumn("share", F.col("n_in") / F.col("n"))
        .where(F.col("share") >= threshold)
        .select("region", "roi", "object_id", "share")
    )


# ---------------------------------------------------------------- label masks from polygons

def centre_spans(shapes: DataFrame) -> DataFrame:
    """(region, roi, y, x0, x1): pixels whose centre lies inside a shape of real-valued rings.

    ``shapes`` carries region, roi, width, height and ``rings`` (arrays of x, y; even-odd over all rings, so
    inner rings are holes). A centre on an outline belongs to the shape on its right or lower side, so shapes
    that share an edge don't overlap. Every edge gives one crossing per row of pixels it passes, and the
    crossings of a row pair up.
    """
    number = lambda v: F.struct(v["x"].cast("double").alias("x"), v["y"].cast("double").alias("y"))
    rings = shapes.select("region", "roi", "width", "height", F.explode("rings").alias("ring"))
    points = rings.withColumn("ring", F.transform("ring", number)).where(F.size("ring") > 2)
    ends = F.concat(F.slice("ring", F.lit(2), F.size("ring") - 1), F.slice("ring", 1, 1))
    edges = points.select(
        "region", "roi", "width", "height", F.explode(F.arrays_zip(F.col("ring").alias("a"), ends.alias("b"))).alias("e")
    ).select("region", "roi", "width", "height", "e.a.x", "e.a.y", F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))
    low = F.greatest(F.ceil(F.least("y", "y2") - 0.5), F.lit(0)).cast("int")
    high = F.least(F.ceil(F.greatest("y", "y2") - 0.5) - 1, F.col("height") - 1).cast("int")
    rows = edges.where(F.col("y") != F.col("y2")).withColumns({"_low": low, "_high": high}).where("_low <= _high")
    at = rows.withColumn("row", F.explode(F.sequence("_low", "_high")))
    cross = F.col("x") + (F.col("row") + 0.5 - F.col("y")) * (F.col("x2") - F.col("x")) / (F.col("y2") - F.col("y"))
    lines = at.groupBy("region", "roi", "width", "row").agg(F.array_sort(F.collect_list(cross)).alias("c"))
    pairs = lines.select(
        "region", "roi", "width", F.col("row").alias("y"),
        F.explode(F.sequence(F.lit(0), F.size("c") - 2, F.lit(2))).alias("k"), "c",
    )
    first, last = F.ceil(F.get("c", F.col("k")) - 0.5), F.ceil(F.get("c", F.col("k") + 1) - 0.5) - 1
    return pairs.select(
        "region", "roi", "y", F.greatest(first, F.lit(0)).cast("int").alias("x0"),
        F.least(last, F.col("width") - 1).cast("int").alias("x1"),
    ).where("x0 <= x1")


def _with_rings(df: DataFrame) -> DataFrame:
    """Shapes with ``rings``; a table with ``vertices`` only has one ring per shape."""
    return df if "rings" in df.columns else df.withColumn("rings", F.array("vertices"))


def mask_from_shapes(shapes: DataFrame, extent: DataFrame, flip: bool = True, scale_factor: float | None = None) -> DataFrame:
    """Label mask of segmentation polygons; where two meet, the later shape wins.

    ``shapes`` carries roi, shape_id (1-based, drawing order) and real-valued vertices (or rings). ``extent``
    gives the raster of an image: (roi, width, height) with its origin at 0, or the bounds of its spots
    (roi, x_min, y_min, x_max, y_max), of which the sides are cut to whole pixels. Coordinates are divided by
    ``scale_factor`` first. With ``flip`` rows follow the coordinate; without it the image stands upside down.
    """
    if "x_min" in extent.columns:
        side = lambda low, high: (F.col(high) - F.col(low)).cast("int")
        raster = extent.select(
            "roi", F.col("x_min").cast("double").alias("_x"), F.col("y_min").cast("double").alias("_y"),
            side("x_min", "x_max").alias("width"), side("y_min", "y_max").alias("height"),
            (side("x_min", "x_max") / (F.col("x_max") - F.col("x_min"))).alias("_sx"),
            (side("y_min", "y_max") / (F.col("y_max") - F.col("y_min"))).alias("_sy"),
        )
    else:
        one, zero = F.lit(1.0), F.lit(0.0)
        raster = extent.select("roi", zero.alias("_x"), zero.alias("_y"), "width", "height", one.alias("_sx"), one.alias("_sy"))
    scale = F.lit(float(scale_factor or 1))
    placed = lambda v: F.struct(
        ((v["x"] / scale - F.col("_x")) * F.col("_sx")).alias("x"), ((v["y"] / scale - F.col("_y")) * F.col("_sy")).alias("y")
    )
    sized = lookup_join(_with_rings(shapes).select("roi", "shape_id", "rings"), raster, ["roi"], spread_by=["shape_id"])
    rings = F.transform("rings", lambda ring: F.transform(ring, placed))
    spans = centre_spans(sized.select(F.col("shape_id").alias("region"), "roi", "width", "height", rings.alias("rings")))
    painted = run_pixels(last_wins(spans, "region"), "region").withColumnRenamed("region", "object_id").select("roi", "y", "x", "object_id")
    if flip:
        return painted
    turned = lookup_join(painted, raster.select("roi", "height"), ["roi"], spread_by=["y", "x"])
    return turned.select("roi", (F.col("height") - 1 - F.col("y")).alias("y"), "x", "object_id")


def mask_from_polygons(polygons: DataFrame, extent: DataFrame, hole_types: tuple[str, ...] = ()) -> DataFrame:
    """Label mask of ordered classified polygons with hole rules, by pixel centres.

    ``polygons`` carries roi, seq, classification and vertices or rings, and where some of them are
    multi-polygons the flag ``many``. Holes clear what lies under them. Multi-polygons paint 1 over everything.
    Other polygons get the ids 1, 2, ... in order; where one meets pixels already labelled it leaves them
    alone, unless it lies wholly on labelled pixels, then it takes them all.
    """
    many = F.coalesce("many", F.lit(False)) if "many" in polygons.columns else F.lit(False)
    is_hole = F.coalesce(F.col("classification").isin(list(hole_types)), F.lit(False)) & ~many
    flagged = _with_rings(polygons).withColumns({"hole": is_hole, "many": many})
    single = ~F.col("hole") & ~F.col("many")
    kept = rank_within(flagged.where(single), ["roi"], "seq", "feature")
    others = flagged.where(~single).withColumn("feature", F.col("many").cast("bigint"))
    shapes = kept.unionByName(others)
    sized = lookup_join(shapes.select(F.col("seq").alias("region"), "roi", "rings"), extent.select("roi", "width", "height"), ["roi"], spread_by=["region"])
    runs = centre_spans(sized).withColumnRenamed("region", "seq").join(shapes.select("roi", "seq", "hole", "feature", "many"), ["roi", "seq"])
    return run_pixels(_painted(runs), "object_id").select("roi", "y", "x", "object_id")


def _painted(runs: DataFrame) -> DataFrame:
    """(roi, y, x0, x1, object_id): what is left after all polygons were painted in order.

    Whether a place is labelled when a polygon comes doesn't depend on which polygon has it: it is if one that is no
    hole came after the last hole there. So all verdicts are found at once, from the last painter and the last
    hole before each step, and a place belongs to the last of the steps after its last hole that took it: the first of
    them, a polygon that lies wholly on labels, or a multi-polygon. Steps are played on pieces of runs, never on pixels.
    """
    place = ["roi", "y", "x0", "x1"]
    steps = layered_runs(runs, ["seq", "hole", "feature", "many"])
    whole = Window.partitionBy(*place)
    earlier = whole.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    paint, hole = F.when(~F.col("hole"), F.col("seq")), F.when(F.col("hole"), F.col("seq"))
    on_labels = F.coalesce(F.max(paint).over(earlier) > F.max(hole).over(earlier), F.max(paint).over(earlier).isNotNull())
    judged = steps.withColumn("_on", on_labels).withColumn("_hole", F.max(hole).over(whole)).where(~F.col("hole"))
    after = F.col("_hole").isNull() | (F.col("seq") > F.col("_hole"))
    judged = judged.withColumn("_after", after).withColumn("_first", F.min(F.when(F.col("_after"), F.col("seq"))).over(whole) == F.col("seq"))
    # one exchange by place gives all that is read twice below
    judged = stored(judged.select(*place, "seq", "feature", "many", "_on", "_after", "_first"))
    takes = judged.where(~F.col("many")).groupBy("roi", "seq").agg(F.bool_and("_on").alias("takes")).where("takes")
    owners = judged.where("_after").join(takes, ["roi", "seq"], "left").where("many OR takes OR _first")
    last = owners.groupBy(*place).agg(F.max(F.struct("seq", "feature")).alias("s"))
    return last.select(*place, F.col("s.feature").alias("object_id"))
