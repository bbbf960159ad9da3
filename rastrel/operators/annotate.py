"""Annotations drawn on images, carried over to objects and rasters.

Annotations are ordered by ``seq``; where several touch an object the last one wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastrel.functions.geometry import path_vertices, vertex_bounds
from rastrel.operators.polygons import objects_in_regions, path_spans
from rastrel.plans.joins import lookup_join, over_tiles, points_in_boxes, tile_of, unrolled
from rastrel.plans.ranks import rank_within
from rastrel.schema import DEFAULT_CATEGORY, q

HIT = ["sample", "cell_id", "annotation_column", "seq", "cell_type"]
OBJECT_TILE = 256


def box_hits(objects: DataFrame, boxes: DataFrame, scope: str = "roi", tile: int = OBJECT_TILE) -> DataFrame:
    """Objects wholly inside zoom or rectangle annotations.

    ``scope='roi'`` matches objects of the annotated image; 'all' matches every image.
    """
    corners = objects.select(
        "sample", "cell_id", F.col("x_min").alias("ox"), F.col("y_min").alias("oy"),
        F.col("x_max").alias("ox2"), F.col("y_max").alias("oy2"),
    )
    limits = boxes.select(
        F.col("roi").alias("sample"), "annotation_column", "seq", "cell_type",
        "x_min", "x_max", "y_min", "y_max",
    )
    if scope == "all":
        limits = limits.drop("sample")
    on = ["sample"] if scope == "roi" else []
    found = points_in_boxes(corners, limits, on, x="ox", y="oy", tile=tile)
    return found.where((F.col("ox2") <= F.col("x_max")) & (F.col("oy2") <= F.col("y_max"))).select(*HIT)


def click_hits(objects: DataFrame, clicks: DataFrame, mask: DataFrame | None = None,
               tile: int = OBJECT_TILE) -> DataFrame:
    """Objects under clicked points: by mask when there is one, else by bounding box.

    ``clicks`` carries roi, x, y, seq, cell_type and annotation_column.
    """
    points = clicks.select("roi", "x", "y", "seq", "cell_type", "annotation_column")
    if mask is not None:
        # clicks on background have no object; they would all share one key
        labels = mask.where(F.col("object_id") != 0).select("roi", "y", "x", "object_id")
        under = points.join(unrolled(labels), ["roi", "y", "x"])
        return objects.select("sample", "cell_id").join(
            under.select(
                F.col("roi").alias("sample"), F.col("object_id").alias("cell_id"),
                "annotation_column", "seq", "cell_type",
            ), ["sample", "cell_id"],
        ).select(*HIT)
    boxes = over_tiles(
        over_tiles(
            objects.select("sample", "cell_id", "x_min", "x_max", "y_min", "y_max"),
            F.col("x_min"), F.col("x_max"), "_tx", tile,
        ), F.col("y_min"), F.col("y_max"), "_ty", tile,
    )
    at = points.select(
        F.col("roi").alias("sample"), "x", "y", "seq", "cell_type", "annotation_column",
        tile_of(F.col("x"), tile).alias("_tx"), tile_of(F.col("y"), tile).alias("_ty"),
    )
    return unrolled(boxes).join(at, ["sample", "_ty", "_tx"]).where(
        F.col("x").between(F.col("x_min"), F.col("x_max")) & F.col("y").between(F.col("y_min"), F.col("y_max"))
    ).select(*HIT)


def gate_hits(objects: DataFrame, gates: DataFrame) -> DataFrame:
    """Objects listed by gate annotations (roi, object_ids, seq, ...)."""
    listed = gates.select(
        F.col("roi").alias("sample"), F.explode("object_ids").alias("cell_id"),
        "annotation_column", "seq", "cell_type",
    )
    return objects.select("sample", "cell_id").join(listed, ["sample", "cell_id"]).select(*HIT)


def path_hits(objects: DataFrame, paths: DataFrame, mask: DataFrame | None = None,
              extent: DataFrame | None = None, threshold: float = 0.85, scope: str = "roi") -> DataFrame:
    """Objects in drawn paths: by pixel share with a mask, else by the path's bounding box."""
    if mask is None:
        box = paths.withColumn("_b", vertex_bounds(path_vertices(F.col("path"))))
        return box_hits(objects, box.select(
            "roi", "annotation_column", "seq", "cell_type", "_b.x_min", "_b.x_max", "_b.y_min", "_b.y_max"
        ), scope)
    spans = path_spans(paths.withColumn("region", F.col("seq")), extent)
    inside = objects_in_regions(mask, spans, threshold)
    listed = inside.join(
        paths.select(F.col("seq").alias("region"), "roi", "annotation_column", "cell_type"), ["region", "roi"]
    ).select(
        F.col("roi").alias("sample"), F.col("object_id").alias("cell_id"), "annotation_column",
        F.col("region").alias("seq"), "cell_type",
    )
    return objects.select("sample", "cell_id").join(listed, ["sample", "cell_id"]).select(*HIT)


def embedding_hits(objects: DataFrame, inside: Column, seq: int, value: str, column: str) -> DataFrame:
    """Objects (with UMAP1, UMAP2) in an embedding window as hits of one annotation."""
    return objects.where(inside).select(
        "sample", "cell_id", F.lit(column).alias("annotation_column"),
        F.lit(seq).cast("bigint").alias("seq"), F.lit(value).alias("cell_type"),
    )


def winners(hits: DataFrame) -> DataFrame:
    """Last annotation per object and annotation column."""
    return hits.groupBy("sample", "cell_id", "annotation_column").agg(
        F.max_by("cell_type", "seq").alias("cell_type")
    )


def apply_annotations(objects: DataFrame, hits: DataFrame, columns: Sequence[str],
                      default: str = DEFAULT_CATEGORY, remove: bool = False) -> DataFrame:
    """Object table with its annotation columns written; untouched objects keep theirs or the default.

    ``remove`` writes the default on every object hit.
    """
    last = winners(hits)
    wide = last.groupBy("sample", "cell_id").agg(*[
        F.max(F.when(F.col("annotation_column") == c, F.col("cell_type"))).alias(f"_new{i}")
        for i, c in enumerate(columns)
    ])
    joined = objects.join(wide, ["sample", "cell_id"], "left")
    written = {}
    for i, c in enumerate(columns):
        old = q(c) if c in objects.columns else F.lit(default)
        new = F.col(f"_new{i}")
        written[c] = F.when(new.isNotNull(), F.lit(default)).otherwise(old) if remove else F.coalesce(new, old)
    return joined.withColumns(written).drop(*[f"_new{i}" for i in range(len(columns))])


def pending(annotations: DataFrame) -> DataFrame:
    """Annotations not yet carried into the object table."""
    return annotations.where(~F.coalesce("imported", F.lit(False)))


def mark_imported(annotations: DataFrame, imported: bool = True) -> DataFrame:
    """All annotations marked as carried over (or reset)."""
    return annotations.withColumn("imported", F.lit(imported))


# ---------------------------------------------------------------- editing the annotation list

def with_index(annotations: DataFrame) -> DataFrame:
    """0-based list position of each annotation in its image."""
    return rank_within(annotations, ["roi"], "seq", "_n").withColumn("index", F.col("_n") - 1).drop("_n")


def _selected(annotations: DataFrame, indices: Sequence[int]) -> tuple[DataFrame, Column]:
    """Annotations with their index, and the test for the listed ones; -1 is the last."""
    indexed = with_index(annotations)
    counts = annotations.groupBy("roi").agg(F.count(F.lit(1)).alias("_count"))
    sized = lookup_join(indexed, counts, ["roi"], spread_by=["seq"])
    test = F.col("index").isin([int(i) for i in indices])
    return sized, test | (F.col("index") - F.col("_count")).isin([int(i) for i in indices])


def remove_annotations(annotations: DataFrame, roi, indices: Sequence[int] | None = None) -> DataFrame:
    """Annotations without the listed positions of one image, the last one by default."""
    chosen = list(indices) if indices else [-1]
    mine = annotations.where(F.col("roi") == F.lit(roi))
    rest = annotations.where(F.col("roi") != F.lit(roi))
    sized, test = _selected(mine, chosen)
    return rest.unionByName(sized.where(~test).select(*annotations.columns))


def drop_last(annotations: DataFrame) -> DataFrame:
    """Every image's annotations without its most recent one."""
    last = annotations.groupBy("roi").agg(F.max("seq").alias("seq"))
    return annotations.join(last, ["roi", "seq"], "left_anti").select(*annotations.columns)


def transfer_annotations(annotations: DataFrame, source, target, indices: Sequence[int]) -> DataFrame:
    """Copies of listed annotations of one image in another; nothing happens within one image."""
    if source == target or not indices:
        return annotations
    sized, test = _selected(annotations.where(F.col("roi") == F.lit(source)), indices)
    copies = sized.where(test).select(*annotations.columns).withColumn(
        "roi", F.lit(target).cast(annotations.schema["roi"].dataType)
    )
    return annotations.unionByName(copies)


def annotation_preview(annotations: DataFrame) -> DataFrame:
    """One line of text per annotation: bounds, point or number of cells."""
    bounds = vertex_bounds(path_vertices(F.col("path")))
    path = F.col("type") == "path"
    shown = lambda c: F.when(path, bounds[c].cast("double")).otherwise(F.col(c))
    rounded = [F.bround(shown(c), 0).cast("bigint").cast("string") for c in ("x_min", "x_max", "y_min", "y_max")]
    region = F.concat(
        F.lit("x: ["), rounded[0], F.lit(", "), rounded[1], F.lit("]\n y: ["), rounded[2], F.lit(", "),
        rounded[3], F.lit("]"),
    )
    number = lambda c: F.col(c).cast("bigint").cast("string")
    point = F.concat(F.lit("x: "), number("x_min"), F.lit(", y: "), number("y_min"))
    cells = F.concat(F.size("object_ids").cast("string"), F.lit(" cells"))
    return annotations.select(
        "id", "roi", "cell_type", "annotation_column", "type",
        F.when(F.col("type") == "point", point).when(F.col("type") == "gate", cells)
        .when(F.col("type").isin("zoom", "rect", "path"), region).alias("preview"),
    )


# ---------------------------------------------------------------- rasters and exports

def class_ids(annotations: DataFrame) -> DataFrame:
    """Number of each class of an annotation column in an image, by first use from 1."""
    first = annotations.groupBy("roi", "annotation_column", "cell_type").agg(F.min("seq").alias("seq"))
    return rank_within(first, ["roi", "annotation_column"], "seq", "class_id").drop("seq")


def annotation_mask(painted: DataFrame, annotations: DataFrame) -> DataFrame:
    """Class raster per annotation column: the last annotation on a pixel gives its class.

    ``painted`` lists covered pixels (roi, y, x, seq). Each pixel holds its class's own number.
    """
    last = (
        painted.join(annotations.select("roi", "seq", "annotation_column", "cell_type"), ["roi", "seq"])
        .groupBy("roi", "annotation_column", "y", "x")
        .agg(F.max_by("cell_type", "seq").alias("cell_type"))
    )
    return last.join(class_ids(annotations), ["roi", "annotation_column", "cell_type"]).select(
        "roi", "annotation_column", "y", "x", "class_id"
    )


def rectangle_pixels(boxes: DataFrame, extent: DataFrame) -> DataFrame:
    """Pixels of rectangle annotations (roi, y, x, seq), half-open, inside the image."""
    low = lambda c: F.greatest(F.col(c).cast("int"), F.lit(0))
    sized = lookup_join(boxes, extent.select("roi", "width", "height"), ["roi"], spread_by=["seq"]).select(
        "roi", "seq", low("x_min").alias("x0"), (F.least(F.col("x_max").cast("int"), F.col("width")) - 1).alias("x1"),
        low("y_min").alias("y0"), (F.least(F.col("y_max").cast("int"), F.col("height")) - 1).alias("y1"),
    ).where((F.col("x0") <= F.col("x1")) & (F.col("y0") <= F.col("y1")))
    lines = sized.withColumn("y", F.explode(F.sequence("y0", "y1"))).repartition("roi", "seq", "y")
    return lines.select("roi", "y", F.explode(F.sequence("x0", "x1")).alias("x"), "seq")


def region_objects(annotations: DataFrame, inside: DataFrame) -> DataFrame:
    """Export rows of path and gate annotations: ROI, mask_name, cell_id, annotation_col, annotation.

    ``inside`` lists the objects of path annotations (region = seq, roi, object_id).
    """
    info = annotations.where(F.col("mask_name").isNotNull()).select(
        "roi", "seq", "type", "mask_name", "annotation_column", "cell_type", "object_ids"
    )
    gated = info.where(F.col("type") == "gate").withColumn("object_id", F.explode("object_ids"))
    drawn = info.where(F.col("type") == "path").join(
        inside.select("roi", F.col("region").alias("seq"), "object_id"), ["roi", "seq"]
    )
    both = gated.drop("object_ids").unionByName(drawn.drop("object_ids"))
    return both.where(F.col("object_id") != 0).select(
        F.col("roi").alias("ROI"), "mask_name", F.col("object_id").alias("cell_id"),
        F.col("annotation_column").alias("annotation_col"), F.col("cell_type").alias("annotation"),
    )


def point_export(points: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """Export rows of point annotations, with the object under each point when there is a mask."""
    rows = points.select(
        F.col("roi").alias("ROI"), "x", "y", F.col("annotation_column").alias("annotation_col"),
        F.col("cell_type").alias("annotation"),
    )
    if mask is None:
        return rows
    under = mask.select(F.col("roi").alias("ROI"), "y", "x", F.col("object_id").alias("mask_cell_id"))
    return rows.join(unrolled(under), ["ROI", "y", "x"], "left")
