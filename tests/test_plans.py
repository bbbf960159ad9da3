"""What physical plans must and must not do, whatever sizes the planner assumes."""

from __future__ import annotations

from pyspark.sql import functions as F

from rastrel.operators import annotate as an
from rastrel.operators import objects as ob
from rastrel.operators import raster as ra
from rastrel.plans import views
from rastrel.plans.joins import points_in_boxes


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_masks_are_not_broadcast(spark, sf):
    pixels, mask, extent = views.pixels(spark, sf), views.mask(spark, sf), views.extent(spark, sf)
    for df in (
        ob.quantify_channel(pixels, mask, views.CHANNELS), ob.labelled_pixels(pixels, mask),
        ra.marker_correlation(pixels, "A", "R", mask, extent=extent),
        ra.overlay_mask(pixels.select("roi", "y", "x", *[F.col("value").alias(c) for c in "rgb"]), mask),
        an.point_export(pixels.select("roi", "x", "y", F.lit("a").alias("annotation_column"), F.lit("b").alias("cell_type")), mask),
    ):
        joins = [line for line in plan(df).splitlines() if "Join" in line and "y#" in line]
        assert joins and all("SortMergeJoin" in line for line in joins)


def test_few_boxes_are_broadcast_and_many_are_not(spark, monkeypatch):
    points = spark.range(1000).select(F.lit(1).alias("roi"), (F.col("id") % 50).alias("x"), (F.col("id") % 37).alias("y"))
    boxes = spark.createDataFrame([(1, 0, 9, 0, 9), (1, 20, 30, 5, 8)], "roi int, x_min int, x_max int, y_min int, y_max int")
    few = points_in_boxes(points, boxes, ["roi"])
    monkeypatch.setattr("rastrel.plans.joins.MOST_BROADCAST", 1)
    many = points_in_boxes(points, boxes, ["roi"])
    assert "BroadcastHashJoin" in plan(few) and "SortMergeJoin" in plan(many) and few.count() == many.count() > 0


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(views.table(spark, sf, "lineitem").where("l_quantity > 49").select("l_suppkey"))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity" in text and "l_comment" not in text


def test_grids_are_not_broadcast(spark, sf):
    dense = views.dense(spark, sf)
    for df in (dense, ra.sparsify(dense), dense.where("value > 3")):
        joins = [line for line in plan(df).splitlines() if "Join" in line]
        assert joins and all("SortMergeJoin" in line for line in joins)


def test_few_lines_are_unrolled_by_many_tasks(spark, sf, tmp_path):
    """A table of few images becomes a long one: its lines must not be put together in one task."""
    assert views.mask(spark, sf).rdd.getNumPartitions() == ra.full_grid(views.extent(spark, sf)).rdd.getNumPartitions() == 4


def test_paths_of_masks_are_distinct_before_they_are_compared(spark, sf, tmp_path):
    """The largest of strings is found by sorting, which must not meet the rows of the masks."""
    from rastrel.sources import files

    views.mask(spark, sf).write.parquet(str(tmp_path / "m"))
    lines = plan(files.read_masks(spark, str(tmp_path / "m"))).splitlines()
    largest = [k for k, line in enumerate(lines) if "partial_max(_path" in line]
    assert largest and all(any("HashAggregate" in line and "count(1)" in line for line in lines[k + 1:]) for k in largest)


def test_colours_are_found_in_one_aggregation_of_pixels(spark, sf):
    from rastrel.queries import pixels

    assert plan(pixels.rgb_to_greyscale(spark, sf)).count("Exchange") == 2 and "pivotfirst" not in plan(pixels.rgb_to_greyscale(spark, sf))


def test_grids_are_shuffled_by_lines(spark, sf):
    """Single places of a grid are never what is shuffled and joined."""
    text = plan(views.dense(spark, sf))
    keys = [line for line in text.splitlines() if "SortMergeJoin" in line]
    assert len(keys) == 1 and "_t#" in keys[0] and "x#" not in keys[0]


def test_small_regions_are_measured_by_one_shuffle_of_their_pixels(spark):
    pixels = spark.range(50).selectExpr("id % 3 AS region", "'c' AS channel", "id AS value")
    areas = spark.range(3).selectExpr("id AS region", "'c' AS channel", "40L AS area")
    text = plan(ra.region_statistics(pixels, None, areas))
    assert text.count("Exchange hashpartitioning") <= 2 and "Scan ExistingRDD" not in text


def test_channels_are_filled_by_lines(spark, sf):
    from rastrel.operators import display as di

    zero = spark.createDataFrame([(c, 1.5) for c in views.CHANNELS], "channel string, zero double")
    joins = [line for line in plan(di.filled(views.pixels(spark, sf), views.extent(spark, sf), views.CHANNELS, zero)).splitlines() if "SortMergeJoin" in line]
    assert len(joins) == 1 and "_t#" in joins[0] and "x#" not in joins[0]
