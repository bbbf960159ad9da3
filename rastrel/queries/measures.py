"""Measuring objects in masks, and the layout of pixel tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rastrel.operators import objects as ob
from rastrel.operators import raster as ra
from rastrel.operators import stencils as st
from rastrel.plans import views
from rastrel.plans.views import with_views
from rastrel.queries.registry import query


@query(with_views("dense", """
SELECT object_id AS cell_id, CAST(roi AS VARCHAR) AS sample,
  round(avg(value) FILTER (channel = 'A'), 6) AS "A", round(avg(value) FILTER (channel = 'N'), 6) AS "N",
  round(avg(value) FILTER (channel = 'R'), 6) AS "R", count(*) FILTER (channel = 'A') AS area
FROM dense WHERE object_id <> 0 GROUP BY roi, object_id"""))
def quantify_objects(spark, sf):
    """Mean of every channel and area per object of every image."""
    table = ob.quantify(views.pixels(spark, sf), views.mask(spark, sf), views.CHANNELS)
    return table.select("cell_id", "sample", *[F.round(c, 6).alias(c) for c in views.CHANNELS], "area")


@query(with_views("mask", """
WITH s AS (SELECT roi, object_id, count(*) AS n, CAST(sum(y) AS DOUBLE) AS sy, CAST(sum(x) AS DOUBLE) AS sx,
    CAST(sum(y * y) AS DOUBLE) AS syy, CAST(sum(x * x) AS DOUBLE) AS sxx, CAST(sum(x * y) AS DOUBLE) AS sxy
    FROM mask WHERE object_id <> 0 GROUP BY 1, 2),
  m AS (SELECT *, syy / n - (sy / n) * (sy / n) AS vyy, sxx / n - (sx / n) * (sx / n) AS vxx,
    sxy / n - (sx / n) * (sy / n) AS vxy FROM s),
  l AS (SELECT *, (vyy + vxx) / 2 + sqrt(((vyy - vxx) / 2) ** 2 + vxy * vxy) AS l1,
    greatest((vyy + vxx) / 2 - sqrt(((vyy - vxx) / 2) ** 2 + vxy * vxy), 0) AS l2 FROM m)
SELECT CAST(roi AS VARCHAR) AS sample, object_id AS cell_id, n AS area, round(sy / n, 6) AS centroid_y,
  round(sx / n, 6) AS centroid_x, round(4 * sqrt(l1), 5) AS axis_major, round(4 * sqrt(l2), 5) AS axis_minor,
  CASE WHEN l1 > 0 THEN round(sqrt(1 - l2 / l1), 5) ELSE 0 END AS eccentricity FROM l"""))
def quantify_shape(spark, sf):
    """Centroid, axis lengths and eccentricity per object."""
    props = ob.mask_properties(views.mask(spark, sf))
    return props.select(
        F.col("roi").cast("string").alias("sample"), F.col("object_id").alias("cell_id"), "area",
        F.round("centroid-0", 6).alias("centroid_y"), F.round("centroid-1", 6).alias("centroid_x"),
        F.round("axis_major_length", 5).alias("axis_major"), F.round("axis_minor_length", 5).alias("axis_minor"),
        F.round("eccentricity", 5).alias("eccentricity"),
    )


@query(with_views("dense", """
SELECT roi, object_id, channel, round(avg(value), 6) AS mean FROM dense WHERE object_id <> 0 GROUP BY 1, 2, 3"""))
def quantify_long(spark, sf):
    """Mean per object and channel in long form."""
    long = ob.quantify_channel(views.pixels(spark, sf), views.mask(spark, sf), views.CHANNELS)
    return long.withColumn("mean", F.round("mean", 6))


@query(with_views("mask", """
SELECT roi, count(DISTINCT object_id) FILTER (object_id <> 0) AS n_objects FROM mask GROUP BY roi"""))
def object_counts(spark, sf):
    return ob.object_counts(views.mask(spark, sf))


@query(with_views("px", """
SELECT roi, max(x) + 1 AS width, max(y) + 1 AS height, count(DISTINCT channel) AS n_channels,
  CAST(max(x) + 1 AS VARCHAR) || 'x' || CAST(max(y) + 1 AS VARCHAR) AS dimensions,
  CAST(count(DISTINCT channel) AS VARCHAR) || ' markers' AS panel FROM px GROUP BY roi"""))
def roi_summary(spark, sf):
    """Image catalog."""
    return ra.roi_summary(views.pixels(spark, sf)).withColumnsRenamed({"Dimensions": "dimensions", "Panel": "panel"})


@query(with_views("px", """
WITH per AS (SELECT roi, count(DISTINCT channel) AS n_channels FROM px GROUP BY roi)
SELECT roi, n_channels, (SELECT min(n_channels) = max(n_channels) FROM per) AS panel_matches FROM per"""))
def panel_check(spark, sf):
    return ra.panel_sizes(views.pixels(spark, sf))


@query(with_views("px", """
SELECT DISTINCT channel, '#FFFFFF' AS color, CAST(NULL AS DOUBLE) AS x_lower_bound,
  CAST(NULL AS DOUBLE) AS x_upper_bound FROM px"""))
def default_params(spark, sf):
    """Default display parameters of every channel."""
    return ra.default_channel_params(views.pixels(spark, sf)).select(
        "channel", "color", "x_lower_bound", "x_upper_bound"
    )


@query(with_views("dense", "SELECT roi, channel, y, x, value FROM dense"))
def densify(spark, sf):
    return views.dense(spark, sf)


@query(with_views("dense", "SELECT roi, channel, y, x, value FROM dense WHERE value <> 0"))
def sparsify(spark, sf):
    return ra.sparsify(views.dense(spark, sf))


@query(with_views("px", "SELECT roi, y, x, value FROM px WHERE channel = 'A'"))
def channel_across_rois(spark, sf):
    return ra.load_channels(views.pixels(spark, sf), channels=["A"]).drop("channel")


@query(with_views("px", """
SELECT roi, channel, y - 4 AS y, x - 8 AS x, value FROM px WHERE y >= 4 AND y < 20 AND x >= 8 AND x < 25"""))
def crop_pixels(spark, sf):
    return ra.crop_pixels(views.pixels(spark, sf), 25.9, 8.2, 4.4, 20.7, rebase=True)


@query(with_views("dense", """
SELECT roi, channel, CAST(y // 4 AS INT) AS y, CAST(x // 4 AS INT) AS x, round(avg(value), 6) AS value
FROM dense GROUP BY roi, channel, y // 4, x // 4"""))
def downsample(spark, sf):
    return ra.downsample(views.dense(spark, sf), 4).withColumn("value", F.round("value", 6))


@query(with_views("dense", """
WITH s AS (SELECT roi, channel, y // 8 AS by, x // 8 AS bx, avg(value) AS v FROM dense GROUP BY ALL),
  a AS (SELECT roi, channel, avg(v) AS small FROM s GROUP BY ALL),
  b AS (SELECT roi, channel, avg(value) AS whole FROM dense GROUP BY ALL)
SELECT roi, channel, round(small / nullif(whole, 0), 6) AS signal_ratio,
  coalesce(small / nullif(whole, 0) > 0.75, FALSE) AS shrunk FROM a JOIN b USING (roi, channel)"""))
def thumbnail_choice(spark, sf):
    """Signal kept by a shrunk channel image, and whether to show it."""
    chosen = ra.thumbnail_choice(views.dense(spark, sf), views.extent(spark, sf), 8, 0.75, 3000, keep_below=0)
    return chosen.withColumn("signal_ratio", F.round("signal_ratio", 6))


@query(with_views("mask", """
SELECT m.roi, m.y, m.x, m.object_id FROM mask m WHERE m.object_id <> 0 AND EXISTS (
  SELECT 1 FROM mask n WHERE n.roi = m.roi AND n.object_id <> m.object_id
    AND ((n.y = m.y AND n.x = m.x - 1) OR (n.y = m.y AND n.x = m.x + 1)
      OR (n.x = m.x AND n.y = m.y - 1) OR (n.x = m.x AND n.y = m.y + 1)))"""))
def mask_boundaries(spark, sf):
    return st.mask_boundaries(views.mask(spark, sf), views.extent(spark, sf), tile=16)


@query(with_views("roi_meta", """
WITH n AS (SELECT roi, 'col' AS axis, width AS size FROM roi_meta UNION ALL SELECT roi, 'row', height FROM roi_meta)
SELECT DISTINCT roi, axis, CASE WHEN i.range = size // 100 - 1 THEN size - 1
  ELSE CAST(floor(i.range * ((size - 1) / (size // 100 - 1))) AS INT) END AS position
FROM n, range(10) i WHERE size >= 200 AND i.range < size // 100"""))
def grid_lines(spark, sf):
    return ra.grid_overlay(views.roi_meta(spark, sf), 100)


@query(with_views("mask", """
SELECT roi, y, x, CASE WHEN object_id = 0 THEN 'None' ELSE CAST(object_id AS VARCHAR) END AS label FROM mask"""))
def object_labels(spark, sf):
    """Object id of every pixel as hover text."""
    from rastrel.functions.names import object_label

    return views.mask(spark, sf).select("roi", "y", "x", object_label(F.col("object_id")).alias("label"))
