"""Spatial expression spots."""

from __future__ import annotations

from pyspark.sql import functions as F

from rastrel.functions.geometry import affine_window
from rastrel.operators import spots as sp
from rastrel.plans import views
from rastrel.plans.views import with_views
from rastrel.queries.registry import query

# scale 65 / (2 * 13) = 2.5 for spot arrays; other images are drawn as they are
SCALES = """sc AS (SELECT DISTINCT roi, roi % 50 = 0 AS based, CASE WHEN roi % 50 = 0 THEN 13 ELSE 3 END AS radius,
    CASE WHEN roi % 50 = 0 THEN 2.5::DOUBLE ELSE 1.0 END AS scale FROM spots),
  bb AS (SELECT roi, any_value(based) AS based, min(x * scale) AS x0, max(x * scale) AS x1, min(y * scale) AS y0, max(y * scale) AS y1
    FROM spots JOIN sc USING (roi) GROUP BY roi),
  lo AS (SELECT roi, based, CASE WHEN based THEN trunc(x0 - trunc(0.03 * (x1 - x0))) ELSE x0 END AS x0, x1,
    CASE WHEN based THEN trunc(y0 - trunc(0.03 * (y1 - y0))) ELSE y0 END AS y0, y1 FROM bb),
  ext AS (SELECT roi, x0, y0, CAST(trunc((CASE WHEN based THEN trunc(x1 + trunc(0.03 * (x1 - x0))) ELSE x1 END) - x0) AS BIGINT) AS w,
    CAST(trunc((CASE WHEN based THEN trunc(y1 + trunc(0.03 * (y1 - y0))) ELSE y1 END) - y0) AS BIGINT) AS h FROM lo)"""


def _draw(values: str) -> str:
    return f"""drawn AS (SELECT v.roi, v.value, CAST(trunc(v.y * scale - y0 + dy.range) AS INT) AS y, CAST(trunc(v.x * scale - x0 + dx.range) AS INT) AS x, w, h
    FROM {values} v JOIN sc USING (roi) JOIN ext USING (roi), range(-40, 41) dy, range(-40, 41) dx
    WHERE dy.range * dy.range + dx.range * dx.range < CAST(floor(radius * scale) AS INT) * CAST(floor(radius * scale) AS INT))"""


def scales(spark, sf):
    """Every fiftieth image is a spot array with spots 26 units wide, the others have markers of radius 3."""
    images = views.spots(spark, sf).select("roi").distinct()
    based = F.col("roi") % 50 == 0
    meta = images.select(
        "roi", based.alias("spot_based"), F.when(based, 26.0).alias("spot_diameter")
    )
    return sp.with_spot_scale(meta, radius=3)


def extents(spark, sf):
    return sp.spatial_extent(views.spots(spark, sf), scales(spark, sf))


@query(with_views("spots", "SELECT DISTINCT roi, CASE WHEN roi % 50 = 0 THEN 13 ELSE 3 END AS radius, CASE WHEN roi % 50 = 0 THEN 2.5::DOUBLE ELSE 1.0 END AS scale FROM spots"))
def spot_scale(spark, sf):
    return scales(spark, sf).select("roi", "radius", "scale")


@query(with_views("spots", f"WITH {SCALES} SELECT roi, w AS grid_width, h AS grid_height, x0 AS x_min, y0 AS y_min FROM ext"))
def spatial_extent(spark, sf):
    """Canvas of each spatial image."""
    return extents(spark, sf)


@query(with_views("spots", f"""
WITH {SCALES}, small AS (SELECT * FROM spots WHERE value > 0), {_draw('small').replace('range(-40, 41)', 'range(-33, 34)')}
SELECT roi, 'g' AS channel, y, x, max(value) AS value FROM drawn WHERE y >= 0 AND y < h AND x >= 0 AND x < w GROUP BY 1, 2, 3, 4"""))
def rasterize_spots(spark, sf):
    """Spots drawn as disks, the largest value staying where they meet."""
    values = views.spots(spark, sf).withColumn("gene", F.lit("g"))
    return sp.rasterize_spots(values, scales(spark, sf), extents(spark, sf))


@query(with_views("spots", f"""
WITH {SCALES}, n AS (SELECT roi, x, y, row_number() OVER (PARTITION BY roi ORDER BY spot_id) AS value FROM spots),
  {_draw('n').replace('range(-40, 41)', 'range(-33, 34)')}
SELECT roi, y, x, max(value) AS object_id FROM drawn WHERE y >= 0 AND y < h AND x >= 0 AND x < w GROUP BY 1, 2, 3"""))
def spot_mask(spark, sf):
    """Label mask with one object per spot."""
    return sp.spot_mask(views.spots(spark, sf), scales(spark, sf), extents(spark, sf))


@query(with_views("spots", "SELECT roi, spot_id, status, row_number() OVER (PARTITION BY roi ORDER BY spot_id) AS object_id FROM spots"))
def obs_projection(spark, sf):
    """Spot metadata with the object id of the spot mask."""
    rows = views.spots(spark, sf).withColumn("cell_id", F.col("spot_id"))
    return sp.obs_projection(rows).select("roi", "spot_id", "status", "object_id")


@query(with_views("spots", "SELECT roi, spot_id, x / 8 AS x, y / 8 AS y, 8 AS bin FROM spots"))
def scale_bins(spark, sf):
    return sp.scale_bins(views.spots(spark, sf), 8).select("roi", "spot_id", "x", "y", "bin")


@query("""
WITH n AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)
SELECT p_partkey AS position, CASE WHEN k = 1 THEN p_name ELSE p_name || '-' || (k - 1) END AS gene FROM n""")
def unique_genes(spark, sf):
    """Repeated names made unique."""
    return sp.unique_genes(views.table(spark, sf, "part").select(F.col("p_partkey").alias("position"), F.col("p_name").alias("gene")))


@query(with_views("spots", """
WITH sh AS (SELECT p_type AS region, CASE WHEN p_type = 'PROMO' THEN p_size ELSE 20 END AS radius FROM part),
  d AS (SELECT region, CASE WHEN min(radius) = max(radius) THEN min(radius) * 2.0::DOUBLE END AS spot_diameter FROM sh GROUP BY 1)
SELECT region || '+++slideNA+++acq' AS roi, spot_id, d.spot_diameter FROM spots s JOIN part ON p_partkey = spot_id JOIN d ON d.region = p_type"""))
def split_by_region(spark, sf):
    """Spots of regions as images of their own, with the diameter where all shapes agree."""
    parts = views.table(spark, sf, "part")
    shapes = parts.select(
        F.col("p_type").alias("region"), F.when(F.col("p_type") == "PROMO", F.col("p_size")).otherwise(20).cast("double").alias("radius")
    )
    rows = views.spots(spark, sf).drop("roi").join(
        parts.select(F.col("p_partkey").alias("spot_id"), F.col("p_type").alias("region")), "spot_id"
    )
    return sp.split_by_region(rows, shapes).select("roi", "spot_id", "spot_diameter")


@query(with_views("spots", f"""
WITH {SCALES}, s AS (SELECT roi, x, y, x * scale - x0 AS px, y * scale - y0 AS py FROM spots JOIN sc USING (roi) JOIN ext USING (roi))
SELECT roi, min(x) AS x, min(y) AS y, CAST(trunc(max(x) - min(x)) AS BIGINT) AS width, CAST(trunc(max(y) - min(y)) AS BIGINT) AS height
FROM s WHERE px BETWEEN 50 AND 400.5 AND py BETWEEN 20 AND 300 GROUP BY roi"""))
def window_to_slide(spark, sf):
    """Slide rectangle of the spots seen in a window."""
    windows = scales(spark, sf).select(
        "roi", F.lit(50.0).alias("x_low"), F.lit(400.5).alias("x_high"), F.lit(20.0).alias("y_low"), F.lit(300.0).alias("y_high")
    )
    return sp.window_to_slide(views.spots(spark, sf), scales(spark, sf), extents(spark, sf), windows)


MATRIX = [[0.0, 0.5, 10.0], [-0.25, 0.0, 20.0], [0.0, 0.0, 1.0]]


@query(with_views("annotations", """
WITH c AS (SELECT id, CASE WHEN x_min - 300 < 0 THEN 0.1::DOUBLE ELSE (x_min - 300) / 0.25::DOUBLE END AS xl,
    CASE WHEN x_max - 300 < 0 THEN 0.1::DOUBLE ELSE (x_max - 300) / 0.25::DOUBLE END AS xh, (y_min + 5) / 0.25::DOUBLE AS yl,
    (y_max + 5) / 0.25::DOUBLE AS yh FROM annotations),
  t AS (SELECT id, 80 - 4 * yl AS ax, 2 * xl - 20 AS ay, 80 - 4 * yh AS bx, 2 * xh - 20 AS bb FROM c)
SELECT id, round(least(ax, bx), 4) AS x, round(least(ay, bb), 4) AS y, CAST(trunc(abs(ax - bx)) AS BIGINT) AS width,
  CAST(trunc(abs(ay - bb)) AS BIGINT) AS height FROM t"""))
def affine_windows(spark, sf):
    """Canvas windows on the slide by an affine transformation."""
    w = affine_window(
        F.col("x_min"), F.col("x_max"), F.col("y_min"), F.col("y_max"), F.lit(-300), F.lit(5), MATRIX, 0.25
    )
    rows = views.annotations(spark, sf).withColumn("w", w)
    return rows.select("id", F.round("w.x", 4).alias("x"), F.round("w.y", 4).alias("y"), "w.width", "w.height")
