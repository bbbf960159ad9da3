"""Intensity bounds, blends, correlations and filters of pixel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastrel.functions.colour import gradient_table, rgb_to_grey, scale_intensity
from rastrel.operators import raster as ra
from rastrel.operators import stencils as st
from rastrel.plans import views
from rastrel.plans.views import with_views
from rastrel.queries.registry import query


def parameters(spark, sf) -> DataFrame:
    """Display parameters of the channels, bounds taken from the data."""
    ranges = views.pixels(spark, sf).groupBy("channel").agg(F.max("value").alias("top"))
    colour = F.when(F.col("channel") == "A", "#BE4115").when(F.col("channel") == "N", "#15BEB0").otherwise("#ffffff")
    return ranges.select(
        "channel", colour.alias("color"), F.when(F.col("channel") == "R", None).otherwise(5.0).alias("x_lower_bound"),
        (F.col("top") - 10).cast("double").alias("x_upper_bound"),
    )


PARAMS = """params AS (SELECT channel, CASE channel WHEN 'A' THEN '#BE4115' WHEN 'N' THEN '#15BEB0' ELSE '#ffffff' END AS color,
    CASE channel WHEN 'A' THEN 190 WHEN 'N' THEN 21 ELSE 255 END AS r, CASE channel WHEN 'A' THEN 65 WHEN 'N' THEN 190 ELSE 255 END AS g,
    CASE channel WHEN 'A' THEN 21 WHEN 'N' THEN 176 ELSE 255 END AS b,
    CASE channel WHEN 'R' THEN 0 ELSE 5 END AS lo, max(value) - 10 AS hi FROM px GROUP BY channel),
  scaled AS (SELECT d.roi, d.y, d.x, d.channel, d.object_id, p.color, p.r, p.g, p.b,
    greatest(least(d.value, p.hi) - p.lo, 0) * (255.0::DOUBLE / (p.hi - p.lo)) AS v FROM dense d JOIN params p USING (channel))"""
WEIGHT = "CAST(CAST({c} AS FLOAT) / 255::FLOAT AS FLOAT) * 255::FLOAT"
SHARE = "CAST(CAST(v AS FLOAT) / 255::FLOAT AS FLOAT)"


def _part(c: str) -> str:
    return f"CASE WHEN color = '#ffffff' THEN CAST(floor(v) AS INT) ELSE CAST(floor({SHARE} * ({WEIGHT.format(c=c)})) AS INT) END"


BLEND = f"""blend AS (SELECT roi, y, x, least(sum({_part('r')}), 255) AS r, least(sum({_part('g')}), 255) AS g,
    least(sum({_part('b')}), 255) AS b FROM scaled GROUP BY roi, y, x)"""


@query(with_views("dense", """
SELECT roi, channel, round(CASE WHEN quantile_cont(value, 0.99) > 0 THEN quantile_cont(value, 0.99) ELSE 1.0 END, 6) AS upper_bound
FROM dense GROUP BY 1, 2"""))
def channel_p99(spark, sf):
    """Default upper bound of each channel of each image."""
    bounds = ra.channel_upper_bound(views.pixels(spark, sf), extent=views.extent(spark, sf), channels=views.CHANNELS)
    return bounds.withColumn("upper_bound", F.round("upper_bound", 6))


@query(with_views("dense", """
SELECT channel, round(CASE WHEN quantile_cont(value, 0.99) > 0 THEN quantile_cont(value, 0.99) ELSE 1.0 END, 6) AS upper_bound
FROM dense GROUP BY 1"""))
def channel_p99_pooled(spark, sf):
    """Upper bound per channel over all images, groups of any size."""
    bounds = ra.channel_upper_bound(views.pixels(spark, sf), ["channel"], extent=views.extent(spark, sf), channels=views.CHANNELS)
    return bounds.withColumn("upper_bound", F.round("upper_bound", 6))


@query(with_views("dense", """
SELECT roi, channel, greatest(CAST(max(value) AS DOUBLE), 1.0) AS max_value FROM dense GROUP BY 1, 2"""))
def channel_max(spark, sf):
    return ra.channel_max(views.dense(spark, sf))


@query(with_views("dense", """
SELECT channel, least(greatest(CAST(floor(value / 5.0) AS BIGINT) + 1, 1), 10) AS bin, count(*) AS n_pixels
FROM dense GROUP BY 1, 2"""))
def pixel_histogram(spark, sf):
    return ra.pixel_histogram(views.dense(spark, sf), ["channel"], 10, 0.0, 50.0)


@query(with_views("dense", f"""
WITH {PARAMS} SELECT roi, channel, y, x, round(v, 6) AS scaled FROM scaled"""))
def scale_intensity_by_channel(spark, sf):
    """Pixels clipped and stretched by their channel's bounds."""
    rows = ra.with_channel_params(views.dense(spark, sf), parameters(spark, sf))
    return rows.select("roi", "channel", "y", "x", F.round("scaled", 6).alias("scaled"))


@query(with_views("px", """
SELECT roi, channel, y, x, CAST(CASE WHEN value % 3 = 0 THEN greatest(value - 4, 0)
  WHEN value % 3 = 1 THEN greatest(least(value, 20) - 20, 0) ELSE greatest(least(value, 9) - 30, 0) END AS DOUBLE) AS value FROM px"""))
def scale_intensity_edges(spark, sf):
    """Scaling without upper bound, with equal bounds and with swapped bounds."""
    kind = F.col("value") % 3
    lower = F.when(kind == 0, 4.0).when(kind == 1, 20.0).otherwise(30.0)
    upper = F.when(kind == 1, 20.0).when(kind == 2, 9.0)
    return views.pixels(spark, sf).select(
        "roi", "channel", "y", "x", F.round(scale_intensity(F.col("value"), lower, upper), 6).alias("value")
    )


@query(with_views("dense", f"""
WITH {PARAMS}, {BLEND} SELECT roi, y, x, CAST(r AS BIGINT) AS r, CAST(g AS BIGINT) AS g, CAST(b AS BIGINT) AS b FROM blend"""))
def blend(spark, sf):
    """Additive colour image of all channels."""
    return ra.blend(views.pixels(spark, sf), parameters(spark, sf), extent=views.extent(spark, sf))


@query(with_views("dense", f"""
WITH {PARAMS}, {BLEND}, w AS (SELECT roi, y, x, CASE WHEN object_id > 0 THEN 127.5 ELSE 0 END AS w FROM mask)
SELECT roi, y, x, CAST(least(round_even(r + w, 0), 255) AS BIGINT) AS r, CAST(least(round_even(g + w, 0), 255) AS BIGINT) AS g,
  CAST(least(round_even(b + w, 0), 255) AS BIGINT) AS b FROM blend JOIN w USING (roi, y, x)"""))
def blend_with_mask(spark, sf):
    """Colour image with the mask laid over it at half weight."""
    image = ra.blend(views.pixels(spark, sf), parameters(spark, sf), extent=views.extent(spark, sf))
    return ra.overlay_mask(image, views.mask(spark, sf), 50.0)


@query(with_views("dense", """
WITH w AS (SELECT roi, y, x, max(object_id) AS object_id, CAST(max(value) FILTER (channel = 'A') AS DOUBLE) AS t0,
    CAST(max(value) FILTER (channel = 'R') AS DOUBLE) AS b0 FROM dense GROUP BY 1, 2, 3),
  c AS (SELECT *, CASE WHEN t0 < 8 THEN 0 ELSE t0 END AS t, CASE WHEN b0 < 3 THEN 0 ELSE b0 END AS b FROM w)
SELECT roi, round(coalesce(sum(t) FILTER (t > 8 AND object_id > 0), 0) / nullif(sum(t) FILTER (t > 8), 0), 6) AS target_in_mask,
  round(coalesce(sum(t) FILTER (t > 8 AND b > 3 AND object_id > 0), 0) / nullif(sum(t) FILTER (t > 8 AND object_id > 0), 0), 6) AS overlap_in_mask,
  round(coalesce(sum(b) FILTER (b > 3 AND object_id > 0), 0) / nullif(sum(b) FILTER (b > 3), 0), 6) AS baseline_in_mask,
  round(corr(t, b), 6) AS pearson FROM c GROUP BY roi"""))
def marker_correlation(spark, sf):
    """Correlation and mask shares of two channels."""
    table = ra.marker_correlation(views.pixels(spark, sf), "A", "R", views.mask(spark, sf), 8.0, 3.0, views.extent(spark, sf))
    return table.select("roi", *[F.round(c, 6).alias(c) for c in table.columns if c != "roi"])


@query(with_views("dense", """
SELECT channel, round(quantile_cont(value, 0.99), 6) AS x_upper_bound, 0.0::DOUBLE AS x_lower_bound
FROM dense WHERE CAST(roi AS VARCHAR) NOT LIKE '%7%' GROUP BY channel"""))
def autoscale(spark, sf):
    """Upper bound per channel over all images not excluded by name."""
    scaled = ra.autoscale(views.pixels(spark, sf), views.extent(spark, sf), size_limit=16, exclude=["7"], channels=views.CHANNELS)
    return scaled.withColumn("x_upper_bound", F.round("x_upper_bound", 6))


@query(with_views("dense", "SELECT channel, 0.0::DOUBLE AS x_lower_bound FROM dense GROUP BY channel"))
def autoscale_sampled(spark, sf):
    """The same from 200 pixels per image and channel; only the channels are checked."""
    sampled = ra.autoscale(views.dense(spark, sf), views.extent(spark, sf), size_limit=16, subsample=200)
    return sampled.select("channel", "x_lower_bound")


def _gradient_check(name: str) -> str:
    table = gradient_table(name)
    lists = [", ".join(str(row[i]) for row in table) for i in range(3)]
    pick = lambda i: f"CASE WHEN value = 0 THEN 0 ELSE ([{lists[i]}])[k + 1] END"
    return with_views("dense", f"""
WITH g AS (SELECT roi, channel, CAST(min(value) AS DOUBLE) AS lo, CAST(max(value) AS DOUBLE) AS hi FROM dense GROUP BY 1, 2),
  i AS (SELECT d.*, least(CAST(floor(coalesce((value - lo) / nullif(hi - lo, 0), 0) * 256) AS INT), 255) AS k
    FROM dense d JOIN g USING (roi, channel))
SELECT roi, channel, y, x, {pick(0)} AS r, {pick(1)} AS g, {pick(2)} AS b FROM i""")


def _gradient(name: str) -> None:
    def run(spark, sf):
        return ra.apply_gradient(views.dense(spark, sf), name).drop("value")

    run.__name__ = f"gradient_{name}"
    query(_gradient_check(name))(run)


for _name in ("rainbow", "blue_gold", "jet"):
    _gradient(_name)


@query(with_views("px", """
WITH c AS (SELECT roi, y, x, coalesce(max(value) FILTER (channel = 'A'), 0) * 5 AS r, coalesce(max(value) FILTER (channel = 'N'), 0) * 5 AS g,
  coalesce(max(value) FILTER (channel = 'R'), 0) * 5 AS b FROM px GROUP BY 1, 2, 3)
SELECT roi, y, x, CAST((r * 19595 + g * 38470 + b * 7471 + 32768) // 65536 AS INT) AS grey FROM c"""))
def rgb_to_greyscale(spark, sf):
    top = lambda c: F.max(F.when(F.col("channel") == c, F.col("value"))).alias(c)
    rows = views.pixels(spark, sf).groupBy("roi", "y", "x").agg(*[top(c) for c in views.CHANNELS])
    part = lambda c: F.coalesce(F.col(c), F.lit(0)) * 5
    return rows.select("roi", "y", "x", rgb_to_grey(part("A"), part("N"), part("R")).alias("grey"))


# neighbourhoods for the checks: every pixel with all window positions, borders folded back
def _near(before: int, after: int, edge: str) -> str:
    def fold(c: str) -> str:
        if edge == "reflect":
            return f"CASE WHEN {c} < 0 THEN -1 - {c} WHEN {c} > 31 THEN 63 - {c} ELSE {c} END"
        if edge == "mirror":
            return f"CASE WHEN {c} < 0 THEN -{c} WHEN {c} > 31 THEN 62 - {c} ELSE {c} END"
        return f"least(greatest({c}, 0), 31)"

    return f"""near AS (SELECT d.roi, d.channel, d.y, d.x, dy.range AS dy, dx.range AS dx, n.value FROM dense d,
    range({-before}, {after + 1}) dy, range({-before}, {after + 1}) dx, dense n
    WHERE n.roi = d.roi AND n.channel = d.channel AND n.y = {fold('(d.y + dy.range)')} AND n.x = {fold('(d.x + dx.range)')})"""


@query(with_views("dense", f"""
WITH {_near(1, 1, 'reflect')} SELECT roi, channel, y, x, CAST(median(value) AS BIGINT) AS value FROM near GROUP BY 1, 2, 3, 4"""))
def median_filter3(spark, sf):
    return st.median_filter(views.dense(spark, sf), views.extent(spark, sf), 3, tile=16)


@query(with_views("dense", f"""
WITH {_near(1, 0, 'reflect')} SELECT roi, channel, y, x, list_sort(list(value))[3] AS value FROM near GROUP BY 1, 2, 3, 4"""))
def median_filter2(spark, sf):
    """Even window: it reaches back, and the upper middle value counts."""
    return st.median_filter(views.dense(spark, sf), views.extent(spark, sf), 2, tile=16)


_W = st.gaussian_weights(3, 1.0)


@query(with_views("dense", f"""
WITH {_near(1, 1, 'mirror')} SELECT roi, channel, y, x, round(sum(value * ([{_W[0]!r}::DOUBLE, {_W[1]!r}, {_W[2]!r}])[dy + 2]
  * ([{_W[0]!r}::DOUBLE, {_W[1]!r}, {_W[2]!r}])[dx + 2]), 6) AS value FROM near GROUP BY 1, 2, 3, 4"""))
def gaussian_filter3(spark, sf):
    blurred = st.gaussian_filter(views.dense(spark, sf), views.extent(spark, sf), 3, 1.0, tile=16)
    return blurred.withColumn("value", F.round("value", 6))


@query(with_views("dense", f"""
WITH {_near(2, 1, 'reflect')}, m AS (SELECT roi, channel, y, x, avg(value) AS m FROM near GROUP BY 1, 2, 3, 4),
  {_near(2, 1, 'mirror').replace('near AS', 'near2 AS')}, t AS (SELECT roi, channel, y, x, max(value) AS t FROM near2 GROUP BY 1, 2, 3, 4)
SELECT roi, channel, round(max(t - m), 6) AS hpf FROM m JOIN t USING (roi, channel, y, x) GROUP BY 1, 2"""))
def hot_pixel_diff(spark, sf):
    """Largest local maximum above the local mean, in windows of 4 x 4."""
    found = st.hot_pixel_diff(views.dense(spark, sf), views.extent(spark, sf), 4, tile=16)
    return found.withColumn("hpf", F.round("hpf", 6))
