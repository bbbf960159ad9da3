"""Stored display settings, crops with a fall-back, and channel order."""

from __future__ import annotations

from pyspark.sql import functions as F

from rastrel.operators import display as di
from rastrel.operators import objects as ob
from rastrel.plans import views
from rastrel.plans.views import with_views
from rastrel.queries.pixels import BLEND, PARAMS, _near, parameters
from rastrel.queries.registry import query


def _filters(params):
    """Channel A with a median of 3 x 3, N with one of 2 x 2, R as it is."""
    a, n = F.col("channel") == "A", F.col("channel") == "N"
    return params.withColumns({
        "filter_type": F.when(a | n, "median"), "filter_val": F.when(a, 3.0).when(n, 2.0), "filter_sigma": F.lit(1.0),
    })


def _around(before: int, after: int, edge: str, table: str, name: str) -> str:
    return _near(before, after, edge).replace("near AS", f"{name} AS").replace("dense", table)


FILTERED = f"""{PARAMS}, sc AS (SELECT roi, channel, y, x, v AS value FROM scaled),
  {_around(1, 1, 'reflect', 'sc', 'near3')}, {_around(1, 0, 'reflect', 'sc', 'near2')},
  filtered AS (SELECT roi, channel, y, x, list_sort(list(value))[5] AS v FROM near3 WHERE channel = 'A' GROUP BY 1, 2, 3, 4
    UNION ALL SELECT roi, channel, y, x, list_sort(list(value))[3] FROM near2 WHERE channel = 'N' GROUP BY 1, 2, 3, 4
    UNION ALL SELECT roi, channel, y, x, value FROM sc WHERE channel = 'R'),
  painted AS (SELECT f.roi, f.y, f.x, f.v, p.color, p.r, p.g, p.b FROM filtered f JOIN params p USING (channel)),
  {BLEND.replace('FROM scaled', 'FROM painted')}"""


@query(with_views("dense", f"WITH {FILTERED} SELECT roi, y, x, CAST(r AS BIGINT) AS r, CAST(g AS BIGINT) AS g, CAST(b AS BIGINT) AS b FROM blend"))
def blend_filtered(spark, sf):
    """Colour image of channels that are filtered as their parameters say."""
    return di.blend_filtered(views.pixels(spark, sf), views.extent(spark, sf), _filters(parameters(spark, sf)))


@query(with_views("dense", f"""
WITH {FILTERED}, long AS MATERIALIZED (SELECT roi, 'r' AS channel, y, x, r AS value FROM blend UNION ALL SELECT roi, 'g', y, x, g FROM blend
    UNION ALL SELECT roi, 'b', y, x, b FROM blend),
  {_around(1, 1, 'nearest', 'long', 'near9')}, m AS (SELECT roi, channel, y, x, list_sort(list(value))[5] AS value FROM near9 GROUP BY 1, 2, 3, 4)
SELECT roi, y, x, CAST(max(value) FILTER (channel = 'r') AS BIGINT) AS r, CAST(max(value) FILTER (channel = 'g') AS BIGINT) AS g,
  CAST(max(value) FILTER (channel = 'b') AS BIGINT) AS b FROM m GROUP BY 1, 2, 3"""))
def blend_filtered_whole(spark, sf):
    """The same with a median over the finished image."""
    return di.blend_filtered(views.pixels(spark, sf), views.extent(spark, sf), _filters(parameters(spark, sf)), "median", 3)


@query(with_views("dense", f"""
WITH sc AS (SELECT roi, channel, y, x, greatest(least(value, 40) - 5, 0) * (255.0::DOUBLE / 35) AS value FROM dense), {_around(1, 1, 'reflect', 'sc', 'near3')}
SELECT roi, channel, y, x, round(list_sort(list(value))[5], 6) AS value FROM near3 GROUP BY 1, 2, 3, 4"""))
def preset_applied(spark, sf):
    """Bounds and filter of a preset on every channel."""
    preset = {"x_lower_bound": 5.0, "x_upper_bound": 40.0, "filter_type": "median", "filter_val": 3, "filter_sigma": None}
    done = di.preset_pixels(views.dense(spark, sf), views.extent(spark, sf), preset)
    return done.select("roi", "channel", "y", "x", F.round("value", 6).alias("value"))


def _sizes(spark, sf):
    return views.extent(spark, sf).withColumn("width", F.when(F.col("roi") % 4 == 0, 20).otherwise(F.col("width")))


@query(with_views("px", """
SELECT roi, channel, y, x, value FROM px WHERE roi % 4 = 0 OR (x >= 3 AND x < 30 AND y >= 8 AND y < 16)"""))
def crop_or_whole(spark, sf):
    """A window of every image; narrow images, which it leaves, stay whole."""
    return di.crop_or_whole(views.pixels(spark, sf), _sizes(spark, sf), 3, 30, 8, 16)


@query(with_views("extent", "SELECT roi, roi % 4 <> 0 AS fits FROM extent"))
def mask_fits_image(spark, sf):
    """Whether masks have the size of their image."""
    return ob.mask_fits_image(views.extent(spark, sf), _sizes(spark, sf))


@query("""
WITH o AS (SELECT o_orderkey AS id, list_filter(['A', 'N', 'R', 'X', 'Y'], lambda c, i: (o_orderkey // i) % 2 = 0) AS chosen,
  list_filter(['Y', 'R', 'A', 'X'], lambda c, i: (o_custkey // i) % 3 > 0) AS current FROM orders)
SELECT id, array_to_string(list_concat(list_filter(current, lambda c: list_contains(chosen, c)), list_filter(chosen, lambda c: NOT list_contains(current, c))), ',') AS ordered
FROM o""")
def channel_order(spark, sf):
    """Blend order of sessions after channels were added and removed."""
    at = lambda names, key, keep: F.filter(F.array(*[F.lit(c) for c in names]), lambda c, i: keep(F.floor(F.col(key) / (i + 1))))
    rows = views.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), at("ANRXY", "o_orderkey", lambda v: v % 2 == 0).alias("chosen"),
        at("YRAX", "o_custkey", lambda v: v % 3 > 0).alias("current"))
    return rows.select("id", F.array_join(di.channel_order(F.col("current"), F.col("chosen")), ",").alias("ordered"))


@query("""
WITH c AS (SELECT c_custkey AS id, unnest(['a', 'b', 'c', 'd']) AS key, unnest([c_mktsegment, lower(c_mktsegment), upper(c_name), substr(c_name, 5)]) AS label,
  unnest([1, 2, 3, 4]) AS i FROM customer)
SELECT id, string_agg(key, ',' ORDER BY lower(label), i) AS sorted FROM c GROUP BY id""")
def sorted_channels(spark, sf):
    """Channels of each session by label, upper and lower case alike."""
    labels = [F.col("c_mktsegment"), F.lower("c_mktsegment"), F.upper("c_name"), F.substr(F.col("c_name"), F.lit(5))]
    channels = F.array(*[F.struct(F.lit(k).alias("key"), label.alias("label")) for k, label in zip("abcd", labels, strict=True)])
    return views.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.array_join(di.sorted_channels(channels), ",").alias("sorted"))


@query(with_views("px", "SELECT roi, channel, y, x, value FROM px WHERE channel IN ('A', 'R')"))
def saved_pixels(spark, sf):
    """Pixels of a named channel list, replaced once."""
    none = spark.createDataFrame([], "name string, channels array<string>")
    saved = di.save_blend(di.save_blend(di.save_blend(none, "mine", ["N"]), "other", ["N"]), "mine", ["R", "A", "none"])
    return di.saved_pixels(views.pixels(spark, sf), saved, "mine")
