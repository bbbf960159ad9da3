"""Names, keys, saved settings and their matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from rastrel.functions import names as na
from rastrel.operators import configs as cf
from rastrel.operators import matching as ma
from rastrel.operators import raster as ra
from rastrel.plans import views
from rastrel.plans.views import with_views
from rastrel.queries.registry import query


@query(with_views("roi_meta", """
SELECT roi, string_split(roi, '+++')[1] AS experiment, string_split(roi, '+++')[2] AS slide, string_split(roi, '+++')[3] AS acq FROM roi_meta"""))
def split_roi(spark, sf):
    return na.split_roi(views.roi_meta(spark, sf)).select("roi", "experiment", "slide", "acq")


@query(with_views("roi_meta", """
SELECT roi, CASE WHEN length(string_split(roi, '+++')[3]) > 8 THEN string_split(roi, '+++')[3] ELSE string_split(roi, '+++')[1] END AS name FROM roi_meta"""))
def roi_output_name(spark, sf):
    return views.roi_meta(spark, sf).select("roi", na.roi_output_name(F.col("roi"), threshold=8).alias("name"))


@query("""SELECT c_custkey, CASE WHEN length(CAST(c_custkey AS VARCHAR)) < 3 THEN lpad(CAST(c_custkey AS VARCHAR), 3, '0')
  ELSE CAST(c_custkey AS VARCHAR) END AS padded FROM customer""")
def pad_index(spark, sf):
    return views.table(spark, sf, "customer").select("c_custkey", na.pad_index(F.col("c_custkey")).alias("padded"))


@query("""SELECT c_custkey, o_orderkey, CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) = o_orderkey % 7 AS same
  FROM customer JOIN orders ON o_custkey = c_custkey""")
def trailing_numbers(spark, sf):
    """Equality of the numbers at the end of two names."""
    rows = views.table(spark, sf, "customer").join(views.table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    other = F.concat(F.lit("pos_0"), (F.col("o_orderkey") % 7).cast("string"))
    return rows.select("c_custkey", "o_orderkey", na.same_trailing_number(F.col("c_name"), other).alias("same"))


@query("""
WITH c AS (SELECT p_partkey, '#' || lpad(to_hex(p_partkey * 7919 % 16777216), 6, '0') AS color FROM part)
SELECT p_partkey, p_partkey * 7919 % 16777216 // 65536 AS r, p_partkey * 7919 % 65536 // 256 AS g, p_partkey * 7919 % 256 AS b,
  TRUE AS valid FROM c""")
def hex_to_rgb(spark, sf):
    """Colour codes to components."""
    code = F.concat(F.lit("#"), F.lpad(F.hex(F.col("p_partkey") * 7919 % 16777216), 6, "0"))
    rows = views.table(spark, sf, "part").select("p_partkey", code.alias("color"))
    rgb = na.hex_to_rgb(F.col("color"))
    part = lambda n: rgb[n].cast("bigint").alias(n)
    return rows.select("p_partkey", part("r"), part("g"), part("b"), na.is_hex_colour(F.col("color")).alias("valid"))


@query("""
SELECT c_custkey AS id, c_custkey % 1000 < c_custkey * 7 % 1000 AS before, c_mktsegment < 'FURNITURE' OR (c_mktsegment = 'FURNITURE' AND c_custkey % 1000 < 50) AS before_other
FROM customer""")
def natural_order(spark, sf):
    """Which of two names comes first when numbers inside them compare by value."""
    name = lambda number: F.concat("c_mktsegment", F.lit("_"), number.cast("string"))
    key = F.col("c_custkey")
    first, second, other = (na.natural_key(c) for c in (name(key % 1000), name(key * 7 % 1000), F.lit("FURNITURE_50")))
    return views.table(spark, sf, "customer").select(key.alias("id"), (first < second).alias("before"), (first < other).alias("before_other"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS x_lower_bound FROM events")
def json_params(spark, sf):
    """Parameters from JSON text."""
    parsed = F.from_json("props", "k DOUBLE")
    return views.table(spark, sf, "events").select("event_id", parsed["k"].alias("x_lower_bound"))


def _config_log(spark, sf):
    """A log of saved settings: users save configurations named by event type."""
    p = F.from_json("props", "k DOUBLE")["k"]
    none = lambda t: F.lit(None).cast(t)
    one = lambda alias, low: F.struct(
        F.lit("#FFFFFF").alias("color"), low.alias("x_lower_bound"), none("double").alias("x_upper_bound"),
        none("string").alias("filter_type"), none("double").alias("filter_val"), none("double").alias("filter_sigma"),
        alias.alias("alias"),
    )
    channels = F.create_map(
        F.lit("A"), one(none("string"), p), F.concat(F.lit("ch"), (F.col("event_id") % 5).cast("string")),
        one(F.concat(F.lit("label "), (F.col("event_id") % 5).cast("string")), F.lit(0.0)),
    )
    setting = F.struct(
        (F.col("event_id") % 2 == 0).alias("global_apply_filter"), F.lit("median").alias("global_filter_type"),
        F.lit(3.0).alias("global_filter_val"), F.lit(1.0).alias("global_filter_sigma"),
    )
    blend = F.array(F.concat(F.lit("ch"), (F.col("event_id") % 5).cast("string")), F.lit("A"))
    return views.table(spark, sf, "events").select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("user"), F.col("event_type").alias("name"),
        F.col("event_id").alias("saved_at"), channels.alias("channels"),
        F.struct(blend.alias("blend"), setting.alias("filter")).alias("config"),
    )


@query("""
SELECT 'user_' || user_id AS user, event_type AS name, max(event_id) AS saved_at FROM events GROUP BY 1, 2""")
def config_latest(spark, sf):
    """Newest saved settings per user and name."""
    return cf.latest_configs(_config_log(spark, sf)).select("user", "name", "saved_at")


@query("""
WITH h AS (SELECT max(event_id) // 2 AS m FROM events), o AS (SELECT user_id, event_type, max(event_id) AS e FROM events, h WHERE event_id <= m GROUP BY 1, 2),
  n AS (SELECT user_id, event_type, max(event_id) AS e FROM events, h WHERE event_id > m AND event_type <> 'click' GROUP BY 1, 2)
SELECT 'user_' || user_id AS user, event_type AS name, max(e) AS saved_at FROM (SELECT * FROM o UNION ALL SELECT * FROM n)
WHERE NOT (user_id = 3 AND event_type = 'error') GROUP BY 1, 2""")
def config_upsert(spark, sf):
    """New settings over saved ones, one entry then removed."""
    log = _config_log(spark, sf)
    half = log.agg(F.expr("max(saved_at) div 2").alias("m")).scalar()
    marked = log.withColumn("new", F.col("saved_at") > half)
    saved = cf.latest_configs(marked.where(~F.col("new")).drop("new"))
    new = marked.where(F.col("new") & (F.col("name") != "click")).drop("new")
    return cf.remove_config(cf.upsert_configs(saved, new), "user_3", "error").select("user", "name", "saved_at")


@query("""
WITH l AS (SELECT user_id, event_type, max(event_id) AS e FROM events GROUP BY 1, 2)
SELECT event_type AS names, CAST(2 AS INT) AS panel_length, 'label ' || (e % 5) || ' \\' || chr(10) || ' A' AS channels,
  'global_apply_filter: ' || CASE WHEN e % 2 = 0 THEN 'True' ELSE 'False' END || ' \\' || chr(10) || ' global_filter_type: median \\'
  || chr(10) || ' global_filter_val: 3.0 \\' || chr(10) || ' global_filter_sigma: 1.0' AS filter FROM l""")
def config_preview(spark, sf):
    return cf.preview_configs(cf.latest_configs(_config_log(spark, sf))).select(
        F.col("Names").alias("names"), F.col("Panel Length").alias("panel_length"),
        F.col("Selected Channels").alias("channels"), F.col("Filter").alias("filter"),
    )


@query("""
SELECT 'user_' || user_id AS user, event_type AS name, event_id AS saved_at, c.ch AS channel,
  CASE WHEN c.ch = 'A' THEN 'A' ELSE 'label ' || (event_id % 5) END AS alias
FROM events, LATERAL (SELECT unnest(['A', 'ch' || (event_id % 5)]) AS ch) c
WHERE (user_id, event_type, event_id) IN (SELECT (user_id, event_type, max(event_id)) FROM events GROUP BY user_id, event_type)""")
def config_aliases(spark, sf):
    """Display names of the channels of saved settings."""
    saved = cf.latest_configs(_config_log(spark, sf))
    return cf.config_aliases(saved).join(saved.select("user", "name", "saved_at"), ["user", "name"])


@query(with_views("px", """
SELECT (SELECT count(DISTINCT channel) FROM px) = 3 AND (SELECT bool_and(channel IN ('A', 'N', 'R')) FROM px) AS matches"""))
def panel_match(spark, sf):
    """Whether a parameter table fits the channels of the images."""
    params = ra.default_channel_params(views.pixels(spark, sf))
    return cf.panels_match(views.pixels(spark, sf).select("channel"), params)


@query(with_views("px", """
SELECT roi, y, x, channel, CASE channel WHEN 'A' THEN 'alpha' ELSE channel END AS alias FROM px"""))
def apply_aliases(spark, sf):
    panel = views.pixels(spark, sf).select("channel").distinct().withColumn(
        "alias", F.when(F.col("channel") == "A", "alpha")
    )
    return ra.apply_aliases(views.pixels(spark, sf), panel).select("roi", "y", "x", "channel", "alias")


ROIS = """rois AS (SELECT 'exp' || (p_partkey % 97) || '+++slide0+++' || CASE p_partkey % 3 WHEN 0 THEN 'pos' || p_partkey || '_' || (p_partkey // 97 + 1)
    WHEN 1 THEN 'roi_' || p_partkey ELSE p_type || '_' || p_partkey || 'x' END AS roi, p_partkey AS position FROM part)"""
MASKS = """masks AS (SELECT CASE s_suppkey % 5 WHEN 0 THEN 'exp' || s_suppkey || '+++slide0+++roi_' || s_suppkey
    WHEN 1 THEN 'exp' || s_suppkey WHEN 2 THEN 'exp' || s_suppkey || '_0' || (s_suppkey % 20 + 1)
    WHEN 3 THEN 'roi_' || (s_suppkey * 4) ELSE 'file_s0_a' || (s_suppkey * 3 + 1) || '_ac_IA_mask' END AS name, s_suppkey AS position FROM supplier)"""


def _rois(spark, sf):
    return views.table(spark, sf, "part").selectExpr(
        "concat('exp', p_partkey % 97, '+++slide0+++', CASE p_partkey % 3 WHEN 0 THEN concat('pos', p_partkey, '_', p_partkey div 97 + 1)"
        " WHEN 1 THEN concat('roi_', p_partkey) ELSE concat(p_type, '_', p_partkey, 'x') END) AS roi", "p_partkey AS position",
    )


def _masks(spark, sf):
    return views.table(spark, sf, "supplier").selectExpr(
        "CASE s_suppkey % 5 WHEN 0 THEN concat('exp', s_suppkey, '+++slide0+++roi_', s_suppkey) WHEN 1 THEN concat('exp', s_suppkey)"
        " WHEN 2 THEN concat('exp', s_suppkey, '_0', s_suppkey % 20 + 1) WHEN 3 THEN concat('roi_', s_suppkey * 4)"
        " ELSE concat('file_s0_a', s_suppkey * 3 + 1, '_ac_IA_mask') END AS name", "s_suppkey AS position",
    )


NUMBER = "CAST(nullif(regexp_extract({}, '([0-9]+)$', 1), '') AS BIGINT)"


@query(f"""
WITH {ROIS}, {MASKS}, k AS (SELECT roi, position, string_split(roi, '+++')[1] AS exp, string_split(roi, '+++')[3] AS acq FROM rois),
  c AS (SELECT k.roi, m.name, CASE WHEN m.name = k.roi THEN 1
      WHEN m.name LIKE '%_ac_IA_mask' AND CAST(regexp_extract(m.name, '_a([0-9]+)_ac', 1) AS BIGINT) - 1 = k.position THEN 2
      WHEN m.name = k.exp THEN 3 WHEN m.name = k.acq THEN 4
      WHEN contains(m.name, k.exp) AND {NUMBER.format('m.name')} = {NUMBER.format('k.acq')} THEN 5
      WHEN contains(m.name, k.exp) OR contains(m.name, k.acq) THEN 6 END AS rule, m.position FROM k, masks m),
  b AS (SELECT roi, name, row_number() OVER (PARTITION BY roi ORDER BY rule, CASE WHEN rule = 2 THEN -position ELSE position END) AS n FROM c WHERE rule IS NOT NULL)
SELECT k.roi, b.name AS mask_name FROM k LEFT JOIN b ON b.roi = k.roi AND b.n = 1""")
def match_masks(spark, sf):
    """Mask of each image by the cascade of naming rules."""
    return ma.match_masks(_rois(spark, sf), _masks(spark, sf))


IMAGES = """images AS (SELECT CASE p_partkey % 4 WHEN 0 THEN 'exp' || (p_partkey % 89) || '_' || (p_partkey % 7) WHEN 1 THEN 'roi_' || p_partkey
    WHEN 2 THEN 'file_' || (p_partkey + 1) ELSE 'img' || p_partkey || 'x' END AS name, min(p_partkey) AS position FROM part GROUP BY 1)"""


def _images(spark, sf):
    named = views.table(spark, sf, "part").selectExpr(
        "CASE p_partkey % 4 WHEN 0 THEN concat('exp', p_partkey % 89, '_', p_partkey % 7) WHEN 1 THEN concat('roi_', p_partkey)"
        " WHEN 2 THEN concat('file_', p_partkey + 1) ELSE concat('img', p_partkey, 'x') END AS name", "p_partkey",
    )
    return named.groupBy("name").agg(F.min("p_partkey").alias("position"))


@query(f"""
WITH {MASKS}, {IMAGES}, c AS (SELECT m.name, i.name AS image, CASE WHEN i.name = m.name THEN 1 WHEN contains(m.name, i.name) THEN 2
      WHEN {NUMBER.format('m.name')} = {NUMBER.format('i.name')} THEN 3
      WHEN m.name LIKE '%_ac_IA_mask' AND regexp_extract(m.name, '_a([0-9]+)_ac', 1) = string_split(i.name, '_')[-1] THEN 4 END AS rule,
      i.position FROM masks m, images i),
  b AS (SELECT name, image, row_number() OVER (PARTITION BY name ORDER BY rule,
      CASE WHEN rule = 2 THEN -position WHEN rule = 3 THEN position ELSE 0 END, CASE WHEN rule = 4 THEN image END DESC) AS n FROM c WHERE rule IS NOT NULL)
SELECT m.name, b.image FROM masks m LEFT JOIN b ON b.name = m.name AND b.n = 1""")
def match_masks_to_images(spark, sf):
    """Object-table image of each mask."""
    return ma.match_masks_to_images(_masks(spark, sf), _images(spark, sf))


@query(f"""
WITH {ROIS}, k AS (SELECT roi, position, string_split(roi, '+++')[1] AS exp, string_split(roi, '+++')[3] AS acq,
    CASE WHEN position % 6 = 0 THEN 'exp' || (position % 97) || '_mask' WHEN position % 6 = 1 THEN 'm_' || position END AS mask FROM rois),
  d AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN 'exp' || (p_partkey % 89) || '_' || lpad(CAST(p_partkey % 7 AS VARCHAR), 3, '0')
    WHEN 1 THEN 'roi_' || p_partkey WHEN 2 THEN 'exp' || (p_partkey % 60) ELSE 'img' || p_partkey END AS name FROM part),
  p AS (SELECT *, exp || '_' || CASE WHEN length(string_split(acq, '_')[-1]) < 3 THEN lpad(string_split(acq, '_')[-1], 3, '0')
      ELSE string_split(acq, '_')[-1] END AS padded, coalesce({NUMBER.format('mask')} = {NUMBER.format('acq')}, FALSE) AS same FROM k),
  s1 AS (SELECT *, CASE WHEN padded IN (SELECT name FROM d) THEN padded END AS v1 FROM p),
  s2 AS (SELECT *, CASE WHEN (v1 IS NULL AND mask IS NOT NULL AND (same OR contains(mask, acq))) OR acq IN (SELECT name FROM d) THEN acq ELSE v1 END AS v2 FROM s1),
  s3 AS (SELECT *, CASE WHEN v2 IS NULL AND (exp IN (SELECT name FROM d) OR coalesce(contains(mask, exp), FALSE))
      THEN CASE WHEN coalesce(contains(mask, exp), FALSE) THEN mask ELSE exp END ELSE v2 END AS v3 FROM s2)
SELECT roi, CASE WHEN v3 IS NOT NULL THEN v3 WHEN mask IS NOT NULL AND (same OR mask = acq) THEN mask ELSE exp || '_' || (position + 1) END AS value,
  CASE WHEN v3 IS NOT NULL THEN 'description' ELSE 'sample' END AS column FROM s3""")
def match_objects(spark, sf):
    """Object-table value and column of each image."""
    masked = F.when(F.col("position") % 6 == 0, F.concat(F.lit("exp"), (F.col("position") % 97).cast("string"), F.lit("_mask"))).when(
        F.col("position") % 6 == 1, F.concat(F.lit("m_"), F.col("position").cast("string"))
    )
    listed = views.table(spark, sf, "part").selectExpr(
        "'description' AS column",
        "CASE p_partkey % 4 WHEN 0 THEN concat('exp', p_partkey % 89, '_', lpad(p_partkey % 7, 3, '0')) WHEN 1 THEN concat('roi_', p_partkey)"
        " WHEN 2 THEN concat('exp', p_partkey % 60) ELSE concat('img', p_partkey) END AS name",
    )
    return ma.match_objects(_rois(spark, sf).withColumn("mask", masked), listed)


@query(with_views("annotations", """
SELECT a.id FROM annotations a WHERE a.x_min % 40 <= 32 AND a.y_min % 40 <= 32"""))
def points_in_images(spark, sf):
    """Points that fit their image, the image size itself included."""
    from rastrel.sources.files import points_in_images as inside

    points = views.annotations(spark, sf).select("id", "roi", (F.col("x_min") % 40).alias("x"), (F.col("y_min") % 40).alias("y"))
    return inside(points, views.extent(spark, sf)).select("id")


@query(with_views("spots", """
WITH c AS (SELECT roi, spot_id, status AS gene, value FROM spots)
SELECT 'img' || roi AS sample, spot_id AS cell_id, CAST(coalesce(sum(value) FILTER (gene = 'F'), 0) AS DOUBLE) AS "F",
  CAST(coalesce(sum(value) FILTER (gene = 'O'), 0) AS DOUBLE) AS "O" FROM c GROUP BY 1, 2"""))
def objects_from_matrix(spark, sf):
    """Object table from expression triples and pipeline metadata."""
    from rastrel.sources.files import objects_from_matrix as build

    rows = views.spots(spark, sf)
    counts = rows.select("roi", "spot_id", F.col("status").alias("gene"), F.col("value").cast("double").alias("value"))
    obs = rows.select(
        "roi", "spot_id", F.concat(F.lit("Object "), F.col("spot_id").cast("string")).alias("name"),
        F.concat(F.lit("img"), F.col("roi").cast("string"), F.lit(".tiff")).alias("Image"),
    )
    return build(counts, obs, ["F", "O"], pipeline=True).select("sample", "cell_id", "F", "O")


@query(with_views("objects", """
SELECT sample, cell_id, 'ch_disc' AS gene, CAST(ch_disc AS DOUBLE) AS value FROM objects WHERE ch_disc <> 0
UNION ALL SELECT sample, cell_id, 'ch_tax', ch_tax FROM objects WHERE ch_tax <> 0"""))
def matrix_from_objects(spark, sf):
    """Expression triples of the object table."""
    from rastrel.sources.files import matrix_from_objects as split

    return split(views.objects(spark, sf), ["sample", "cell_id"], ["ch_disc", "ch_tax"])[0]


@query(with_views("roi_meta", """
SELECT roi, (width * height >= 200000 AND n >= 10) OR width * height >= 700000 OR width * height * n >= 5000000 AS single_channel
FROM (SELECT *, length(roi) - 10 AS n FROM roi_meta)"""))
def single_channel_advice(spark, sf):
    """Which images to read one channel at a time, with limits scaled to the views."""
    meta = views.roi_meta(spark, sf).withColumn("n_channels", F.length("roi") - 10)
    return ra.needs_single_channel_load(meta, 200_000, 10, 700_000, 5_000_000).select("roi", "single_channel")
