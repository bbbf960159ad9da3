"""Selecting, gating and summarising objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from rastrel.functions.names import parse_id_list
from rastrel.operators import gating as ga
from rastrel.operators import objects as ob
from rastrel.plans import views
from rastrel.plans.views import OBJECT_CHANNELS as CH
from rastrel.plans.views import with_views
from rastrel.queries.registry import query

GATES = {
    "ch_qty": {"lower_bound": 0.2, "upper_bound": 0.45},
    "ch_disc": {"lower_bound": 0.31, "upper_bound": 1.0},
    "ch_tax": {"lower_bound": 0.0, "upper_bound": 1.0},
}
SELECTED = ["ch_qty", "ch_disc", "absent"]
SCALED = """r AS (SELECT min(ch_qty) AS q0, max(ch_qty) AS q1, min(ch_disc) AS d0, max(ch_disc) AS d1,
    min(ch_tax) AS t0, max(ch_tax) AS t1 FROM objects),
  s AS (SELECT o.*, (ch_qty - q0) / CAST(nullif(q1 - q0, 0) AS DOUBLE) AS nq,
    (ch_disc - d0) / CAST(nullif(d1 - d0, 0) AS DOUBLE) AS nd,
    (ch_tax - t0) / CAST(nullif(t1 - t0, 0) AS DOUBLE) AS nt FROM objects o, r)"""
JOINED = "SELECT o.*, e.UMAP1, e.UMAP2 FROM objects o JOIN embedding e USING (cell_id)"
WINDOW = {"x0": 0.0, "x1": 3.0, "y0": 3.0, "y1": -0.05}
LONG = """SELECT 'ch_qty' AS channel, ch_qty AS v FROM objects UNION ALL SELECT 'ch_disc', ch_disc FROM objects
  UNION ALL SELECT 'ch_tax', ch_tax FROM objects"""


@query(with_views("objects", """
WITH q AS (SELECT quantile_cont(ch_qty, 0.95) AS a, quantile_cont(ch_disc, 0.95) AS b,
  quantile_cont(ch_tax, 0.95) AS c FROM objects)
SELECT sample, cell_id, ch_qty, ch_disc, ch_tax FROM objects, q WHERE ch_qty < a AND ch_disc < b AND ch_tax < c"""))
def hot_object_filter(spark, sf):
    """Objects below the 95th percentile in every channel."""
    return ob.filter_hot_objects(views.objects(spark, sf), CH, 0.95).select("sample", "cell_id", *CH)


@query(with_views("objects", """
SELECT sample, cell_id FROM objects WHERE x_min >= 100 AND x_max <= 400 AND y_min >= 50 AND y_max <= 600"""))
def box_filter(spark, sf):
    return ob.objects_in_box(views.objects(spark, sf), 400, 100, 50, 600).select("sample", "cell_id")


@query(with_views("objects", """
SELECT sample, cell_id FROM objects WHERE x_max BETWEEN 100 AND 400 AND y_max BETWEEN 50 AND 600"""))
def upper_corner_filter(spark, sf):
    return ob.objects_by_upper_corner(views.objects(spark, sf), 100, 400, 50, 600).select("sample", "cell_id")


@query(with_views("objects", """
SELECT sample, cell_id FROM objects WHERE x_min <= 111 AND x_max >= 111 AND y_min <= 160 AND y_max >= 160"""))
def point_filter(spark, sf):
    return ob.objects_at_point(views.objects(spark, sf), 111, 160).select("sample", "cell_id")


@query(with_views("objects embedding", f"""
SELECT sample, cell_id, ch_qty FROM ({JOINED}) WHERE UMAP1 >= 0 AND UMAP1 <= 3 AND UMAP2 >= -0.05 AND UMAP2 <= 3"""))
def embedding_window(spark, sf):
    found = ob.objects_in_embedding_window(views.objects(spark, sf), views.embedding(spark, sf), ["cell_id"], WINDOW)
    return found.select("sample", "cell_id", "ch_qty")


@query(with_views("objects clusters typed", """
SELECT sample, cell_id, kind FROM typed WHERE kind IN ('ECONOMY', 'PROMO')"""))
def category_filter(spark, sf):
    return ob.filter_categories(views.typed_objects(spark, sf), "kind", ["ECONOMY", "PROMO"]).select("sample", "cell_id", "kind")


@query(with_views("typed", "SELECT kind AS category, min(cell_id) AS first_position FROM typed GROUP BY 1"))
def category_order(spark, sf):
    """Categories with their first appearance."""
    return ob.category_order(views.typed_objects(spark, sf), "kind", "cell_id")


@query(with_views("typed", """
SELECT sample, cell_id, kind AS category, min(cell_id) OVER (PARTITION BY kind) AS category_position,
  CAST(NULL AS DOUBLE) AS number FROM typed"""))
def embedding_overlay(spark, sf):
    """Objects with a category overlay in order of first appearance."""
    shown = ob.embedding_overlay(views.typed_objects(spark, sf), "kind", "cell_id", True)
    return shown.select("sample", "cell_id", "category", "category_position", "number")


@query(with_views("objects", """
SELECT sample, cell_id, CAST(NULL AS VARCHAR) AS category, CAST(NULL AS BIGINT) AS category_position, CAST(area AS DOUBLE) AS number FROM objects"""))
def embedding_overlay_number(spark, sf):
    """Objects with a numeric overlay."""
    shown = ob.embedding_overlay(views.objects(spark, sf), "area", "cell_id", False)
    return shown.select("sample", "cell_id", "category", "category_position", "number")


@query(with_views("objects", """
SELECT CAST(area AS DOUBLE) AS x, CAST(ch_qty AS DOUBLE) AS y, CAST(sample % 3 AS VARCHAR) AS "group" FROM objects"""))
def associate_numbers(spark, sf):
    """Area against a channel as points."""
    rows = views.objects(spark, sf).withColumn("third", F.col("sample") % 3)
    return ob.associate_numbers(rows, "area", "ch_qty", "third")


@query(with_views("objects", f"WITH {SCALED} SELECT sample, cell_id FROM s WHERE (nq >= 0.2 AND nq <= 0.45) OR nd >= 0.31"))
def gate_union(spark, sf):
    return ga.gate(views.objects(spark, sf), GATES, SELECTED).select("sample", "cell_id")


@query(with_views("objects", f"WITH {SCALED} SELECT sample, cell_id FROM s WHERE nq >= 0.2 AND nq <= 0.45 AND nd >= 0.31"))
def gate_intersection(spark, sf):
    return ga.gate(views.objects(spark, sf), GATES, SELECTED, intersection=True).select("sample", "cell_id")


@query(with_views("objects", "SELECT sample, cell_id FROM objects WHERE ch_qty BETWEEN 10 AND 60"))
def gate_raw(spark, sf):
    """Gate on unscaled values."""
    gates = {"ch_qty": {"lower_bound": 10, "upper_bound": 60}}
    return ga.gate(views.objects(spark, sf), gates, ["ch_qty"], normalize=False).select("sample", "cell_id")


@query(with_views("objects", f"""
WITH {SCALED} SELECT sample, cell_id, CASE WHEN nq >= 0.2 AND nq <= 0.45 AND nd >= 0.31 THEN 'bright'
  ELSE 'Unassigned' END AS gated FROM s"""))
def gate_label_all(spark, sf):
    labelled = ga.label_gated(views.objects(spark, sf), GATES, SELECTED, "gated", "bright", intersection=True)
    return labelled.select("sample", "cell_id", "gated")


@query(with_views("mask objects", f"""
WITH {SCALED}, g AS (SELECT sample AS roi, cell_id % 20 AS object_id FROM s WHERE nq >= 0.2 AND nq <= 0.45)
SELECT DISTINCT m.roi, m.object_id FROM mask m WHERE y >= 3 AND y < 18 AND x >= 5 AND x < 27
  AND EXISTS (SELECT 1 FROM g WHERE g.roi = m.roi AND g.object_id = m.object_id)"""))
def gate_in_window(spark, sf):
    """Gated objects seen in a window of their image."""
    gated = ga.gate(views.objects(spark, sf), GATES, ["ch_qty"]).select(
        F.col("sample").alias("roi"), (F.col("cell_id") % 20).alias("object_id")
    )
    return ga.gated_in_window(views.mask(spark, sf), gated, 27.6, 5.1, 18.9, 3.0)


@query("""
SELECT event_id, CAST(trim(u.part) AS BIGINT) AS id FROM (SELECT event_id,
  unnest(string_split(CAST(user_id AS VARCHAR) || ', ' || event_type || ' ,' || CAST(event_id AS VARCHAR), ',')) AS part
  FROM events) u WHERE regexp_full_match(trim(u.part), '[0-9]+')""")
def id_list(spark, sf):
    """Typed id lists with entries that are no numbers."""
    events = views.table(spark, sf, "events")
    typed = F.concat(
        F.col("user_id").cast("string"), F.lit(", "), F.col("event_type"), F.lit(" ,"), F.col("event_id").cast("string")
    )
    return events.select("event_id", F.explode(parse_id_list(typed)).alias("id"))


def _summary(mode: str, fold: str):
    sql = with_views("objects", f"SELECT channel AS \"Channel\", round(CAST({fold} AS DOUBLE), 6) AS {mode} FROM ({LONG}) GROUP BY channel")

    def run(spark, sf):
        return ob.summarize_channels(views.objects(spark, sf), CH, mode).withColumn(mode, F.round(mode, 6))

    run.__name__ = f"channel_summary_{mode}"
    query(sql)(run)


for _mode, _fold in (("mean", "avg(v)"), ("max", "max(v)"), ("min", "min(v)"), ("median", "quantile_cont(v, 0.5)")):
    _summary(_mode, _fold)


@query(with_views("objects", f"""
WITH {SCALED} SELECT sample, cell_id, round(nq, 6) AS ch_qty, round(nd, 6) AS ch_disc, round(nt, 6) AS ch_tax FROM s"""))
def minmax(spark, sf):
    scaled = ob.minmax(views.objects(spark, sf), CH)
    return scaled.select("sample", "cell_id", *[F.round(c, 6).alias(c) for c in CH])


@query(with_views("typed", """
WITH g AS (SELECT kind, avg(ch_qty) AS q, avg(ch_disc) AS d, avg(ch_tax) AS t FROM typed GROUP BY 1)
SELECT kind, round(q / max(q) OVER (), 6) AS ch_qty, round(d / max(d) OVER (), 6) AS ch_disc,
  round(t / max(t) OVER (), 6) AS ch_tax FROM g"""))
def group_expression(spark, sf):
    """Mean channel values per category relative to the largest."""
    table = ob.group_expression(views.typed_objects(spark, sf), CH, "kind")
    return table.select("kind", *[F.round(c, 6).alias(c) for c in CH])


@query(with_views("objects", f"""
SELECT channel AS "Channel", round(avg(v), 6) AS "Expression" FROM ({LONG}) GROUP BY channel"""))
def expression_summary(spark, sf):
    return ob.expression_summary(views.objects(spark, sf), CH).withColumn("Expression", F.round("Expression", 6))


@query(with_views("typed embedding", """
WITH k AS (SELECT t.*, e.UMAP1, e.UMAP2 FROM typed t JOIN embedding e USING (cell_id)
    WHERE kind IN ('ECONOMY', 'PROMO', 'SMALL')),
  r AS (SELECT min(ch_qty) AS q0, max(ch_qty) AS q1, min(ch_disc) AS d0, max(ch_disc) AS d1 FROM k)
SELECT sample, cell_id, round((ch_qty - q0) / CAST(nullif(q1 - q0, 0) AS DOUBLE), 6) AS ch_qty,
  round((ch_disc - d0) / CAST(nullif(d1 - d0, 0) AS DOUBLE), 6) AS ch_disc FROM k, r
WHERE UMAP1 >= 0 AND UMAP1 <= 3 AND UMAP2 >= -0.05 AND UMAP2 <= 3"""))
def expression_of_window(spark, sf):
    """Category filter, scaling, then the embedding window."""
    rows = ob.with_embedding(views.typed_objects(spark, sf), views.embedding(spark, sf), ["cell_id"])
    found = ob.expression_of_window(rows, CH[:2], WINDOW, "kind", ["ECONOMY", "PROMO", "SMALL"])
    return found.select("sample", "cell_id", *[F.round(c, 6).alias(c) for c in CH[:2]])


@query(with_views("typed", """
WITH c AS (SELECT kind, count(*) AS n FROM typed GROUP BY 1)
SELECT kind AS "Value", n AS "Counts", round_even(n / CAST(sum(n) OVER () AS DOUBLE) * 1000, 0) / 1000 AS "Proportion",
  count(*) OVER () AS n_values FROM c"""))
def distribution(spark, sf):
    return ob.distribution(views.typed_objects(spark, sf), "kind")


@query("""
WITH c AS (SELECT CAST(l_partkey AS VARCHAR) AS v, count(*) AS n FROM lineitem GROUP BY 1)
SELECT v AS "Value", n AS "Counts", round_even(n / CAST(sum(n) OVER () AS DOUBLE) * 1000, 0) / 1000 AS "Proportion",
  count(*) OVER () AS n_values FROM c""")
def distribution_of_many(spark, sf):
    """Distribution of a column with many different values: all of them."""
    return ob.distribution(views.table(spark, sf, "lineitem"), "l_partkey")


@query(with_views("objects", """
SELECT DISTINCT sample AS image, cell_id // 4096 AS id_range, cell_id AS id FROM objects"""))
def ids_per_roi(spark, sf):
    """Object ids of each image in ranges, unrolled for the check."""
    lists = ob.ids_per_image(views.objects(spark, sf))
    return lists.select("image", "id_range", F.explode("ids").alias("id"))


@query(with_views("typed", """
SELECT kind AS x, CAST(sample % 3 AS VARCHAR) AS "group", count(ch_qty) AS n, CAST(min(ch_qty) AS DOUBLE) AS low,
  round(quantile_cont(ch_qty, 0.25), 6) AS q1, round(quantile_cont(ch_qty, 0.5), 6) AS median,
  round(quantile_cont(ch_qty, 0.75), 6) AS q3, CAST(max(ch_qty) AS DOUBLE) AS high FROM typed GROUP BY 1, 2"""))
def associate(spark, sf):
    """Five-number summary of a channel per category and group."""
    rows = views.typed_objects(spark, sf).withColumn("third", F.col("sample") % 3)
    table = ob.associate(rows, "kind", "ch_qty", "third")
    return table.select("x", "group", "n", *[F.round(c, 6).alias(c) for c in ("low", "q1", "median", "q3", "high")])


@query(with_views("objects", """
SELECT sample, count(*) AS n, round(avg(ch_qty), 6) AS ch_qty, round(avg(ch_disc), 6) AS ch_disc
FROM objects GROUP BY ROLLUP (sample)"""))
def mean_by_roi_and_all(spark, sf):
    """Channel means per image and over all images in one pass."""
    return views.objects(spark, sf).rollup("sample").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("ch_qty"), 6).alias("ch_qty"), F.round(F.avg("ch_disc"), 6).alias("ch_disc")
    )


@query(with_views("objects", "SELECT sample, cell_id, ch_qty, area FROM objects"))
def append_quantification(spark, sf):
    """Objects of half of the images added to those of the other half."""
    rows = views.objects(spark, sf).select("sample", "cell_id", "ch_qty", "area")
    even, odd = rows.where(F.col("sample") % 2 == 0), rows.where(F.col("sample") % 2 == 1)
    return ob.append_quantification(even, odd)


@query(with_views("objects", "SELECT sample, cell_id, ch_qty, area FROM objects WHERE sample >= 5"))
def append_known_image(spark, sf):
    """Images measured before: the new table replaces the old one."""
    rows = views.objects(spark, sf).select("sample", "cell_id", "ch_qty", "area")
    return ob.append_quantification(rows, rows.where(F.col("sample") >= 5))


@query(with_views("objects", "SELECT least(500, count(*)) AS n, TRUE AS known FROM objects"))
def sample_objects(spark, sf):
    """A fixed-size sample: its size, and whether it holds only objects of the table, each once."""
    rows = views.objects(spark, sf)
    drawn = ob.sample_objects(rows, 500, ["sample", "cell_id"])
    back = drawn.select("sample", "cell_id").distinct().join(rows.select("sample", "cell_id"), ["sample", "cell_id"], "left_semi")
    n_back = back.agg(F.count(F.lit(1)).alias("n")).scalar()
    return drawn.agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) == n_back).alias("known"))
