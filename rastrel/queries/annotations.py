"""Annotations on objects and rasters, and cluster tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rastrel.operators import annotate as an
from rastrel.operators import clusters as cl
from rastrel.operators import objects as ob
from rastrel.operators import polygons as po
from rastrel.plans import views
from rastrel.plans.views import with_views
from rastrel.queries.registry import query

COLUMNS = ["col_0", "col_1"]
BOX = """hits AS (SELECT o.sample, o.cell_id, a.annotation_column, a.seq, a.cell_type FROM objects o JOIN annotations a
  ON a.roi = o.sample AND o.x_min >= a.x_min AND o.x_max <= a.x_max AND o.y_min >= a.y_min AND o.y_max <= a.y_max)"""
LAST = """last AS (SELECT sample, cell_id, max_by(cell_type, seq) FILTER (annotation_column = 'col_0') AS c0,
  max_by(cell_type, seq) FILTER (annotation_column = 'col_1') AS c1 FROM hits GROUP BY 1, 2)"""
WRITTEN = """SELECT o.sample, o.cell_id, coalesce(c0, 'Unassigned') AS col_0, coalesce(c1, 'Unassigned') AS col_1
  FROM objects o LEFT JOIN last USING (sample, cell_id)"""
PALETTE = ["#932652", "#FAE4B0", "#DCCAFC", "#00FF80"]


def _written(objects, hits, **options):
    table = an.apply_annotations(objects, hits, COLUMNS, **options)
    return table.select("sample", "cell_id", *COLUMNS)


@query(with_views("objects annotations", f"WITH {BOX}, {LAST} {WRITTEN}"))
def annotate_boxes(spark, sf):
    """Every object with the last box annotation that holds it, per annotation column."""
    objects = views.objects(spark, sf)
    return _written(objects, an.box_hits(objects, views.annotations(spark, sf)))


@query(with_views("objects annotations", f"""
WITH a AS (SELECT DISTINCT cell_type, annotation_column, x_min, x_max, y_min, y_max, max(seq) OVER (
    PARTITION BY x_min, y_min, annotation_column) AS seq, seq AS own FROM annotations),
  {BOX.replace('annotations a', 'a').replace('a.roi = o.sample AND ', '').replace('hits AS (', 'hits AS (SELECT * FROM (').replace('o.y_max <= a.y_max)', 'o.y_max <= a.y_max AND a.own = a.seq))')},
  {LAST} {WRITTEN}"""))
def annotate_boxes_everywhere(spark, sf):
    """The same with boxes that apply to the objects of all images."""
    objects = views.objects(spark, sf)
    boxes = views.annotations(spark, sf)
    # of boxes with equal bounds only the last can win
    last = boxes.groupBy("annotation_column", "x_min", "x_max", "y_min", "y_max").agg(
        F.max("seq").alias("seq"), F.max_by("cell_type", "seq").alias("cell_type"), F.max_by("roi", "seq").alias("roi")
    )
    return _written(objects, an.box_hits(objects, last, scope="all"))


CLICKS = """clicks AS (SELECT roi, x_min AS x, y_min AS y, seq, cell_type, annotation_column FROM annotations)"""


def _clicks(spark, sf):
    return views.annotations(spark, sf).select(
        "roi", F.col("x_min").alias("x"), F.col("y_min").alias("y"), "seq", "cell_type", "annotation_column"
    )


@query(with_views("objects annotations", f"""
WITH {CLICKS}, hits AS (SELECT o.sample, o.cell_id, c.annotation_column, c.seq, c.cell_type FROM objects o JOIN clicks c
  ON c.roi = o.sample AND c.x BETWEEN o.x_min AND o.x_max AND c.y BETWEEN o.y_min AND o.y_max), {LAST} {WRITTEN}"""))
def annotate_click(spark, sf):
    """Objects whose box holds a clicked point."""
    objects = views.objects(spark, sf)
    return _written(objects, an.click_hits(objects, _clicks(spark, sf)))


def _mask_objects(spark, sf):
    """Objects of the label masks as an object table."""
    return ob.mask_properties(views.mask(spark, sf)).select(
        F.col("roi").alias("sample"), F.col("object_id").alias("cell_id"), "area"
    )


MASK_OBJECTS = "mobj AS (SELECT roi AS sample, object_id AS cell_id FROM mask WHERE object_id <> 0 GROUP BY 1, 2)"


@query(with_views("mask annotations", f"""
WITH {MASK_OBJECTS}, hits AS (SELECT m.roi AS sample, m.object_id AS cell_id, a.annotation_column, a.seq, a.cell_type
  FROM annotations a JOIN mask m ON m.roi = a.roi AND m.x = a.x_min % 32 AND m.y = a.y_min % 32 WHERE m.object_id <> 0), {LAST}
{WRITTEN.replace('FROM objects o', 'FROM mobj o')}"""))
def annotate_click_on_mask(spark, sf):
    """Objects whose mask pixel was clicked."""
    clicks = _clicks(spark, sf).withColumns({"x": (F.col("x") % 32).cast("int"), "y": (F.col("y") % 32).cast("int")})
    objects = _mask_objects(spark, sf)
    return _written(objects, an.click_hits(objects, clicks, views.mask(spark, sf)))


GATES = """gates AS (SELECT roi, seq, cell_type, annotation_column, [seq % 20 + 1, (seq * 3) % 20 + 1, (seq * 7) % 20 + 1] AS ids
  FROM annotations)"""


def _gates(spark, sf):
    s = F.col("seq")
    return views.annotations(spark, sf).select(
        "id", "roi", "seq", "cell_type", "annotation_column",
        F.array(s % 20 + 1, (s * 3) % 20 + 1, (s * 7) % 20 + 1).alias("object_ids"),
    )


@query(with_views("mask annotations", f"""
WITH {MASK_OBJECTS}, {GATES}, hits AS (SELECT roi AS sample, unnest(ids) AS cell_id, annotation_column, seq, cell_type FROM gates), {LAST}
{WRITTEN.replace('FROM objects o', 'FROM mobj o')}"""))
def annotate_gate(spark, sf):
    """Objects listed by gate annotations."""
    objects = _mask_objects(spark, sf)
    return _written(objects, an.gate_hits(objects, _gates(spark, sf)))


def _drawn(spark, sf):
    return views.paths(spark, sf).select(
        F.col("region").alias("seq"), "roi", "cell_type", "path",
        F.concat(F.lit("col_"), (F.col("region") % 2).cast("string")).alias("annotation_column"),
    )


PATH_HITS = """share AS (SELECT i.region, i.roi, i.cell_type, m.object_id, count(*) AS c FROM inside i JOIN mask m USING (roi, y, x)
    WHERE m.object_id <> 0 GROUP BY ALL),
  n AS (SELECT roi, object_id, count(*) AS n FROM mask WHERE object_id <> 0 GROUP BY 1, 2),
  hits AS (SELECT roi AS sample, object_id AS cell_id, 'col_' || (region % 2) AS annotation_column, region AS seq, cell_type
    FROM share JOIN n USING (roi, object_id) WHERE c / CAST(n.n AS DOUBLE) >= 0.6)"""


@query(with_views("mask inside", f"""
WITH {MASK_OBJECTS}, {PATH_HITS}, {LAST} {WRITTEN.replace('FROM objects o', 'FROM mobj o')}"""))
def annotate_path(spark, sf):
    """Objects mostly inside drawn paths."""
    objects = _mask_objects(spark, sf)
    hits = an.path_hits(objects, _drawn(spark, sf), views.mask(spark, sf), views.extent(spark, sf), 0.6)
    return _written(objects, hits)


@query(with_views("objects corners", f"""
WITH annotations AS (SELECT region AS seq, roi, cell_type, 'col_' || (region % 2) AS annotation_column, (cx - rx) AS x_min,
  cx + rx AS x_max, cy - ry AS y_min, greatest(cy + ry, cy + 1) AS y_max FROM corners), {BOX}, {LAST} {WRITTEN}"""))
def annotate_path_without_mask(spark, sf):
    """Without a mask the bounding box of a path counts."""
    objects = views.objects(spark, sf)
    return _written(objects, an.path_hits(objects, _drawn(spark, sf)))


@query(with_views("objects embedding", """
SELECT sample, cell_id, CASE WHEN UMAP1 >= 0 AND UMAP1 <= 3 AND UMAP2 >= -0.05 AND UMAP2 <= 3 THEN 'seen' ELSE 'Unassigned' END AS cls
FROM objects JOIN embedding USING (cell_id)"""))
def annotate_embedding(spark, sf):
    """Objects in an embedding window."""
    objects = ob.with_embedding(views.objects(spark, sf), views.embedding(spark, sf), ["cell_id"])
    window = {"x0": 0.0, "x1": 3.0, "y0": 3.0, "y1": -0.05}
    hits = an.embedding_hits(objects, ob.in_embedding_window(window), 1, "seen", "cls")
    return an.apply_annotations(objects, hits, ["cls"]).select("sample", "cell_id", "cls")


@query(with_views("objects annotations", f"""
WITH {BOX}, {LAST} SELECT o.sample, o.cell_id, CASE WHEN c0 IS NOT NULL THEN 'Unassigned' ELSE 'old' END AS col_0,
  'Unassigned' AS col_1 FROM objects o LEFT JOIN last USING (sample, cell_id)"""))
def annotate_remove(spark, sf):
    """Removing annotations writes the default on the objects they hold."""
    objects = views.objects(spark, sf).withColumn("col_0", F.lit("old"))
    return _written(objects, an.box_hits(objects, views.annotations(spark, sf)), remove=True)


@query(with_views("annotations", """
WITH i AS (SELECT *, row_number() OVER (PARTITION BY roi ORDER BY seq) - 1 AS k, count(*) OVER (PARTITION BY roi) AS n FROM annotations)
SELECT id, roi FROM i WHERE NOT (roi = 3 AND (k IN (0, 2) OR k = n - 1))"""))
def annotation_remove(spark, sf):
    """Annotations of one image removed by list position."""
    return an.remove_annotations(views.annotations(spark, sf), 3, [0, 2, -1]).select("id", "roi")


@query(with_views("annotations", """
SELECT id, roi FROM annotations WHERE (roi, seq) NOT IN (SELECT (roi, max(seq)) FROM annotations GROUP BY roi)"""))
def annotation_drop_last(spark, sf):
    return an.drop_last(views.annotations(spark, sf)).select("id", "roi")


@query(with_views("annotations", """
WITH i AS (SELECT *, row_number() OVER (PARTITION BY roi ORDER BY seq) - 1 AS k FROM annotations)
SELECT id, roi FROM annotations UNION ALL SELECT id, 5 AS roi FROM i WHERE roi = 2 AND k IN (1, 4)"""))
def annotation_transfer(spark, sf):
    """Annotations copied from one image to another."""
    return an.transfer_annotations(views.annotations(spark, sf), 2, 5, [1, 4]).select("id", "roi")


@query(with_views("annotations", """
SELECT id, row_number() OVER (PARTITION BY roi ORDER BY seq) - 1 AS index FROM annotations"""))
def annotation_index(spark, sf):
    return an.with_index(views.annotations(spark, sf)).select("id", "index")


@query(with_views("annotations", """
SELECT id, CASE id % 3 WHEN 0 THEN 'x: [' || x_min || ', ' || x_max || ']' || chr(10) || ' y: [' || y_min || ', ' || y_max || ']'
  WHEN 1 THEN 'x: ' || x_min || ', y: ' || y_min ELSE '3 cells' END AS preview FROM annotations"""))
def annotation_preview(spark, sf):
    rows = views.annotations(spark, sf).join(_gates(spark, sf).select("id", "object_ids"), "id")
    kind = F.col("id") % 3
    typed = rows.withColumns({
        "type": F.when(kind == 0, "rect").when(kind == 1, "point").otherwise("gate"),
        "path": F.lit(None).cast("string"),
        **{c: F.col(c).cast("double") for c in ("x_min", "x_max", "y_min", "y_max")},
    })
    return an.annotation_preview(typed).select("id", "preview")


@query(with_views("mask regions", """
WITH a AS (SELECT r.*, 'col_' || (region % 2) AS annotation_column, e.event_type AS cell_type FROM regions r JOIN events e ON e.event_id = region),
  f AS (SELECT roi, annotation_column, cell_type, min(region) AS s FROM a GROUP BY 1, 2, 3),
  ids AS (SELECT roi, annotation_column, cell_type, row_number() OVER (PARTITION BY roi, annotation_column ORDER BY s) AS class_id FROM f),
  p AS (SELECT a.roi, a.annotation_column, m.y, m.x, max_by(a.cell_type, a.region) AS cell_type FROM a JOIN mask m ON m.roi = a.roi
    AND m.x >= x_min AND m.x < x_max AND m.y >= y_min AND m.y < y_max GROUP BY 1, 2, 3, 4)
SELECT roi, annotation_column, y, x, class_id FROM p JOIN ids USING (roi, annotation_column, cell_type)"""))
def annotation_mask(spark, sf):
    """Class raster of rectangle annotations per annotation column."""
    kinds = views.table(spark, sf, "events").select(F.col("event_id").alias("region"), F.col("event_type").alias("cell_type"))
    boxes = views.regions(spark, sf).join(kinds, "region").select(
        F.col("region").alias("seq"), "roi", "cell_type", "x_min", "x_max", "y_min", "y_max",
        F.concat(F.lit("col_"), (F.col("region") % 2).cast("string")).alias("annotation_column"),
    )
    return an.annotation_mask(an.rectangle_pixels(boxes, views.extent(spark, sf)), boxes)


@query(with_views("mask inside annotations", f"""
WITH {PATH_HITS}, {GATES}
SELECT sample AS "ROI", 'mask' AS mask_name, cell_id, annotation_column AS annotation_col, cell_type AS annotation FROM hits
UNION ALL SELECT roi, 'mask', unnest(ids), annotation_column, cell_type FROM gates"""))
def export_region_objects(spark, sf):
    """Objects of path and gate annotations as export rows."""
    drawn = _drawn(spark, sf).withColumn("type", F.lit("path")).withColumn("object_ids", F.lit(None).cast("array<bigint>"))
    gates = _gates(spark, sf).withColumn("type", F.lit("gate"))
    columns = ["roi", "seq", "type", "annotation_column", "cell_type", "object_ids"]
    both = drawn.select(*columns).unionByName(gates.select(*columns)).withColumn("mask_name", F.lit("mask"))
    inside = po.objects_in_regions(views.mask(spark, sf), po.path_spans(views.paths(spark, sf), views.extent(spark, sf)), 0.6)
    return an.region_objects(both, inside)


@query(with_views("mask annotations", f"""
WITH {CLICKS}, c AS (SELECT roi, x % 40 AS x, y % 40 AS y, cell_type, annotation_column FROM clicks)
SELECT c.roi AS "ROI", c.x, c.y, c.annotation_column AS annotation_col, c.cell_type AS annotation, m.object_id AS mask_cell_id
FROM c LEFT JOIN mask m ON m.roi = c.roi AND m.x = c.x AND m.y = c.y"""))
def export_points(spark, sf):
    """Point annotations with the object under each point."""
    clicks = _clicks(spark, sf).withColumns({"x": F.col("x") % 40, "y": F.col("y") % 40})
    return an.point_export(clicks, views.mask(spark, sf))


# ---------------------------------------------------------------- clusters

MC = """mc AS (SELECT DISTINCT m.roi, m.object_id, c.cluster FROM mask m JOIN clusters c ON c.object_id = (m.roi * 31 + m.object_id * 7) % (SELECT max(object_id) + 1 FROM clusters)
  WHERE m.object_id <> 0)"""


def _mask_clusters(spark, sf):
    """Cluster of each mask object, taken from the labelled embeddings."""
    objects = _mask_objects(spark, sf).select(F.col("sample").alias("roi"), F.col("cell_id").alias("object_id"))
    size = views.clusters(spark, sf).agg((F.max("object_id") + 1).alias("n")).scalar()
    key = ((F.col("roi") * 31 + F.col("object_id") * 7) % size).alias("_k")
    return objects.select("*", key).join(
        views.clusters(spark, sf).withColumnRenamed("object_id", "_k"), "_k"
    ).select("roi", "object_id", "cluster")


@query(with_views("clusters", """
SELECT a.object_id, a.cluster AS cluster_x, b.cell_id, b.cluster AS cluster_y, b.size FROM clusters a
JOIN (SELECT p_partkey AS cell_id, p_type AS cluster, p_size AS size FROM part) b ON a.object_id = b.cell_id"""))
def merge_clusters(spark, sf):
    """Two cluster tables joined by object, equal names told apart."""
    second = views.table(spark, sf, "part").select(
        F.col("p_partkey").alias("cell_id"), F.col("p_type").alias("cluster"), F.col("p_size").alias("size")
    )
    return cl.merge_clusters(views.clusters(spark, sf), second)


@query(with_views("typed", """
SELECT 'set+++slide+++' || sample AS roi, cell_id, kind FROM typed"""))
def transfer_category(spark, sf):
    """A category of the object table as cluster table of matched images."""
    objects = views.typed_objects(spark, sf)
    images = views.extent(spark, sf).select(
        F.concat(F.lit("set+++slide+++"), F.col("roi").cast("string")).alias("roi"),
        F.col("roi").cast("string").alias("value"), F.lit("sample").alias("column"),
    )
    return cl.transfer_category(objects, images, ["kind"])


@query(with_views("clusters", """
SELECT 'set+++slide+++' || s_suppkey AS roi, c.object_id, c.cluster FROM clusters c JOIN supplier ON s_suppkey = c.object_id % (SELECT max(s_suppkey) + 1 FROM supplier)"""))
def assign_clusters(spark, sf):
    """Uploaded clusters of several images attached to the images of the session."""
    size = views.table(spark, sf, "supplier").agg((F.max("s_suppkey") + 1).alias("n")).scalar()
    upload = views.clusters(spark, sf).withColumn("description", (F.col("object_id") % size).cast("string"))
    images = views.extent(spark, sf).select(
        F.concat(F.lit("set+++slide+++"), F.col("roi").cast("string")).alias("roi"),
        F.col("roi").cast("string").alias("value"), F.lit("description").alias("column"),
    )
    return cl.assign_clusters(upload, images).select("roi", "object_id", "cluster")


@query(with_views("mask clusters", f"""
WITH {MC} SELECT roi, object_id, cluster FROM mc WHERE cluster IN ('c1', 'c4', 'c7') AND object_id % 2 = 0"""))
def subset_clusters(spark, sf):
    gate = _mask_objects(spark, sf).where(F.col("cell_id") % 2 == 0).select(
        F.col("sample").alias("roi"), F.col("cell_id").alias("object_id")
    )
    return cl.subset_clusters(_mask_clusters(spark, sf), "cluster", ["c1", "c4", "c7"], gate)


COLOURS = """f AS (SELECT cluster, min(object_id) AS p FROM clusters GROUP BY 1),
  colours AS (SELECT cluster, ([{}])[(row_number() OVER (ORDER BY p) - 1) % 4 + 1] AS color FROM f)""".format(
    ", ".join(f"'{c}'" for c in PALETTE)
)


@query(with_views("clusters", f"WITH {COLOURS} SELECT cluster AS category, color FROM colours"))
def assign_palette(spark, sf):
    """Colours in order of first appearance."""
    return cl.assign_palette(views.clusters(spark, sf), "cluster", "object_id", PALETTE, keys=())


def _hex(at: int) -> str:
    return f"CAST('0x' || substr(color, {at}, 2) AS INT)"


@query(with_views("mask clusters", f"""
WITH {MC}, {COLOURS}, k AS (SELECT mc.roi, mc.object_id, coalesce(color, '#000000') AS color FROM mc LEFT JOIN colours USING (cluster)
  WHERE cluster <> 'c2')
SELECT m.roi, m.y, m.x, coalesce({_hex(2)}, 0) AS r, coalesce({_hex(4)}, 0) AS g, coalesce({_hex(6)}, 0) AS b
FROM mask m LEFT JOIN k USING (roi, object_id)"""))
def paint_mask(spark, sf):
    """Masks coloured by cluster."""
    colours = cl.assign_palette(views.clusters(spark, sf), "cluster", "object_id", PALETTE, keys=())
    kept = [f"c{i}" for i in range(10) if i != 2]
    return cl.paint_mask(views.mask(spark, sf), _mask_clusters(spark, sf), colours, "cluster", categories=kept)


@query(with_views("mask clusters", f"""
WITH {MC}, c AS (SELECT roi, object_id, avg(y) AS cy, avg(x) AS cx FROM mask WHERE object_id <> 0 GROUP BY 1, 2)
SELECT roi, object_id, cluster AS category, CAST(floor(cx) AS INT) - 2 AS x0, CAST(floor(cx) AS INT) + 2 AS x1,
  CAST(floor(cy) AS INT) - 2 AS y0, CAST(floor(cy) AS INT) + 2 AS y1 FROM c JOIN mc USING (roi, object_id)"""))
def centroids(spark, sf):
    """Markers at object centres with their cluster."""
    return cl.object_centroids(views.mask(spark, sf), _mask_clusters(spark, sf), "cluster")
