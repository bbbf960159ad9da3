"""Image, mask, object, annotation and spot tables derived from the driver's tables.

Each view exists twice: as a DataFrame and as the same definition in DuckDB SQL, so that a
query and its check start from equal rows. Suppliers act as images, so every view grows with
the tables. All arithmetic is on integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrel.plans.joins import dealt

SIDE = 32
CHANNELS = ["A", "N", "R"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse pixels; several measurements of one pixel collapse to the largest."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("roi"), F.col("l_returnflag").alias("channel"),
        (F.col("l_orderkey") % SIDE).cast("int").alias("y"),
        (F.col("l_partkey") % SIDE).cast("int").alias("x"), "l_quantity",
    )
    return rows.groupBy("roi", "channel", "y", "x").agg(
        F.max("l_quantity").cast("bigint").alias("value")
    )


def extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("roi"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height")
    )


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8-pixel cells with a one-pixel background gutter, shifted from image to image.

    Lines are spread before they are unrolled, as the table of images is small enough for one task.
    """
    shift = F.col("roi") % 8
    images = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("roi"))
    lines = dealt(images.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1)))), "roi", "y")
    grid = lines.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))))
    row = F.expr(f"(y + roi % 8) div 8")
    cell = (row * 4 + F.expr("x div 8") + 1).cast("bigint")
    gutter = ((F.col("y") + shift) % 8 == 0) | (F.col("x") % 8 == 0)
    return grid.withColumn("object_id", F.when(gutter, F.lit(0).cast("bigint")).otherwise(cell))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rastrel.operators.raster import densify

    return densify(pixels(spark, sf_dir), extent(spark, sf_dir), CHANNELS)


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object table: channels qty, disc, tax first, then sample, cell_id, area and boxes."""
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("bigint"))
    key = F.col("cell_id")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("cell_id"))
        .agg(
            F.sum(F.col("l_quantity").cast("bigint")).alias("ch_qty"),
            cents("l_discount").alias("ch_disc"), cents("l_tax").alias("ch_tax"),
            F.count(F.lit(1)).alias("area"),
        )
        .select(
            "ch_qty", "ch_disc", "ch_tax", "sample", "cell_id", "area",
            ((key * 37) % 1000).alias("x_min"), ((key * 37) % 1000 + 1 + key % 15).alias("x_max"),
            ((key * 53) % 1000).alias("y_min"), ((key * 53) % 1000 + 1 + key % 11).alias("y_max"),
        )
    )


OBJECT_CHANNELS = ["ch_qty", "ch_disc", "ch_tax"]


def embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("cell_id"),
        F.col("embedding")[0].cast("double").alias("UMAP1"),
        F.col("embedding")[1].cast("double").alias("UMAP2"),
    )


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(object_id, cluster) by the label of an embedding."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("object_id"),
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("cluster"),
    )


def typed_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects with a cell type taken from the part they stand for."""
    kinds = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cell_id"), F.col("p_type").alias("kind"))
    return objects(spark, sf_dir).join(kinds, "cell_id")


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ordered box annotation per event on the canvas of the objects."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e.alias("id"), e.alias("seq"), F.expr("user_id * 2 div 3").alias("roi"),
        F.col("event_type").alias("cell_type"),
        F.concat(F.lit("col_"), (e % 2).cast("string")).alias("annotation_column"),
        ((e * 37) % 1000).alias("x_min"), ((e * 37) % 1000 + 50).alias("x_max"),
        ((e * 53) % 1000).alias("y_min"), ((e * 53) % 1000 + 50).alias("y_max"),
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One drawn rectangle per event on the raster canvas."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e.alias("region"), F.expr("user_id * 2 div 3").alias("roi"),
        ((e * 7) % 24).alias("x_min"), ((e * 7) % 24 + 4 + e % 5).alias("x_max"),
        ((e * 11) % 24).alias("y_min"), ((e * 11) % 24 + 4 + e % 4).alias("y_max"),
    )


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One drawn four-sided path per event on the raster canvas, partly beyond its border."""
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id AS region", "user_id * 2 div 3 AS roi", "event_type AS cell_type",
        "(event_id * 7) % 32 AS cx", "(event_id * 11) % 32 AS cy",
        "3 + event_id % 4 AS rx", "2 + event_id % 5 AS ry",
    )
    point = lambda x, y: F.concat(x.cast("string"), F.lit(","), y.cast("string"))
    cx, cy, rx, ry = (F.col(n) for n in ("cx", "cy", "rx", "ry"))
    corners = [point(cx - rx, cy), point(cx, cy - ry), point(cx + rx, cy + 1), point(cx, cy + ry)]
    return rows.select(
        "region", "roi", "cell_type",
        F.concat(F.lit("M"), F.concat_ws("L", *corners), F.lit("Z")).alias("path"),
    )


def roi_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "concat('exp', p_partkey % 7, '+++slide', p_partkey % 3, '+++', p_type, '_', p_partkey) AS roi",
        "p_size * 20 AS width", "CAST(p_partkey % 50 AS INT) * 20 AS height",
    )


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_custkey div 15 AS roi", "o_orderkey AS spot_id",
        "CAST((o_orderkey * 17) % 500 AS DOUBLE) AS x", "CAST((o_orderkey * 29) % 500 AS DOUBLE) AS y",
        "CAST(floor(o_totalprice) AS BIGINT) % 100 AS value", "o_orderstatus AS status",
    )


# the same views for DuckDB, in the order in which they build on each other
SQL = {
    "px": """SELECT l_suppkey AS roi, l_returnflag AS channel, CAST(l_orderkey % 32 AS INT) AS y,
        CAST(l_partkey % 32 AS INT) AS x, CAST(max(l_quantity) AS BIGINT) AS value
        FROM lineitem GROUP BY 1, 2, 3, 4""",
    "extent": "SELECT s_suppkey AS roi, 32 AS width, 32 AS height FROM supplier",
    "mask": """SELECT s_suppkey AS roi, CAST(yy.range AS INT) AS y, CAST(xx.range AS INT) AS x,
        CASE WHEN (yy.range + s_suppkey % 8) % 8 = 0 OR xx.range % 8 = 0 THEN 0
             ELSE ((yy.range + s_suppkey % 8) // 8) * 4 + xx.range // 8 + 1 END AS object_id
        FROM supplier, range(32) yy, range(32) xx""",
    "dense": """SELECT m.roi, c.channel, m.y, m.x, coalesce(px.value, 0) AS value, m.object_id
        FROM mask m CROSS JOIN (SELECT DISTINCT l_returnflag AS channel FROM lineitem) c
        LEFT JOIN px ON px.roi = m.roi AND px.channel = c.channel AND px.y = m.y AND px.x = m.x""",
    "objects": """SELECT l_suppkey AS sample, l_partkey AS cell_id,
        CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS ch_qty,
        CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS ch_disc,
        CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS ch_tax, count(*) AS area,
        (l_partkey * 37) % 1000 AS x_min, (l_partkey * 37) % 1000 + 1 + l_partkey % 15 AS x_max,
        (l_partkey * 53) % 1000 AS y_min, (l_partkey * 53) % 1000 + 1 + l_partkey % 11 AS y_max
        FROM lineitem GROUP BY l_suppkey, l_partkey""",
    "embedding": """SELECT vec_id AS cell_id, CAST(embedding[1] AS DOUBLE) AS UMAP1,
        CAST(embedding[2] AS DOUBLE) AS UMAP2 FROM embeddings""",
    "clusters": "SELECT vec_id AS object_id, 'c' || label AS cluster FROM embeddings",
    "typed": """SELECT o.*, p.p_type AS kind FROM objects o JOIN part p ON p.p_partkey = o.cell_id""",
    "annotations": """SELECT event_id AS id, event_id AS seq, user_id * 2 // 3 AS roi,
        event_type AS cell_type, 'col_' || (event_id % 2) AS annotation_column,
        (event_id * 37) % 1000 AS x_min, (event_id * 37) % 1000 + 50 AS x_max,
        (event_id * 53) % 1000 AS y_min, (event_id * 53) % 1000 + 50 AS y_max FROM events""",
    "regions": """SELECT event_id AS region, user_id * 2 // 3 AS roi, (event_id * 7) % 24 AS x_min,
        (event_id * 7) % 24 + 4 + event_id % 5 AS x_max, (event_id * 11) % 24 AS y_min,
        (event_id * 11) % 24 + 4 + event_id % 4 AS y_max FROM events""",
    "corners": """SELECT event_id AS region, user_id * 2 // 3 AS roi, event_type AS cell_type,
        (event_id * 7) % 32 AS cx, (event_id * 11) % 32 AS cy, 3 + event_id % 4 AS rx,
        2 + event_id % 5 AS ry FROM events""",
    "edges": """SELECT region, roi, cell_type, e.k,
        CASE e.k WHEN 0 THEN cx - rx WHEN 1 THEN cx WHEN 2 THEN cx + rx ELSE cx END AS x1,
        CASE e.k WHEN 0 THEN cy WHEN 1 THEN cy - ry WHEN 2 THEN cy + 1 ELSE cy + ry END AS y1,
        CASE e.k WHEN 0 THEN cx WHEN 1 THEN cx + rx WHEN 2 THEN cx ELSE cx - rx END AS x2,
        CASE e.k WHEN 0 THEN cy - ry WHEN 1 THEN cy + 1 WHEN 2 THEN cy + ry ELSE cy END AS y2
        FROM corners, (SELECT range AS k FROM range(4)) e""",
    # closed even-odd test of every lattice point in the path's own box, in exact integers
    "inside": """SELECT b.region, b.roi, b.cell_type, b.y, b.x FROM (
          SELECT region, roi, cell_type, gy.range AS y, gx.range AS x FROM corners,
            range(32) gy, range(32) gx
          WHERE gy.range BETWEEN cy - ry AND cy + ry AND gx.range BETWEEN cx - rx AND cx + rx) b
        JOIN edges e ON e.region = b.region GROUP BY ALL
        HAVING sum(CASE WHEN ((e.y1 <= b.y) <> (e.y2 <= b.y)) AND
             ((b.x - e.x1) * (e.y2 - e.y1) - (b.y - e.y1) * (e.x2 - e.x1)) *
             (CASE WHEN e.y2 > e.y1 THEN 1 ELSE -1 END) < 0 THEN 1 ELSE 0 END) % 2 = 1
          OR bool_or((b.x - e.x1) * (e.y2 - e.y1) = (b.y - e.y1) * (e.x2 - e.x1)
             AND b.x BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2)
             AND b.y BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2))""",
    # pixels whose centre lies in the path, by the crossings of the line through it
    "centres": """SELECT region, roi, cell_type, CAST(gy.range AS INT) AS y, CAST(gx.range AS INT) AS x FROM edges, range(32) gy, range(32) gx
        WHERE (y1 <= gy.range + 0.5::DOUBLE) <> (y2 <= gy.range + 0.5::DOUBLE)
          AND gx.range + 0.5::DOUBLE >= x1 + (gy.range + 0.5::DOUBLE - y1) * (x2 - x1) / CAST(y2 - y1 AS DOUBLE)
        GROUP BY 1, 2, 3, 4, 5 HAVING count(*) % 2 = 1""",
    "roi_meta": """SELECT 'exp' || (p_partkey % 7) || '+++slide' || (p_partkey % 3) || '+++' || p_type
        || '_' || p_partkey AS roi, p_size * 20 AS width, CAST(p_partkey % 50 AS INT) * 20 AS height
        FROM part""",
    "spots": """SELECT o_custkey // 15 AS roi, o_orderkey AS spot_id,
        CAST((o_orderkey * 17) % 500 AS DOUBLE) AS x, CAST((o_orderkey * 29) % 500 AS DOUBLE) AS y,
        CAST(floor(o_totalprice) AS BIGINT) % 100 AS value, o_orderstatus AS status FROM orders""",
}
NEEDS = {
    "dense": ["px", "mask"], "typed": ["objects"], "edges": ["corners"],
    "inside": ["corners", "edges"], "centres": ["corners", "edges"],
}


def with_views(names: str, query: str) -> str:
    """DuckDB text of ``query`` with the named views (and what they need) in front."""
    wanted: set[str] = set()

    def add(name: str) -> None:
        for below in NEEDS.get(name, []):
            add(below)
        wanted.add(name)

    for name in names.split():
        add(name)
    parts = [f"{n} AS MATERIALIZED ({SQL[n]})" for n in SQL if n in wanted]
    text = query.strip()
    if text.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + text[5:]
    return "WITH " + ",\n".join(parts) + "\n" + text
