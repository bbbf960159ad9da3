"""The same results from arriving data."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rastrel.operators import annotate as an
from rastrel.plans import views
from rastrel.plans.views import with_views
from rastrel.queries.annotations import BOX, COLUMNS, LAST, WRITTEN
from rastrel.queries.registry import query
from rastrel.session import shared_folder
from rastrel.streaming import jobs


def _run_folder(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _arriving(spark, sf: str, name: str):
    schema = views.table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


@query(with_views("mask", """
WITH p AS (SELECT l_suppkey AS roi, l_returnflag AS channel, l_orderkey % 32 AS y, l_partkey % 32 AS x, l_quantity AS value FROM lineitem)
SELECT p.roi, m.object_id, p.channel, count(*) AS n, CAST(sum(p.value) AS DOUBLE) AS total FROM p JOIN mask m USING (roi, y, x)
WHERE m.object_id <> 0 GROUP BY 1, 2, 3"""))
def stream_quantify(spark, sf):
    """Running count and sum per object and channel of arriving pixel readings."""
    readings = _arriving(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("roi"), F.col("l_returnflag").alias("channel"),
        (F.col("l_orderkey") % views.SIDE).cast("int").alias("y"), (F.col("l_partkey") % views.SIDE).cast("int").alias("x"),
        F.col("l_quantity").alias("value"),
    )
    folder = _run_folder(spark)
    jobs.write_updates(jobs.stream_quantify(readings, views.mask(spark, sf)), f"{folder}/out", f"{folder}/state")
    return jobs.latest_state(spark.read.parquet(f"{folder}/out"), ["roi", "object_id", "channel"])


@query(with_views("objects annotations", f"WITH {BOX}, {LAST} {WRITTEN}"))
def stream_annotations(spark, sf):
    """Annotations of an arriving log, each applied once."""
    e = F.col("event_id")
    log = jobs.once_each(_arriving(spark, sf, "events"), "event_id").select(
        e.alias("id"), e.alias("seq"), F.expr("user_id * 2 div 3").alias("roi"), F.col("event_type").alias("cell_type"),
        F.concat(F.lit("col_"), (e % 2).cast("string")).alias("annotation_column"),
        ((e * 37) % 1000).alias("x_min"), ((e * 37) % 1000 + 50).alias("x_max"),
        ((e * 53) % 1000).alias("y_min"), ((e * 53) % 1000 + 50).alias("y_max"),
    )
    objects = views.objects(spark, sf)
    folder = _run_folder(spark)
    jobs.apply_stream(log, f"{folder}/out", f"{folder}/state", lambda batch: an.box_hits(objects, batch))
    hits = spark.read.parquet(f"{folder}/out").drop("batch", "batch_no")
    return an.apply_annotations(objects, hits, COLUMNS).select("sample", "cell_id", *COLUMNS)
