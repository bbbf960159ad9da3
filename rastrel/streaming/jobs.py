"""Running totals and one-time annotations on arriving data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastrel.operators.objects import labelled_pixels


def stream_quantify(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """Running pixel count and sum per image, object and channel of a stream of pixels.

    ``mask`` is a static table. State holds one row per object and channel.
    """
    return labelled_pixels(pixels, mask).groupBy("roi", "object_id", "channel").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("double")).alias("total")
    )


def write_updates(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run what is available and store changed rows, one folder per micro-batch.

    A batch repeated after a failure overwrites its own folder.
    """
    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch_no={number}")

    query = (
        stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .foreachBatch(store).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def latest_state(stored: DataFrame, keys: list[str]) -> DataFrame:
    """Last stored row per key."""
    rest = [c for c in stored.columns if c not in (*keys, "batch", "batch_no")]
    last = stored.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return last.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def once_each(log: DataFrame, key: str = "id", time: str | None = None, delay: str | None = None) -> DataFrame:
    """Annotations of an append-only log, each one a single time.

    All ids are remembered unless a ``delay`` is given; then ids, and entries arriving later than
    that, are forgotten to bound the state.
    """
    if delay is None:
        return log.dropDuplicates([key])
    stamped = log.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return stamped.dropDuplicatesWithinWatermark([key])


def apply_stream(log: DataFrame, path: str, checkpoint: str, hits) -> None:
    """Turn each batch of new annotations into object hits with ``hits(batch)`` and store them."""
    def store(batch: DataFrame, number: int) -> None:
        hits(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch_no={number}")

    query = (
        log.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
