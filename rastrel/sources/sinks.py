"""Writing tables and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastrel.plans.joins import tile_of


def write_pixels(pixels: DataFrame, path: str, parts: int | None = None, tile: int = 256) -> None:
    """Pixel table partitioned by channel, with rows of one image and tile next to each other.

    Files are cut by ranges of (channel, image, tile), so an image that holds a large part of all
    rows is spread over many files, and row-group statistics let readers skip other images.
    """
    rows = pixels.withColumn("_ty", tile_of(F.col("y"), tile)).withColumn("_tx", tile_of(F.col("x"), tile))
    order = ["channel", "roi", "_ty", "_tx"]
    ranged = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).drop("_ty", "_tx").write.mode("overwrite").partitionBy("channel").parquet(path)


def write_objects(objects: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Object table or export rows as Parquet or CSV with header."""
    objects.write.mode("overwrite").option("header", True).format(fmt).save(path)


def write_documents(rows: DataFrame, path: str) -> None:
    """One JSON document per row: session configurations, shapes or parameters."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)


def session_documents(params: DataFrame, blend: list[str], filters: dict) -> DataFrame:
    """One JSON-ready row from channel parameters, blend list and global filter."""
    rest = [c for c in params.columns if c != "channel"]
    channels = F.map_from_entries(F.sort_array(F.collect_list(F.struct("channel", F.struct(*rest).alias("p")))))
    setting = F.struct(*[F.lit(v).alias(k) for k, v in filters.items()])
    return params.agg(channels.alias("channels")).select(
        "channels", F.struct(F.array(*[F.lit(b) for b in blend]).alias("blend"), setting.alias("filter")).alias("config")
    )


def shape_documents(shapes: DataFrame) -> DataFrame:
    """Drawn shapes without scale bars as rows to write as documents."""
    return shapes.where(~F.coalesce("is_scalebar", F.lit(False)))
