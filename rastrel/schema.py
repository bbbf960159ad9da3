"""Table layouts of the data model and the rule that tells channel columns from metadata.

A raster is a table keyed by (roi, channel, y, x); a segmentation mask is a table
(roi, y, x) -> object_id with 0 as background. Object tables stay wide, channels first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROI_DELIMITER = "+++"

PIXELS = "roi STRING, channel STRING, y INT, x INT, value FLOAT"
MASK = "mask_name STRING, roi STRING, y INT, x INT, object_id BIGINT"
ROI_META = "roi STRING, width INT, height INT, n_channels INT, path STRING"
PANEL = "channel_order INT, channel STRING, label STRING, alias STRING"
CHANNEL_PARAMS = (
    "channel STRING, color STRING, x_lower_bound DOUBLE, x_upper_bound DOUBLE, "
    "filter_type STRING, filter_val DOUBLE, filter_sigma DOUBLE, alias STRING"
)
ANNOTATIONS = (
    "id BIGINT, seq BIGINT, roi STRING, type STRING, x_min DOUBLE, x_max DOUBLE, y_min DOUBLE, "
    "y_max DOUBLE, path STRING, object_ids ARRAY<BIGINT>, cell_type STRING, "
    "annotation_column STRING, mask_name STRING, imported BOOLEAN"
)
SPOTS = "roi STRING, spot_id BIGINT, x DOUBLE, y DOUBLE"
COUNTS = "roi STRING, spot_id BIGINT, gene STRING, value DOUBLE"
SHAPES = "roi STRING, shape_id BIGINT, vertices ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>, radius DOUBLE"

# Columns that identify an image, columns where metadata starts, and the
# metadata columns dropped when no such start column is present (next to any column whose
# name ends in _cell_annotation).
IDENTIFIER_COLUMNS = ["sample", "description"]
POSITION_COLUMNS = ["sample", "cell_id", "description"]
DEFAULT_METADATA = [
    "cell_id", "x", "y", "x_max", "y_max", "area", "sample", "x_min", "y_min",
    "object_annotation_1", "PhenoGraph_clusters", "Labels",
]
DEFAULT_CATEGORY = "Unassigned"
DEFAULT_ANNOTATION_COLUMN = "object_annotation_1"


def q(name: str) -> Column:
    """Column by exact name; channel names often hold dots, brackets or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def metadata_columns(columns: Sequence[str]) -> list[str]:
    """Columns that are not channels: everything from the first position column on."""
    starts = [columns.index(c) for c in POSITION_COLUMNS if c in columns]
    if not starts:
        extra = [c for c in columns if c.endswith("_cell_annotation")]
        return DEFAULT_METADATA + extra
    return list(columns[min(starts):])


def channel_columns(df: DataFrame) -> list[str]:
    """Channel columns of a wide object table."""
    dropped = set(metadata_columns(df.columns))
    return [c for c in df.columns if c not in dropped]


def matrix_columns(df: DataFrame) -> list[str]:
    """Channel columns by the rule for expression matrices: all before description, or sample."""
    start = "description" if "description" in df.columns else "sample"
    return df.columns[: df.columns.index(start)]


def image_column(df: DataFrame, prefer: str = "sample") -> str:
    """The column naming the image of each object."""
    order = [prefer, *[c for c in IDENTIFIER_COLUMNS if c != prefer]]
    for name in order:
        if name in df.columns:
            return name
    raise ValueError("object table needs a 'sample' or 'description' column")


def object_id_column(df: DataFrame) -> str | None:
    """Id column of a cluster or object table."""
    for name in ("cell_id", "object_id"):
        if name in df.columns:
            return name
    return None


def category_columns(df: DataFrame) -> list[str] | None:
    """Columns a cluster projection may use; None when the table has no id column."""
    if object_id_column(df) is None:
        return None
    return [c for c in df.columns if c not in ("cell_id", "object_id")]


def long_channels(df: DataFrame, keys: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """Long view (keys, channel, value) of a wide object table."""
    wide = df.select(*[q(k) for k in keys], *[q(c).cast("double").alias(c) for c in channels])
    return wide.unpivot([q(k) for k in keys], [q(c) for c in channels], "channel", "value")
