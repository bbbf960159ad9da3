"""Measuring segmented objects and working on the object table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rastrel.plans.joins import lookup_join, unrolled
from rastrel.plans.ranks import percentiles, take_smallest
from rastrel.schema import (
    IDENTIFIER_COLUMNS,
    channel_columns,
    image_column,
    long_channels,
    q,
)


class ObjectTableError(ValueError):
    """An object table lacks the columns that link rows to images."""


# ---------------------------------------------------------------- measurement

def labelled_pixels(pixels: DataFrame, mask: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """Pixels that lie in an object. Background is dropped before the join.

    A mask has a row per pixel, so it is never broadcast, whatever its size is taken for.
    """
    objects = mask.where(F.col("object_id") != 0).select("roi", "y", "x", "object_id", *columns)
    return pixels.join(unrolled(objects), ["roi", "y", "x"])


def quantify_channel(pixels: DataFrame, mask: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Mean of every channel per object, long: (roi, object_id, channel, mean).

    Pixels may be stored sparsely: those of an object that are absent count as 0.
    """
    named = F.explode(F.array(*[F.lit(c) for c in channels])).alias("channel")
    areas = mask.where(F.col("object_id") != 0).groupBy("roi", "object_id").agg(F.count(F.lit(1)).alias("area"))
    sums = (
        labelled_pixels(pixels.where(F.col("channel").isin(list(channels))), mask)
        .groupBy("roi", "object_id", "channel").agg(F.sum(F.col("value").cast("double")).alias("s"))
    )
    return areas.select("roi", "object_id", "area", named).join(sums, ["roi", "object_id", "channel"], "left").select(
        "roi", "object_id", "channel", (F.coalesce("s", F.lit(0.0)) / F.col("area")).alias("mean")
    )


def quantify(
    pixels: DataFrame,
    mask: DataFrame,
    channels: Sequence[str],
    aliases: Mapping[str, str] | None = None,
    shape: bool = True,
    catalog: DataFrame | None = None,
) -> DataFrame | None:
    """Object table of segmented images: channel means, then description, cell_id, sample, shape.

    Returns None when there is no channel to measure. Columns carry the alias of a channel when
    one is given. ``mask`` needs (mask_name, roi, y, x, object_id); without mask_name the image
    key is used. Pixels may be stored sparsely: absent ones count as 0. With ``catalog`` (roi, channel),
    a channel that an image doesn't have is NULL for its objects.
    """
    if not channels:
        return None
    names = {c: (aliases or {}).get(c, c) for c in channels}
    wide = (
        labelled_pixels(pixels.where(F.col("channel").isin(list(channels))), mask)
        .groupBy("roi", "object_id")
        .pivot("channel", list(channels))
        .agg(F.sum(F.col("value").cast("double")))
    )
    if "mask_name" in mask.columns:
        # the name is constant per image, so it travels through the shape aggregate
        props = mask_properties(mask, [F.first("mask_name").alias("_mask")])
    else:
        props = mask_properties(mask, [F.first(F.col("roi").cast("string")).alias("_mask")])
    joined = props.join(wide, ["roi", "object_id"], "left")
    mean = {c: F.coalesce(q(c), F.lit(0.0)) / F.col("area") for c in channels}
    if catalog is not None:
        has = catalog.groupBy("roi").agg(F.collect_set(F.when(F.col("channel").isin(list(channels)), F.col("channel"))).alias("_has"))
        joined = lookup_join(joined, has, ["roi"], "left", spread_by=["object_id"])
        mean = {c: F.when(F.array_contains("_has", c), m) for c, m in mean.items()}
    measured = [mean[c].alias(names[c]) for c in channels]
    shapes = [
        "area", "centroid-0", "centroid-1", "axis_major_length", "axis_minor_length",
        "eccentricity",
    ]
    return joined.select(
        *measured,
        F.col("_mask").alias("description"),
        F.col("object_id").alias("cell_id"),
        F.col("_mask").alias("sample"),
        *([q(c) for c in shapes] if shape else []),
    )


def mask_fits_image(mask_extent: DataFrame, extent: DataFrame) -> DataFrame:
    """(roi, fits): whether a mask has the width and height of its image; FALSE without an image."""
    sizes = extent.select("roi", F.col("width").alias("_w"), F.col("height").alias("_h"))
    same = (F.col("width") == F.col("_w")) & (F.col("height") == F.col("_h"))
    return mask_extent.join(sizes, "roi", "left").select("roi", F.coalesce(same, F.lit(False)).alias("fits"))


def mask_properties(mask: DataFrame, extra: Sequence[Column] = ()) -> DataFrame:
    """Area, centroid, axis lengths and eccentricity per object from six running sums."""
    y, x = F.col("y").cast("bigint"), F.col("x").cast("bigint")
    sums = (
        mask.where(F.col("object_id") != 0)
        .groupBy("roi", "object_id")
        .agg(
            F.count(F.lit(1)).alias("area"),
            F.sum(y).alias("sy"), F.sum(x).alias("sx"),
            F.sum(y * y).alias("syy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"),
            *extra,
        )
    )
    n = F.col("area")
    # n*sum(ab) - sum(a)*sum(b) stays exact; as decimals it cannot overflow either
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    moment = lambda ab, a, b: (
        ((n.cast("decimal(19,0)") * wide(ab)) - (wide(a) * wide(b))).cast("double") / n / n
    )
    sums = sums.withColumns({
        "vyy": moment("syy", "sy", "sy"), "vxx": moment("sxx", "sx", "sx"),
        "vxy": moment("sxy", "sx", "sy"),
    })
    half = (F.col("vyy") + F.col("vxx")) / 2
    spread = F.sqrt(
        F.pow((F.col("vyy") - F.col("vxx")) / 2, F.lit(2.0)) + F.col("vxy") * F.col("vxy")
    )
    big, small = half + spread, F.greatest(half - spread, F.lit(0.0))
    return sums.select(
        "roi", "object_id", "area",
        (F.col("sy") / n).alias("centroid-0"),
        (F.col("sx") / n).alias("centroid-1"),
        (F.sqrt(big) * 4).alias("axis_major_length"),
        (F.sqrt(small) * 4).alias("axis_minor_length"),
        F.coalesce(F.sqrt(F.lit(1.0) - F.try_divide(small, big)), F.lit(0.0)).alias("eccentricity"),
        *[c for c in sums.columns if c.startswith("_")],
    )


def object_counts(mask: DataFrame) -> DataFrame:
    """Number of different objects per image; images without objects count 0."""
    ids = mask.groupBy("roi", "object_id").agg(F.lit(1).alias("one"))
    return ids.groupBy("roi").agg(
        F.count(F.when(F.col("object_id") != 0, 1)).alias("n_objects")
    )


def append_quantification(existing: DataFrame | None, new: DataFrame | None) -> DataFrame | None:
    """Add the objects of newly measured images, or start over with them.

    Rows are added when both tables have the same columns and no image of ``new`` is in
    ``existing`` yet; otherwise ``new`` replaces ``existing``.
    """
    if existing is None or new is None:
        return new if existing is None else existing
    if set(existing.columns) != set(new.columns):
        return new
    key = image_column(new)
    known = existing.select(q(key).alias("_image")).distinct()
    overlap = (
        new.select(q(key).alias("_image")).distinct().join(known, "_image", "left_semi")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return existing.where(overlap.scalar() == 0).unionByName(new)


# ---------------------------------------------------------------- validation, selection

def validate_objects(df: DataFrame, required: Sequence[str] = ("sample", "cell_id")):
    """The table if complete, None if a required column is missing, an error without image column."""
    if not any(c in df.columns for c in IDENTIFIER_COLUMNS):
        raise ObjectTableError(
            "the object table needs a 'sample' or 'description' column right after the channels"
        )
    return df if all(c in df.columns for c in required) else None


def select_channels(df: DataFrame, columns: Sequence[str] | None, strict: bool = True) -> DataFrame:
    """Listed columns. Strict: all or nothing changes; otherwise those present."""
    if not columns:
        return df
    present = [c for c in columns if c in df.columns]
    if strict and len(present) < len(columns):
        return df
    return df.select(*[q(c) for c in present])


def only_channels(df: DataFrame) -> DataFrame:
    return df.select(*[q(c) for c in channel_columns(df)])


def filter_hot_objects(df: DataFrame, columns: Sequence[str], percentile: float = 0.999) -> DataFrame:
    """Objects whose every listed value is strictly below that column's percentile."""
    ranks = percentiles(long_channels(df, [], columns), ["channel"], "value", {"limit": percentile})
    limits = ranks.agg(
        F.map_from_entries(F.collect_list(F.struct("channel", "limit"))).alias("limits")
    )
    keep = F.lit(True)
    for c in columns:
        keep = keep & (q(c) < F.try_element_at(F.col("_limits"), F.lit(c)))
    return df.withColumn("_limits", limits.scalar()).where(keep).drop("_limits")


def objects_in_box(df: DataFrame, x0, x1, y0, y1) -> DataFrame | None:
    """Objects that lie wholly in a window; None when the table has no bounding boxes."""
    if not {"x_min", "x_max", "y_min", "y_max"} <= set(df.columns):
        return None
    return df.where(
        (F.col("x_min") >= min(x0, x1)) & (F.col("x_max") <= max(x0, x1))
        & (F.col("y_min") >= min(y0, y1)) & (F.col("y_max") <= max(y0, y1))
    )


def objects_at_point(df: DataFrame, x, y) -> DataFrame | None:
    """Objects whose bounding box holds a point, borders included."""
    if not {"x_min", "x_max", "y_min", "y_max"} <= set(df.columns):
        return None
    return df.where(
        (F.col("x_min") <= x) & (F.col("x_max") >= x) & (F.col("y_min") <= y) & (F.col("y_max") >= y)
    )


def objects_by_upper_corner(df: DataFrame, x_min, x_max, y_min, y_max) -> DataFrame:
    """Bar-chart window: only the upper corner of each object is tested."""
    if not {"x_max", "y_max"} <= set(df.columns):
        return df
    return df.where(F.col("x_max").between(x_min, x_max) & F.col("y_max").between(y_min, y_max))


def with_embedding(df: DataFrame, embedding: DataFrame, on: Sequence[str]) -> DataFrame:
    """Attach UMAP1/UMAP2 by object key."""
    return df.join(embedding.select(*[q(k) for k in on], "UMAP1", "UMAP2"), list(on))


def in_embedding_window(window: Mapping[str, float] | None) -> Column:
    """Test on UMAP1/UMAP2; the x bounds are taken as given, the y bounds in either order."""
    names = ("x0", "x1", "y0", "y1")
    if not window or any(n not in window for n in names):
        return F.lit(True)
    x0, x1, y0, y1 = (float(window[n]) for n in names)
    return (
        (F.col("UMAP1") >= x0) & (F.col("UMAP1") <= x1)
        & (F.col("UMAP2") >= min(y0, y1)) & (F.col("UMAP2") <= max(y0, y1))
    )


def objects_in_embedding_window(df: DataFrame, embedding: DataFrame, on: Sequence[str],
                                window: Mapping[str, float] | None) -> DataFrame:
    return with_embedding(df, embedding, on).where(in_embedding_window(window))


def filter_categories(df: DataFrame, column: str, keep: Sequence) -> DataFrame:
    return df.where(q(column).cast("string").isin([str(k) for k in keep]))


def toggle_categories(
    visible: Sequence, changed: Sequence[int], total: int, current: Sequence[int] | None = None
) -> list[int]:
    """Ordinals of the categories that stay after a legend click.

    A full list of states replaces the selection; one 'legendonly' removes a category, any other
    single state adds one.
    """
    if len(visible) == total:
        return [i for i, state in enumerate(visible) if state != "legendonly"]
    if len(visible) == 1 and len(changed) == 1:
        if visible[0] == "legendonly":
            kept = list(range(total)) if current is None else list(current)
            return [i for i in kept if i != changed[0]]
        if visible[0]:
            kept = [] if current is None else list(current)
            return kept + [i for i in changed if i not in kept]
    return []


def category_order(df: DataFrame, column: str, position: str) -> DataFrame:
    """Categories with the ordinal of their first appearance, for legend ordinals."""
    return df.groupBy(q(column).cast("string").alias("category")).agg(
        F.min(q(position)).alias("first_position")
    )


# ---------------------------------------------------------------- summaries

def column_ranges(df: DataFrame, columns: Sequence[str]) -> Column:
    """Minimum and maximum of columns over the whole table as one scalar struct."""
    stats = df.agg(F.struct(*[
        F.struct(F.min(q(c)).alias("low"), F.max(q(c)).alias("high")).alias(f"c{i}")
        for i, c in enumerate(columns)
    ]).alias("ranges"))
    return stats.scalar()


def minmax(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns scaled to 0..1 over the whole table; a constant column becomes NULL."""
    named = df.withColumn("_ranges", column_ranges(df, columns))
    scaled = {}
    for i, c in enumerate(columns):
        r = F.col(f"_ranges.c{i}")
        scaled[c] = F.try_divide(
            (q(c) - r["low"]).cast("double"), (r["high"] - r["low"]).cast("double")
        )
    rest = [c for c in df.columns]
    return named.select(*[scaled[c].alias(c) if c in scaled else q(c) for c in rest])


SUMMARY_MODES = ("mean", "max", "min", "median")


def summarize_channels(df: DataFrame, columns: Sequence[str], mode: str = "mean") -> DataFrame:
    """One value per channel over all objects: (Channel, <mode>)."""
    if mode not in SUMMARY_MODES:
        raise ValueError(f"{mode} is not one of {SUMMARY_MODES}")
    rows = long_channels(df, [], columns)
    if mode == "median":
        ranked = percentiles(rows, ["channel"], "value", {"median": 0.5})
        return ranked.select(F.col("channel").alias("Channel"), "median")
    fold = {"mean": F.avg, "max": F.max, "min": F.min}[mode]
    return rows.groupBy(F.col("channel").alias("Channel")).agg(fold("value").alias(mode))


def is_categorical(df: DataFrame, column: str, limit: int) -> Column:
    """Whether a column is text or has at most ``limit`` different values."""
    if isinstance(df.schema[column].dataType, T.StringType):
        return F.lit(True)
    few = df.select(q(column).alias("v")).where(F.col("v").isNotNull()).distinct().limit(limit + 1)
    return few.agg(F.count(F.lit(1)).alias("n")).scalar() <= limit


def usable_overlay(df: DataFrame, overlay: str, limit: int = 100) -> Column:
    """Whether a grouping column has 2..limit different values."""
    few = df.select(q(overlay).alias("v")).where(F.col("v").isNotNull()).distinct().limit(limit + 1)
    return few.agg(F.count(F.lit(1)).alias("n")).scalar().between(2, limit)


def group_expression(df: DataFrame, columns: Sequence[str], overlay: str, normalize: bool = True,
                     transpose: bool = False) -> DataFrame:
    """Mean of each channel per category, each channel divided by its largest category mean.

    Wide by category, or long (channel, category, value) rows when transposed.
    """
    grouped = df.groupBy(q(overlay).cast("string").alias(overlay)).agg(
        *[F.avg(q(c).cast("double")).alias(c) for c in columns]
    )
    if normalize:
        tops = grouped.agg(
            F.struct(*[F.max(q(c)).alias(f"c{i}") for i, c in enumerate(columns)]).alias("s")
        )
        named = grouped.withColumn("_tops", tops.scalar())
        grouped = named.select(q(overlay), *[
            F.try_divide(q(c), F.col(f"_tops.c{i}")).alias(c) for i, c in enumerate(columns)
        ])
    if transpose:
        return grouped.unpivot([q(overlay)], [q(c) for c in columns], "channel", "value")
    return grouped


def sample_objects(df: DataFrame, count: int, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """Exactly ``count`` rows (or all) in hash order of their key; repeatable."""
    hashed = df.withColumn("_h", F.xxhash64(*[q(k) for k in keys], F.lit(seed)))
    return take_smallest(hashed, [], "_h", count).drop("_h")


def expression_summary(
    df: DataFrame,
    columns: Sequence[str],
    overlay: str | None = None,
    normalize: bool = True,
    sample: int | None = None,
    keys: Sequence[str] = ("sample", "cell_id"),
) -> DataFrame:
    """Grouped matrix when an overlay is given, else the mean of each channel."""
    if overlay and overlay in df.columns:
        return group_expression(df, columns, overlay, normalize)
    rows = sample_objects(df, sample, keys) if sample else df
    means = summarize_channels(rows, columns, "mean")
    return means.withColumnRenamed("mean", "Expression")


def expression_of_window(
    df: DataFrame,
    columns: Sequence[str],
    window: Mapping[str, float] | None,
    category: str | None = None,
    keep: Sequence | None = None,
    normalize: bool = True,
) -> DataFrame:
    """Category filter, min-max over what is left, then the embedding window.

    ``df`` carries UMAP1 and UMAP2. Scaling is relative to the rows before the window.
    """
    rows = filter_categories(df, category, keep) if category and keep is not None else df
    scaled = minmax(rows, columns) if normalize else rows
    return scaled.where(in_embedding_window(window))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """(Value, Counts, Proportion, n_values) per category, proportion to 3 decimals, most frequent first.

    ``n_values`` is the number of different categories, so a caller can tell a long table from a short one.
    """
    counts = df.groupBy(q(column).cast("string").alias("Value")).agg(
        F.count(F.lit(1)).alias("Counts")
    )
    return _proportions(counts)


def _proportions(counts: DataFrame) -> DataFrame:
    totals = counts.agg(
        F.struct(F.sum(F.abs("Counts")).alias("rows"), F.count(F.lit(1)).alias("values")).alias("s")
    )
    named = counts.withColumn("_t", totals.scalar())
    return named.select(
        "Value", "Counts",
        # rounding a frame scales, rounds half to even and scales back
        (F.rint(F.try_divide(F.col("Counts").cast("double"), F.col("_t.rows").cast("double")) * 1000)
         / 1000).alias("Proportion"), F.col("_t.values").alias("n_values"),
    ).orderBy(F.desc_nulls_last("Counts"), "Value")


def distribution_of_counts(counts: DataFrame, column: str = "Value") -> DataFrame:
    """Same table from ready (Value, Counts) rows."""
    return _proportions(counts.select(q(column).alias("Value"), F.col("Counts").cast("bigint").alias("Counts")))


def ids_per_image(df: DataFrame, image: str = "sample", object_id: str = "cell_id",
                  width: int = 4096) -> DataFrame | None:
    """Distinct object ids of each image as arrays of bounded length.

    One row per image and id range of ``width``: (image, id_range, ids). An image with very many
    objects has many rows instead of one huge array. None without the needed columns.
    """
    name = image if image in df.columns else "description"
    if name not in df.columns or object_id not in df.columns:
        return None
    pairs = df.select(q(name).alias("image"), q(object_id).cast("bigint").alias("id"))
    return pairs.groupBy("image", F.floor(F.col("id") / width).alias("id_range")).agg(
        F.sort_array(F.collect_set("id")).alias("ids")
    )


def embedding_overlay(df: DataFrame, overlay: str, position: str, categorical: bool) -> DataFrame:
    """UMAP rows with the overlay as text category and its rank of first appearance, or as number.

    Adds ``category`` and ``category_position`` (NULL for a numeric overlay) and ``number`` (NULL for
    a categorical one); the caller says which it is.
    """
    own = [q(c) for c in df.columns]
    if not categorical:
        return df.select(*own, F.lit(None).cast("string").alias("category"), F.lit(None).cast("bigint").alias("category_position"),
                         q(overlay).try_cast("double").alias("number"))
    flagged = df.withColumn("category", q(overlay).cast("string"))
    joined = lookup_join(flagged, category_order(df, overlay, position), ["category"], "left", spread_by=[position])
    return joined.select(*own, "category", F.col("first_position").alias("category_position"), F.lit(None).cast("double").alias("number"))


def associate(df: DataFrame, x: str, y: str, grouping: str | None = None) -> DataFrame:
    """Five-number summary and count of ``y`` per (x, group) for a categorical ``x``."""
    groups = [q(x).cast("string").alias("x")]
    groups.append((q(grouping).cast("string") if grouping else F.lit(None).cast("string")).alias("group"))
    rows = df.select(*groups, q(y).cast("double").alias("y"))
    points = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}
    if not grouping:
        ranked = percentiles(rows, ["x"], "y", points).withColumn("group", F.lit(None).cast("string"))
        counts = rows.groupBy("x").agg(F.count("y").alias("n"))
        return ranked.join(counts, "x").select("x", "group", "n", *points)
    ranked = percentiles(rows, ["x", "group"], "y", points)
    counts = rows.groupBy("x", "group").agg(F.count("y").alias("n"))
    return ranked.join(counts, ["x", "group"]).select("x", "group", "n", *points)


def associate_numbers(df: DataFrame, x: str, y: str, grouping: str | None = None) -> DataFrame:
    """(x, y, group) of every row for a numeric ``x``: the points of a scatter."""
    group = q(grouping).cast("string") if grouping else F.lit(None).cast("string")
    return df.select(q(x).try_cast("double").alias("x"), q(y).try_cast("double").alias("y"), group.alias("group"))
