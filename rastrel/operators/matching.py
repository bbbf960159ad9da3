"""Matching image keys to mask names and to image names in an object table.

Rules are tried in order and the first that gives a name wins. A rule is an equality join on a
derived key (whole name, part of the key, trailing number, list position, substring), and the
name list is reduced to one name per key before the join, so no rule pairs all images with all
names.

Inputs: ``rois`` (roi, position) and name lists (name, position), positions from 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastrel.functions.names import pad_index, roi_parts, trailing_number
from rastrel.plans.joins import unrolled
from rastrel.schema import ROI_DELIMITER

OLD_MASK = "_ac_IA_mask"


def _keyed(rois: DataFrame, delimiter: str) -> DataFrame:
    parts = roi_parts(F.col("roi"), delimiter)
    known = F.size(parts) == 3
    rows = rois.select(
        "roi", "position",
        F.when(known, F.get(parts, F.lit(0))).alias("experiment"),
        F.when(known, F.get(parts, F.lit(2))).alias("acq"),
    )
    return rows.withColumn("acq_number", trailing_number(F.col("acq")))


def _old_number(name):
    """Acquisition number in the older mask name form <file>_s<slide>_a<number>_ac_IA_mask."""
    stem = F.substring_index(name, OLD_MASK, 1)
    text = F.replace(F.substring_index(stem, "_", -1), F.lit("a"), F.lit(""))
    return F.when(name.contains(OLD_MASK), text.try_cast("bigint"))


def substrings(names: DataFrame, lengths) -> DataFrame:
    """Every substring of each name with one of the given lengths (an array column)."""
    size = F.length("name")
    sized = names.withColumn("_lens", lengths)
    cut = sized.withColumn("_len", F.explode(F.filter("_lens", lambda n: n <= F.length("name"))))
    start = F.explode(F.sequence(F.lit(1), size - F.col("_len") + 1))
    return cut.withColumn("_at", start).select(
        "name", "position", F.col("name").substr(F.col("_at"), F.col("_len")).alias("part")
    )


def _lengths(keys: DataFrame, *columns: str):
    """Distinct key lengths as one scalar array."""
    sizes = keys.select(F.explode(F.array(*[F.length(c) for c in columns])).alias("n"))
    return sizes.where(F.col("n") > 0).agg(F.collect_set("n").alias("s")).scalar()


def _first(df: DataFrame, *keys: str) -> DataFrame:
    """First name in list order per key."""
    return df.groupBy(*keys).agg(
        F.min(F.struct("position", "name")).alias("hit")
    ).select(*keys, F.col("hit.name").alias("hit"), F.col("hit.position").alias("hit_position"))


def match_masks(rois: DataFrame, masks: DataFrame, delimiter: str = ROI_DELIMITER) -> DataFrame:
    """Mask name for each image: (roi, mask_name), NULL without a match.

    Order: the whole key; older mask form by list position; experiment; acquisition; equal trailing
    number with the experiment inside the name; experiment or acquisition inside the name.
    """
    keys = _keyed(rois, delimiter)
    names = masks.select("name", "position")
    exact = names.select(F.col("name").alias("key"), F.lit(1).alias("known")).distinct()
    old = names.withColumn("number", _old_number(F.col("name"))).where(F.col("number").isNotNull())
    # of several masks with one number the last in the list counts
    old = old.groupBy((F.col("number") - 1).alias("position")).agg(
        F.max(F.struct(F.col("position").alias("p"), "name")).alias("h")
    ).select("position", F.col("h.name").alias("old_name"))
    parts = substrings(names, _lengths(keys, "experiment", "acq"))
    parts = parts.withColumn("number", trailing_number(F.col("name")))
    any_part = _first(parts, "part")
    numbered = _first(parts.where(F.col("number").isNotNull()), "part", "number")

    def known(rows: DataFrame, column: str) -> DataFrame:
        return rows.join(
            exact.select(F.col("key").alias(column), F.col("known").alias(f"{column}_known")), column, "left"
        )

    rows = known(known(known(keys, "roi"), "experiment"), "acq").join(old, "position", "left")
    rows = rows.join(
        unrolled(numbered).select(
            F.col("part").alias("experiment"), F.col("number").alias("acq_number"),
            F.col("hit").alias("numbered"),
        ), ["experiment", "acq_number"], "left",
    )
    for column in ("experiment", "acq"):
        rows = rows.join(
            unrolled(any_part).select(
                F.col("part").alias(column), F.col("hit").alias(f"{column}_in"),
                F.col("hit_position").alias(f"{column}_at"),
            ), column, "left",
        )
    # the earlier of the two lists positions, experiment or acquisition
    by_exp, by_acq = F.col("experiment_at"), F.col("acq_at")
    inside = F.when(by_acq.isNull() | (by_exp <= by_acq), F.col("experiment_in")).otherwise(F.col("acq_in"))
    return rows.select(
        "roi",
        F.coalesce(
            F.when(F.col("roi_known") == 1, F.col("roi")), F.col("old_name"),
            F.when(F.col("experiment_known") == 1, F.col("experiment")),
            F.when(F.col("acq_known") == 1, F.col("acq")), F.col("numbered"), inside,
        ).alias("mask_name"),
    )


def match_masks_to_images(masks: DataFrame, images: DataFrame, sample: bool = True) -> DataFrame:
    """Image name of an object table for each mask: (name, image), NULL without a match.

    Order: equal names; the last image name found inside the mask name, or with an equal trailing
    number before any such; the older mask form by number when images are named by sample.
    ``images`` is (name, position).
    """
    listed = images.select("name", "position")
    rows = masks.select(
        "name", "position", trailing_number(F.col("name")).alias("number"),
        _old_number(F.col("name")).cast("string").alias("old_number"),
    )
    exact = listed.select(F.col("name")).distinct().withColumn("exact", F.lit(1))
    # last image whose name is part of the mask name
    parts = substrings(
        rows.select("name", "position"), _lengths(listed, "name")
    ).join(listed.select(F.col("name").alias("part"), F.col("position").alias("at")), "part")
    inside = parts.groupBy("name").agg(
        F.max(F.struct("at", "part")).alias("h")
    ).select("name", F.col("h.part").alias("inside"))
    numbers = listed.withColumn("number", trailing_number(F.col("name"))).where(F.col("number").isNotNull())
    first = numbers.groupBy("number").agg(F.min(F.struct("position", "name")).alias("h")).select(
        "number", F.col("h.name").alias("same_number")
    )
    tails = listed.select(
        F.substring_index("name", "_", -1).try_cast("bigint").cast("string").alias("old_number"), "name"
    ).where(F.col("old_number").isNotNull())
    by_old = tails.groupBy("old_number").agg(F.max("name").alias("old_image"))
    joined = (
        rows.join(exact, "name", "left").join(inside, "name", "left")
        .join(first, "number", "left").join(by_old, "old_number", "left")
    )
    old = F.col("old_image") if sample else F.lit(None).cast("string")
    return joined.select(
        "name",
        F.coalesce(
            F.when(F.col("exact") == 1, F.col("name")), F.col("inside"), F.col("same_number"), old
        ).alias("image"),
    )


def match_objects(rois: DataFrame, images: DataFrame, delimiter: str = ROI_DELIMITER,
                  descriptors: tuple[str, ...] = ("description",), has_sample: bool = True) -> DataFrame:
    """Which value of which object-table column names each image: (roi, value, column).

    ``rois`` is (roi, position, mask), mask being the mask in use or NULL. ``images`` lists the
    different values of each column as (column, name). For each descriptor column in order: the
    experiment with the padded acquisition index; the acquisition itself (when listed, or when the
    mask matches it); the experiment (when listed, or the mask holding it). Then for sample: the
    mask; the experiment with the 1-based list position, which is not checked.
    """
    keys = _keyed(rois, delimiter).join(rois.select("roi", "mask"), "roi")
    mask, acq, exp = F.col("mask"), F.col("acq"), F.col("experiment")
    same_number = F.coalesce(trailing_number(mask) == F.col("acq_number"), F.lit(False))
    mask_fits = mask.isNotNull() & (same_number | F.coalesce(mask.contains(acq), F.lit(False)))
    mask_has_exp = F.coalesce(mask.contains(exp), F.lit(False))
    rows = keys.withColumn(
        "padded", F.concat(exp, F.lit("_"), pad_index(F.substring_index(acq, "_", -1)))
    )
    listed = images.select("column", "name").distinct()
    value, column = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, d in enumerate(descriptors):
        own = listed.where(F.col("column") == d)
        for key in ("padded", "acq", "experiment"):
            rows = rows.join(
                own.select(F.col("name").alias(key), F.lit(True).alias(f"{key}_{i}")), key, "left"
            )
        present = own.agg(F.count(F.lit(1)).alias("n")).scalar() > 0
        is_in = lambda key: F.coalesce(F.col(f"{key}_{i}"), F.lit(False))  # noqa: E731, B023
        unset = value.isNull()
        step = F.when(unset & is_in("padded"), F.col("padded")).otherwise(value)
        step = F.when((step.isNull() & mask_fits) | is_in("acq"), acq).otherwise(step)
        by_exp = F.when(mask_has_exp, mask).otherwise(exp)
        step = F.when(
            (step.isNull() & (exp != "") & is_in("experiment")) | (step.isNull() & mask_has_exp), by_exp
        ).otherwise(step)
        changed = ~step.eqNullSafe(value)
        rows = rows.withColumn(f"v{i}", F.when(present, step).otherwise(value)).withColumn(
            f"c{i}", F.when(present & changed, F.lit(d)).otherwise(column)
        )
        value, column = F.col(f"v{i}"), F.col(f"c{i}")
    if has_sample:
        by_mask = mask.isNotNull() & (same_number | F.coalesce(mask == acq, F.lit(False)))
        listed_roi = F.col("position") >= 0
        by_position = F.concat(exp, F.lit("_"), (F.col("position") + 1).cast("string"))
        final = F.when(value.isNull() & by_mask, mask).when(
            value.isNull() & listed_roi & exp.isNotNull(), by_position
        ).otherwise(value)
        column = F.when(value.isNull() & final.isNotNull(), F.lit("sample")).otherwise(column)
        value = final
    return rows.select("roi", value.alias("value"), column.alias("column"))
