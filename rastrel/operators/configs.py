"""Saved session configurations as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARAMS = (
    "STRUCT<color: STRING, x_lower_bound: DOUBLE, x_upper_bound: DOUBLE, filter_type: STRING, "
    "filter_val: DOUBLE, filter_sigma: DOUBLE, alias: STRING>"
)
FILTER = (
    "STRUCT<global_apply_filter: BOOLEAN, global_filter_type: STRING, global_filter_val: DOUBLE, "
    "global_filter_sigma: DOUBLE>"
)
CONFIG = (
    f"user STRING, name STRING, saved_at BIGINT, channels MAP<STRING, {PARAMS}>, "
    f"config STRUCT<blend: ARRAY<STRING>, filter: {FILTER}>, "
    "cluster MAP<STRING, MAP<STRING, STRING>>, "
    "gating MAP<STRING, STRUCT<lower_bound: DOUBLE, upper_bound: DOUBLE>>, "
    "mask STRUCT<mask_toggle: BOOLEAN, mask_level: DOUBLE, mask_boundary: BOOLEAN, mask_hover: BOOLEAN>"
)


def latest_configs(log: DataFrame, order: str = "saved_at") -> DataFrame:
    """Newest entry per user and name; map-side aggregation keeps one row per key before the shuffle."""
    rest = [c for c in log.columns if c not in ("user", "name")]
    newest = log.groupBy("user", "name").agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return newest.select("user", "name", *[F.col(f"_row.`{c}`").alias(c) for c in rest])


def upsert_configs(saved: DataFrame, new: DataFrame, order: str = "saved_at") -> DataFrame:
    """Saved table with new entries in place of those of the same user and name."""
    kept = saved.join(new.select("user", "name").distinct(), ["user", "name"], "left_anti")
    return kept.unionByName(latest_configs(new, order))


def configs_of_user(saved: DataFrame, user: str) -> DataFrame:
    return saved.where(F.col("user") == user)


def remove_config(saved: DataFrame, user: str, name: str) -> DataFrame:
    return saved.where(~((F.col("user") == user) & (F.col("name") == name)))


def preview_configs(saved: DataFrame) -> DataFrame:
    """Name, panel length, blended channels by display name, and filter settings of each entry."""
    separator = " \\\n "
    label = lambda c: F.coalesce(
        F.try_element_at("channels", c)["alias"], c
    )
    f = F.col("config.filter")
    applied = F.when(f["global_apply_filter"], "True").when(~f["global_apply_filter"], "False")
    text = lambda k: applied if k == "global_apply_filter" else f[k].cast("string")
    settings = F.concat_ws(separator, *[
        F.concat(F.lit(f"{k}: "), F.coalesce(text(k), F.lit("None")))
        for k in ("global_apply_filter", "global_filter_type", "global_filter_val", "global_filter_sigma")
    ])
    return saved.select(
        F.col("name").alias("Names"), F.size(F.map_keys("channels")).alias("Panel Length"),
        F.array_join(F.transform("config.blend", label), separator).alias("Selected Channels"),
        settings.alias("Filter"),
    )


def channel_params_of(saved: DataFrame) -> DataFrame:
    """One row per channel of each entry."""
    rows = saved.select("user", "name", F.explode("channels").alias("channel", "p"))
    return rows.select("user", "name", "channel", "p.*")


def config_aliases(saved: DataFrame) -> DataFrame:
    """Display name of each channel in an entry."""
    rows = channel_params_of(saved)
    return rows.select("user", "name", "channel", F.coalesce("alias", "channel").alias("alias"))


def panels_match(panel: DataFrame, params: DataFrame) -> DataFrame:
    """Whether two channel lists hold the same channels: one row (matches)."""
    left = panel.select("channel").distinct().withColumn("l", F.lit(1))
    right = params.select("channel").distinct().withColumn("r", F.lit(1))
    both = left.join(right, "channel", "full_outer")
    return both.agg(
        (F.count(F.lit(1)) == F.count(F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), 1))).alias("matches")
    )
