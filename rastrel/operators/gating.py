"""Gates: ranges on min-max scaled channels that select objects across all images."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastrel.operators.objects import column_ranges
from rastrel.schema import DEFAULT_CATEGORY, q


def gates_with_defaults(gates: Mapping | None, columns: Sequence[str]) -> dict:
    """Gate table with a full 0..1 range for every column that has none."""
    filled = {c: dict(g) for c, g in (gates or {}).items()}
    for c in columns:
        filled.setdefault(c, {"lower_bound": 0.0, "upper_bound": 1.0})
    return filled


def update_gate(gates: Mapping | None, column: str, values: Sequence[float] = (0.0, 1.0)) -> dict:
    changed = {c: dict(g) for c, g in (gates or {}).items()}
    changed[column] = {"lower_bound": float(min(values)), "upper_bound": float(max(values))}
    return changed


def gate_flag(df: DataFrame, gates: Mapping, selection: Sequence[str], intersection: bool = False,
              normalize: bool = True) -> tuple[DataFrame, Column]:
    """The table with helper column ``_ranges`` and the gate test on it.

    Selected columns without a gate are skipped. With no gate left, an intersection passes every
    row and a union none. Ranges are scaled over all images together; a constant column never
    passes.
    """
    used = [c for c in selection if c in gates and c in df.columns]
    rows = df
    if used and normalize:
        rows = df.withColumn("_ranges", column_ranges(df, used))
    else:
        rows = df.withColumn("_ranges", F.lit(None).cast("int"))
    test = F.lit(bool(intersection))
    for i, c in enumerate(used):
        value = q(c).cast("double")
        if normalize:
            r = F.col(f"_ranges.c{i}")
            value = F.try_divide((q(c) - r["low"]).cast("double"), (r["high"] - r["low"]).cast("double"))
        hit = F.coalesce(
            (value >= gates[c]["lower_bound"]) & (value <= gates[c]["upper_bound"]), F.lit(False)
        )
        test = (test & hit) if intersection else (test | hit)
    return rows, test


def gate(df: DataFrame, gates: Mapping, selection: Sequence[str], intersection: bool = False,
         normalize: bool = True, image: str | None = None, image_column: str = "sample") -> DataFrame:
    """Objects that pass the gates: of one image, or of all."""
    rows, test = gate_flag(df, gates, selection, intersection, normalize)
    passed = rows.where(test).drop("_ranges")
    return passed if image is None else passed.where(q(image_column) == image)


def label_gated(df: DataFrame, gates: Mapping, selection: Sequence[str], column: str | None,
                value: str, default: str = DEFAULT_CATEGORY, reset: bool = False,
                intersection: bool = False) -> DataFrame:
    """Write a category on gated objects of every image; ``reset`` writes the default instead."""
    if not column:
        return df
    rows, test = gate_flag(df, gates, selection, intersection)
    old = q(column) if column in df.columns else F.lit(default)
    return rows.withColumn(column, F.when(test, F.lit(default if reset else value)).otherwise(old)).drop(
        "_ranges"
    )


def gated_in_window(mask: DataFrame, gated: DataFrame, x0, x1, y0, y1) -> DataFrame:
    """Gated (roi, object_id) seen in a half-open pixel window, corners truncated to integers."""
    xs, ys = sorted((int(x0), int(x1))), sorted((int(y0), int(y1)))
    seen = (
        mask.where(
            (F.col("x") >= xs[0]) & (F.col("x") < xs[1]) & (F.col("y") >= ys[0]) & (F.col("y") < ys[1])
        )
        .select("roi", "object_id").distinct()
    )
    return seen.join(gated.select("roi", "object_id").distinct(), ["roi", "object_id"], "left_semi")
