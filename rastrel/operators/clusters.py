"""Cluster tables: merging, transfer from objects, colours, painted masks and markers."""

from __future__ import annotations

import colorsys
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rastrel.functions.names import hex_to_rgb
from rastrel.plans.joins import lookup_join
from rastrel.schema import object_id_column, q

#: Different colours of the default palette; further categories start over.
PALETTE_SIZE = 100


def merge_key(df: DataFrame) -> str:
    return "object_id" if "object_id" in df.columns else "cell_id"


def merge_clusters(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Inner join of two cluster tables of the same image(s) by object id.

    Equal column names get the suffixes _x and _y. Tables with a ``roi`` column on both sides are
    joined per image.
    """
    left, right = merge_key(current), merge_key(incoming)
    keys = [(left, right)] + ([("roi", "roi")] if "roi" in current.columns and "roi" in incoming.columns else [])
    joined_names = {a for a, b in keys if a == b}
    clash = (set(current.columns) & set(incoming.columns)) - joined_names
    a, b = current.alias("a"), incoming.alias("b")
    test = F.lit(True)
    for x, y in keys:
        test = test & (F.col(f"a.`{x}`") == F.col(f"b.`{y}`"))
    columns = [F.col(f"a.`{c}`").alias(f"{c}_x" if c in clash else c) for c in current.columns]
    columns += [
        F.col(f"b.`{c}`").alias(f"{c}_y" if c in clash else c)
        for c in incoming.columns if c not in joined_names
    ]
    return a.join(b, test).select(*columns)


def transfer_category(objects: DataFrame, matches: DataFrame, categories: Sequence[str],
                      existing: DataFrame | None = None) -> DataFrame:
    """Categories of an object table as cluster table of matched images.

    ``matches`` is (roi, value, column). Rows are the objects whose column holds the value; with an
    existing cluster table only objects known there stay.
    """
    wanted = matches.where(F.col("value").isNotNull())
    key = object_id_column(objects)
    found = None
    for name in ("description", "sample"):
        if name not in objects.columns:
            continue
        rows = objects.select(
            q(name).cast("string").alias("value"), q(key).cast("bigint").alias(key), *[q(c).alias(f"cat_{c}") for c in categories]
        )
        part = lookup_join(rows, wanted.where(F.col("column") == name).select("roi", "value"), ["value"], spread_by=[key])
        part = part.select("roi", key, *[F.col(f"`cat_{c}`").alias(c) for c in categories])
        found = part if found is None else found.unionByName(part)
    return found if existing is None else merge_clusters(existing, found)


def assign_clusters(clusters: DataFrame, matches: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Uploaded cluster rows of several images, attached to session images by name match.

    ``matches`` is (roi, value, column); rows of images without a match are not taken.
    """
    parts = []
    for name in ("roi", "description"):
        if name in clusters.columns:
            named = matches.where((F.col("column") == name) & F.col("value").isNotNull())
            rows = clusters.withColumn("_value", q(name).cast("string")).drop("roi")
            images = named.select(F.col("value").alias("_value"), "roi")
            parts.append(lookup_join(rows, images, ["_value"]).drop("_value"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p, allowMissingColumns=True)
    return found if existing is None else merge_clusters(existing, found)


def subset_clusters(clusters: DataFrame, column: str, categories: Sequence,
                    gate: DataFrame | None = None) -> DataFrame:
    """Cluster rows of some categories (compared as text) and, if given, of gated objects."""
    rows = clusters.withColumn(column, q(column).cast("string"))
    rows = rows.where(q(column).isin([str(c) for c in categories]))
    if gate is None:
        return rows
    key = object_id_column(clusters)
    on = [key] + (["roi"] if "roi" in gate.columns and "roi" in clusters.columns else [])
    ids = gate.withColumnRenamed(object_id_column(gate), key).select(*on).distinct()
    return rows.join(ids, on, "left_semi")


def hue_palette(count: int) -> list[str]:
    """Evenly spread colours, every second one darker."""
    out = []
    for i in range(count):
        r, g, b = colorsys.hsv_to_rgb(i / max(count, 1), 0.85, 0.95 if i % 2 == 0 else 0.65)
        out.append("#%02x%02x%02x" % (round(r * 255), round(g * 255), round(b * 255)))
    return out


def assign_palette(clusters: DataFrame, column: str, position: str, palette: Sequence[str] | None = None,
                   keys: Sequence[str] = ("roi",)) -> DataFrame:
    """Colour per category in order of first appearance: (keys, category, color).

    The palette starts over when an image has more categories than it has colours.
    """
    colours = F.array(*[F.lit(c) for c in (palette or hue_palette(PALETTE_SIZE))])
    ks = [q(k) for k in keys]
    first = clusters.groupBy(*ks, q(column).cast("string").alias("category")).agg(
        F.min(q(position)).alias("_first")
    )
    order = F.row_number().over(Window.partitionBy(*ks).orderBy("_first", "category"))
    place = F.pmod(order - 1, F.size(colours)) + 1
    return first.select(*ks, "category", F.element_at(colours, place).alias("color"))


def palette_changed(current: Mapping[str, str] | None, incoming: Sequence) -> bool:
    """Whether categories differ from those that already have colours."""
    if not current or not incoming:
        return True
    return {str(c) for c in current} != {str(c) for c in incoming}


def paint_mask(mask: DataFrame, clusters: DataFrame, colours: DataFrame, column: str,
               gate: DataFrame | None = None, categories: Sequence | None = None,
               default: str = "#000000") -> DataFrame:
    """Mask as RGB by the category of each object: (roi, y, x, r, g, b).

    Background, objects without a cluster, outside the gate or outside ``categories`` are black;
    categories without a colour take the default.
    """
    key = object_id_column(clusters)
    kinds = clusters.select("roi", q(key).cast("bigint").alias("object_id"), q(column).cast("string").alias("category"))
    if categories is not None:
        kinds = kinds.where(F.col("category").isin([str(c) for c in categories]))
    if gate is not None:
        kinds = kinds.join(gate.select("roi", "object_id").distinct(), ["roi", "object_id"], "left_semi")
    on = ["roi", "category"] if "roi" in colours.columns else ["category"]
    painted = lookup_join(kinds, colours.select(*on, "color"), on, "left", spread_by=["object_id"]).groupBy(
        "roi", "object_id"
    ).agg(F.max(F.coalesce("color", F.lit(default))).alias("color"))
    rgb = hex_to_rgb(F.col("color"))
    part = lambda n: F.coalesce(rgb[n], F.lit(0)).alias(n)
    # background never matches; it is spread over many keys instead of meeting under one
    spread = F.when(F.col("object_id") == 0, -1 - F.pmod(F.xxhash64("y", "x"), F.lit(1024))).otherwise(F.col("object_id"))
    keyed = mask.select("roi", "y", "x", spread.alias("object_id"))
    return keyed.join(painted, ["roi", "object_id"], "left").select("roi", "y", "x", part("r"), part("g"), part("b"))


def object_centroids(mask: DataFrame, clusters: DataFrame, column: str, radius: int = 2,
                     gate: DataFrame | None = None, categories: Sequence | None = None) -> DataFrame:
    """Circle bounds around object centres with the object's first category.

    ``clusters`` carries position when an object can have several rows; the first one counts.
    """
    objects = mask.where(F.col("object_id") != 0)
    if gate is not None:
        objects = objects.join(gate.select("roi", "object_id").distinct(), ["roi", "object_id"], "left_semi")
    centres = objects.groupBy("roi", "object_id").agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"))
    key = object_id_column(clusters)
    text = q(column).cast("string")
    first = F.min_by(text, q("position")) if "position" in clusters.columns else F.min(text)
    kinds = clusters.groupBy("roi", q(key).cast("bigint").alias("object_id")).agg(first.alias("category"))
    if categories is not None:
        kinds = kinds.where(F.col("category").isin([str(c) for c in categories]))
    whole = lambda c: F.floor(c).cast("int")
    return centres.join(kinds, ["roi", "object_id"]).select(
        "roi", "object_id", "category",
        (whole("cx") - radius).alias("x0"), (whole("cx") + radius).alias("x1"),
        (whole("cy") - radius).alias("y0"), (whole("cy") + radius).alias("y1"),
    )


def default_cluster_column(df: DataFrame, current: str | None = None) -> str | None:
    """The category column to show: the current one if the table has it, else its first that is no id."""
    key = object_id_column(df)
    columns = [c for c in df.columns if c != key and c != "roi"]
    return current if current in columns else next(iter(columns), None)
