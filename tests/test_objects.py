"""Object tables: known results, limits and invariants."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastrel.functions import names as na
from rastrel.operators import annotate as an
from rastrel.operators import clusters as cl
from rastrel.operators import cohort as co
from rastrel.operators import gating as ga
from rastrel.operators import objects as ob
from rastrel.plans.ranks import percentiles, rank_within, take_smallest
from rastrel.schema import channel_columns, metadata_columns


def values(df, expr):
    return df.select(expr.alias("v")).first()["v"]


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


@pytest.mark.parametrize("index, padded", [("1", "001"), ("12", "012"), ("123", "123"), ("1234", "1234"), (None, "000")])
def test_pad_index(one, index, padded):
    assert values(one, na.pad_index(F.lit(index))) == padded


@pytest.mark.parametrize("mask, roi, same", [
    ("patient1_003", "pos_1_3_3", True), ("patient1_003", "pos_1_3_2", False), ("pos1_3_003", "pos_1_3_3", True),
    ("file_1_name", "pos_1_3_3", False), ("patient1_003", "3_this_is_an_roi", False),
])
def test_same_trailing_number(one, mask, roi, same):
    assert values(one, na.same_trailing_number(F.lit(mask), F.lit(roi))) is same


def test_id_list(one):
    assert values(one, na.parse_id_list(F.lit("130,145,156, 170  ,   not_a_number"))) == [130, 145, 156, 170]
    assert values(one, na.parse_id_list(F.lit(None).cast("string"))) == []


def test_natural_order(spark):
    names = ["umap_min_dist_0.25", "umap_min_dist_0", "umap_min_dist_0.1", "umap_min_dist_0.5", "a10", "a9"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(na.natural_key(F.col("n"))).collect()
    assert [r.n for r in rows] == ["a9", "a10", "umap_min_dist_0", "umap_min_dist_0.1", "umap_min_dist_0.25", "umap_min_dist_0.5"]


def test_metadata_columns():
    assert metadata_columns(["a", "cell_id", "sample", "x"]) == ["cell_id", "sample", "x"]
    assert "x_my_cell_annotation" in metadata_columns(["a", "x_my_cell_annotation"])


def test_channel_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, "s", 1)], "`191Ir.DNA1` double, b double, sample string, cell_id int")
    assert channel_columns(df) == ["191Ir.DNA1", "b"]
    assert ob.minmax(df, ["191Ir.DNA1", "b"]).first()[0] is None


def test_validate(spark):
    df = spark.createDataFrame([(1.0, "s")], "a double, sample string")
    assert ob.validate_objects(df) is None
    with pytest.raises(ob.ObjectTableError):
        ob.validate_objects(df.drop("sample"))
    assert ob.objects_in_box(df, 0, 1, 0, 1) is None
    assert ob.ids_per_image(df) is None


def test_quantify_layout(spark):
    pix = spark.createDataFrame([("r", c, y, x, float(i + 1)) for i, c in enumerate(["c1", "c2", "c3"]) for y in range(4) for x in range(4)],
                                "roi string, channel string, y int, x int, value double")
    mask = spark.createDataFrame([("set1", "r", y, x, y // 2 + 1) for y in range(4) for x in range(4)],
                                 "mask_name string, roi string, y int, x int, object_id bigint")
    table = ob.quantify(pix, mask, ["c2", "c3"], {"c2": "two"})
    assert table.columns[:5] == ["two", "c3", "description", "cell_id", "sample"]
    assert {(r["two"], r["c3"], r["sample"], r["area"]) for r in table.collect()} == {(2.0, 3.0, "set1", 8)}
    assert ob.quantify(pix, mask, []) is None


def test_quantify_sparse_pixels(spark):
    pix = spark.createDataFrame([("r", "a", 0, 0, 10.0), ("r", "a", 0, 1, 20.0), ("s", "a", 0, 0, 4.0), ("s", "b", 0, 0, 6.0)],
                                "roi string, channel string, y int, x int, value double")
    mask = spark.createDataFrame([("r", 0, x, 1) for x in range(3)] + [("r", 1, 0, 2), ("r", 1, 1, 0), ("s", 0, 0, 1), ("s", 0, 1, 1)], "roi string, y int, x int, object_id bigint")
    means = lambda t: {(r["sample"], r["cell_id"]): (r["a"], r["b"]) for r in t.collect()}
    assert means(ob.quantify(pix, mask, ["a", "b"])) == {("r", 1): (10.0, 0.0), ("r", 2): (0.0, 0.0), ("s", 1): (2.0, 3.0)}
    known = spark.createDataFrame([("r", "a"), ("s", "a"), ("s", "b")], "roi string, channel string")
    assert means(ob.quantify(pix, mask, ["a", "b"], catalog=known)) == {("r", 1): (10.0, None), ("r", 2): (0.0, None), ("s", 1): (2.0, 3.0)}
    long = {(r["roi"], r["object_id"], r["channel"]): r["mean"] for r in ob.quantify_channel(pix, mask, ["a", "b"]).collect()}
    assert len(long) == 6 and long["r", 1, "a"] == 10.0 and long["r", 2, "b"] == 0.0


def test_mask_fits_image(spark):
    sizes = "roi string, width int, height int"
    masks = spark.createDataFrame([("a", 3, 4), ("b", 3, 4), ("c", 3, 4)], sizes)
    fits = ob.mask_fits_image(masks, spark.createDataFrame([("a", 3, 4), ("b", 4, 3)], sizes))
    assert {r["roi"]: r["fits"] for r in fits.collect()} == {"a": True, "b": False, "c": False}


def test_append(spark):
    a = spark.createDataFrame([(1, "s1")], "c int, sample string")
    b = spark.createDataFrame([(2, "s2")], "c int, sample string")
    assert ob.append_quantification(a, b).count() == 2
    assert ob.append_quantification(a, a).count() == 1
    assert ob.append_quantification(a, b.withColumnRenamed("c", "d")).columns == ["d", "sample"]
    assert ob.append_quantification(None, b).count() == 1 and ob.append_quantification(None, None) is None


def test_distribution_golden(spark):
    df = spark.createDataFrame([("test_1",)] * 202 + [("test_2",)] * 42, "sample string")
    assert [r.Proportion for r in ob.distribution(df, "sample").collect()] == [0.828, 0.172]
    ready = spark.createDataFrame([("test_1", 97), ("test_2", 8)], "Value string, Counts int")
    assert [r.Proportion for r in ob.distribution_of_counts(ready).collect()] == [0.924, 0.076]
    many = spark.range(200).withColumn("gene", F.col("id"))
    assert ob.distribution(many, "gene").count() == many.select("gene").distinct().count()


def test_toggle_categories():
    assert ob.toggle_categories([True, "legendonly", True], [0, 1, 2], 3) == [0, 2]
    assert ob.toggle_categories(["legendonly"], [1], 3) == [0, 2]
    assert ob.toggle_categories(["legendonly"], [1], 3, [1, 2]) == [2]
    assert ob.toggle_categories([True], [2], 3, [0]) == [0, 2]


def test_gates(spark):
    rows = [("s1", i, float(i), float(10 - i), 5.0) for i in range(11)] + [("s2", i, float(i), 0.0, 5.0) for i in range(11)]
    df = spark.createDataFrame(rows, "sample string, cell_id int, a double, b double, flat double")
    gates = {"a": {"lower_bound": 0.2, "upper_bound": 0.4}, "b": {"lower_bound": 0.5, "upper_bound": 1.0}}
    union, both = ga.gate(df, gates, ["a", "b"]), ga.gate(df, gates, ["a", "b"], intersection=True)
    per_image = sum(ga.gate(df, gates, ["a", "b"], image=s).count() for s in ("s1", "s2"))
    assert union.count() == per_image and both.count() < union.count()
    assert both.exceptAll(union).count() == 0
    assert ga.gate(df, gates, ["missing"], intersection=True).count() == 22 and ga.gate(df, gates, ["missing"]).count() == 0
    assert ga.gate(df, {"flat": {"lower_bound": 0, "upper_bound": 1}}, ["flat"]).count() == 0
    labelled = ga.label_gated(df, gates, ["a"], "g", "t1")
    assert labelled.where("g = 't1'").count() == ga.gate(df, gates, ["a"]).count()
    reset = ga.label_gated(labelled, gates, ["a"], "g", "t1", reset=True)
    assert [r.g for r in reset.select("g").distinct().collect()] == ["Unassigned"]
    assert ga.label_gated(df, gates, ["a"], None, "x").columns == df.columns


def test_gate_helpers():
    gates = ga.gates_with_defaults({"c1": {"lower_bound": 0.2, "upper_bound": 0.4}}, ["c1", "c2"])
    assert gates["c1"]["lower_bound"] == 0.2 and gates["c2"] == {"lower_bound": 0.0, "upper_bound": 1.0}
    assert ga.update_gate(gates, "c5", (0.51, 0.33))["c5"] == {"lower_bound": 0.33, "upper_bound": 0.51}


def test_percentiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    data = np.r_[rng.lognormal(2, 3, 3000), -rng.lognormal(0, 2, 500), np.zeros(700), [5.0] * 300]
    groups = np.where(rng.random(len(data)) < 0.8, "hot", "cold")
    df = spark.createDataFrame(list(zip(groups.tolist(), data.tolist())), "g string, v double")
    points = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    for r in percentiles(df, ["g"], "v", points).collect():
        want = np.percentile(data[groups == r.g], [0, 25, 50, 99, 100])
        assert np.allclose([r[p] for p in points], want, rtol=1e-12)


def test_rank_within_hot_group(spark):
    df = spark.range(10_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("g"), (F.col("id") * 7).alias("o"))
    ranked = rank_within(df, ["g"], "o", "n", rows=500)
    hot = [r.n for r in ranked.where("g = 'hot'").orderBy("o").collect()]
    assert hot == list(range(1, len(hot) + 1))
    assert ranked.count() == 10_000


def test_take_smallest_is_exact(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.xxhash64("id").alias("h"), "id")
    got = take_smallest(df, ["g"], "h", 77)
    want = {g: {r.id for r in df.where(F.col("g") == g).orderBy("h").limit(77).collect()} for g in (0, 1)}
    assert {g: {r.id for r in got.where(F.col("g") == g).collect()} for g in (0, 1)} == want


def test_similarity_is_symmetric(spark):
    df = spark.createDataFrame([(f"s{i % 7}", i, f"k{(i * i) % 5}") for i in range(300)], "sample string, cell_id int, kind string")
    m = {(r.image, r.other): r.score for r in co.image_similarity(df, "kind", block=2).collect()}
    assert len(m) == 49 and all(abs(m[a, b] - m[b, a]) < 1e-12 for a, b in m)
    assert co.similar_images(df, "kind", "not there").count() == 0


def test_annotation_order_and_repeat(spark):
    objects = spark.createDataFrame([("r", i, i * 10, i * 10 + 5, 0, 5) for i in range(6)],
                                    "sample string, cell_id int, x_min int, x_max int, y_min int, y_max int")
    boxes = spark.createDataFrame([("r", "ann", 1, "first", 0, 40, 0, 9), ("r", "ann", 2, "second", 20, 26, 0, 9), ("q", "ann", 3, "other", 0, 99, 0, 9)],
                                  "roi string, annotation_column string, seq int, cell_type string, x_min int, x_max int, y_min int, y_max int")
    hits = an.box_hits(objects, boxes)
    once = an.apply_annotations(objects, hits, ["ann"])
    assert [r.ann for r in once.orderBy("cell_id").collect()] == ["first", "first", "second", "first", "Unassigned", "Unassigned"]
    twice = an.apply_annotations(once, hits, ["ann"])
    assert twice.exceptAll(once.select(*twice.columns)).count() == 0
    everywhere = an.apply_annotations(objects, an.box_hits(objects, boxes, scope="all"), ["ann"])
    assert {r.ann for r in everywhere.collect()} == {"other"}


def test_merge_clusters_suffixes(spark):
    a = spark.createDataFrame([(1, "x", "p"), (2, "y", "q")], "cell_id int, cluster string, a string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "cell_id int, cluster string")
    merged = cl.merge_clusters(a, b)
    assert merged.columns == ["cell_id", "cluster_x", "a", "cluster_y"] and merged.count() == 1
    assert cl.palette_changed({"a": "#fff"}, ["a", "b"]) and not cl.palette_changed({"a": "#fff"}, ["a"])


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "a double, sample string, cell_id int")
    assert ob.minmax(empty, ["a"]).count() == 0
    assert ob.filter_hot_objects(empty, ["a"]).count() == 0
    assert ob.distribution(empty, "sample").count() == 0
    assert ob.summarize_channels(empty, ["a"], "median").count() == 0
