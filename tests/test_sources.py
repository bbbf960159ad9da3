"""Files in and out, name matching, models, spots and streams."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastrel.operators import configs as cf
from rastrel.operators import matching as ma
from rastrel.operators import models as mo
from rastrel.operators import spots as sp
from rastrel.sources import files, sinks
from rastrel.streaming import jobs


def names(spark, *items):
    return spark.createDataFrame([(n, i) for i, n in enumerate(items)], "name string, position bigint")


def rois(spark, *items, mask=None):
    return spark.createDataFrame([(r, i, mask) for i, r in enumerate(items)], "roi string, position bigint, mask string")


def mask_of(spark, key, *masks, delimiter="+++"):
    return ma.match_masks(rois(spark, key), names(spark, *masks), delimiter).first().mask_name


KEY = "liver+++deck+++spot_4"


def test_mask_of_an_image_by_each_rule(spark):
    assert mask_of(spark, KEY, "liver", "spot_4", KEY) == KEY  # the whole key
    assert mask_of(spark, KEY, "spot_4", "scan_s0_a1_ac_IA_mask") == "scan_s0_a1_ac_IA_mask"  # number of the list position
    assert mask_of(spark, KEY, "in_spot_4_too", "spot_4", "liver") == "liver"  # the experiment
    assert mask_of(spark, KEY, "in_liver_too", "spot_4") == "spot_4"  # the acquisition
    assert mask_of(spark, KEY, "liver_part_03", "liver_part_04", "lung_04") == "liver_part_04"  # experiment and equal number
    assert mask_of(spark, KEY, "lung_old", "my_liver_old", "with_spot_4_in") == "my_liver_old"  # part of the name
    assert mask_of(spark, KEY, "lung_1", "spot_5") is None
    assert mask_of(spark, "liver::deck::spot_4", "liver_part_04", "x_liver", delimiter="::") == "liver_part_04"


@pytest.mark.parametrize("mask, images, want", [
    ("lung_b", ["lung_a", "lung_b"], "lung_b"),  # equal names
    ("west_lung_b_mask", ["lung_b", "west", "none"], "west"),  # the last image found in the name
    ("scan_s0_a3_ac_IA_mask", ["area_1", "area_2", "area_3"], "area_3"),  # the older form's number
    ("liver_9", ["area_8", "area_09", "more_9"], "area_09"),  # the first with an equal number
    ("liver_7", ["area_8", "area"], None),
])
def test_image_of_a_mask_by_each_rule(spark, mask, images, want):
    assert ma.match_masks_to_images(names(spark, mask), names(spark, *images)).first().image == want


def found(spark, keys, columns, delimiter="+++", mask=None, has_sample=False):
    listed = spark.createDataFrame(columns, "column string, name string")
    r = ma.match_objects(rois(spark, *keys, mask=mask), listed, delimiter, has_sample=has_sample).first()
    return r.value, r.column


def test_object_rows_of_an_image_by_each_rule(spark):
    assert found(spark, [KEY], [("description", "liver_004"), ("description", "spot_4")]) == ("spot_4", "description")  # a listed acquisition
    assert found(spark, [KEY], [("description", "liver_004")]) == ("liver_004", "description")  # experiment and padded number
    assert found(spark, [KEY], [("description", "liver")]) == ("liver", "description")  # the experiment
    assert found(spark, [KEY], [("description", "other")]) == (None, None)
    assert found(spark, [KEY], [("description", "x")], mask="old_liver_scan") == ("old_liver_scan", "description")  # the mask holds the experiment
    assert found(spark, [KEY], [("sample", "x")], mask="m_4", has_sample=True) == ("m_4", "sample")  # the mask's number
    assert found(spark, ["a+++b+++c", KEY][:1], [("sample", "x")], has_sample=True) == ("a_1", "sample")  # the list position
    both = ma.match_objects(rois(spark, "first", KEY), spark.createDataFrame([("sample", "x")], "column string, name string"))
    assert {r.roi: r.value for r in both.collect()}[KEY] == "liver_2"


def test_ordered_csv_and_embedding(spark, tmp_path):
    path = tmp_path / "umap_min_dist_0_coordinates.csv"
    rows = [(i * 0.5, -i) for i in range(5000)]
    path.write_text("a,b\n" + "\n".join(f"{a},{b}" for a, b in rows) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        got = files.read_embedding(spark, str(path)).orderBy("position").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.position, r.UMAP1, r.UMAP2) for r in got] == [(i, a, float(b)) for i, (a, b) in enumerate(rows)]


def test_text_acquisition(spark, tmp_path):
    (tmp_path / "exp1.txt").write_text("Start_push\tX\tY\tZ\t80ArAr(ArAr80Di)\tCD3(Er170Di)\n1\t0\t0\t0\t1.5\t2\n2\t1\t0\t0\t0\t4\n")
    rows = files.read_pixels_txt(spark, str(tmp_path / "exp1.txt")).collect()
    assert {(r.roi, r.channel, r.label, r.y, r.x, r.value) for r in rows} == {
        ("exp1+++slideNA+++acq", "ArAr80", "80ArAr", 0, 0, 1.5), ("exp1+++slideNA+++acq", "ArAr80", "80ArAr", 0, 1, 0.0),
        ("exp1+++slideNA+++acq", "Er170", "CD3", 0, 0, 2.0), ("exp1+++slideNA+++acq", "Er170", "CD3", 0, 1, 4.0)}


def test_catalog_and_project(spark, tmp_path):
    for name in ("mcd/a.mcd", "deepcell/cell/m_001.tiff", "export/x.h5ad", "export/umap/umap_0.25_coordinates.csv",
                 "export/umap/umap_0.1_coordinates.csv", "export/scaling.json", "export/readme.md"):
        p = tmp_path / "proj" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x")
    rows = files.scan_project(spark, str(tmp_path / "proj")).collect()
    assert sorted(r.role for r in rows) == ["embedding", "embedding", "image", "mask", "objects", "scaling"]
    assert [r.path.split("/")[-1] for r in rows if r.preferred] == ["umap_0.1_coordinates.csv"]
    listed = files.scan_catalog(spark, str(tmp_path / "proj" / "mcd")).collect()
    assert [(r.stem, r.extension) for r in listed] == [("a", "mcd")]
    assert files.is_project(["mcd", "quantification", "deepcell"]) and not files.is_project(["mcd"])


def test_masks_points_params(spark, tmp_path):
    (tmp_path / "m1.csv").write_text("y,x,object_id\n0,0,0\n0,1,5\n")
    masks = files.read_masks(spark, str(tmp_path / "m1.csv"), "csv").collect()
    assert {(r.mask_name, r.y, r.x, r.object_id) for r in masks} == {("m1", 0, 0, 0), ("m1", 0, 1, 5)}
    (tmp_path / "p.csv").write_text("ROI,x,y,annotation_col,annotation\nr,10,10,c,a\nr,101,10,c,a\nr,100,10,c,b\n")
    extent = spark.createDataFrame([("r", 100, 1000)], "roi string, width int, height int")
    assert files.read_points(spark, str(tmp_path / "p.csv"), extent).count() == 2
    doc = {"channels": {"A": {"color": "#FFFFFF", "x_lower_bound": 0, "x_upper_bound": 9.5, "filter_type": None, "alias": "alpha"}},
           "config": {"blend": ["A"], "filter": {"global_apply_filter": [], "global_filter_type": "median", "global_filter_val": 3, "global_filter_sigma": 1}}}
    (tmp_path / "s.json").write_text(json.dumps(doc))
    r = files.read_channel_params(spark, str(tmp_path / "s.json")).first()
    assert (r.channel, r.x_upper_bound, r.alias) == ("A", 9.5, "alpha")
    session = files.read_session(spark, str(tmp_path / "s.json")).first()
    assert session.blend == ["A"] and session.global_filter_val == 3.0


def test_sinks_round_trip(spark, tmp_path):
    pix = spark.createDataFrame([(f"r{i % 3}", f"c{i % 2}", i, i, float(i)) for i in range(60)], "roi string, channel string, y int, x int, value float")
    sinks.write_pixels(pix, str(tmp_path / "pix"))
    back = files.read_pixels(spark, str(tmp_path / "pix"))
    assert back.select(*pix.columns).exceptAll(pix).count() == 0 and back.count() == 60
    params = spark.createDataFrame([("A", "#FFFFFF", 0.0, 5.0)], "channel string, color string, x_lower_bound double, x_upper_bound double")
    sinks.write_documents(sinks.session_documents(params, ["A"], {"global_filter_type": "median"}), str(tmp_path / "doc"))
    assert files.read_channel_params(spark, str(tmp_path / "doc")).first().x_upper_bound == 5.0
    assert cf.panels_match(params, params).first().matches
    assert not cf.panels_match(params, params.withColumn("channel", F.lit("B"))).first().matches


def test_pipeline_objects(spark):
    counts = spark.createDataFrame([("r", 1, "g1", 2.0), ("r", 2, "g2", 3.0)], "roi string, spot_id int, gene string, value double")
    obs = spark.createDataFrame([("r", 1, "Object 1", "im_001.tiff"), ("r", 2, "Object 2", "im_001.tiff")], "roi string, spot_id int, name string, Image string")
    assert files.is_pipeline_export(obs)
    table = files.objects_from_matrix(counts, obs, ["g1", "g2"], True)
    assert table.columns[:5] == ["g1", "g2", "description", "cell_id", "sample"]
    assert {(r.g1, r.g2, r.cell_id, r["sample"]) for r in table.collect()} == {(2.0, 0.0, 1, "im_001"), (0.0, 3.0, 2, "im_001")}


def test_disks_match_brute_force(spark):
    rng = np.random.default_rng(4)
    pts = [("r", i, float(x), float(y), int(v)) for i, (x, y, v) in enumerate(zip(rng.integers(0, 30, 25), rng.integers(0, 30, 25), rng.integers(0, 9, 25)))]
    spots = spark.createDataFrame(pts, "roi string, spot_id bigint, x double, y double, value bigint")
    meta = spark.createDataFrame([("r", False, None)], "roi string, spot_based boolean, spot_diameter double")
    scales = sp.with_spot_scale(meta, radius=3)
    extents = sp.spatial_extent(spots, scales)
    e = extents.first()
    want = np.zeros((e.grid_height, e.grid_width))
    for _, _, x, y, v in pts:
        for dy in range(-3, 4):
            for dx in range(-3, 4):
                yy, xx = int(y - e.y_min + dy), int(x - e.x_min + dx)
                if dy * dy + dx * dx < 9 and 0 <= yy < e.grid_height and 0 <= xx < e.grid_width:
                    want[yy, xx] = max(want[yy, xx], v)
    got = np.zeros_like(want)
    for r in sp.rasterize_spots(spots.withColumn("gene", F.lit("g")), scales, extents).collect():
        got[r.y, r.x] = r.value
    assert np.array_equal(got, want)


def test_technology():
    assert sp.technology(["x", "y", "array_row", "array_col", "spot_diameter"]) == "spots"
    assert sp.technology(["x", "y"]) == "points" and sp.technology(["x"]) is None
    assert sp.technology([], ["square_008um"]) == "bins" and sp.technology([], [], ["cell_boundaries"]) == "cells"


def blobs(spark, n=120):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(n):
        c = i % 3
        a, b = rng.normal([0, 10, 20][c], 0.5), rng.normal([0, 10, -10][c], 0.5)
        rows.append((float(a), float(b), f"s{i % 4}", i, f"k{c}" if i % 4 < 2 else "Unassigned"))
    return spark.createDataFrame(rows, "a double, b double, sample string, cell_id bigint, label string")


def test_models(spark):
    df = blobs(spark)
    known = df.where("label <> 'Unassigned'").count()
    forest = mo.run_model(df, "label", "rf", "random forest", n_estimators=5, max_depth=4)
    assert forest.where("rf = label and label <> 'Unassigned'").count() == known
    assert forest.where("rf = 'Unassigned'").count() == 0
    boosted = mo.run_model(df, "label", "ada", "boosted trees", rounds=2, n_estimators=2, max_depth=3)
    assert boosted.where("ada = label and label <> 'Unassigned'").count() > known * 0.9
    groups = mo.run_model(df, None, "com", n_neighbors=6)
    truth = groups.withColumn("c", F.col("cell_id") % 3)
    assert truth.groupBy("com").agg(F.count_distinct("c").alias("n")).where("n > 1").count() == 0
    with pytest.raises(mo.ModelNotFoundError):
        mo.run_model(df, None, mode="not found")


def test_pca_and_scaling(spark):
    df = blobs(spark)
    flat = mo.pca_embedding(df.select("sample", "cell_id", "a", "b"), ["a", "b"])
    assert flat.columns == ["sample", "cell_id", "UMAP1", "UMAP2"]
    m = mo.scale_features(df, ["a", "b"]).agg(F.avg("a").alias("m"), F.stddev_pop("a").alias("s")).first()
    assert abs(m.m) < 1e-9 and abs(m.s - 1) < 1e-9


def test_stream_totals_grow_by_batch(spark, tmp_path):
    schema = "roi string, channel string, y int, x int, value double"
    mask = spark.createDataFrame([("r", 0, 0, 1), ("r", 0, 1, 0)], "roi string, y int, x int, object_id bigint")
    for part in range(2):
        spark.createDataFrame([("r", "c", 0, 0, 2.0 + part), ("r", "c", 0, 1, 9.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.write_updates(jobs.stream_quantify(stream, mask), str(tmp_path / "out"), str(tmp_path / "state"))
    state = jobs.latest_state(spark.read.parquet(str(tmp_path / "out")), ["roi", "object_id", "channel"]).collect()
    assert [(r.n, r.total) for r in state] == [(2, 5.0)]


def test_an_acquisition_is_one_file(spark, sf, tmp_path, monkeypatch):
    """The rows of an image meet before they are written, however many tasks hold them."""
    from rastrel.queries import readers

    monkeypatch.setattr(readers, "folder", lambda spark, what: str(tmp_path / what))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        images = readers.read_acquisitions(spark, sf).select("roi").distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(list(tmp_path.rglob("*.csv"))) == images > 1
