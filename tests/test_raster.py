"""Rasters, polygons and stencils against brute force on small arrays, and known results."""

from __future__ import annotations

import numpy as np
import pytest
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import functions as F

from rastrel.functions.colour import gradient_table
from rastrel.functions.geometry import path_vertices, recentre_window, vertex_bounds
from rastrel.operators import polygons as po
from rastrel.operators import raster as ra
from rastrel.operators import stencils as st

#: A drawn outline with real-valued corners, and its corners as whole pixels.
PATH = "M50.4,11.6L83.7,14.2L90.1,45.8L71.5,67.3L38.2,65.9L22.6,32.4Z"
CORNERS = [(50, 12), (84, 14), (90, 46), (72, 67), (38, 66), (23, 32)]


def pixels_of(spark, arrays: dict):
    rows = [(r, c, y, x, v.item()) for (r, c), a in arrays.items() for (y, x), v in np.ndenumerate(a)]
    kind = "bigint" if all(a.dtype.kind == "i" for a in arrays.values()) else "double"
    return spark.createDataFrame(rows, f"roi string, channel string, y int, x int, value {kind}")


def extent_of(spark, sizes: dict):
    return spark.createDataFrame([(r, w, h) for r, (h, w) in sizes.items()], "roi string, width int, height int")


def to_array(rows, shape):
    out = np.full(shape, np.nan)
    for r in rows:
        out[r.y, r.x] = r.value
    return out


def closed_polygon(xs, ys, shape):
    """Reference raster: even-odd inside or on an edge, holes closed by flooding from outside."""
    h, w = shape
    mask = np.zeros(shape, bool)
    n = len(xs)
    for y in range(h):
        for x in range(w):
            odd = on = False
            for i in range(n):
                x1, y1, x2, y2 = xs[i], ys[i], xs[(i + 1) % n], ys[(i + 1) % n]
                cross = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
                if cross == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                    on = True
                if (y1 <= y) != (y2 <= y) and (cross < 0) == (y2 > y1):
                    odd = not odd
            mask[y, x] = odd or on
    outside = np.zeros((h + 2, w + 2), bool)
    padded = np.pad(mask, 1)
    todo = [(0, 0)]
    outside[0, 0] = True
    while todo:
        y, x = todo.pop()
        for v, u in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
            if 0 <= v < h + 2 and 0 <= u < w + 2 and not outside[v, u] and not padded[v, u]:
                outside[v, u] = True
                todo.append((v, u))
    return mask, ~outside[1:-1, 1:-1]


def painted(spans, n, shape):
    out = np.zeros((n, *shape), bool)
    for p, y, a, b in zip(*(c.tolist() for c in spans)):
        out[p, y, a:b + 1] = True
    return out


def test_polygons_match_brute_force():
    rng = np.random.default_rng(0)
    shapes = [(rng.integers(-4, 24, k), rng.integers(-4, 24, k)) for k in rng.integers(3, 9, 60)]
    shapes.append((np.array([2, 12, 2, 12, 7]), np.array([4, 4, 14, 14, 0])))
    size = np.full(len(shapes), 20)
    args = ([s[0] for s in shapes], [s[1] for s in shapes], size, size)
    plain, filled = painted(po.spans_of_polygons(*args, False), len(shapes), (20, 20)), painted(po.spans_of_polygons(*args, True), len(shapes), (20, 20))
    for i, (xs, ys) in enumerate(shapes):
        want, closed = closed_polygon(xs.tolist(), ys.tolist(), (20, 20))
        assert np.array_equal(plain[i], want) and np.array_equal(filled[i], closed), (xs, ys)


def test_drawn_path(spark):
    paths = spark.createDataFrame([(1, "r", PATH)], "region int, roi string, path string")
    spans = po.path_spans(paths, extent_of(spark, {"r": (80, 100)}))
    want = closed_polygon(*map(list, zip(*CORNERS)), (80, 100))[0]
    got = np.zeros((80, 100), bool)
    for p in po.spans_to_pixels(spans).collect():
        got[p.y, p.x] = True
    assert np.array_equal(got, want)
    b = paths.select(vertex_bounds(path_vertices(F.col("path"))).alias("b")).first().b
    assert (b.x_min, b.x_max, b.y_min, b.y_max) == (23, 90, 12, 67)
    a = np.zeros((80, 100))
    a[12, 50], a[5, 5] = 700, 900
    dense = pixels_of(spark, {("r", "c"): a})
    r = ra.region_statistics(ra.pixels_in_spans(dense, spans), None).first()
    inside = a[want]
    assert (r.Max, r.Min, r.Total, r.Median) == (700, 0, 700, 0) and r.Mean == pytest.approx(inside.mean()) and r.SD == pytest.approx(inside.std())
    stored = ra.region_statistics(ra.pixels_in_spans(ra.sparsify(dense), spans), None, ra.span_areas(spans, ["c", "none"]))
    got = {x.channel: x for x in stored.collect()}
    assert all(got["c"][k] == pytest.approx(r[k]) for k in ra.STATISTICS) and all(got["none"][k] == 0 for k in ra.STATISTICS)


def test_path_over_border(spark):
    path = "M18,2L30,2L30,9L18,9Z"
    paths = spark.createDataFrame([(1, "r", path)], "region int, roi string, path string")
    found = po.spans_to_pixels(po.path_spans(paths, extent_of(spark, {"r": (20, 20)}))).collect()
    assert {(p.y, p.x) for p in found} == {(y, x) for y in range(2, 10) for x in (18, 19)}


def test_hot_pixels_golden(spark):
    a = np.full((60, 60), 150)
    a[10, 10] = 175
    ext = extent_of(spark, {"r": (60, 60)})
    hpf = lambda arr: st.hot_pixel_diff(pixels_of(spark, {("r", "c"): arr}), ext, integer_mean=True, tile=16).first().hpf
    assert hpf(a) == 25
    a[20, 20] = 151
    assert hpf(a) == 25
    a[50, 50] = 200
    assert hpf(a) == 50
    rect = spark.createDataFrame([(1, "r", 1, 31, 1, 31)], "region int, roi string, x_min int, x_max int, y_min int, y_max int")
    assert st.hot_pixel_diff_of_rectangles(pixels_of(spark, {("r", "c"): a}), rect, ext, integer_mean=True).first().hpf == 25


def test_hot_pixels_in_path(spark):
    a = np.full((80, 100), 90)
    paths = spark.createDataFrame([(1, "r", PATH)], "region int, roi string, path string")
    ext = extent_of(spark, {"r": (80, 100)})
    hpf = lambda: st.hot_pixel_diff_of_paths(pixels_of(spark, {("r", "c"): a}), paths, ext, integer_mean=True).first().hpf
    assert hpf() == 0
    a[40, 60] = 200
    inside = hpf()
    assert 50 < inside <= 110
    a[75, 5] = 999  # not in the path
    assert hpf() == inside


@pytest.mark.parametrize("size, tile", [(3, 7), (4, 7), (5, 64), (1, 8)])
def test_median_matches_brute_force(spark, size, tile):
    a = np.random.default_rng(1).integers(0, 99, (19, 23))
    got = st.median_filter(pixels_of(spark, {("r", "c"): a}), extent_of(spark, {"r": a.shape}), size, tile=tile).collect()
    before, after = size // 2, size - size // 2 - 1
    near = sliding_window_view(np.pad(a, ((before, after), (before, after)), "symmetric"), (size, size)).reshape(*a.shape, -1)
    assert np.array_equal(to_array(got, a.shape), np.sort(near, -1)[..., size * size // 2])


def test_gaussian_matches_brute_force(spark):
    a = np.random.default_rng(2).random((21, 17)) * 100
    w = np.array(st.gaussian_weights(5, 1.3))
    got = st.gaussian_filter(pixels_of(spark, {("r", "c"): a}), extent_of(spark, {"r": a.shape}), 5, 1.3, tile=6).collect()
    near = sliding_window_view(np.pad(a, 2, "reflect"), (5, 5))
    assert np.allclose(to_array(got, a.shape), np.einsum("ijkl,k,l->ij", near, w, w))
    same = pixels_of(spark, {("r", "c"): a})
    assert st.gaussian_filter(same, None, 4, 1.0) is same and st.global_filter(same, None, "median", 98) is same
    with pytest.raises(TypeError):
        st.global_filter(same, None, "other", 3)


def centre_raster(rings, shape):
    """Even-odd test of every pixel centre against every edge."""
    out = np.zeros(shape, bool)
    for y in range(shape[0]):
        for x in range(shape[1]):
            odd = False
            for ring in rings:
                for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
                    if (y1 <= y + 0.5) != (y2 <= y + 0.5) and x + 0.5 >= x1 + (y + 0.5 - y1) * (x2 - x1) / (y2 - y1):
                        odd = not odd
            out[y, x] = odd
    return out


VERTICES = "array<struct<x: double, y: double>>"


def test_square_covers_its_own_area(spark):
    squares = [("r", 1, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]), ("r", 2, [(4.0, 0.0), (8.0, 0.0), (8.0, 4.0), (4.0, 4.0)])]
    df = spark.createDataFrame(squares, f"roi string, shape_id long, vertices {VERTICES}")
    rows = po.mask_from_shapes(df, extent_of(spark, {"r": (10, 10)})).groupBy("object_id").count().collect()
    assert {r["object_id"]: r["count"] for r in rows} == {1: 16, 2: 16}


def test_real_vertices_and_rings(spark):
    rng = np.random.default_rng(8)
    shapes = [[[(float(x), float(y)) for x, y in rng.uniform(-3, 23, (k, 2))]] for k in rng.integers(3, 8, 25)]
    shapes.append([[(1.0, 1.0), (15.0, 2.0), (14.5, 16.0), (2.0, 13.0)], [(4.2, 4.1), (9.0, 4.7), (8.0, 9.9)]])
    df = spark.createDataFrame([(i, "r", r, 20, 20) for i, r in enumerate(shapes)], f"region int, roi string, rings array<{VERTICES}>, width int, height int")
    got = np.zeros((len(shapes), 20, 20), bool)
    for s in po.centre_spans(df).collect():
        got[s.region, s.y, s.x0:s.x1 + 1] = True
    for i, r in enumerate(shapes):
        assert np.array_equal(got[i], centre_raster(r, (20, 20))), i


def test_polygon_mask_rules(spark):
    """Paint order with holes, multi-polygons, partial overlap and nesting, against the rules played on an array."""
    rng = np.random.default_rng(5)
    boxes = [(int(x), int(y), int(x + w), int(y + h)) for x, y, w, h in zip(*(rng.integers(0, 14, 25), rng.integers(0, 14, 25), rng.integers(1, 6, 25), rng.integers(1, 6, 25)))]
    boxes += [(1, 1, 18, 18), (3, 3, 6, 6), (4, 4, 5, 5)]
    kinds = ["hole" if i % 6 == 5 else "many" if i % 11 == 7 else "cell" for i in range(len(boxes))]
    want = np.zeros((20, 20), int)
    index = 1
    for (x0, y0, x1, y1), kind in zip(boxes, kinds):
        img = np.zeros((20, 20), bool)
        img[y0:y1, x0:x1] = True
        if kind != "cell":
            want[img] = kind == "many"
            continue
        if (want[img] == 0).any():
            img &= want == 0
        want[img] = index
        index += 1
    rows = [("r", i, k, k == "many", [(float(x), float(y)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]) for i, ((x0, y0, x1, y1), k) in enumerate(zip(boxes, kinds))]
    df = spark.createDataFrame(rows, f"roi string, seq bigint, classification string, many boolean, vertices {VERTICES}")
    got = np.zeros((20, 20), int)
    for r in po.mask_from_polygons(df, extent_of(spark, {"r": (20, 20)}), ("hole",)).collect():
        got[r.y, r.x] = r.object_id
    assert np.array_equal(got, want)


def test_blend_sums(spark):
    arrays = {("r", f"c{i}"): np.full((4, 4), v) for i, v in enumerate((3, 6, 9))}
    white = spark.createDataFrame([(f"c{i}", "#FFFFFF", None, None) for i in range(3)],
                                  "channel string, color string, x_lower_bound double, x_upper_bound double")
    assert {(p.r, p.g, p.b) for p in ra.blend(pixels_of(spark, arrays), white).collect()} == {(18, 18, 18)}
    bright = {k: a * 0 + 200 for k, a in arrays.items()}
    assert {p.r for p in ra.blend(pixels_of(spark, bright), white).collect()} == {255}
    assert {p.r for p in ra.blend(pixels_of(spark, bright), white, clip=False).collect()} == {600}


def test_marker_correlation_logic(spark):
    mask = np.zeros((6, 6), int)
    mask[1:3, 1:3], mask[4:6, 4:6] = 1, 2
    labels = spark.createDataFrame([("r", y, x, int(v)) for (y, x), v in np.ndenumerate(mask)], "roi string, y int, x int, object_id bigint")
    apart = {("r", "t"): (mask == 1) * 1000, ("r", "b"): (mask > 1) * 1000}
    r = ra.marker_correlation(pixels_of(spark, apart), "t", "b", labels).first()
    assert (r.target_in_mask, r.overlap_in_mask, r.baseline_in_mask) == (1.0, 0.0, 1.0)
    same = {("r", "t"): (mask > 0) * 1000, ("r", "b"): (mask > 0) * 1000}
    r = ra.marker_correlation(pixels_of(spark, same), "t", "b", labels).first()
    assert r.target_in_mask == r.overlap_in_mask == r.baseline_in_mask == 1.0 and abs(r.pearson - 1) < 1e-12
    window = ra.crop_pixels(pixels_of(spark, same), 0, 1, 0, 6)
    assert ra.marker_correlation(window, "t", "b", labels).first().target_in_mask is None


def test_upper_bound_floor(spark):
    zeros = pixels_of(spark, {("r", "c"): np.zeros((8, 8))})
    assert ra.channel_upper_bound(zeros).first().upper_bound == 1.0
    assert ra.approx_upper_bound(zeros).first().upper_bound == 1.0


def test_panel_mismatch(spark):
    two = pixels_of(spark, {("a", "c1"): np.ones((2, 2)), ("b", "c1"): np.ones((2, 2)), ("b", "c2"): np.ones((2, 2))})
    assert not ra.panel_sizes(two).first().panel_matches
    with pytest.raises(Exception, match="panel lengths"):
        ra.validate_panel(two).collect()
    assert ra.validate_panel(two.where("channel = 'c1'")).count() == 8


def test_presets_keep_colours(spark):
    params = spark.createDataFrame([("c", "#FFFFFF", None, None)], "channel string, color string, x_lower_bound double, x_upper_bound double")
    r = ra.preset_params(params, {"color": "#FF00FF", "x_lower_bound": 1, "x_upper_bound": 100}).first()
    assert (r.color, r.x_lower_bound, r.x_upper_bound) == ("#FFFFFF", 1.0, 100.0)


def test_window_recentre(spark):
    w = spark.range(1).select(recentre_window(F.lit(100), F.lit(200), F.lit(200), F.lit(100), F.lit(500), F.lit(500)).alias("w")).first().w
    assert (w.x_low, w.x_high, w.y_low, w.y_high) == (450.0, 550.0, 450.0, 550.0)


def test_gradients():
    assert gradient_table("blue_gold")[0] == (0, 0, 0) and gradient_table("blue_gold")[255] == (255, 215, 0)
    assert len(gradient_table("rainbow")) == 256
    with pytest.raises(ValueError):
        gradient_table("unknown")


def test_skewed_image(spark):
    """One image holding most pixels gives the same statistics as numpy."""
    rng = np.random.default_rng(9)
    arrays = {("hot", "c"): rng.random((120, 120)), **{(f"r{i}", "c"): rng.random((5, 5)) for i in range(20)}}
    pix = pixels_of(spark, arrays)
    bounds = {r.roi: r.upper_bound for r in ra.channel_upper_bound(pix).collect()}
    for (roi, _), a in arrays.items():
        assert abs(bounds[roi] - np.percentile(a, 99)) < 1e-12


def test_a_long_chain_of_polygons(spark):
    """A thousand polygons, each over the one before: what an earlier one labelled stays, and no round is needed for each."""
    square = lambda i: [(float(i), 0.0), (i + 5.0, 0.0), (i + 5.0, 2.0), (float(i), 2.0)]
    df = spark.createDataFrame([("r", i, "cell", square(i)) for i in range(1000)], f"roi string, seq bigint, classification string, vertices {VERTICES}")
    got = {(r.y, r.x): r.object_id for r in po.mask_from_polygons(df, extent_of(spark, {"r": (3, 1004)})).collect()}
    assert got == {(y, x): max(0, x - 4) + 1 for y in range(2) for x in range(1004)}


def test_hot_pixels_of_sparse_pixels(spark):
    """Stored sparsely, regions give the same numbers as densely, and those without a stored pixel give 0."""
    a = np.zeros((40, 40))
    a[3, 4], a[11, 17], a[30, 9] = 7, 40, 5
    ext, dense = extent_of(spark, {"r": (40, 40)}), pixels_of(spark, {("r", "c"): a, ("r", "d"): a.T * 2})
    rects = spark.createDataFrame(
        [(1, "r", 0, 9, 0, 9), (2, "r", 30, 38, 30, 44), (3, "r", 5, 20, 8, 35), (4, "r", 50, 60, 1, 5)],
        "region int, roi string, x_min int, x_max int, y_min int, y_max int")
    paths = spark.createDataFrame([(1, "r", "M0,0L9,0L9,9Z"), (2, "r", "M30,30L38,30L38,45Z"), (3, "r", PATH)], "region int, roi string, path string")
    for work, shapes in ((st.hot_pixel_diff_of_rectangles, rects), (st.hot_pixel_diff_of_paths, paths)):
        rows = lambda df: sorted(map(tuple, df.select("region", "channel", "hpf").collect()))
        want = rows(work(dense, shapes, ext, 3))
        assert rows(work(ra.sparsify(dense), shapes, ext, 3, channels=["c", "d"])) == want and any(r[2] == 0 for r in want)


def test_tiles_are_filtered_together(spark, monkeypatch):
    """A call of the filter takes all tiles of one shape that lie at hand, however many groups they belong to."""
    own = np.random.default_rng(3).integers(0, 50, (40, 20, 20))
    calls = []

    def work(blocks, pads):
        calls.append(len(blocks))
        return np.arange(len(blocks)), {"s": blocks.sum(axis=(1, 2))}

    rows = {c: v.ravel() for c, v in zip(("k", "y", "x"), np.indices(own.shape))}
    rows |= {"value": own.ravel(), "height": np.full(own.size, 20), "width": np.full(own.size, 20), "_ty": np.zeros(own.size, int), "_tx": np.zeros(own.size, int)}
    for block, pads, tiles, _, _ in st._stacks(rows, st._starts(rows, ["k"]), 0, 0, 32):
        at, found = work(block, pads)
        assert (found["s"] == own.sum(axis=(1, 2))[tiles[at]]).all()
    assert calls == [40]


def test_statistics_of_small_and_large_regions_agree(spark, monkeypatch):
    """Values below, at and above 0, NaN and NULL, with absent pixels and without, by both ways."""
    rows = [(1, float(v)) for v in (-3, -1, 4, 7)] + [(2, 0.0), (2, 5.0), (2, -2.5)] + [(3, float("nan")), (3, 1.0)] + [(4, None), (4, 2.0), (4, 6.0)] + [(5, 9.0)]
    pixels = spark.createDataFrame([(r, "c", v) for r, v in rows], "region int, channel string, value double")
    areas = spark.createDataFrame([(1, "c", 4), (2, "c", 6), (3, "c", 2), (4, "c", 3), (5, "c", 8), (6, "c", 2)], "region int, channel string, area bigint")
    found = []
    for limit in (100, 3, 0):
        monkeypatch.setattr(ra, "SMALL_REGION", limit)
        table = ra.region_statistics(pixels, 9, areas)
        found.append(sorted((str(tuple(r)) for r in table.collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == 6
    one = {r.region: r for r in ra.region_statistics(pixels, 9, areas).collect()}
    assert one[1].Median == 1.5 and one[2].Median == 0.0 and one[4].Median == 4.0 and one[6].Total == 0.0


def test_lines_keep_pixels_given_twice_and_drop_those_outside(spark):
    pixels = spark.createDataFrame(
        [("r", "c", 0, 1, 5), ("r", "c", 0, 1, 6), ("r", "c", 0, 299, 7), ("r", "c", 0, 300, 8), ("r", "c", 2, 0, 9), ("r", "d", 0, 0, 4), ("r", "c", 1, 0, None)],
        "roi string, channel string, y int, x int, value bigint")
    extent = spark.createDataFrame([("r", 300, 2)], "roi string, width int, height int")
    got = ra.densify(pixels, extent, ["c"]).collect()
    stored = sorted((r.y, r.x, r.value) for r in got if r.value)
    assert len(got) == 601 and stored == [(0, 1, 5), (0, 1, 6), (0, 299, 7)] and len({(r.y, r.x) for r in got}) == 600


def test_polygon_masks_exchange_steps_once(spark):
    """What the windows find is written once; the plan behind it exchanges verdicts and owners only."""
    from rastrel.operators import polygons as po

    runs = spark.createDataFrame(
        [(1, k, 0, 0, 9, k % 3 == 1, k, False) for k in range(4)], "roi long, seq long, y int, x0 int, x1 int, hole boolean, feature long, many boolean")
    painted = po._painted(runs)
    plan = painted._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Join") == 1
    assert [(r.x0, r.x1, r.object_id) for r in painted.collect()] == [(0, 9, 3)]


def test_blend_is_written_before_its_filter(spark):
    """The filter of the whole image starts from the written blend, so the shuffles of the channels are gone by then."""
    from rastrel.operators import display as di

    pixels = spark.createDataFrame([(1, c, y, x, float(y + x)) for c in "AB" for y in range(4) for x in range(4)], "roi long, channel string, y int, x int, value double")
    extent = spark.createDataFrame([(1, 4, 4)], "roi long, width int, height int")
    rows = [(c, 0.0, 6.0, h, [w * 1.0 for w in ws], None, None, None) for c, h, ws in (("A", "#ff0000", (1, 0, 0)), ("B", "#0000ff", (0, 0, 1)))]
    names = "channel string, x_lower_bound double, x_upper_bound double, color string, weights array<double>, filter_type string, filter_val double, filter_sigma double"
    plan = di.blend_filtered(pixels, extent, spark.createDataFrame(rows, names), "median", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan and plan.count("LogicalRDD") <= 1
