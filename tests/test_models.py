"""Neighbour graphs of the embeddings against brute force over all their components."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from rastrel.operators import models as mo
from rastrel.queries import QUERIES


@pytest.fixture(scope="module")
def graph(spark, sf):
    """Both directions of the edges to the ten nearest of each vector."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    ids, v = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float)
    square = ((v[:, None] - v[None]) ** 2).sum(2)
    np.fill_diagonal(square, np.inf)
    edges = {(ids[a], ids[b]) for a, row in enumerate(square) for b in np.argsort(row, kind="stable")[:10]}
    near: dict[int, list[int]] = {i: [] for i in ids}
    for a, b in edges | {(b, a) for a, b in edges}:
        near[a].append(b)
    return near


@pytest.fixture(scope="module")
def labels(graph):
    found = {i: i for i in graph}
    for _ in range(10):
        heard = {a: Counter(found[b] for b in near) for a, near in graph.items()}
        following = {a: max(c, key=lambda x, a=a, c=c: (c[x], x == found[a], -x)) for a, c in heard.items()}
        if following == found:
            break
        found = following
    return found


def test_communities_of_whole_vectors(spark, sf, labels):
    got = {r["cell_id"]: r["community"] for r in QUERIES["knn_communities"](spark, sf).collect()}
    assert got == {i: str(x) for i, x in labels.items()}


def test_modularity_of_whole_vectors(spark, sf, graph, labels):
    m = sum(map(len, graph.values()))
    degree, within = Counter(), Counter()
    for a, near in graph.items():
        degree[labels[a]] += len(near)
        within[labels[a]] += sum(labels[b] == labels[a] for b in near)
    want = sum(within[x] / m - (degree[x] / m) ** 2 for x in degree)
    assert QUERIES["community_modularity"](spark, sf).first()["modularity"] == pytest.approx(want, abs=1e-9)


def boosted(spark, rounds, **options):
    rows = [(f"s{i % 4}", i, float((i * 37) % 101), float((i * 53) % 89), "Unassigned" if i % 4 == 3 else "ab"[(i * 37) % 101 > 50] + "cd"[(i * 53) % 89 > 40])
            for i in range(400)]
    df = spark.createDataFrame(rows, "sample string, cell_id long, ch1 double, ch2 double, label string").select("ch1", "ch2", "sample", "cell_id", "label")
    return df, mo.adaboost_labels(df, "label", "out", ["ch1", "ch2"], rounds=rounds, n_estimators=1, **options)


def test_boosting_plan_does_not_grow(spark):
    """Stumps can't tell four classes apart, boosted stumps do so better; the result's plan stays as long."""
    plans, right = [], []
    for rounds in (1, 8):
        df, out = boosted(spark, rounds, max_depth=1)
        assert out.columns == [*df.columns, "out"] and out.count() == 400
        plans.append(len(out._jdf.queryExecution().optimizedPlan().toString().split("\n")))
        truth = [("ab"[(r["cell_id"] * 37) % 101 > 50] + "cd"[(r["cell_id"] * 53) % 89 > 40], r["out"]) for r in out.where("sample <> 's3'").collect()]
        right.append(sum(a == b for a, b in truth) / len(truth))
    assert plans[0] == plans[1]
    assert right[1] >= right[0]


def test_boosting_labels_images_without_labels(spark):
    """Images that carry no label of their own are not trained on, and get labels all the same."""
    _, out = boosted(spark, 3, max_depth=6)
    rows = out.where("sample = 's3'").collect()
    truth = ["ab"[(r["cell_id"] * 37) % 101 > 50] + "cd"[(r["cell_id"] * 53) % 89 > 40] for r in rows]
    assert len(rows) == 100 and sum(r["out"] == t for r, t in zip(rows, truth, strict=True)) >= 90
