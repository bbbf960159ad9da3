from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from rastrel.llm import sharding
from rastrel.llm.queries import QUERIES


def test_rows_law_on_the_table(spark, sf):
    rows = QUERIES["op7_hypergeometric_shards"](spark, sf).toPandas()
    total = spark.read.parquet(f"{sf}/documents.parquet").count()
    sizes = rows.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert len(rows) == total and len(sizes) == 16 and sizes["count"].max() - sizes["count"].min() <= 1
    assert (sizes["min"] == 0).all() and (sizes["max"] == sizes["count"] - 1).all() and (sizes["nunique"] == sizes["count"]).all()


@pytest.mark.parametrize("cells", [1, 3, 10_000])
def test_edges_keep_every_row(edge_docs, cells):
    rows = sharding.shard(edge_docs, 4, rows_per_cell=cells).select("row.doc_id", "row.shard", "shard", "slot").collect()
    assert Counter(r[0] for r in rows) == Counter(r["doc_id"] for r in edge_docs.collect())
    for s in range(4):
        slots = sorted(r[3] for r in rows if r[2] == s)
        assert slots == list(range(13 // 4 + (s < 13 % 4)))


def test_empty_table(no_docs):
    assert sharding.shard(no_docs).count() == 0


def test_matrix_has_its_margins():
    matrix = np.array(sharding.communication_matrix([5, 0, 1000, 17], [256, 256, 255, 255], 3))
    assert matrix.sum(1).tolist() == [5, 0, 1000, 17] and matrix.sum(0).tolist() == [256, 256, 255, 255] and (matrix >= 0).all()


def test_draws_follow_the_law():
    rng = np.random.default_rng(1)
    drawn = Counter(sharding.hypergeometric(rng, 4, 6, 3) for _ in range(20_000))
    want = {0: 20 / 120, 1: 60 / 120, 2: 36 / 120, 3: 4 / 120}
    assert set(drawn) == set(want) and all(abs(drawn[k] / 20_000 - p) < 0.02 for k, p in want.items())
    large = sharding.hypergeometric(rng, 10**12, 3 * 10**12, 10**6)
    assert abs(large - 250_000) < 5_000


def test_uniform_over_seeds(spark):
    df = spark.range(12).repartition(3)
    seen = Counter()
    for seed in range(12):
        for r in sharding.shard(df, 3, seed=seed).select("row.id", "shard").collect():
            seen[r["shard"], r["id"] < 4] += 1
    assert all(sum(v for (s, _), v in seen.items() if s == k) == 48 for k in range(3))
    assert all(seen[k, True] > 4 for k in range(3))
