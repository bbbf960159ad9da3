"""Every registered query against its check SQL on the smallest tables."""

from __future__ import annotations

import pytest
from compare import difference, duck

from rastrel.queries import CHECKS, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


# drawn out over the largest canvases; compared by tests/compare.py
SLOW = {"rasterize_spots", "spot_mask"}


@pytest.mark.parametrize("name", sorted(set(CHECKS) - SLOW))
def test_query_agrees(spark, sf, con, name):
    assert difference(QUERIES[name](spark, sf), con, CHECKS[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_query_runs(spark, sf, name):
    assert len(QUERIES[name](spark, sf).collect()) > 0


def test_check_names_are_queries():
    assert set(CHECKS) <= set(QUERIES)
