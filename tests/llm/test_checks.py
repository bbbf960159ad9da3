"""Registered queries against their SQL, and what all queries must hold."""

from __future__ import annotations

import pytest
from compare import difference, duck

from rastrel.llm.queries import CHECKS, QUERIES


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_agrees(spark, sf, name):
    assert difference(QUERIES[name](spark, sf), duck(sf), CHECKS[name]) is None


def test_all_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
