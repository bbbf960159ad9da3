"""Algebra of runs against sets of pixels."""

from __future__ import annotations

import random

import pytest

from rastrel.plans import runs as ru


def draw(seed, n):
    own = random.Random(seed)
    out = []
    for k in range(n):
        x0 = own.randrange(0, 700)
        out.append((own.choice("ab"), own.randrange(4), x0, x0 + own.choice([0, 1, 5, 90, 400]) - (1 if k % 17 == 0 else 0), k))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "roi string, y int, x0 int, x1 int, seq long")


def pixels(rows):
    return {(roi, y, x) for roi, y, x0, x1, *_ in rows for x in range(x0, x1 + 1)}


def once(df):
    """Runs as pixels, none of them twice."""
    rows = [tuple(r) for r in df.select("roi", "y", "x0", "x1").collect()]
    found = pixels(rows)
    assert len(found) == sum(x1 - x0 + 1 for _, _, x0, x1 in rows)
    return found


@pytest.mark.parametrize("stretch", [16, 256, 4096])
def test_sets(spark, stretch):
    a, b = draw(1, 120), draw(2, 80)
    fa, fb = frame(spark, a), frame(spark, b)
    assert once(ru.union_runs(fa, stretch=stretch)) == pixels(a)
    assert once(ru.intersect_runs(fa, fb, stretch=stretch)) == pixels(a) & pixels(b)
    assert once(ru.subtract_runs(fa, fb, stretch=stretch)) == pixels(a) - pixels(b)


def test_union_is_short(spark):
    rows = [("a", 0, 0, 3, 1), ("a", 0, 4, 9, 2), ("a", 0, 2, 5, 3), ("a", 0, 11, 12, 4), ("a", 1, 0, 0, 5), ("a", 0, 20, 19, 6)]
    got = sorted(tuple(r) for r in ru.union_runs(frame(spark, rows)).collect())
    assert got == [("a", 0, 0, 9), ("a", 0, 11, 12), ("a", 1, 0, 0)]
    assert {r.roi: r.pixels for r in ru.run_area(frame(spark, rows)).collect()} == {"a": 13}
    assert ru.union_runs(frame(spark, rows).where("seq > 9")).count() == 0


@pytest.mark.parametrize("stretch", [16, 256])
def test_last_wins(spark, stretch):
    rows = draw(3, 150)
    want = {}
    for roi, y, x0, x1, seq in rows:
        for x in range(x0, x1 + 1):
            want[roi, y, x] = max(seq, want.get((roi, y, x), -1))
    got = {}
    for r in ru.run_pixels(ru.last_wins(frame(spark, rows), "seq", stretch=stretch), "seq").collect():
        assert (r.roi, r.y, r.x) not in got
        got[r.roi, r.y, r.x] = r.seq
    assert got == want


def test_a_deep_stack(spark):
    """Many shapes over one place: rows follow the ends of runs."""
    rows = [("a", 0, k, 1000 - k, k) for k in range(400)]
    got = {(r.x0, r.x1): r.seq for r in ru.last_wins(frame(spark, rows), "seq").collect()}
    assert max(got.values()) == 399 and sum(x1 - x0 + 1 for x0, x1 in got) == 1001
