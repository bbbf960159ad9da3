from __future__ import annotations

import random
from collections import defaultdict

import pytest

from rastrel.llm import fixity


def slow(rows) -> set[tuple]:
    at = defaultdict(lambda: ([], []))
    for copy, file, offset, length, digest in rows:
        if file is not None and offset is not None:
            at[file, offset][copy].append((length or 0, digest or ""))
    out = set()
    for (file, offset), (a, b) in at.items():
        if sorted(a) != sorted(b):
            text = lambda x: ",".join(d for _, d in sorted(x)) if x else None
            out.add((file, offset, "lost" if not b else "extra" if not a else "changed", text(a), text(b), sorted(a or b)[0][0]))
    return out


SCHEMA = "copy int, file long, offset long, length long, digest string"


@pytest.mark.parametrize(("leaf", "fanout"), [(100, 2), (1000, 16), (1 << 20, 4)])
def test_against_comparing_all(spark, leaf, fanout):
    rng = random.Random(leaf)
    rows, found = [], []
    for file in range(6):
        at = 0
        for k in range(rng.choice([0, 1, 50, 400])):
            n = rng.randint(1, 300)
            rows.append((0, file, at, n, f"d{k}"))
            at += n
        for r in [r for r in rows if r[1] == file]:
            x = rng.random()
            if x < 0.01:
                found.append((1, file, r[2], r[3], "bad"))
            elif x < 0.02:
                found.append((1, file, r[2], r[3] + 1, r[4]))
            elif x > 0.03:
                found.append((1, *r[1:]))
    found.append((1, 77, 5, 5, "extra"))
    rows += found + [(0, None, 1, 1, "x"), (0, 1, None, 1, "x"), (0, 2, 10**7, None, None), (1, 2, 10**7, None, None), (0, 3, 7, 1, "twice"), (0, 3, 7, 1, "twice"), (1, 3, 7, 1, "twice")]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", i string")
    got = [tuple(r) for r in fixity.audit(df, leaf, fanout).collect()]
    assert set(got) == slow(rows) and len(got) == len(set(got))


def test_empty_and_equal_replicas(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert fixity.audit(none).count() == 0
    one = spark.createDataFrame([(c, 1, k * 10, 10, str(k)) for c in (0, 1) for k in range(2000)], SCHEMA)
    assert fixity.audit(one, 64, 4).count() == 0
    assert fixity.audit(one.filter("copy = 0"), 64, 4).filter("damage = 'lost'").count() == 2000


def test_layout(spark):
    df = spark.createDataFrame([(k % 7 if k % 5 else None, k, 10 + k) for k in range(100)], "page_id long, k long, length long").repartition(3)
    rows = sorted(fixity.laid_out(df, "page_id", 8).collect(), key=lambda r: (r["file"], r["offset"]))
    assert len(rows) == 100 and [r["file"] for r in rows] == [k // 8 for k in range(100)]
    ids = [r["page_id"] for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    for a, b in zip(rows, rows[1:], strict=False):
        assert b["offset"] == (a["offset"] + a["length"] if a["file"] == b["file"] else 0)


def test_null_pages(spark):
    df = spark.createDataFrame([(None, None, None), (1, None, "x"), (7, "u", None), (9, "u", "x"), (7 + 101, "u", "é")], "page_id long, url string, html string")
    got = {(r["file"], r["damage"]) for r in fixity.audit(fixity.damaged_replica(df)).collect()}
    assert got == {(0, "changed"), (0, "lost")}
