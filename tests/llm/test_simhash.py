from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from rastrel.llm import simhash
from rastrel.llm.queries import QUERIES


def slow_fingerprint(text: str | None) -> int:
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    parts = [w for w in words.split(" ") if w]
    shingles = [" ".join(parts[k : k + 4]) for k in range(max(1, len(parts) - 3))] if parts else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum((2 * sum(h >> k & 1 for h in hashes) > len(hashes)) << k for k in range(64))


def slow_components(marks: list[int], distance: int) -> dict[int, int]:
    root = {m: m for m in marks}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= distance:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {m: find(m) for m in root}


def expected(rows) -> list:
    marks = [slow_fingerprint(r["text"]) for r in rows]
    roots = slow_components(marks, 4)
    least = {}
    for r, m in zip(rows, marks, strict=True):
        if r["doc_id"] is not None:
            least[roots[m]] = min(r["doc_id"], least.get(roots[m], r["doc_id"]))
    return sorted(((r["doc_id"], f"{m:016x}", least.get(roots[m])) for r, m in zip(rows, marks, strict=True)), key=str)


def test_table_against_all_pairs(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert sorted(map(tuple, QUERIES["op9_simhash_components"](spark, sf).collect()), key=str) == expected(rows)


def test_edges(edge_docs, no_docs):
    got = simhash.component_ids(simhash.near_duplicates(edge_docs)).collect()
    assert sorted(map(tuple, got), key=str) == expected(edge_docs.collect())
    assert simhash.component_ids(simhash.near_duplicates(no_docs)).count() == 0


def test_spark_hash_is_the_same(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("the cat sat on")).alias("h")).first()
    assert row["h"] % 2**64 == xxhash.xxh64_intdigest(b"the cat sat on", seed=42)


def test_chains_and_dense_buckets(spark):
    rng = np.random.default_rng(5)
    marks = {0}
    centre = int(rng.integers(1 << 62))
    for _ in range(400):  # a dense group: few bits from one centre, and a chain away from it
        x = centre
        for k in rng.integers(0, 64, rng.integers(0, 6)):
            x ^= 1 << int(k)
        marks.add(x)
    x = int(rng.integers(1 << 62))
    for _ in range(30):
        for k in rng.choice(64, 4, replace=False):
            x ^= 1 << int(k)
        marks.add(x)
    marks |= {int(v) for v in rng.integers(0, 1 << 63, 300, dtype=np.uint64)}
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    df = spark.createDataFrame([(m,) for m in signed], "fp long").repartition(5)
    for chunk in (7, 4096):
        roots = {r["node"]: r["root"] for r in simhash.components(simhash.close_links(df, 4, chunk)).collect()}
        want = slow_components(list(marks), 4)
        groups, own = {}, {}
        for m, s in zip(marks, signed, strict=True):
            groups.setdefault(want[m], set()).add(s)
            own.setdefault(roots.get(s, s), set()).add(s)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, own.values()))


def test_keep_one_of_each(edge_docs, no_docs):
    kept = simhash.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    want = {}
    for r, (_, mark, component) in zip(sorted(edge_docs.collect(), key=lambda r: str((r["doc_id"], f"{slow_fingerprint(r['text']):016x}"))), expected(edge_docs.collect()), strict=True):
        want.setdefault(component if component is not None else mark, set()).add(r["doc_id"])
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(k for k in want if isinstance(k, int))
    assert kept.count() == len(want) and simhash.keep_one(no_docs).count() == 0


def test_long_text_in_steps(monkeypatch):
    text = " ".join(str(k % 977) for k in range(5000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "STEP", 100)
    assert simhash.fingerprint(text) == whole == np.uint64(slow_fingerprint(text.decode())).astype(np.int64)
