"""Exact duplicates by block naming against plain comparison of the texts."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from rastrel.llm import block_naming


def plain(text):
    return (text or "").encode().lower()


def slow(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(plain(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[plain(t)]
        out.append((i, max((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(plain(t)).hexdigest()))
    return sorted(out, key=str), len(groups)


@pytest.mark.parametrize("size", [1, 7, 64, 1024])
def test_edges(spark, edge_docs, no_docs, size):
    docs = edge_docs.filter("doc_id IS DISTINCT FROM 7") if size < 64 else edge_docs
    out = block_naming.duplicates(docs, size).collect()
    rows, groups = slow([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.sha) for r in out), key=str) == rows
    kept = [r for r in out if r.kept]
    assert len(kept) == groups and all(r.doc_id == r.keep_id for r in kept)
    assert block_naming.duplicates(no_docs, size).count() == 0


def test_texts_that_share_blocks(spark):
    """Texts of the same blocks in another order, number or case, and with a shared beginning or end."""
    texts = ["abab", "ABab", "baba", "ab", "aba", "abababab", "", "a", "éab", "Éab", "abé", "ababab", "aB" * 100, "ab" * 100, "ab" * 99 + "b"]
    rows = [(k, t) for k, t in enumerate(texts * 3)]
    out = block_naming.duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.sha) for r in out), key=str) == slow(rows)[0]


def test_a_hot_block_spans_partitions(spark):
    """Copies of one text are spread over partitions and still share a name; names are dense."""
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 != 0, F.lit("same text")).otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    docs = rows.withColumnRenamed("id", "doc_id").repartition(6)
    cut = block_naming.blocks(docs, 4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = block_naming.named(cut, ("h", "block"), ("h", "rid"), "names").join(cut.select("rid", "pos", "block"), ["rid", "pos"]).select("name", "block").distinct().collect()
        out = block_naming.duplicates(docs, 4)
        sizes = {r.group_size: r["count"] for r in out.groupBy("group_size").count().collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.name for r in found}) == len({bytes(r.block) for r in found}) == len(found)
    assert {r.name for r in found} == set(range(len(found)))
    assert sizes == {2000: 2000, 1: 1000} and out.filter("kept").count() == 1001


def test_a_cut_inside_a_shared_hash_is_noticed(spark):
    """Two blocks under one hash: named apart where the hash lies in one partition, refused where a cut falls into it."""
    rows = spark.range(400).select("id", F.lit(5).cast("long").alias("h"), F.concat(F.lit("b"), F.col("id") % 2).cast("binary").alias("block"))
    rows = rows.select(F.col("id").alias("rid"), F.lit(0).cast("long").alias("pos"), "h", "block")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert block_naming.named(rows.repartition(4), ("h", "block"), ("h", "rid"), "names") is None
        one = block_naming.named(rows.withColumn("h", F.conv(F.hex("block"), 16, 10).cast("long")), ("h", "block"), ("h", "rid"), "names")
        assert sorted(r.name for r in one.select("name").distinct().collect()) == [0, 1]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
