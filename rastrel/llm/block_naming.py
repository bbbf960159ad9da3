"""Exact duplicates by deterministic naming of blocks.

Normalised texts are cut into blocks of a fixed number of bytes. All blocks are sorted, and equal ones get the same integer: their place
among the distinct blocks. Neighbouring names are then paired, the pairs are sorted and named in the same way, and so on; after about
log2(blocks) rounds each text has one name. Names are places in an order, not hashes, so two texts share a name exactly if they are equal.

The order is made by one range exchange. Its cuts use the row's number too, so copies of one block, however many, are spread over
neighbouring partitions; there, a partition that begins with the block its forerunner ends with goes on with that name. Blocks are
ordered by a hash first and by their bytes within it: the sampled cuts then hold sixteen bytes each, not a block. Only if a cut falls
into a hash that two different blocks share, the step is repeated with another seed. Each round is a written table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastrel.llm.common import written

#: Bytes of a block.
BLOCK = 1024
#: Blocks that leave the worker at once.
STEP = 8192
#: Groups over this share of all rows meet their rows by broadcast; there can't be more of them than its inverse.
HOT = 0.001


def _slices(batch: pa.RecordBatch, size: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Columns rid, doc_id, text to rows (rid, pos, n, doc_id, sha, h, block); doc_id and sha stand in the first row of a text only."""
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        row, pos, n, sha, h, block = zip(*out, strict=True)
        first = pa.array([r if p == 0 else None for r, p in zip(row, pos, strict=True)], pa.int32())
        return pa.record_batch(
            [batch.column(0).take(pa.array(row, pa.int32())), pa.array(pos, pa.int64()), pa.array(n, pa.int64()), batch.column(1).take(first),
             pa.array(sha, pa.string()), pa.array(h, pa.int64()), pa.array(block, pa.binary())],
            names=["rid", "pos", "n", "doc_id", "sha", "h", "block"])

    for r, text in enumerate(batch.column(2)):
        data = text.as_buffer().to_pybytes().lower()  # of bytes: A-Z only
        n = max(1, -(-len(data) // size))
        for k in range(n):
            block = data[k * size : (k + 1) * size]
            out.append((r, k, n, hashlib.sha256(data).hexdigest() if k == 0 else None, xxhash.xxh64_intdigest(block, seed) - (1 << 63), block))
            if len(out) >= STEP:
                yield flush()
                out = []
    if out:
        yield flush()


def blocks(docs: DataFrame, size: int = BLOCK, seed: int = 0) -> DataFrame:
    """Blocks of the normalised texts; ``rid`` is the row's number in the scan, a null text counts as empty and has one empty block."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _slices(batch, size, seed)

    return rows.mapInArrow(run, f"rid long, pos long, n long, doc_id {dict(docs.dtypes)['doc_id']}, sha string, h long, block binary")


def _ranks(key: Sequence[str], hashed: bool):
    """Adds ``rank`` among the distinct keys of the sorted partition, and ``side``: 1 for its first row, 2 for its last, 4 for a key
    with the same hash as another key before it. Keys themselves are kept for such rows only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, rank, held = None, 0, None

        def out(batch: pa.RecordBatch, ranks: np.ndarray, sides: np.ndarray) -> pa.RecordBatch:
            marked = pa.array(np.arange(len(sides)), mask=sides == 0)
            columns = [c.take(marked) if n in key else c for n, c in zip(batch.schema.names, batch.columns, strict=True)]
            return pa.record_batch([*columns, pa.array(ranks), pa.array(sides)], names=[*batch.schema.names, "rank", "side"])

        for batch in batches:
            if not batch.num_rows:
                continue
            same = {}
            for k in key:
                c = batch.column(batch.schema.get_field_index(k))
                inner = pc.equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
                same[k] = np.r_[before is not None and before[k] == c[0].as_py(), inner]
            new = ~np.logical_and.reduce([same[k] for k in key])
            ranks = rank + np.cumsum(new) - (before is None)
            sides = np.where(new & same[key[0]] & hashed, 4, 0).astype(np.int32)
            sides[0] |= before is None
            if held is not None:
                yield out(*held)
            if batch.num_rows > 1:
                yield out(batch.slice(0, batch.num_rows - 1), ranks[:-1], sides[:-1])
            held = batch.take(pa.array([batch.num_rows - 1])), ranks[-1:], sides[-1:]
            rank = int(ranks[-1])
            before = {k: held[0].column(batch.schema.get_field_index(k))[0].as_py() for k in key}
        if held is not None:
            yield out(held[0], held[1], held[2] | 2)

    return run


def named(rows: DataFrame, key: Sequence[str], cut: Sequence[str], what: str) -> DataFrame | None:
    """Replaces the columns ``key`` by ``name``, the place of the key among all distinct keys, from 0 without gaps.

    ``cut`` holds the key, or the hash it begins with, and then the row's number. None if a cut falls into a hash of two keys.
    """
    hashed = len(cut) <= len(key)
    laid = rows.repartitionByRange(*cut).sortWithinPartitions(*key).withColumn("p", F.spark_partition_id())
    kinds = {f.name: f.dataType.simpleString() for f in laid.schema}
    table = written(laid.mapInArrow(_ranks(key, hashed), ", ".join(f"{n} {t}" for n, t in kinds.items()) + ", rank long, side int"), what)
    # two rows for each partition, and the few keys that share a hash
    edges: dict[int, dict[int, tuple]] = {}
    shared = set()
    for r in table.filter("side > 0").select("p", "side", "rank", *key).collect():
        values = tuple(r[k] for k in key)
        if r.side & 4:
            shared.add(values[0])
        for s in (1, 2):
            if r.side & s:
                edges.setdefault(r.p, {})[s] = (values, r.rank)
    offsets, start, last = [], 0, None
    for p in sorted(edges):
        first = edges[p][1][0]
        if last is not None and first[0] == last[0] and first[0] in shared:
            return None
        start -= first == last
        offsets.append((p, start))
        last, highest = edges[p][2]
        start += highest + 1
    small = rows.sparkSession.createDataFrame(offsets, "p int, start long")
    rest = [c for c in rows.columns if c not in key]
    return table.join(F.broadcast(small), "p").select(*rest, (F.col("start") + F.col("rank")).alias("name"))


def identities(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """(rid, doc_id, sha, level, name) for every row; equal (level, name) are equal normalised texts, and the other way round.

    ``sha`` is the SHA-256 of the normalised text. A null text counts as empty; repeated rows are rows of their own. An empty table gives an
    empty result. Only doc_id and text are read. Very long texts take more rounds, one for each doubling.
    """
    for seed in count():
        now = named(blocks(docs, size, seed), ("h", "block"), ("h", "rid"), "names")
        if now is not None:
            break
    facts = now.filter("pos = 0").select("rid", "doc_id", "sha")
    longest = now.agg(F.max("n")).first()[0] or 1
    now, found, level = now.select("rid", "pos", "n", "name"), None, 0
    while True:
        done = now.filter("n = 1").select("rid", F.lit(level).alias("level"), "name")
        found = done if found is None else found.union(done)
        if longest == 1:
            break
        even = F.col("pos") % 2 == 0
        pairs = now.filter("n > 1").groupBy("rid", F.shiftright("pos", 1).alias("pos")).agg(
            F.max(F.shiftright(F.col("n") + 1, 1)).alias("n"), F.max(F.when(even, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"))
        now = named(pairs, ("a", "b"), ("a", "b", "rid"), "names").select("rid", "pos", "n", "name")
        longest, level = -(-longest // 2), level + 1
    return facts.join(found, "rid")


def duplicates(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """(rid, doc_id, sha, keep_id, group_size, kept) for every row: of equal normalised texts the row with the largest doc_id stays.

    Null doc_ids come last; of rows that share the largest doc_id the first in the scan stays. See ``identities`` for the rest.
    """
    rows = written(identities(docs, size), "identities")
    best = F.max(F.struct("doc_id", (-F.col("rid")).alias("r")))
    groups = written(rows.groupBy("level", "name").agg(F.count("*").alias("group_size"), best.alias("best")).filter("group_size > 1"), "groups")
    total = rows.count()
    large = groups.filter(F.col("group_size") > HOT * total)
    near = rows.join(F.broadcast(large), ["level", "name"], "left")
    far = near.filter("group_size IS NULL").drop("group_size", "best").join(groups.filter(F.col("group_size") <= HOT * total), ["level", "name"], "left")
    both = near.filter("group_size IS NOT NULL").unionByName(far)
    return both.select(
        "rid", "doc_id", "sha", F.when(F.col("group_size") > 1, F.col("best.doc_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("best.r") == -F.col("rid"), F.lit(True)).alias("kept"))


#: The same rows in DuckDB, for the query's columns.
SQL = """
WITH d AS MATERIALIZED (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS plain, row_number() OVER () AS r FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY plain ORDER BY doc_id DESC NULLS LAST, r) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY plain)
"""
