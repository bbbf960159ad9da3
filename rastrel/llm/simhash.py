"""SimHash near-duplicates: fingerprints by majority of shingle hashes, pigeonhole blocks, exact components.

Fingerprints are made in Arrow batches. Equal ones meet first, by aggregation, so copies cost one row. A fingerprint is cut into
six blocks; two that differ in four bits or fewer agree in two blocks at least, so every choice of two blocks is a join key of
21 or 22 bits. Fingerprints under one key are compared in cells of bounded size (a large bucket is dealt to pairs of chunks), and a
cell passes on a spanning forest of its links, never all its pairs. Components of the links follow by alternating stars; every
round is a written table, so nothing is collected and a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rastrel.llm.common import written

SHINGLE, SEED, BITS = 4, 42, 4
#: A bucket is compared in chunks of about this many fingerprints.
CHUNK = 4096
#: Shingles whose bits are counted at once.
STEP = 1 << 16


def blocks(distance: int = BITS, spare: int = 2) -> list[int]:
    """Masks of all choices of ``spare`` blocks out of distance + spare: close pairs agree on one mask at least."""
    edges = np.linspace(0, 64, distance + spare + 1).round().astype(int)
    parts = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [int(np.array(sum(c), dtype=np.uint64).view(np.int64)) for c in combinations(parts, spare)]


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """64 bits, each set if set in over half the shingles' hashes; 0 without words."""
    words = text.lower().split()  # of bytes: A-Z, and the white space \x20 \x09-\x0D
    if not words:
        return 0
    size = min(size, len(words))
    joined = memoryview(b" ".join(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1]
    ends = ends[size - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), STEP):
        ones += np.unpackbits(hashes[k : k + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, two non-null 64-bit keys of (doc_id, text), and the fingerprint; a null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("k2"), text.cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = pa.array([fingerprint(t.as_buffer().to_pybytes(), size) for t in batch.column(3)], pa.int64())
            yield pa.record_batch([*batch.columns[:3], marks], names=["doc_id", "k1", "k2", "fp"])

    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, k1 long, k2 long, fp long")


def forest(marks: np.ndarray, distance: int) -> list[tuple[int, np.ndarray]]:
    """A spanning forest of the links among distinct fingerprints: (one end, its other ends)."""
    out, rest = [], marks
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            close = np.bitwise_count(rest ^ x) <= distance
            if close.any():
                out.append((x, rest[close]))
                todo.extend(rest[close])
                rest = rest[~close]
    return out


def _cells(distance: int):
    """Links of each cell; rows of a cell follow each other, and the last cell of a batch waits for the next batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(columns: list[np.ndarray], last: bool):
            change = np.zeros(len(columns[0]) + 1, bool)
            change[0] = change[-1] = True
            for c in columns[:-1]:
                change[1:-1] |= c[1:] != c[:-1]
            edges = np.flatnonzero(change)
            if not last:
                edges = edges[:-1]
            marks = columns[-1].astype(np.uint64)
            sizes = np.diff(edges)
            two = edges[:-1][sizes == 2]
            two = two[np.bitwise_count(marks[two] ^ marks[two + 1]) <= distance]
            found = [(marks[two], marks[two + 1])]
            for k in np.flatnonzero(sizes > 2):
                for x, ys in forest(np.unique(marks[edges[k] : edges[k + 1]]), distance):
                    found.append((np.full(len(ys), x, np.uint64), ys))
            a, b = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
            return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"]), edges[-1]

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = [np.concatenate(x) for x in zip(held, columns, strict=True)] if held else columns
            if len(held[0]):
                found, done = links(held, False)
                held = [c[done:] for c in held]
                yield found
        if held and len(held[0]):
            yield links(held, True)[0]

    return run


def close_links(marks: DataFrame, distance: int = BITS, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b), a < b, with the components that all pairs within ``distance`` bits have; ``marks`` holds distinct fp."""
    masks = F.array(*[F.lit(m) for m in blocks(distance)])
    keyed = marks.select("fp", F.posexplode(masks).alias("k", "mask")).select("fp", "k", F.col("fp").bitwiseAND(F.col("mask")).alias("v"))
    large = keyed.groupBy("k", "v").count().filter(F.col("count") > chunk).select("k", "v", F.ceil(F.col("count") / chunk).cast("int").alias("n"))
    own = keyed.join(large, ["k", "v"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
    own = own.withColumn("c", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    dealt = own.select("fp", "k", "v", "c", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("d"))
    cells = dealt.select("k", "v", F.least("c", "d").alias("i"), F.greatest("c", "d").alias("j"), "fp")
    key = ["k", "v", "i", "j"]
    return cells.repartition(*key).sortWithinPartitions(*key).mapInArrow(_cells(distance), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a < b): the smallest node that can be reached."""
    state, seen = written(links, "links"), None
    while True:
        both = state.union(state.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        lowest = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(lowest, "b").filter("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        state = written(small.union(lowest.select(F.col("m").alias("a"), "b")).distinct(), "links")
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return state.select(F.col("b").alias("node"), F.col("a").alias("root")).union(state.select("a", "a").distinct())
        seen = now


def near_duplicates(docs: DataFrame, distance: int = BITS, size: int = SHINGLE) -> DataFrame:
    """doc_id, k1, k2, fp and ``root`` (a fingerprint that names the component) for every row.

    Null and empty texts have fingerprint zero and are linked like any others; texts shorter than a shingle are one shingle.
    Repeated rows and texts share a fingerprint. An empty table gives an empty result; other columns are not read.
    """
    rows = written(fingerprints(docs, size), "fingerprints")
    links = close_links(rows.select("fp").distinct(), distance)
    roots = components(links)
    return rows.join(roots, rows.fp == roots.node, "left").select("doc_id", "k1", "k2", "fp", F.coalesce("root", "fp").alias("root"))


def component_ids(found: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, the smallest doc_id in the component (null if all are)."""
    least = found.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "root").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, distance: int = BITS, size: int = SHINGLE) -> DataFrame:
    """All columns of one row of each component: of the smallest doc_id (null last), and of repeated rows one."""
    found = near_duplicates(docs, distance, size)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "k1", "k2")).alias("f")).select("f.k1", "f.k2")
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("k2"))
    chosen = rows.join(first, ["k1", "k2"])
    once = chosen.withColumn("rank", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("k1"))).filter("rank = 1")
    return once.select("row.*")
