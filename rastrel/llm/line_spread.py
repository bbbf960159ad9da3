"""Removal of lines that stand on many sites.

A line's hash collects a HyperLogLog sketch of the sites it was seen on: registers are rows (line, register, highest rank), so
sketches merge by an ordinary aggregation that combines before the exchange, and a line seen everywhere sends few rows per
task. The estimate settles lines far from the threshold; lines near it get an exact distinct count.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastrel.llm.common import host, text_key, written

MIN_SITES = 10
#: 2^10 registers: a standard error of 3 %. Estimates within BAND of the threshold are counted exactly.
REGISTER_BITS = 10
BAND = 0.3


def _estimate(ranks: Column, used: Column, registers: int) -> Column:
    """The HyperLogLog estimate from the sum of 2^-rank and the number of registers in use."""
    zero = registers - used
    raw = 0.7213 / (1 + 1.079 / registers) * registers**2 / (ranks + zero)
    return F.when((raw <= 2.5 * registers) & (zero > 0), registers * F.log(registers / zero)).otherwise(raw)


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, text key, site, position and 128-bit hash of every line that is not blank, written once."""
    rows = docs.select("doc_id", text_key().alias("tk"), host().alias("site"), F.col("text").cast("binary").alias("text")).filter("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pos, marks = array("i"), array("i"), []
            for k, text in enumerate(batch.column(3)):
                for i, line in enumerate(text.as_buffer().to_pybytes().split(b"\n")):
                    plain = b" ".join(line.split()).lower()  # of bytes: only A-Z, and white space of ASCII
                    if plain:
                        row.append(k)
                        pos.append(i)
                        marks.append(xxhash.xxh3_128_digest(plain))
            own = pa.array(np.frombuffer(row, np.int32))
            halves = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2)
            yield pa.record_batch(
                [*(c.take(own) for c in batch.columns[:3]), pa.array(np.frombuffer(pos, np.int32)), pa.array(halves[:, 0]), pa.array(halves[:, 1])],
                names=["doc_id", "tk", "site", "pos", "a", "b"])

    kind = dict(docs.dtypes)["doc_id"]
    return written(rows.mapInArrow(run, f"doc_id {kind}, tk long, site string, pos int, a long, b long"), "lines")


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES, bits: int = REGISTER_BITS, band: float = BAND) -> DataFrame:
    """Hashes (a, b) of lines seen on ``min_sites`` sites or more, and the smallest doc_id that has each."""
    registers = 1 << bits
    low, high = math.floor(min_sites * (1 - band)), math.ceil(min_sites * (1 + band))
    h = F.xxhash64(F.lit(2), "site")
    rest = F.shiftrightunsigned(h, bits)
    rank = (64 - bits) - F.floor(F.log2(rest.cast("double") + F.lit(0.5))).cast("int")
    marks = lines.select("a", "b", "doc_id", h.bitwiseAND(F.lit(registers - 1)).alias("register"), rank.alias("rank"))
    sketch = marks.groupBy("a", "b", "register").agg(F.max("rank").alias("rank"), F.min("doc_id").alias("first"))
    merged = sketch.groupBy("a", "b").agg(
        F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("ranks"), F.count("*").alias("used"), F.min("first").alias("first"))
    sized = merged.select("a", "b", "first", _estimate(F.col("ranks"), F.col("used"), registers).alias("sites")).filter(F.col("sites") >= low)
    near = sized.filter(F.col("sites") <= high)
    # one row per line and site comes before the join, so a line on every site never meets in one task
    exact = lines.groupBy("a", "b", "site").count().join(near.select("a", "b"), ["a", "b"], "left_semi").groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= min_sites)
    kept = near.join(exact, ["a", "b"], "left_semi")
    return sized.filter(F.col("sites") > high).union(kept).select("a", "b", "first")


def remove_spread_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``row`` (a struct of all columns), the cleaned ``text`` and ``n_removed`` for every row.

    A line that stands on ``min_sites`` sites or more goes from every document but the one with the smallest doc_id, where it
    stays, so no content is lost. Lines are compared without regard to case of A-Z and to the length of white space; blank lines
    are never removed. A null text stays null, a text whose lines all go becomes empty; rows without a source are one site;
    a null doc_id is never the smallest. Rows of equal doc_id and text lose the same lines.
    """
    lines = lines_of(docs)
    common = spread_lines(lines, min_sites)
    gone = lines.join(common, ["a", "b"]).filter(~F.col("doc_id").eqNullSafe(F.col("first")) | F.col("doc_id").isNull())
    gone = gone.groupBy(F.col("doc_id").alias("id"), F.col("tk").alias("key")).agg(F.collect_set("pos").alias("gone"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc"), text_key().alias("tk"))
    joined = rows.join(gone, F.col("doc").eqNullSafe(F.col("id")) & (F.col("tk") == F.col("key")), "left")
    left = F.filter(F.split("row.text", "\n", -1), lambda line, i: ~F.array_contains("gone", i))
    return joined.select(
        "row", F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n")).alias("text"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


#: The same rows by exact distinct counts.
SQL = r"""
WITH l AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
p AS (
  SELECT doc_id, coalesce('=' || source, '-') AS site, text, pos, line,
    translate(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS plain
  FROM l),
c AS (SELECT plain, min(doc_id) AS first FROM p WHERE plain <> '' GROUP BY plain HAVING count(DISTINCT site) >= 10),
k AS (
  SELECT p.doc_id, p.text, string_agg(p.line, chr(10) ORDER BY p.pos) FILTER (c.plain IS NULL OR p.doc_id = c.first) AS left_text,
    count(*) FILTER (c.plain IS NOT NULL AND (p.doc_id <> c.first OR p.doc_id IS NULL OR c.first IS NULL)) AS n_removed
  FROM (SELECT DISTINCT * FROM p) p LEFT JOIN c USING (plain) GROUP BY p.doc_id, p.text)
SELECT d.doc_id, d.source,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.left_text, '') END AS text, coalesce(k.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND d.text IS NOT DISTINCT FROM k.text
"""
