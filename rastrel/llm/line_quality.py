"""Quality rules: counts over the words and lines of a document, and lines that too many documents of one host share.

One pass in Arrow batches turns a text into its counts and the hashes of its plain lines. Lines are counted per host over distinct
texts, so copies of one document don't make its lines boilerplate; what is left of a document after the lines above the limit are
removed decides whether it is depleted. Only hashes and counts are exchanged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastrel.llm.common import host, written

WINDOW, MIN_WORDS, MAX_REPEATED = 5, 10, 20
SYMBOLS = b"#*$%&|<>"
#: A line goes if over MIN_DOCUMENTS distinct texts of its host have it and these are over MAX_SHARE of the host's, or over MOST_DOCUMENTS
#: in any case: on a large host the limit doesn't grow beyond that.
MIN_DOCUMENTS, MAX_SHARE, MOST_DOCUMENTS = 20, 0.02, 1000
#: A document is depleted if less than this share of its word characters is left.
MIN_LEFT = 0.2

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = ("doc_id {id}, host string, tk long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "lines array<struct<h: bigint, chars: bigint>>")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    code = ids[:n]
    for k in range(1, window):
        if int(code.max(initial=0) + 1) * len(number) >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
        code = code * len(number) + ids[k : k + n]
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    step = np.zeros(len(words) + 1, np.int64)
    step[:n] += twice
    step[window : window + n] -= twice
    return int((np.cumsum(step)[: len(words)] > 0).sum())


def _characters(data: bytes) -> int:
    """Code points of valid UTF-8."""
    return len(data.decode("utf-8"))


def measure(text: bytes) -> tuple[list[int], list[dict[str, int]]]:
    """The counts, and hash and word characters of each plain line with a word."""
    words = text.split()
    seen: set[bytes] = set()
    dup, lines = 0, []
    for line in text.split(b"\n"):
        parts = line.split()
        if parts:
            dup += line in seen
            seen.add(line)
            plain = b" ".join(parts).lower()
            lines.append({"h": xxhash.xxh64_intdigest(plain) - (1 << 63), "chars": _characters(b"".join(parts))})
    symbols = sum(text.count(bytes([c])) for c in SYMBOLS)
    return [len(words), sum(x["chars"] for x in lines), symbols, dup, repeated_words(words)], lines


def measured(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", host().alias("host"), F.xxhash64(text).alias("tk"), text.cast("binary").alias("text"))
    lines_type = pa.list_(pa.struct([("h", pa.int64()), ("chars", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(t.as_buffer().to_pybytes()) for t in batch.column(3)]
            counts = [pa.array([f[0][k] for f in found], pa.int64()) for k in range(len(COUNTS))]
            yield pa.record_batch([*batch.columns[:3], *counts, pa.array([f[1] for f in found], lines_type)], names=["doc_id", "host", "tk", *COUNTS, "lines"])

    return rows.mapInArrow(run, SCHEMA.format(id=dict(docs.dtypes)["doc_id"]))


def judge(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT,
          most_documents: int = MOST_DOCUMENTS) -> DataFrame:
    """doc_id, the counts, ``chars_left`` (word characters outside lines above the limit), base_failed and kept for every row.

    Lines are compared without regard to case of A-Z and to the length of white space. Rows without a source are one host. Null
    and empty texts count as documents without words, which fail the base rule. Repeated rows and equal texts of a host count
    once per line. An empty table gives an empty result; other columns are not read.
    """
    rows = written(measured(docs).withColumn("row_id", F.monotonically_increasing_id()), "quality")
    lines = rows.select("row_id", "host", "tk", F.explode("lines").alias("line")).select("row_id", "host", "tk", "line.h", "line.chars")
    texts = lines.groupBy("host", "h", "tk").count().groupBy("host", "h").agg(F.count("*").alias("n")).filter(F.col("n") > min_documents)
    hosts = rows.groupBy("host", "tk").count().groupBy("host").agg(F.count("*").alias("total"))
    over = texts.join(hosts, "host").filter((F.col("n") > max_share * F.col("total")) | (F.col("n") > most_documents)).select("host", "h")
    gone = lines.join(over, ["host", "h"]).groupBy("row_id").agg(F.sum("chars").alias("gone"))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    left = F.col("word_chars") - F.coalesce("gone", F.lit(0))
    return rows.join(gone, "row_id", "left").select(
        "doc_id", *COUNTS, left.alias("chars_left"), base.alias("base_failed"),
        (~base & (left >= min_left * F.col("word_chars"))).alias("kept"))


#: The same rows in DuckDB.
SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '-') AS host, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (
  SELECT rid, word, row_number() OVER (PARTITION BY rid ORDER BY k) AS i FROM (
    SELECT rid, unnest(regexp_split_to_array(text, '[\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), 1) AS k FROM d)
  WHERE word <> ''),
n AS (SELECT rid, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars FROM w GROUP BY rid),
f AS (
  SELECT rid, i, word AS a, lead(word, 1) OVER p AS b, lead(word, 2) OVER p AS c, lead(word, 3) OVER p AS e, lead(word, 4) OVER p AS g FROM w
  WINDOW p AS (PARTITION BY rid ORDER BY i)),
t AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c, e, g) AS m FROM f WHERE g IS NOT NULL) WHERE m > 1),
r AS (SELECT rid, count(DISTINCT i + j.range) AS n_repeat_words FROM t, range(5) j GROUP BY rid),
l AS MATERIALIZED (
  SELECT rid, host, text, line, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
    translate(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS plain
  FROM (SELECT rid, host, text, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
u AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY rid),
h AS (SELECT host, count(DISTINCT text) AS total FROM d GROUP BY host),
o AS (SELECT host, plain FROM l JOIN h USING (host) GROUP BY host, plain, total HAVING count(DISTINCT text) > {MIN_DOCUMENTS} AND (count(DISTINCT text) > {MAX_SHARE} * total OR count(DISTINCT text) > {MOST_DOCUMENTS})),
g AS (SELECT rid, sum(chars)::BIGINT AS gone FROM l JOIN o USING (host, plain) GROUP BY rid),
a AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(word_chars, 0) - coalesce(gone, 0) AS chars_left
  FROM d LEFT JOIN n USING (rid) LEFT JOIN u USING (rid) LEFT JOIN r USING (rid) LEFT JOIN g USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND chars_left >= {MIN_LEFT} * word_chars AS kept FROM b
"""
