"""Merkle fixity audit of web archives.

Records are hashed with SHA-256. Inside a file the record hashes of each stretch of offsets are hashed in order into a leaf of the file's
tree, and ``FANOUT`` neighbouring nodes into their parent, up to one root per file. The roots of two replicas are compared first, and only
branches that differ are opened, level by level, until the damaged records are found. Both replicas go through the same grouping, so a
level is one aggregation by (file, node): nothing is gathered by file, however large a file is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastrel.llm.common import written

FANOUT = 16
#: Bytes of offsets under one leaf.
LEAF_BYTES = 64 * 1024


def record(url: Column, body: Column) -> Column:
    """The text of a WARC response record; null parts count as empty."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def laid_out(records: DataFrame, order: str, per_file: int) -> DataFrame:
    """Files of ``per_file`` records in the order of one column: adds ``file``, and ``offset`` from the column ``length``.

    Rows are numbered by a range exchange and the sizes of its partitions, of which the driver holds one number each; rows that tie
    keep one order, as the numbering is written once. Nulls come first.
    """
    spark = records.sparkSession
    named = written(records.withColumn("_tie", F.monotonically_increasing_id()), "records")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = named.repartitionByRange(order, "_tie").sortWithinPartitions(order, "_tie")
    numbered = written(ranged.withColumns({"_p": F.spark_partition_id(), "_r": place}), "numbered")
    starts, total = [], 0
    for p, n in sorted(numbered.groupBy("_p").count().collect()):
        starts.append((p, total))
        total += n
    known = numbered.join(spark.createDataFrame(starts, "_p int, _start long"), "_p")
    number = F.col("_start") + F.col("_r")
    filed = known.withColumn("file", F.floor(number / per_file).cast("long")).withColumn("_n", number)
    before = Window.partitionBy("file").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    return filed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("_p", "_r", "_start", "_tie", "_n")


def _hash(parts: Column) -> Column:
    """SHA-256 of ordered parts; null if there are none."""
    return F.when(F.size(parts) > 0, F.sha2(F.array_join(F.transform(parts, lambda x: F.to_json(x)), "\n"), 256))


def leaves(copies: DataFrame, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """(file, i, a, b): the hash of each stretch of offsets in replica 0 and in replica 1."""
    one = F.struct("offset", "length", "digest")
    return copies.groupBy("file", F.floor(F.col("offset") / leaf_bytes).cast("long").alias("i")).agg(
        *[_hash(F.array_sort(F.collect_list(F.when(F.col("copy") == k, one)))).alias(c) for k, c in enumerate("ab")])


def parents(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    return nodes.groupBy("file", F.floor(F.col("i") / fanout).cast("long").alias("i")).agg(
        *[_hash(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("i", F.col(c).alias("h")))))).alias(c) for c in "ab"])


def audit(copies: DataFrame, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT) -> DataFrame:
    """(file, offset, damage, kept, found, length) of every record in which the replicas differ.

    ``copies`` has copy (0 kept, 1 checked), file, offset, length and digest. ``damage`` is ``changed``, ``lost`` (not in replica 1,
    a whole file included) or ``extra`` (only there); a record counts as changed if its length or digest differs. ``kept`` and
    ``found`` are digests, joined by commas if several records claim one offset. Repeated rows of one replica count, so a record that
    stands twice in one replica and once in the other is changed. Rows without file or offset are left out: they have no place. Null
    digests are read as empty. An empty replica loses everything; two empty ones give no row.
    """
    rows = written(copies.filter("file IS NOT NULL AND offset IS NOT NULL").select(
        "copy", "file", F.col("offset").cast("long").alias("offset"), F.coalesce("length", F.lit(0)).cast("long").alias("length"),
        F.coalesce("digest", F.lit("")).alias("digest")), "copies")
    top = rows.agg(F.max("offset")).first()[0] or 0
    levels = [written(leaves(rows, leaf_bytes), "nodes")]
    reach = leaf_bytes
    while reach <= top:
        levels.append(written(parents(levels[-1], fanout), "nodes"))
        reach *= fanout
    differs = ~F.col("a").eqNullSafe(F.col("b"))
    bad = levels[-1].filter(differs).select("file", "i")
    for nodes in reversed(levels[:-1]):
        opened = bad.select("file", F.col("i").alias("up"))
        inside = nodes.withColumn("up", F.floor(F.col("i") / fanout).cast("long")).join(opened, ["file", "up"], "left_semi")
        bad = inside.filter(differs).select("file", "i")
    near = rows.withColumn("i", F.floor(F.col("offset") / leaf_bytes).cast("long")).join(bad, ["file", "i"], "left_semi")
    one = F.struct("length", "digest")
    pairs = near.groupBy("file", "offset").agg(*[F.array_sort(F.collect_list(F.when(F.col("copy") == k, one))).alias(c) for k, c in enumerate("ab")])
    damage = F.when(F.size("b") == 0, "lost").when(F.size("a") == 0, "extra").otherwise("changed")
    text = lambda c: F.when(F.size(c) > 0, F.array_join(F.col(f"{c}.digest"), ","))
    return pairs.filter(F.col("a") != F.col("b")).select(
        "file", "offset", damage.alias("damage"), text("a").alias("kept"), text("b").alias("found"),
        F.coalesce(F.get(F.col("a.length"), F.lit(0)), F.get(F.col("b.length"), F.lit(0))).alias("length"))


#: How the registered query damages the replica: by the id of a page and the number of a file.
PER_FILE = 64
CHANGED, LOST, LOST_FILE, EXTRA_FILE = (101, 7), (101, 9), (31, 2), (17, 1)


def damaged_replica(pages: DataFrame) -> DataFrame:
    """Two replicas of the pages as archive files; in replica 1 some records are changed or lost, some files lost or longer."""
    hit = lambda c, rule: F.coalesce(F.pmod(F.col(c), F.lit(rule[0])) == rule[1], F.lit(False))
    text = record(F.col("url"), F.col("html"))
    wrong = F.concat(F.substring(text, 1, 9), F.lit("?"), F.substr(text, F.lit(11)))
    both = pages.select(
        "page_id", F.octet_length(text).cast("long").alias("length"), F.sha2(text, 256).alias("digest"),
        F.when(hit("page_id", CHANGED), F.sha2(wrong, 256)).otherwise(F.sha2(text, 256)).alias("found"))
    files = laid_out(both, "page_id", PER_FILE)
    kept = files.select(F.lit(0).alias("copy"), "file", "offset", "length", "digest")
    there = files.filter(~hit("page_id", LOST) & ~hit("file", LOST_FILE)).select(F.lit(1).alias("copy"), "file", "offset", "length", F.col("found").alias("digest"))
    ends = files.filter(hit("file", EXTRA_FILE)).groupBy("file").agg(F.sum("length").alias("offset")).select(
        F.lit(1).alias("copy"), "file", "offset", F.lit(9).cast("long").alias("length"), F.sha2(F.lit("WARC/1.0\n"), 256).alias("digest"))
    return kept.union(there).union(ends)


#: The same rows by comparing all records.
SQL = r"""
WITH r AS MATERIALIZED (
  SELECT page_id, row_number() OVER (ORDER BY page_id NULLS FIRST) - 1 AS n,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS t
  FROM pages),
f AS (
  SELECT page_id, n // 64 AS file, strlen(t) AS length, sha256(t) AS digest, sha256(substr(t, 1, 9) || '?' || substr(t, 11)) AS wrong,
    coalesce(sum(strlen(t)) OVER (PARTITION BY n // 64 ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM r)
SELECT file, "offset", CASE WHEN page_id % 101 = 9 OR file % 31 = 2 THEN 'lost' ELSE 'changed' END AS damage, digest AS kept,
  CASE WHEN page_id % 101 = 9 OR file % 31 = 2 THEN NULL ELSE wrong END AS found, length
FROM f WHERE page_id % 101 IN (7, 9) OR file % 31 = 2
UNION ALL SELECT file, sum(length)::BIGINT, 'extra', NULL, sha256('WARC/1.0' || chr(10)), 9 FROM f WHERE file % 17 = 1 GROUP BY file
"""
