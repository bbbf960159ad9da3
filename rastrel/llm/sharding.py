"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Every input partition holds n_p rows, shard j shall hold s_j. How many rows of p a uniform permutation sends to j is one draw
from the multivariate hypergeometric law; the matrix of these counts is drawn exactly, partition after partition. Rows are then
permuted inside their partition without an exchange, cut into runs of the drawn lengths, exchanged once, and permuted inside
their shard. Both permutations order by a hash of the row's place in a written table, so equal rows spread like any others and a
task that runs again gives the same answer.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rastrel.llm.common import written

#: A shard is permuted in cells of about this many rows, each sorted by one task.
ROWS_PER_CELL = 10_000
#: The matrix is broadcast up to this many numbers (8 bytes each), and joined by an exchange beyond.
BROADCAST_NUMBERS = 4_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """One exact draw: how many of ``draws`` rows taken without return from good + bad rows are good.

    The weights follow from the mode by the ratio of neighbours, over 12 standard deviations to either side.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    n = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (n + 2)))
    spread = (draws / n * good * (bad / n) * ((n - draws) / max(n - 1, 1))) ** 0.5
    first, last = max(low, mode - int(12 * spread) - 12), min(high, mode + int(12 * spread) + 12)
    up = np.arange(mode, last, dtype=float)
    down = np.arange(mode, first, -1, dtype=float)
    above = np.cumprod((good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1)))
    below = np.cumprod(down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1)))
    weights = np.concatenate([below[::-1], [1.0], above])
    total = np.cumsum(weights)
    return first + int(np.searchsorted(total, rng.random() * total[-1], side="right").clip(0, len(total) - 1))


def communication_matrix(rows: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Row sums ``rows``, column sums ``sizes``, drawn as a uniform permutation would fill it."""
    rng, left, out = np.random.default_rng(seed), list(sizes), []
    for n in rows:
        drawn, open_rows, open_all = [], n, sum(left)
        for size in left:
            k = hypergeometric(rng, size, open_all - size, open_rows)
            drawn.append(k)
            open_rows, open_all = open_rows - k, open_all - size
        left = [a - k for a, k in zip(left, drawn, strict=True)]
        out.append(drawn)
    return out


def shard(df: DataFrame, shards: int = 16, seed: int = 7, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """``row`` (a struct of all columns of ``df``, so no name can clash), ``shard`` and ``slot`` for every row.

    Shard sizes differ by one at most, the first ones are the larger; slots of a shard count from 0 without gaps. The result is
    one uniform permutation for a seed and a layout of input partitions. Nulls, empty texts and repeated rows are rows like any
    others; an empty table gives an empty result. The driver holds one number per input partition and shard, no rows.
    """
    spark = df.sparkSession
    within = F.lit((1 << 33) - 1)
    first = df.select(
        F.struct("*").alias("row"), F.spark_partition_id().alias("p"),
        F.xxhash64(F.lit(seed), F.monotonically_increasing_id()).alias("h"),
    ).sortWithinPartitions("h")
    placed = written(first.select("row", "p", F.monotonically_increasing_id().bitwiseAND(within).alias("r")), "shard")
    counts = sorted((r["p"], r["count"]) for r in placed.groupBy("p").count().collect())
    total = sum(n for _, n in counts)
    sizes = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = communication_matrix([n for _, n in counts], sizes, seed)
    edges = spark.createDataFrame(
        [(p, [int(x) for x in np.cumsum(row)]) for (p, _), row in zip(counts, matrix, strict=True)], "p int, edges array<bigint>"
    )
    if len(counts) * shards <= BROADCAST_NUMBERS:
        edges = F.broadcast(edges)
    cells = max(1, -(-total // (shards * rows_per_cell)))
    h2 = F.xxhash64(F.lit(seed + 1), "p", "r")

    def dealt(rows: DataFrame) -> DataFrame:
        """The row's shard, and its cell there: a range of the hash that orders the shard."""
        return rows.join(edges, "p").select(
            *[c for c in rows.columns if c == "row"],
            F.size(F.filter("edges", lambda e: e <= F.col("r"))).alias("shard"), h2.alias("h2"), "p", "r",
        ).withColumn("cell", F.floor((F.col("h2") / 2.0**64 + 0.5) * cells).cast("int"))

    by_shard = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt(placed.select("p", "r")).groupBy("shard", "cell").count().select(
        "shard", "cell", F.coalesce(F.sum("count").over(by_shard), F.lit(0)).alias("start"))
    in_cell = Window.partitionBy("shard", "cell").orderBy("h2", "p", "r")
    ranked = dealt(placed).withColumn("rank", F.row_number().over(in_cell) - 1)
    return ranked.join(starts, ["shard", "cell"]).select(
        "row", F.col("shard").cast("int").alias("shard"), (F.col("start") + F.col("rank")).cast("long").alias("slot"))
