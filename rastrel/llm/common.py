"""Helpers shared by the operators: tables, tables written in the shared folder, keys of rows and sites."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrel.session import shared_folder

def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, what: str) -> DataFrame:
    """The same rows, written once to the folder all executors share, so that later steps survive a lost executor
    and see one version of whatever depends on the layout of partitions. The files may go when the session has ended."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/rastrel-llm/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of small keys that may be broadcast (about 50 bytes each).
FEW = 1_000_000


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """A written table of keys, counted: broadcast while it is small, so that the texts it meets stay where they are; else exchanged."""
    return F.broadcast(df) if df.count() <= most else df.hint("merge")


def text_key(text: str | Column = "text") -> Column:
    """64 bits that stand for a text next to its doc_id; null has its own value."""
    return F.xxhash64(F.col(text) if isinstance(text, str) else text)


def host(source: str = "source") -> Column:
    """The site a row is from, never null: rows without a source make up one site of their own."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("-"))


#: Values a Python worker remembers per function, before the older ones go.
REMEMBERED = 250_000


class Remembered(dict):
    """Values of a function by key. When ``most`` are held they become the old ones, of which those asked for again stay."""

    def __init__(self, of, most: int = REMEMBERED):
        super().__init__()
        self.of, self.most, self.old = of, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.of(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
