"""Registered queries of the operators, each over its whole table, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrel.llm import block_naming, conversations, cross_tokens, decontaminate, fixity, language, line_quality, line_spread, main_text, pieces, secrets, sharding, simhash
from rastrel.llm.common import table


def op1_tree_marginals(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled pages are those whose address names the document they show."""
    pages = table(spark, folder, "pages")
    number = F.regexp_extract("url", r"^[a-z]+://[^/]+/[a-z]+/([0-9]{1,18})", 1).try_cast("long")
    sample = pages.select("html", number.alias("doc_id")).filter("doc_id IS NOT NULL AND html IS NOT NULL")
    sample = sample.orderBy(F.xxhash64("html"), "html", "doc_id").limit(main_text.SAMPLE)
    labelled = sample.join(table(spark, folder, "documents").select("doc_id", F.col("text").alias("main")), "doc_id")
    return main_text.main_text(pages, main_text.train(labelled)).drop("n_blocks")


def op2_spaced_seeds(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "n_same", "n_item", "longest")


def op3_trigram_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digests(table(spark, folder, "documents"))


#: The vocabulary file of the registered queries; a parameter of the operator.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op4_piece_paths(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode(table(spark, folder, "documents"), pieces.load_model(spark, f"file://{PIECES}"))


def op5_language_back_off(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = language.fold() == 2
    model = language.fit(docs.filter(~held_out))
    out = language.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return out.select("row.doc_id", "row.held_out", "lang_pred", "score")


def op6_line_spread(spark: SparkSession, folder: str) -> DataFrame:
    out = line_spread.remove_spread_lines(table(spark, folder, "documents"))
    return out.select("row.doc_id", "row.source", "text", "n_removed")


def op7_hypergeometric_shards(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, folder, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = sharding.shard(rows)
    return out.select("row.*", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_merkle_audit(spark: SparkSession, folder: str) -> DataFrame:
    return fixity.audit(fixity.damaged_replica(table(spark, folder, "pages")))


def op9_simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.component_ids(simhash.near_duplicates(table(spark, folder, "documents")))


def op10_line_quality(spark: SparkSession, folder: str) -> DataFrame:
    return line_quality.judge(table(spark, folder, "documents"))


def op11_block_naming(spark: SparkSession, folder: str) -> DataFrame:
    out = block_naming.duplicates(table(spark, folder, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


#: The byte-level vocabulary of the registered queries.
BYTES = "/opt/tokenizers/byte_bpe_50k.json"


def op12_cross_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return cross_tokens.align(table(spark, folder, "documents"), cross_tokens.load(spark, f"file://{BYTES}", f"file://{PIECES}"))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    return conversations.repair(conversations.damage(rows), rows)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_tree_marginals, op2_spaced_seeds, op3_trigram_secrets, op4_piece_paths, op5_language_back_off, op6_line_spread,
        op7_hypergeometric_shards, op8_merkle_audit, op9_simhash_components, op10_line_quality, op11_block_naming, op12_cross_tokens, op13_conversation_repair)
}
CHECKS: dict[str, str] = {"op3_trigram_secrets": secrets.check_sql(), "op6_line_spread": line_spread.SQL, "op8_merkle_audit": fixity.SQL,
    "op10_line_quality": line_quality.SQL, "op11_block_naming": block_naming.SQL}
