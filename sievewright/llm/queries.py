"""Queries of this subpackage and, where SQL can state one, its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encoding, handwritten, leakage, packing, parsing, secrets, splitting, truncation, vocab
from .base import table


def limits(spark: SparkSession, folder: str, purpose: str) -> tuple[int, int]:
    row = table(spark, folder, "size_limits").where(F.col("purpose") == purpose).first()  # five rows at every scale
    return row["max_tokens"], row["overlap_tokens"]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.find_truncated(table(spark, folder, "responses", True)).select("seq")


def p2_rates(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncation_rates(table(spark, folder, "responses", True))


def p2_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.evidence(table(spark, folder, "responses", True))


def p2_hazards(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.hazards(truncation.endings(table(spark, folder, "responses", True))).where("significant").drop("significant")


def _pieces(spark: SparkSession, folder: str, purpose: str) -> DataFrame:
    return splitting.split_oversized(table(spark, folder, "source_text", True), *limits(spark, folder, purpose))


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder, "chunk").withColumnRenamed("id", "file_id")


def p5_pieces_small(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder, "chunk_small").withColumnRenamed("id", "file_id")


def p5_pieces_bpe(spark: SparkSession, folder: str) -> DataFrame:
    cut = splitting.split_oversized(table(spark, folder, "source_text", True), *limits(spark, folder, "chunk"), tokenizer=vocab.path("byte_bpe_50k.tiktoken"))
    return cut.withColumnRenamed("id", "file_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder, "chunk").where("piece_no = 0").select(F.col("id").alias("file_id"))


def _packed(spark: SparkSession, folder: str, purpose: str) -> DataFrame:
    sizes = packing.count_tokens(table(spark, folder, "documents", True), vocab.path("byte_bpe_50k.tiktoken"))
    return packing.pack(sizes, limits(spark, folder, purpose)[0]).withColumnRenamed("id", "doc_id")


def p6_pack(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder, "pack")


def p6_pack_small(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder, "pack_small")


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.find_leaks(table(spark, folder, "documents", True), table(spark, folder, "eval_items"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_leaks(spark, folder).select("item_id", "doc_id")


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    return p7_leaks(spark, folder).groupBy("item_id").agg(F.count("*").alias("n_documents"), F.max("n_words").alias("longest"))


def p8_repaired(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.find_garbled(table(spark, folder, "documents", True))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_repaired(spark, folder).select("doc_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_rates, p2_evidence, p2_hazards, p5_found, p5_pieces, p5_pieces_small, p5_pieces_bpe, p6_pack, p6_pack_small, p7_found, p7_leaks, p7_items, p8_found, p8_repaired)}

SQL = {
    "p5_found": """
        SELECT file_id FROM source_text
        WHERE (length(text) + 3) // 4 > (SELECT max_tokens FROM size_limits WHERE purpose = 'chunk')""",
}


def p4_credentials(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.find_credentials(table(spark, folder, "source_text", True))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_credentials(spark, folder).select("file_id", "line_no")


def p4_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.redact(table(spark, folder, "source_text", True))


def p4_index(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.trigram_index(table(spark, folder, "source_text", True))


QUERIES |= {f.__name__: f for f in (p4_found, p4_credentials, p4_redacted, p4_index)}


def p1_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return handwritten.find_machine_made(table(spark, folder, "source_text", True))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_kinds(spark, folder).select("file_id")


def p1_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return handwritten.evidence(table(spark, folder, "source_text", True))


QUERIES |= {f.__name__: f for f in (p1_found, p1_kinds, p1_evidence)}


def p3_parsed(spark: SparkSession, folder: str) -> DataFrame:
    return parsing.parse_files(table(spark, folder, "source_text", True))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_parsed(spark, folder).where("not accepted").select("file_id")


def p3_rates(spark: SparkSession, folder: str) -> DataFrame:
    return parsing.rates(table(spark, folder, "source_text", True))


def p3_acceptance(spark: SparkSession, folder: str) -> DataFrame:
    return parsing.acceptance(table(spark, folder, "source_text", True))


QUERIES |= {f.__name__: f for f in (p3_found, p3_parsed, p3_rates, p3_acceptance)}
