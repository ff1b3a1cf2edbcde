"""Queries of the problems of TESTDATA.md that this subpackage solves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeseam.llm import bpe, docpairs, pack, provenance, repetition, secrets, split, validity
from codeseam.session import table


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_oversized(table(spark, sf_dir, "chunks"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = split.split_oversized(table(spark, sf_dir, "chunks"), oversized_only=True)
    return cut.where(F.col("piece_no") == 1).select(F.col("id").alias("chunk_id"))


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docpairs.documented_functions(table(spark, sf_dir, "symbols"), table(spark, sf_dir, "corpus_files"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_pairs(spark, sf_dir).select("symbol_id")


def p3_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_credentials(table(spark, sf_dir, "chunks"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.credential_lines(table(spark, sf_dir, "chunks")).withColumnRenamed("id", "chunk_id")


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.redact_credentials(table(spark, sf_dir, "chunks"))


def p4_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity.check_syntax(table(spark, sf_dir, "corpus_files"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_checked(spark, sf_dir).where(F.col("n_faults") > 0).select("file_id")


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity.broken_rates(p4_checked(spark, sf_dir), table(spark, sf_dir, "index_rows"))


def p6_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.classify(table(spark, sf_dir, "corpus_files"), table(spark, sf_dir, "index_rows"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_labels(spark, sf_dir).where(F.col("label") != "handwritten").select("file_id")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf_dir, "documents"))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(table(spark, sf_dir, "documents"), "doc_id", bpe.count_tokens())


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.fill(p8_packed(spark, sf_dir))


def p9_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.beyond_limits(repetition.measure_repetition(table(spark, sf_dir, "documents")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_repetition(spark, sf_dir).where("share_beyond").select("doc_id")


QUERIES = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p2_found": p2_found,
    "p2_pairs": p2_pairs,
    "p3_found": p3_found,
    "p3_credentials": p3_credentials,
    "p3_redacted": p3_redacted,
    "p4_found": p4_found,
    "p4_checked": p4_checked,
    "p4_rates": p4_rates,
    "p6_found": p6_found,
    "p6_labels": p6_labels,
    "p7_ids": p7_ids,
    "p8_packed": p8_packed,
    "p8_fill": p8_fill,
    "p9_found": p9_found,
    "p9_repetition": p9_repetition,
}

ORACLES = {
    "p1_found": "SELECT DISTINCT id AS chunk_id FROM chunks WHERE length(content) > 2000",
}
