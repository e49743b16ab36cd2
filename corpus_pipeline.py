"""The corpus pipeline: rules, near-duplicates, benchmark passages, secrets, token ids.

Each stage is (name, function of session, documents and data folder). Its result is
written as Parquet and read again as the documents of the next one.

Defined results for odd input: see the operators' modules. Rows without an id pass
like others; an empty table stays empty; extra columns are carried along by all
stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from parley.llm import bpe, decontaminate, quality_rules, secret_scan, simhash
from parley.llm.queries import table, tokenizer_file
from parley.session import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject."""
    return quality_rules.keep_good(docs)


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share four fifths of their five-word shingles with one of a smaller id."""
    return simhash.one_similar_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in place of each secret; all documents stay."""
    return secret_scan.redact(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed 32-bit numbers) and the SHA-256 of ids and decoded text."""
    rows = bpe.encode_and_decode(docs, tokenizer_file("word_bpe_49k.json"))
    return rows.select(
        "doc_id", F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"), "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", good_documents),
    ("near-duplicates", one_per_group),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("token ids", token_ids),
]

#: Fingerprints, tilings, automata and merges have no SQL; the tests hold plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
