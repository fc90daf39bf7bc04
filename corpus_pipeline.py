"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, benchmark decontamination, SentencePiece.

Each stage works on all that its predecessor kept, and returns the columns of `documents`; the last one returns tokens.
Rows with a null doc_id take part, and stand behind all others where the smallest doc_id of a group stays; of repeated
rows one stays. Documents without text go at the first stage. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlode.llm import decontaminate, jaccard, line_dedup, quality_rules, sentencepieces
from textlode.llm.queries import PIECES, table, tokenizer_path
from textlode.session import materialise, workspace

#: Near duplicates: words in a shingle, similarity in percent.
SHINGLE, PERCENT = 5, 80


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.kept(docs)


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has; those of which nothing is left go."""
    out = line_dedup.dedup_lines(docs).filter((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    out = out.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies."""
    return jaccard.one_of_each(docs, SHINGLE, PERCENT)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their byte spans in the text, and a digest of the decoded text."""
    encoded = sentencepieces.encode_texts(docs, tokenizer_path(PIECES))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "starts", "ends", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", good_documents),
    ("line dedup", new_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", not_in_benchmark),
    ("SentencePiece encoding and decoding", tokens),
]

#: SQL has no SentencePiece; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again."""
    root = workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"{root}/{k}")
    return docs
