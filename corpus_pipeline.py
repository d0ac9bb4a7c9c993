"""A corpus pipeline of five of the operators, each on what the one before it kept.

Toxic documents go; lines that repeat or nearly repeat an earlier one go, and documents of which nothing is left; of
each group of near-duplicates the document with the smallest id stays; documents that leak a benchmark item go; the rest
is encoded. Rows with a null id or text pass through every filter, repeated rows stay or go together, an empty table gives
no rows; all columns of ``documents`` stay until the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import decontaminate, lines, minhash, pieces, toxicity
from tarn.llm._store import Scratch


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id isn't in the one-column table ``ids``."""
    gone = ids.toDF("_tarn_gone").distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_tarn_gone"), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_ordinary(docs, toxicity.fit(docs, labels))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, minhash.near_duplicates(docs).where(~F.col("kept")).select("id"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontaminate.leaks(docs, items).select("id"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, round_trip, ids)."""
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("minhash", dedup_documents),
    ("decontaminate", drop_leaks),
    ("sentencepiece", encode),
]

#: No stage but the exact filters can be put into SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.put(docs, name)
    return docs
