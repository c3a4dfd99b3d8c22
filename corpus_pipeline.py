"""The corpus pipeline: five of the training-data operators, one after the other, over documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet
below the shared folder and reads it back as the next stage's docs. All stages but the last
return the columns of documents, in their order.

1. language_id: documents whose text has no letter or no leading language, or whose letters are far from the order
   of any learned language (langid's ``fit``), go.
2. near_dedup: of each class of near copies the document with the smallest doc_id stays.
3. decontaminate: documents that hold a window of a benchmark item go.
4. secrets: secrets in texts give way to a mark.
5. mix: one row per document, with the words that the mix takes of it.

The stages' docstrings (in quarry.llm) define nulls, empty texts, ties, repeated rows, empty
tables and extra columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontaminate as _decontaminate
from quarry.llm import langid, minhash, mixing, secrets
from quarry.llm.common import read_table, settle


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"), mode="document")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
]

#: A trained forest and dart signatures have no SQL form; tests/llm hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
