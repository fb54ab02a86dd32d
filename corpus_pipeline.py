"""The corpus pipeline: from raw documents to packed token sequences, one operator per stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one reads what it wrote. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import langid, mixing, ngram_join, packing, pii
from veilspark.llm.common import durable
from veilspark.llm.queries import table, vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or without a clear language."""
    return langid.keep_identified(docs, vocabulary("piece_bpe_32k.model"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one of least doc_id, of each group linked by 0.8 or more of shared five-word shingles."""
    return ngram_join.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Orders documents so that sources interleave in their target weights."""
    return mixing.mixed_order(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place there; sequences follow the mix, whose positions are worked out again from the same rows."""

    def place(slim: DataFrame) -> DataFrame:
        return mixing.pfair_mix(slim, tie="_tie").withColumnRenamed("mix_position", "position")

    return packing.ordered_packing(docs, vocabulary("byte_bpe_50k.json"), place, keep=("source",))


STAGES = [("language ID", language_id), ("near duplicates", near_duplicates), ("personal data", personal_data), ("mixing", mix_sources), ("packing", pack)]

#: SQL has no tokenizer, and no stage's model; tests/llm/test_pipeline.py holds run() against a brute-force version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
