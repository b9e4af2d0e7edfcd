"""From raw documents to token ids: toxicity, exact dedup, near-dedup, mixing, BPE.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again
as the next stage's ``docs``. All stages but the last return the columns of ``documents``; further columns go with their
rows through those stages.

Defined results. Null and empty texts: toxicity scores them like any text without words, all of them are one text to exact
dedup (one row stays), near-dedup keeps them, the mix keeps them once, they encode to no tokens. Null ids rank last.
Rows that repeat id and text become one row in exact dedup. A null source is a source of its own. Very long texts pass
every stage whole. Without labels nothing is rejected as toxic. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, exact, mixing, neardup, toxicity
from quillon.llm.common import Staged
from quillon.llm.queries import vocabulary
from quillon.runtime import kept, scratch, ship_package
from quillon.sources import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score 0.5 or more) go."""
    ship_package(spark)
    return toxicity.reject_toxic(docs, toxicity.model_of(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, one document stays."""
    ship_package(spark)
    return exact.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at Jaccard 0.8 over five-word shingles, the one with the smallest id stays."""
    ship_package(spark)
    return neardup.near_dedup(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights: documents repeat, or go, as the mix takes them."""
    ship_package(spark)
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, ids_sha256, decoded_sha256`` of every document of the mix."""
    ship_package(spark)
    out = bpe.digests(docs, vocabulary(), with_ids=True)
    return out.select(F.col("key").alias("doc_id"), "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]
#: A trained classifier has no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written to the shared folder and read again.

    What a stage stages for itself is deleted once its result is written, and a stage's result once the next one is.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, apply in STAGES:
        result = Staged(spark)
        with scratch(spark):
            made = apply(spark, docs, sf_dir)
            with kept():
                docs = result.write(made, f"pipeline-{name}")
        if before is not None:
            before.drop()
        before = result
    return docs
