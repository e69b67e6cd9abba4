"""A corpus pipeline over documents: each stage is an operator of tessera.llm, written and read again.

Toxic documents go, then those of low quality, then all but one of each group of near copies; what
stays is packed into training sequences. Null texts count as empty ones and stay unless an operator
rejects them; an empty table gives an empty result; columns beyond those of documents are carried
along until the last stage, whose rows are pieces of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import documents, scratch
from tessera.llm.jaccard_join import one_of_each
from tessera.llm.packing import pack_with_words
from tessera.llm.quality import keep_good
from tessera.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 for toxicity, with all their columns; a null text scores as an empty one, repeated rows alike, and without confirmed labels all stay."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more for quality, with all their columns; nulls, repeats and missing labels as in tessera.llm.quality.quality_scores."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near copies (five words, 0.8), with all its columns; rows without id stay, and of rows that repeat an id one for each text. Empty texts are no copies."""
    return one_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 ids; a null text gives the end alone, repeated rows are packed each for itself. Other columns end here."""
    return pack_with_words(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near_copies", near_copies),
    ("packing", packing),
]

#: The classifiers are learnt and the packing is greedy: SQL cannot express the rows of run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the rows are written to the shared folder."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch(docs, name)
    return docs
