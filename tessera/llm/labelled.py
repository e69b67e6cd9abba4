"""Bounded training samples of labelled documents, and scores for all documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.llm.common import by_place
from tessera.llm.memory import releasing
from tessera.llm.wordhash import byte_chunks

FOLDS = 5


def fold(doc_id: str = "doc_id") -> Column:
    """The remainder of the id's CRC-32 (as text); fold 0 is held out. A null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")) % FOLDS


def draw(rows: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """n rows at most, those of the least hash of the key: the same ones for the same table."""
    return rows.orderBy(F.xxhash64(key), key).limit(n)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, n: int) -> DataFrame:
    """Up to n documents outside fold 0 with their label: doc_id, text, label. n bounds what is broadcast."""
    known = labels.filter(F.col(label).isNotNull() & (fold() != 0)).select("doc_id", F.col(label).alias("label"))
    return docs.select("doc_id", "text").join(F.broadcast(draw(known, n)), "doc_id")


def with_scores(docs: DataFrame, scores: Callable[[np.ndarray, np.ndarray], np.ndarray], name: str = "score") -> DataFrame:
    """Adds the scores of whole texts, given as bytes and offsets; a null text scores as an empty one. Rows and other columns stay.

    scores travels with the tasks: models here have some 100 KB.
    """
    plain, text = by_place(docs), f"c{docs.columns.index('text')}"
    schema = StructType([*(StructField(f.name, f.dataType) for f in plain.schema), StructField("score", DoubleType())])

    @releasing
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in byte_chunks(batch[text]):
                own = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(scores(data, offsets))], [*batch.schema.names, "score"])

    return plain.mapInArrow(add, schema).toDF(*docs.columns, name)


def free_name(docs: DataFrame, name: str) -> str:
    """name, made longer until no column of docs has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name
