"""Rows of vectors that searches take part in, and their stated queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Queries of the registered searches: ids divisible by this.
STEP = 100


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, embedding of rows whose id and vector are known and whose components are all finite numbers."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)


def stated_queries(rows: DataFrame, step: int = STEP) -> DataFrame:
    """query_id, embedding: one row for each id divisible by step; of rows that share an id, the least vector."""
    return rows.filter(F.col("vec_id") % step == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("embedding"))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors of one width as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def struct_lists(ends: np.ndarray, **fields: np.ndarray) -> pa.Array:
    """Lists of structs, cut at the given ends (with a leading 0)."""
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(v) for v in fields.values()], list(fields)))
