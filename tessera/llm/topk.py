"""Exact top-k search by inner product over integer components: tiled matrix products, partial selection, tree merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import dataset
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import merge_tops, scratch, scratch_path
from tessera.llm.vectors import embeddings, matrix, stated_queries, struct_lists, usable

#: Rows of a tile, rows of a block of queries, and bytes of the tiles that a task holds at once.
SHARD_ROWS = 2_048
QUERY_ROWS = 512
SHARD_BYTES = 128 << 20


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(x * scale)


MOST = 2**63 - 1


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of integer-valued rows, exactly: by doubles while every partial sum stays below 2**53, by 64-bit integers below 2**63, else by whole numbers of any size.

    A product beyond 64 bits counts as the nearest of -MOST and MOST.
    """
    bound = np.abs(q).sum(1)[:, None] * np.abs(x).max(1, initial=0)[None, :]
    if not (wide := bound >= 2**53).any():
        return (q @ x.T).astype("i8")
    light = lambda v: np.where(np.abs(v) < 2**53, v, 0)
    whole64 = lambda v: np.where(np.abs(v) < 2**63, v, 0).astype("i8")
    out = np.where(wide, whole64(q) @ whole64(x).T, np.where(wide, 0, light(q) @ light(x).T).astype("i8"))
    for i, j in zip(*np.nonzero(bound >= 2**63), strict=True):
        out[i, j] = max(-MOST, min(MOST, sum(int(a) * int(b) for a, b in zip(q[i], x[j], strict=True))))
    return out


class Tops:
    """The k best of each query so far: highest score, then least id."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.query, self.score, self.vec = (np.zeros(0, "i8") for _ in range(3))
        self.least = np.full(len(ids), np.iinfo("i8").min)

    def add(self, first: int, scores: np.ndarray, vecs: np.ndarray) -> None:
        """scores: of the queries from first on (rows) and the vectors vecs (columns)."""
        own = self.ids[first : first + len(scores), None] == vecs[None, :]
        cut = self.least[first : first + len(scores)]
        if scores.shape[1] > self.k:  # partial selection: what is below the tile's k-th best cannot count, but ties with it can
            low = np.where(own, np.iinfo("i8").min, scores)
            cut = np.maximum(cut, np.partition(low, -self.k, axis=1)[:, -self.k])
        q, v = np.nonzero((scores >= cut[:, None]) & ~own)
        self.query = np.concatenate([self.query, q + first])
        self.score = np.concatenate([self.score, scores[q, v]])
        self.vec = np.concatenate([self.vec, vecs[v]])
        order = np.lexsort((self.vec, -self.score, self.query))
        query = self.query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = order[place < self.k]
        self.query, self.score, self.vec = self.query[keep], self.score[keep], self.vec[keep]
        full = place[place < self.k] == self.k - 1
        self.least[self.query[full]] = self.score[full]

    def batch(self, part: int) -> pa.RecordBatch:
        ends = np.searchsorted(self.query, np.arange(len(self.ids) + 1))
        lists = struct_lists(ends, neg=-self.score, vec_id=self.vec)
        return pa.RecordBatch.from_arrays([pa.array(self.ids), pa.array(np.full(len(self.ids), part, "i4")), lists], ["query_id", "part", "top"])


LISTS = "query_id long, part int, top array<struct<neg: long, vec_id: long>>"


def by_width(batch: pa.RecordBatch, ids: str, scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Width, ids and integer rows of the vectors of each width."""
    widths = pc.list_value_length(batch["embedding"]).to_numpy(zero_copy_only=False)
    for width in np.unique(widths).tolist():
        same = batch.filter(pa.array(widths == width))
        yield width, same[ids].to_numpy(), whole(matrix(same["embedding"], width), scale)


def shards(batches: Iterator[pa.RecordBatch], scale: int, most: int) -> Iterator[dict[int, list[tuple[np.ndarray, np.ndarray]]]]:
    """Tiles of ids and integer rows, by width, of as many vectors as a task holds at once."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0
    for batch in batches:
        for at in range(0, len(batch), SHARD_ROWS):
            for width, ids, x in by_width(batch.slice(at, SHARD_ROWS), "vec_id", scale):
                held.setdefault(width, []).append((ids, x))
                size += x.nbytes
        if size >= most:
            yield held
            held, size = {}, 0
    if held:
        yield held


def scan(batches: Iterator[pa.RecordBatch], queries: str, k: int, scale: int, query_rows: int, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """Each shard of a partition against all queries, which are read from their table block by block."""
    fs, folder = FileSystem.from_uri(queries)
    table = dataset.dataset(folder, filesystem=fs, format="parquet")
    for shard in shards(batches, scale, shard_bytes):
        for block in table.to_batches(batch_size=query_rows, batch_readahead=1, fragment_readahead=1):
            for width, ids, q in by_width(block, "query_id", scale):
                tops = Tops(ids, k)
                for vecs, x in shard.get(width, ()):
                    tops.add(0, products(q, x), vecs)
                yield tops.batch(TaskContext.get().partitionId())


def top_products(rows: DataFrame, k: int = 10, scale: int = 1024, query_rows: int = QUERY_ROWS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Each stated query's k highest inner products over all other rows: query_id, rank, vec_id, score.

    Components become floor(scale * x). Ties go to the smaller vec_id; rows that share the query's id
    are its own. Vectors of another length than the query's are no candidates of it. Null vectors and ids, and
    vectors with components that are null or not finite, take no part; other columns are not read. Queries are
    a table in the shared folder that each task reads in blocks for each shard it holds, so there may be any
    number of them: the fewer side travels, in one stage. query_rows and shard_bytes bound what a task holds.
    """
    spark = rows.sparkSession
    vectors = usable(rows)
    path = scratch_path(spark, "queries")
    stated_queries(vectors).write.parquet(path)
    lists = scratch(vectors.mapInArrow(lambda b: scan(b, path, k, scale, query_rows, shard_bytes), LISTS), "tops")
    merged = merge_tops(lists, k)
    ranked = merged.select("query_id", F.posexplode("top").alias("at", "one"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), "one.vec_id", (-F.col("one.neg")).alias("score"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest integer inner products of every stated query."""
    return top_products(embeddings(spark, sf_dir))
