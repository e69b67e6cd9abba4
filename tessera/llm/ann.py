"""Approximate nearest neighbours: inverted lists with an adaptive scan over dimensions.

Vectors are turned by a random rotation and scanned in blocks of columns. After each block a
hypothesis test compares a candidate's partial distance with the k-th best distance so far: under
a random rotation, the distance over m of d dimensions, times d/m, is near the whole one, so a
candidate whose share is too large by more than chance is abandoned. What survives all blocks is
measured exactly on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import merge_tops, scratch
from tessera.llm.vectors import embeddings, matrix, stated_queries, struct_lists, usable

BLOCK = 16
#: How many times the chance deviation (1/sqrt(m)) a partial distance may exceed its share.
DOUBT = 2.1
CELL_ROWS = 8_192
CELL_QUERIES = 16_384
PAGE = 1_024


@dataclass
class Index:
    """centroids of the lists; rotation; probes: how many lists a query looks into at least."""

    centroids: np.ndarray
    rotation: np.ndarray
    probes: int

    def nearest_lists(self, x: np.ndarray) -> np.ndarray:
        """All lists in the order of their centroids' distances, for each row."""
        return np.argsort((self.centroids**2).sum(1) - 2 * x @ self.centroids.T, axis=1, kind="stable")


def k_means(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    rng = np.random.default_rng(7)
    centroids = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = np.argmin((centroids**2).sum(1) - 2 * x @ centroids.T, axis=1)
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], x[rng.choice(len(x), k)])
    return centroids


def fit(sample: np.ndarray, rows: int, k: int, recall: float = 0.985, most: int = 4_096) -> Index:
    """Learns lists from a sample, and from exact searches in it how many of them reach the recall.

    Neighbours in a sample lie farther away than in the whole table, so the count errs upwards.
    """
    d = sample.shape[1]
    rotation, _ = np.linalg.qr(np.random.default_rng(11).normal(size=(d, d)))
    lists = int(np.clip(round(rows**0.5), 1, min(most, max(1, len(sample) // 8))))
    if rows <= 20 * k:
        return Index(sample.mean(0, keepdims=True), rotation, 1)
    index = Index(k_means(sample, lists), rotation, 1)
    asked = sample[:: max(1, len(sample) // 300)]
    gaps = (sample**2).sum(1) - 2 * asked @ sample.T
    near = np.argpartition(gaps, k, axis=1)[:, : k + 1]
    own = index.nearest_lists(sample)[:, 0]
    order = index.nearest_lists(asked)
    place = np.argsort(order, axis=1)[np.arange(len(asked))[:, None], own[near]]
    reached = (place[:, :, None] < np.arange(1, lists + 1)).mean((0, 1))
    index.probes = int(np.argmax(reached >= recall)) + 1
    return index


def adaptive_scan(q: np.ndarray, turned: np.ndarray, x: np.ndarray, rotated: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest rows of x to q: by distance, ties by smaller id; own is the query's id. turned and rotated are q and x after rotation."""
    d = len(q)
    best_d, best_i = np.zeros(0), np.zeros(0, "i8")
    for at in range(0, len(x), PAGE):
        live = np.flatnonzero(ids[at : at + PAGE] != own) + at
        if len(best_d) == k:
            part, limit = np.zeros(len(live)), best_d[-1] ** 2
            for b in range(0, d, BLOCK):
                part += ((rotated[live, b : b + BLOCK] - turned[b : b + BLOCK]) ** 2).sum(1)
                m = min(d, b + BLOCK)
                slack = (1 + DOUBT / m**0.5) ** 2 if m < d else 1 + 1e-9
                stays = part <= limit * m / d * slack
                live, part = live[stays], part[stays]
        dist = np.sqrt(((x[live] - q) ** 2).sum(1))
        best_d, best_i = np.concatenate([best_d, dist]), np.concatenate([best_i, ids[live]])
        keep = np.lexsort((best_i, best_d))[:k]
        best_d, best_i = best_d[keep], best_i[keep]
    return best_d, best_i


def nearest(rows: DataFrame, k: int = 10, sample_rows: int = 20_000) -> DataFrame:
    """Each stated query's k nearest other rows found: query_id, rank, vec_id, score (Euclidean distance in doubles).

    The index is fitted on up to sample_rows vectors (those of the least hash of their ids) and holds every
    vector of the commonest length; zero vectors and those of other lengths take no part. Lists of many
    vectors are cut into cells, and so are the queries that look into them, so no task holds a whole list.
    Ties go to the smaller vec_id; rows that share the query's id are its own. Fewer candidates: all of them.
    """
    spark = rows.sparkSession
    vectors = usable(rows).filter(F.exists("embedding", lambda x: x != 0))
    widths = vectors.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").first()
    out = "query_id long, rank int, vec_id long, score double"
    if widths is None:
        return spark.createDataFrame([], out)
    width, n = widths
    vectors = vectors.filter(F.size("embedding") == width)
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("embedding").toPandas()
    index = spark.sparkContext.broadcast(fit(np.stack(sample["embedding"].to_list()).astype(float), n, k))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), PAGE):
                part = batch.slice(at, PAGE)
                own = index.value.nearest_lists(matrix(part["embedding"], width))[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(own.astype("i4")), *part.columns], ["list", *part.schema.names])

    assigned = scratch(vectors.mapInArrow(assign, "list int, vec_id long, embedding array<float>"), "lists")
    queries = stated_queries(vectors)
    lists = len(index.value.centroids)
    counts = np.zeros(lists, "i8")
    for r in assigned.groupBy("list").count().collect():  # one row for each list
        counts[r[0]] = r[1]
    chunks = np.maximum(1, -(-counts // CELL_ROWS))
    splits = max(1, -(-queries.count() * index.value.probes // lists // CELL_QUERIES))
    most = int(chunks.max())
    cell = lambda own, chunk, split: (own * most + chunk) * splits + split

    def route_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch["list"].to_numpy().astype("i8")
            chunk = (batch["vec_id"].to_numpy().view("u8") * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype("i8") % chunks[own]
            for split in range(splits):
                yield pa.RecordBatch.from_arrays([pa.array(cell(own, chunk, split)), batch["vec_id"], batch["embedding"]], ["cell", "vec_id", "embedding"])

    def route_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), PAGE):
                part = batch.slice(at, PAGE)
                order = index.value.nearest_lists(matrix(part["embedding"], width))
                enough = np.argmax(np.cumsum(counts[order], 1) >= min(n, 20 * k), axis=1) + 1
                looks = np.arange(lists) < np.maximum(enough, index.value.probes)[:, None]
                row, place = np.nonzero(looks & (counts[order] > 0))
                own = order[row, place]
                times = chunks[own]
                chunk = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row, own = np.repeat(row, times), np.repeat(own, times)
                picked = part.take(pa.array(row))
                split = (picked["query_id"].to_numpy() // 100) % splits
                yield pa.RecordBatch.from_arrays([pa.array(cell(own, chunk, split)), picked["query_id"], picked["embedding"]], ["cell", "query_id", "embedding"])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.Table.from_batches([], lists_schema)
        x, ids = matrix(left["embedding"], width), left["vec_id"].to_numpy()
        q, asked = matrix(right["embedding"], width), right["query_id"].to_numpy()
        rotated, turned = x @ index.value.rotation, q @ index.value.rotation
        found = [adaptive_scan(q[i], turned[i], x, rotated, ids, int(asked[i]), k) for i in range(len(q))]
        ends = np.cumsum([0, *(len(f[0]) for f in found)])
        tops = struct_lists(ends, score=np.concatenate([f[0] for f in found]), vec_id=np.concatenate([f[1] for f in found]))
        part = pa.array(np.full(len(q), right["cell"][0].as_py() % 1_048_576, "i4"))
        return pa.table({"query_id": asked, "part": part, "top": tops})

    lists_schema = pa.schema([("query_id", pa.int64()), ("part", pa.int32()), ("top", pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())])))])
    left = assigned.mapInArrow(route_rows, "cell long, vec_id long, embedding array<float>")
    right = queries.mapInArrow(route_queries, "cell long, query_id long, embedding array<float>")
    found = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(search, "query_id long, part int, top array<struct<score: double, vec_id: long>>")
    ranked = merge_tops(scratch(found, "found"), k).select("query_id", F.posexplode("top").alias("at", "one"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), "one.vec_id", "one.score")


def op2_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest neighbours found of every stated query."""
    return nearest(embeddings(spark, sf_dir))
