"""Shards along a Hilbert curve, by DataFrame and SQL expressions only.

Each metadata dimension is quantised to 2**bits cells, a row's cells become its index on the
curve, rows are sorted by that index, and the sorted run is cut into shards. Rows of a shard are
then near one another in every dimension, so the minima and maxima of its columns prune files
for filters on any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, exclusive_prefix_sum, global_rank, scratch

#: Bytes of cells that may be broadcast, and parts of each value's rows beyond that.
SEND_BYTES = 16 << 20
SALTS = 64


def magnitude_cell(value: Column, bits: int = 6) -> Column:
    """A number from 1 by its power of two and the bit below that; falls into the last cell from there on."""
    power = (F.length(F.bin(value)) - 1).cast("int")
    half = F.when(power > 0, F.getbit(value, F.greatest(power - 1, F.lit(0))).cast("int")).otherwise(0)
    return F.least(power * 2 + half, F.lit((1 << bits) - 1)).cast("int")


def depth_cells(df: DataFrame, column: str, bits: int = 6) -> DataFrame:
    """For each distinct value, the cell by the share of rows with smaller values: cells hold about as many rows each.

    Columns: the column and <column>_cell. Nulls count as the empty text.
    """
    counts = df.groupBy(F.coalesce(F.col(column), F.lit("")).alias(column)).agg(F.count("*").alias("n"))
    placed = exclusive_prefix_sum(counts, [column], "n", "before")
    total = F.lit(df.count()).cast("long")
    return scratch(placed.withColumn("total", total).select(column, F.expr(f"cast(before * {1 << bits} div total as int)").alias(f"{column}_cell")), "cells")


def with_cells(rows: DataFrame, cells: DataFrame, column: str, key: str) -> DataFrame:
    """rows with the cell of their value of column. Cells of few bytes are broadcast; else rows of a value are dealt by key too, as one value may have any share of them."""
    size = cells.agg(F.sum(F.octet_length(column) + 16)).first()[0] or 0
    if size <= SEND_BYTES:
        return rows.join(F.broadcast(cells), column)
    salted = cells.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), [column, "_salt"]).drop("_salt")


def curve_steps(dims: int) -> tuple[list[int], list[int]]:
    """For each place w in a cell's walk through its 2**dims corners: the entry corner and the direction of the sub-cell.

    These follow from the reflected Gray code: the entry of w is the Gray code of the even number
    below w, its direction the count of trailing ones of w or w - 1.
    """
    gray = lambda x: x ^ (x >> 1)
    ones = lambda x: (~x & (x + 1)).bit_length() - 1
    corners = range(1 << dims)
    return [gray((w - 1) // 2 * 2) if w else 0 for w in corners], [ones(w if w % 2 else w - 1) % dims if w else 0 for w in corners]


def curve_index(cells: list[str], bits: int = 6) -> Column:
    """The index on the Hilbert curve of a row's cells (int columns from 0 to 2**bits - 1): a fold over bits, highest first."""
    n = len(cells)
    mask, entries, directions = (1 << n) - 1, *curve_steps(n)
    table = lambda xs, at: f"element_at(array({', '.join(map(str, xs))}), {at} + 1)"
    corner = " | ".join(f"shiftleft(shiftright({c}, i) & 1, {j})" for j, c in enumerate(cells))
    turn = f"((s.d + 1) % {n})"
    back = f"((shiftright(s.v, {turn}) | shiftleft(s.v, {n} - {turn})) & {mask})"
    ungray = " ^ ".join(f"shiftright(s.v, {j})" for j in range(n))
    rolled = lambda x: f"((shiftleft({x}, {turn}) | shiftright({x}, {n} - {turn})) & {mask})"
    # One bit takes three small steps, so that no expression is written out more than twice.
    step = f"""transform(array(named_struct('h', s.h, 'e', s.e, 'd', s.d, 'v', ({corner}) ^ s.e)), s ->
        named_struct('h', s.h, 'e', s.e, 'd', s.d, 'v', {back}))"""
    step = f"transform({step}, s -> named_struct('h', s.h, 'e', s.e, 'd', s.d, 'v', {ungray}))"
    step = f"""transform({step}, s -> named_struct('h', shiftleft(s.h, {n}) | s.v, 'e', s.e ^ {rolled(table(entries, "s.v"))},
        'd', (s.d + {table(directions, "s.v")} + 1) % {n}, 'v', 0))"""
    return F.expr(f"aggregate(sequence({bits - 1}, 0, -1), named_struct('h', 0L, 'e', 0, 'd', 0, 'v', 0), (s, i) -> element_at({step}, 1), s -> s.h)")


def hilbert_shards(rows: DataFrame, cells: list[str], shards: int, ties: list[str], bits: int = 6) -> DataFrame:
    """Adds curve, shard (0 to shards - 1, row counts at most one apart) and slot (place in the shard from 0).

    ties: columns that order rows of one cell; rows equal in all of them are interchangeable.
    An empty table gives an empty one.
    """
    curved = rows.withColumn("curve", curve_index(cells, bits))
    ranked = global_rank(curved, [F.col("curve"), *map(F.col, ties)], "_rank")
    n = F.lit(max(1, rows.count())).cast("long")
    exact = F.expr("(_rank * _k) div _n")
    first = F.expr("(shard * _n + _k - 1) div _k")
    return (
        ranked.withColumns({"_n": n, "_k": F.lit(shards).cast("long")})
        .withColumn("shard", exact.cast("int"))
        .withColumn("slot", F.col("_rank") - first)
        .drop("_n", "_k", "_rank")
    )


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Documents over size, language and source along the curve.

    Columns: doc_id, size (UTF-8 bytes and 1; null text: 1), text_crc32 (null text: that of no bytes),
    law, shard, slot, grown_shard (null under this law), curve. Null lang or source count as empty;
    columns besides these four of the input are not read.
    """
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
    ).withColumn("size_cell", magnitude_cell(F.col("size")))
    for c in ("lang", "source"):
        rows = with_cells(rows, depth_cells(docs, c), c, "doc_id")
    placed = hilbert_shards(rows.drop("lang", "source"), ["size_cell", "lang_cell", "source_cell"], shards, ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op7_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of equal row counts; nulls, repeated rows and ties as in shard_documents and hilbert_shards."""
    return shard_documents(documents(spark, sf_dir)).drop("curve")
