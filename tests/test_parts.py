"""Answers of Python columns come back in parts of bounded size, whole and in order."""

import pyarrow as pa
from pyspark.sql import functions as F

from tessera import queries
from tessera.operators import codecs, parts, rasters


def batches_of(column, monkeypatch):
    """What a column's function yields for one batch of blobs."""
    seen = {}
    monkeypatch.setattr(F, "arrow_udf", lambda f, returns: lambda *of: seen.setdefault("f", f))
    column()
    monkeypatch.undo()
    return seen["f"]


def test_parts_are_bounded():
    found = list(parts.parts(((bytes(n), n) for n in (3, 3, 3, 10, 1)), lambda rows: pa.array(rows, pa.binary()), 6))
    assert [[len(x) for x in part.to_pylist()] for part in found] == [[3, 3], [3, 10], [1]]
    assert list(parts.parts(iter(()), pa.array)) == []


def test_made_blobs_leave_in_parts(monkeypatch):
    """One batch of 200 small rows that grow to 20 MB."""
    each = batches_of(lambda: queries.made(lambda b: b * 100_000), monkeypatch)
    found = list(each(iter([pa.array([b"x"] * 200, pa.binary())])))
    assert max(part.nbytes for part in found) < 2 * parts.PART and sum(map(len, found)) == 200


def test_rasters_leave_in_parts(monkeypatch):
    picture = b"P5 1000 1000 255\n" + bytes(1_000_000)
    each = batches_of(lambda: rasters.raster("content", "pnm"), monkeypatch)
    found = list(each(iter([pa.array([picture] * 20, pa.binary())])))
    assert max(part.nbytes for part in found) < 2 * parts.PART and sum(map(len, found)) == 20


def test_columns_in_parts_keep_rows_and_order(spark):
    blobs = spark.range(500).select("id", F.encode(F.repeat(F.lit("x"), (F.col("id") % 50 * 4_000).cast("int")), "UTF-8").alias("content"))
    found = blobs.select("id", queries.made(lambda b: b + b"!").alias("m")).select("id", "m", codecs.decompress("m", "stored", F.col("id")).alias("d")).collect()
    assert len(found) == 500 and all(r.m == b"x" * (r.id % 50 * 4_000) + b"!" and r.d.data == bytes(r.m)[: r.id] for r in found)
    nulls = spark.createDataFrame([(1, None), (2, bytearray(b"\0a"))], "id int, content binary").select("id", codecs.decompress("content", "packbits").alias("d")).orderBy("id").collect()
    assert nulls[0].d is None and nulls[1].d.data == b"a"
