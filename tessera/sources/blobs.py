"""Tables of blobs: one row for each binary artifact, with a path that names it and its content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOB_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def blobs_from_files(spark: SparkSession, *paths: str, glob: str | None = None) -> DataFrame:
    """Files as blobs. Projections that leave content out do not read it."""
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(list(paths))


def blob_stream(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """Files as they arrive; all operators on single blobs work on it unchanged."""
    reader = spark.readStream.format("binaryFile").schema(BLOB_SCHEMA)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)


def blobs_from_column(rows: DataFrame, path: str, content: str) -> DataFrame:
    """A text or binary column as blobs, named by another column. A null is an empty blob."""
    value = F.col(content)
    if dict(rows.dtypes)[content] != "binary":
        value = F.encode(value, "UTF-8")
    return rows.select(F.col(path).cast("string").alias("path"), F.coalesce(value, F.lit(b"")).alias("content")).withColumn("length", F.octet_length("content").cast("long"))


def with_companions(blobs: DataFrame, companions: DataFrame, key: str = "path", most: int = 32 << 20) -> DataFrame:
    """blobs with the content of the other file that goes with each (column companion; null without one): a palette, a list of names, the other part of a set.

    companions: key, content; of several, the least. They are broadcast while they have most bytes at most, else joined by a shuffle.
    """
    other = companions.groupBy(key).agg(F.min("content").alias("companion"))
    size = other.agg(F.sum(F.octet_length("companion").cast("long"))).first()[0] or 0
    return blobs.join(F.broadcast(other) if size <= most else other, key, "left")


def slice_blob(content: Column, start: int | Column = 0, size: int | Column | None = None) -> Column:
    """size bytes from start (to the end without size); null unless 0 <= start and the slice lies within the blob."""
    start = F.lit(start) if isinstance(start, int) else start
    size = F.octet_length(content) - start if size is None else F.lit(size) if isinstance(size, int) else size
    fits = (start >= 0) & (size >= 0) & (start + size <= F.octet_length(content))
    return F.when(fits, F.substring(content, start + 1, size))


def overlay_start(content: Column) -> Column:
    """Where the data appended to a DOS executable begins, by its header; null for other blobs."""
    from tessera.functions.reading import u16le

    pages, last = u16le(content, 4), u16le(content, 2)
    end = F.when(last > 0, (pages - 1) * 512 + last).otherwise(pages * 512)
    return F.when(F.substring(content, 1, 2).isin(bytearray(b"MZ"), bytearray(b"ZM")), end)
