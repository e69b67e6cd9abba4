"""Operators on whole blobs: splitting, joining, XOR, dumps and byte statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import dates
from tessera.functions.reading import raw, u16le, u32be, u32le, u64le


def split_blob(blobs: DataFrame, size: int, stride: int | None = None, most: int | None = 256) -> DataFrame:
    """path, part (from 0), at, content: chunks of size bytes every stride bytes (size, unless given); the last may be short.

    A blob of more than most chunks gives none unless most is None, as that is taken for a mistake.
    """
    stride = stride or size
    if size < 1 or stride < size:
        raise ValueError("size must be at least 1, and stride at least size")
    n = F.octet_length("content")
    wanted = blobs.filter(n > 0) if most is None else blobs.filter((n > 0) & (n <= most * stride))
    rows = wanted.select("path", "content", F.posexplode(F.expr(f"sequence(0, octet_length(content) - 1, {stride})")).alias("part", "at"))
    return rows.select("path", "part", "at", F.expr(f"substring(content, at + 1, {size})").alias("content"))


def join_blobs(parts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, content: the parts of each set one after another. A set is one value, so it must fit in a task, as blobs do."""
    grouped = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.hex("content").alias("digits")))).alias("parts"))
    return grouped.select(*keys, F.unhex(F.array_join(F.transform("parts", lambda x: F.coalesce(x["digits"], F.lit(""))), "")).alias("content"))


def xor_blob(content: Column | str, key: str = "FF") -> Column:
    """Each byte exclusive-or the key's (1 to 100 bytes in hexadecimal), over and over."""
    mask = np.frombuffer(bytes.fromhex(key), np.uint8)
    if not 1 <= len(mask) <= 100:
        raise ValueError("the key has 1 to 100 bytes")

    @F.pandas_udf("binary")
    def each(blobs: pd.Series) -> pd.Series:
        sizes = np.array([0 if b is None else len(b) for b in blobs])
        ends = np.cumsum(sizes)
        place = np.arange(sizes.sum()) - np.repeat(ends - sizes, sizes)
        turned = (np.frombuffer(b"".join(b for b in blobs if b), np.uint8) ^ mask[place % len(mask)]).tobytes()
        return pd.Series([None if b is None else turned[end - n : end] for b, n, end in zip(blobs, sizes, ends, strict=True)])

    return each(content)


def hexdump(blobs: DataFrame) -> DataFrame:
    """path, row, line: 16 bytes a row as decimal offset (as wide as the last), hexadecimal and ASCII; none for an empty blob."""
    rows = blobs.filter(F.octet_length("content") > 0).select("path", "content", F.posexplode(F.expr("sequence(0, octet_length(content) - 1, 16)")).alias("row", "at"))
    width = F.length((F.call_function("div", F.octet_length("content") - 1, F.lit(16)) * 16).cast("string"))
    piece = F.expr("substring(content, at + 1, 16)")
    digits = F.rpad(F.rtrim(F.lower(F.regexp_replace(F.hex(piece), "(..)", "$1 "))), 47, " ")
    shown = F.regexp_replace(F.decode(piece, "ISO-8859-1"), r"[^\x20-\x7E]", ".")
    offset = F.lpad(F.col("at").cast("string"), width, F.lit(" "))
    return rows.select("path", "row", F.concat(offset, F.lit(": "), digits, F.lit("  "), shown).alias("line"))


#: Bytes and blobs that are counted at once.
COUNTED_BYTES, COUNTED_BLOBS = 4 << 20, 8_192


def byte_frequencies(blobs: DataFrame) -> DataFrame:
    """path, byte, count, first (up to three first offsets), char (null unless printable ASCII) for every byte value that a blob has.

    Many blobs are counted in one pass over their bytes; none is split into rows of bytes. Null and empty blobs give no row.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = batch["content"].cast(pa.large_binary()).fill_null(b"")
            ends = np.frombuffer(content.buffers()[1], "i8")[content.offset : content.offset + len(content) + 1]
            data = np.frombuffer(content.buffers()[2] or b"", np.uint8)
            at = 0
            while at < len(content):
                to = min(at + COUNTED_BLOBS, max(at + 1, int(np.searchsorted(ends, ends[at] + COUNTED_BYTES, "right")) - 1))
                yield counted(batch["path"].slice(at, to - at), data[ends[at] : ends[to]], ends[at : to + 1] - ends[at])
                at = to

    return blobs.select("path", "content").mapInArrow(count, "path string, byte int, count long, first array<long>, char string")


def counted(paths: pa.Array, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)
    key = row * 256 + data
    counts = np.bincount(key, minlength=len(sizes) * 256)
    seen = np.flatnonzero(counts)
    index = np.zeros(len(counts), "i8")
    index[seen] = np.arange(len(seen))
    place, item = np.arange(len(data)) - offsets[row], index[key]
    first = np.full((len(seen), 3), -1)
    for k in range(3):
        first[item[::-1], k] = place[::-1]  # of several, the last one written stays: the least place
        later = place > first[item, k]
        place, item = place[later], item[later]
    known = first >= 0
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(known.sum(1))]), pa.int32()), pa.array(first[known]))
    value = seen % 256
    chars = pa.array([chr(v) if 0x20 <= v < 0x7F else None for v in range(256)], pa.string()).take(pa.array(value))
    return pa.RecordBatch.from_arrays([paths.take(pa.array(seen // 256)), pa.array(value, pa.int32()), pa.array(counts[seen]), lists, chars], ["path", "byte", "count", "first", "char"])


def total_bytes(frequencies: DataFrame) -> DataFrame:
    return frequencies.groupBy("path").agg(F.sum("count").alias("total"))


def as_dates(blobs: DataFrame) -> DataFrame:
    """The first eight bytes of each blob read as a time in six ways, as FILETIME (null where not valid)."""
    c = F.col("content")
    return blobs.select(
        "path",
        dates.from_filetime(u64le(c, 0).cast("decimal(20,0)")).cast("long").alias("filetime_le"),
        dates.from_unix(F.when(u32le(c, 0) > 0, u32le(c, 0))).alias("unix_le"), dates.from_unix(F.when(u32be(c, 0) > 0, u32be(c, 0))).alias("unix_be"),
        dates.from_mac(F.when(u32be(c, 0) > 0, u32be(c, 0))).alias("mac_be"),
        dates.from_dos(u16le(c, 2), u16le(c, 0)).alias("dos_time_date"), dates.from_dos(u16le(c, 0), u16le(c, 2)).alias("dos_date_time"),
    )


def find_bytes(content: Column | str, needle: bytes) -> Column:
    """The first offset of needle, -1 without one; an empty needle is found at 0. Each byte is one character of Latin-1, so places of characters are those of bytes."""
    place = F.locate(needle.decode("latin-1"), F.decode(content, "ISO-8859-1")) - 1
    return F.coalesce(place if needle else F.lit(0), F.lit(-1)).cast("long")


def all_zero(content: Column | str) -> Column:
    return ~F.hex(content).rlike("[1-9A-F]")


def is_ascii(content: Column | str) -> Column:
    return ~F.decode(content, "ISO-8859-1").rlike(r"[^\x00-\x7F]")


def first_bytes(blobs: DataFrame, size: int) -> DataFrame:
    """path, head: zero-filled beginnings of the same size."""
    return blobs.select("path", raw("content", 0, size).alias("head"))
