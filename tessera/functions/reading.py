"""Typed reads from a binary column at a byte offset, as native expressions.

Reads outside the blob give zero bytes, never an error or null: b"\\x01" read as a 16-bit
little-endian number is 1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def raw(content: Column | str, at: int | Column, size: int) -> Column:
    """size bytes from at (from 0 on), zero-filled past the end."""
    content = F.col(content) if isinstance(content, str) else content
    at = F.lit(at) if isinstance(at, int) else at
    return F.rpad(F.substring(content, at.cast("int") + 1, F.lit(size)), size, bytes(1))


def _number(content: Column | str, at: int | Column, size: int, little: bool) -> Column:
    digits = F.hex(raw(content, at, size))
    if little:
        digits = F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))))
    return F.conv(digits, 16, 10)


def u8(content: Column | str, at: int | Column) -> Column:
    return _number(content, at, 1, True).cast("int")


def i8(content: Column | str, at: int | Column) -> Column:
    return _signed(u8(content, at), 8).cast("int")


def _signed(value: Column, bits: int) -> Column:
    return F.when(value >= 1 << (bits - 1), value - (1 << bits)).otherwise(value)


def u16le(content: Column | str, at: int | Column) -> Column:
    return _number(content, at, 2, True).cast("int")


def u16be(content: Column | str, at: int | Column) -> Column:
    return _number(content, at, 2, False).cast("int")


def i16le(content: Column | str, at: int | Column) -> Column:
    return _signed(u16le(content, at), 16).cast("int")


def i16be(content: Column | str, at: int | Column) -> Column:
    return _signed(u16be(content, at), 16).cast("int")


def u32le(content: Column | str, at: int | Column) -> Column:
    return _number(content, at, 4, True).cast("long")


def u32be(content: Column | str, at: int | Column) -> Column:
    return _number(content, at, 4, False).cast("long")


def i32le(content: Column | str, at: int | Column) -> Column:
    return _signed(u32le(content, at), 32)


def i32be(content: Column | str, at: int | Column) -> Column:
    return _signed(u32be(content, at), 32)


def u64le(content: Column | str, at: int | Column) -> Column:
    return _number(content, at, 8, True).cast("decimal(20,0)")


def u64be(content: Column | str, at: int | Column) -> Column:
    return _number(content, at, 8, False).cast("decimal(20,0)")


def fourcc(content: Column | str, at: int | Column) -> Column:
    """Four bytes as Latin-1 text."""
    return F.decode(raw(content, at, 4), "ISO-8859-1")


def fixed_16_16(content: Column | str, at: int | Column) -> Column:
    return i32be(content, at) / 65536.0


def ascii_number(content: Column | str, at: int | Column, size: int, base: int) -> Column:
    """A number written in digits of the base, with spaces or NULs around it; null without digits."""
    text = F.decode(raw(content, at, size), "ISO-8859-1")
    digits = F.regexp_extract(text, r"^[\x00 ]*([0-9A-Za-z]+)", 1)
    return F.when(digits != "", F.conv(digits, base, 10)).cast("long")


def has_bytes(content: Column | str, at: int | Column, value: bytes) -> Column:
    """Whether value stands at the offset (past the end there are zero bytes)."""
    return raw(content, at, len(value)) == F.lit(value)


def has_pattern(content: Column | str, at: int | Column, value: bytes, wildcard: int) -> Column:
    """Like has_bytes, but the byte wildcard in value matches any byte."""
    pattern = "".join(".." if b == wildcard else f"{b:02X}" for b in value)
    return F.hex(raw(content, at, len(value))).rlike(f"^{pattern}$")


def extension(path: Column | str) -> Column:
    """What follows the last dot of a file name, in lower case; empty without one."""
    path = F.col(path) if isinstance(path, str) else path
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
