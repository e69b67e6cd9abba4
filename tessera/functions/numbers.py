"""Sample scaling, colours and small integer helpers as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad_to(value: Column, unit: int) -> Column:
    """The least multiple of unit from value on."""
    return F.call_function("div", value + unit - 1, F.lit(unit)) * unit


def log2_up(value: Column) -> Column:
    """The least n with 2**n >= value; 0 for values below 2."""
    return F.when(value < 2, 0).otherwise(F.length(F.bin(value - 1))).cast("int")


def copy_bits(value: Column, start: int, n: int, to: int) -> Column:
    """n bits of value from bit start on (0 the lowest), at bit to of the result."""
    return F.shiftleft(F.shiftright(value.cast("long"), start).bitwiseAND(F.lit((1 << n) - 1)), to)


def short_number(first: Column, second: Column) -> Column:
    """A help file's number of one or two bytes: half the first byte if that is even, else half of both (least byte first)."""
    return F.when(first % 2 == 0, F.shiftright(first, 1)).otherwise(F.shiftright(first + second * 256, 1)).cast("int")


def scale_16(value: Column) -> Column:
    """A sample of 16 bits as one of 8."""
    return F.call_function("div", value * 510 + 65_535, F.lit(131_070)).cast("int")


def constrain(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


def scale_to_255(value: Column, top: int) -> Column:
    """A sample from 0 to top as one from 0 to 255, to the nearest."""
    return F.call_function("div", value * 510 + top, F.lit(2 * top)).cast("int")


def _rgb(r: Column, g: Column, b: Column) -> Column:
    return (F.lit(0xFF000000) + r * 65_536 + g * 256 + b).cast("long")


def _bits(value: Column, low: int, width: int) -> Column:
    return F.shiftright(value, low).bitwiseAND((1 << width) - 1)


def rgb565(value: Column) -> Column:
    """A 16-bit colour of 5, 6 and 5 bits as opaque 32-bit ARGB."""
    return _rgb(scale_to_255(_bits(value, 11, 5), 31), scale_to_255(_bits(value, 5, 6), 63), scale_to_255(_bits(value, 0, 5), 31))


def rgb555(value: Column) -> Column:
    return _rgb(*(scale_to_255(_bits(value, at, 5), 31) for at in (10, 5, 0)))


def bgr555(value: Column) -> Column:
    return _rgb(*(scale_to_255(_bits(value, at, 5), 31) for at in (0, 5, 10)))


def css_colour(argb: Column) -> Column:
    """#rrggbb, or rgba() with the opacity in thousandths if not opaque."""
    r, g, b, a = (_bits(argb, at, 8) for at in (16, 8, 0, 24))
    return F.when(a == 255, F.lower(F.format_string("#%02x%02x%02x", r, g, b))).otherwise(F.format_string("rgba(%d,%d,%d,%.3f)", r, g, b, a / 255))


def dos_attributes(value: Column) -> Column:
    """The set attributes of a DOS file by name."""
    names = ((0x01, "read-only"), (0x02, "hidden"), (0x04, "system"), (0x08, "volume label"), (0x10, "directory"), (0x20, "archive"))
    named = F.array(*(F.when(value.bitwiseAND(bit) != 0, name) for bit, name in names))
    return F.array_join(F.array_compact(named), " | ")
