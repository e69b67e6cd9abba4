"""Timestamps of old formats as native expressions.

All give FILETIME: units of 100 ns since 1601-01-01 UTC as a long, or null where the source value is
not valid. Days up to 31 are taken in any month, and second 60 in any minute; both roll over.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIX_EPOCH = 86_400 * (369 * 365 + 89)  # seconds from 1601 to 1970
SECOND = 10_000_000
LAST = (910_692_730_085 + UNIX_EPOCH) * SECOND  # in the year 30828


def div(value: Column, by: int) -> Column:
    """Whole-number division; doubles would not hold these values."""
    return F.call_function("div", value, F.lit(by))


def from_unix(seconds: Column) -> Column:
    value = (seconds.cast("long") + UNIX_EPOCH) * SECOND
    return F.when((seconds > -UNIX_EPOCH) & (value <= LAST), value)


def from_filetime(value: Column) -> Column:
    return F.when(value > 0, value.cast("long"))


def from_mac(seconds: Column) -> Column:
    """Seconds since 1904."""
    return from_unix(seconds - 2_082_844_800)


def from_parts(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    good = year.between(1601, 30_828) & month.between(1, 12) & day.between(1, 31) & hour.between(0, 23) & minute.between(0, 59) & second.between(0, 60)
    days = F.unix_date(F.make_date(F.when(good, year), month, F.lit(1))) + day - 1
    return from_unix(days.cast("long") * 86_400 + hour * 3_600 + minute * 60 + second)


def bits(value: Column, low: int, width: int) -> Column:
    return F.shiftright(value, low).bitwiseAND((1 << width) - 1)


def from_dos(date: Column, time: Column) -> Column:
    """16-bit date and time of FAT file systems, two seconds exact; date 0 is none."""
    return F.when(date != 0, from_parts(bits(date, 9, 7) + 1980, bits(date, 5, 4), bits(date, 0, 5), bits(time, 11, 5), bits(time, 5, 6), bits(time, 0, 5) * 2))


def from_prodos(date: Column, time: Column) -> Column:
    """16-bit date and time of ProDOS, one minute exact; date 0 or unused bits in the time are none."""
    good = (date != 0) & (time.bitwiseAND(0xE0C0) == 0)
    return F.when(good, from_parts(bits(date, 9, 7) + 1900, bits(date, 5, 4), bits(date, 0, 5), bits(time, 8, 5), bits(time, 0, 6), F.lit(0)))


def from_riscos(load: Column, execute: Column) -> Column:
    """Load and execution addresses that hold centiseconds since 1900; other load addresses are none."""
    stamped = bits(load, 20, 12) == 0xFFF
    centi = bits(load, 0, 8) * (1 << 32) + execute
    seconds = div(centi, 100) - 2_208_988_800
    exact = (centi - 220_898_880_000 + UNIX_EPOCH * 100) * (SECOND // 100)
    return F.when(stamped & (seconds > 0) & (seconds < 8_000_000_000), exact)


def to_utc(filetime: Column, minutes_east: Column) -> Column:
    """A local time as UTC, by how far its zone lies east of it; without a zone it stays."""
    return filetime - F.coalesce(minutes_east.cast("long"), F.lit(0)) * 60 * SECOND


def fields_of(filetime: Column) -> Column:
    """A struct of year, month, day, hour, minute, second and hundred-nanoseconds."""
    when = F.timestamp_seconds(to_unix(filetime))
    parts = {"year": F.year(when), "month": F.month(when), "day": F.day(when), "hour": F.hour(when), "minute": F.minute(when), "second": F.second(when), "ticks": F.pmod(filetime, F.lit(SECOND))}
    return F.struct(*(c.cast("int").alias(n) for n, c in parts.items()))


def to_unix(filetime: Column) -> Column:
    return div(filetime, SECOND) - UNIX_EPOCH


def to_timestamp(filetime: Column) -> Column:
    """A Spark timestamp, cut to microseconds."""
    return F.timestamp_micros(div(filetime, 10) - UNIX_EPOCH * 1_000_000)


def to_text(filetime: Column, precision: Column, utc: Column) -> Column:
    """The time as text: a date alone for precision "day", milliseconds only for "high", " UTC" if the zone is known."""
    when = to_timestamp(filetime)
    shown = F.when(precision == "day", F.date_format(when, "yyyy-MM-dd")).when(precision == "high", F.date_format(when, "yyyy-MM-dd HH:mm:ss.SSS")).otherwise(F.date_format(when, "yyyy-MM-dd HH:mm:ss"))
    return F.concat(shown, F.when(utc & (precision != "day"), " UTC").otherwise(""))
