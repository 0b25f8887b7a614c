"""Column functions that parse and format reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_bool(c: Column) -> Column:
    """True for the text ``True`` alone; anything else, null too, is False."""
    return F.coalesce(c.cast("string") == "True", F.lit(False))


def native_bool(c: Column) -> Column:
    """A boolean column with null as False."""
    return F.coalesce(c.cast("boolean"), F.lit(False))


def parse_double(c: Column) -> Column:
    """The number, or null for bad text; NaN gives null."""
    number = c.try_cast("double")
    return F.when(~F.isnan(number), number)


def parse_long(c: Column) -> Column:
    """An integer by way of a double, so ``12.0`` is 12; a fraction is cut."""
    return parse_double(c).try_cast("bigint")


def parse_byte(c: Column, default: int = 0) -> Column:
    return F.coalesce(parse_double(c), F.lit(float(default))).cast("tinyint")


def trim_reported(c: Column) -> Column:
    """Trimmed; empty gives null, but blanks alone give ''."""
    return F.when(c != "", F.trim(c))


def trim_stored(c: Column) -> Column:
    """Trimmed; empty and blanks alone give null."""
    return F.nullif(F.trim(c), F.lit(""))


def parse_longs(c: Column) -> Column:
    """``[1, 2]`` or ``(1, 2)`` as an array; empty lists and bad text give null."""
    found = F.from_json(F.translate(c, "()", "[]"), "array<bigint>", {"mode": "PERMISSIVE"})
    return F.when((F.size(found) > 0) & F.trim(c).rlike(r"^[\[(][-0-9, ]*[\])]$"), found)


def parse_utc(c: Column) -> Column:
    """A timestamp; text without an offset is taken as UTC in a UTC session, bad text gives null."""
    return F.try_to_timestamp(c)


def has_offset(c: Column) -> Column:
    """Whether a timestamp's text names an offset."""
    return F.coalesce(c.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.lit(False))


def zone_assumed(c: Column) -> Column:
    """Whether a time's text is good but names no offset."""
    return parse_utc(c).isNotNull() & ~has_offset(c)


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970, microseconds as a fraction."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def rounded_epoch(ts: Column) -> Column:
    """Whole seconds since 1970, halves to even."""
    return F.rint(epoch_seconds(ts)).cast("bigint")


def micros_of(seconds: Column) -> Column:
    """The timestamp of fractional epoch seconds, to the nearest microsecond."""
    return F.timestamp_micros(F.rint(seconds * 1e6).cast("bigint"))


def date_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def slug(c: Column) -> Column:
    return F.lower(F.replace(c, F.lit(" "), F.lit("_")))


def file_safe(c: Column) -> Column:
    return F.replace(c, F.lit(":"), F.lit("-"))


def numbered(prefix: Column, i: Column) -> Column:
    return F.format_string("%s_%06d", prefix, i)
