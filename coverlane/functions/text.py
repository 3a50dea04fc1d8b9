"""Scalar helpers on text, time and maps. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Every character that Unicode-aware stripping removes.
BLANKS = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

BLANK_CHARS = "".join(chr(c) for c in (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Remove blanks of any kind from both ends (plain ``trim`` takes U+0020 only)."""
    return F.trim(col(value), F.lit(BLANK_CHARS))


def fold_name(value: Column | str) -> Column:
    """Collapse runs of blanks to one space, drop the outer ones, upper-case."""
    return F.upper(F.trim(F.regexp_replace(col(value), f"[{BLANKS}]+", " ")))


def full_name(*parts: Column | str) -> Column:
    """Stripped parts joined by one space each; a null part makes the name null."""
    spaced: list[Column] = []
    for part in parts:
        spaced += [F.lit(" "), strip(part)]
    return F.nullif(strip(F.concat(*spaced[1:])), F.lit(""))


def field(source: Column | str, key: str, default: Column | str | None = "") -> Column:
    """Map value by key. A missing key gives the default, an explicit null stays null."""
    source = col(source)
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.when(F.map_contains_key(source, key), source[key]).otherwise(fallback.cast("string"))


def has_value(value: Column | str) -> Column:
    """True for text that is neither null nor empty."""
    value = col(value)
    return F.coalesce(value != F.lit(""), F.lit(False))


def has_id(value: Column | str) -> Column:
    """True for an id that is neither null nor zero."""
    return F.coalesce(col(value) != F.lit(0), F.lit(False))


def first_filled(*values: Column | str) -> Column:
    """The first value that is neither null nor empty, else the empty text."""
    return F.coalesce(*[F.nullif(col(v), F.lit("")) for v in values], F.lit(""))


def shown(value: Column | str, placeholder: str) -> Column:
    return F.coalesce(F.nullif(col(value), F.lit("")), F.lit(placeholder))


def comma_list(value: Column | str) -> Column:
    """Split on commas; unset or empty text is an empty list, not a list of ''."""
    value = col(value)
    return F.when(has_value(value), F.split(value, ",")).otherwise(F.array().cast("array<string>"))


def flag(value: Column | str, truth: str = "true", default: str = "false") -> Column:
    return F.lower(F.coalesce(col(value), F.lit(default))) == F.lit(truth)


def number(value: Column | str, kind: str = "int", default: Column | float | None = None) -> Column:
    """Parse a number; unset text gives the default, unreadable text gives null."""
    value = col(value)
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.when(has_value(value), value.try_cast(kind)).otherwise(fallback.cast(kind))


def prefix(value: Column | str, length: int) -> Column:
    return F.substring(col(value), 1, length)


def contains_any(value: Column | str, words: list[str]) -> Column:
    value = col(value)
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(value, F.lit(word))
    return hit


def iso(ts: Column | str) -> Column:
    """ISO text; the fraction is written only when it is not zero."""
    ts = col(ts)
    fraction = F.date_format(ts, "SSSSSS")
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), fraction))


def stamp(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd HH:mm:ss")


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since the epoch, the same in every session time zone."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        since = F.col(name) - F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
        return (since.cast("interval second").cast("decimal(18,6)") * 1_000_000).cast("long")
    return F.unix_micros(F.col(name))


def seconds_between(start_micros: Column, end_micros: Column) -> Column:
    return (end_micros - start_micros) / F.lit(1_000_000.0)


def verdict(ok: Column) -> Column:
    # The two labels of a run report.
    return F.when(ok, "EXITOSO").otherwise("FALLIDO")


def stable_id(*parts: Column | str) -> Column:
    """A repeatable row id, so that a retried write makes the same row again."""
    return F.md5(F.concat_ws("-", *[col(p).cast("string") for p in parts]))
