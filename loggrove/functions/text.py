"""Expressions over entry names, file names and values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that count as missing when staged records are read.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def null_if_missing(value: Column, missing: list[str] = MISSING) -> Column:
    """NULL for the texts that count as missing."""
    return F.when(~value.isin(missing), value)


def without_prefix(entry: Column, *prefixes: str) -> Column:
    """The entry with every occurrence of the literal prefixes removed."""
    for prefix in prefixes:
        entry = F.replace(entry, F.lit(prefix), F.lit(""))
    return entry


def one_line(value: Column) -> Column:
    """CR and LF each become a blank."""
    return F.translate(value, "\r\n", "  ")


def key_value(line: Column) -> Column:
    """struct(key, value) of 'key: value'; NULL unless there is exactly one ': '."""
    parts = F.split(line, ": ", -1)
    return F.when(F.size(parts) == 2, F.struct(F.get(parts, F.lit(0)).alias("key"), F.get(parts, F.lit(1)).alias("value")))


def last_segment(path: Column, separator: str = "/") -> Column:
    return F.substring_index(path, separator, -1)


def stem(path: Column) -> Column:
    """The base name without what follows its last dot."""
    return F.regexp_replace(last_segment(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    """What follows the last dot of the base name, with the dot."""
    return F.regexp_extract(last_segment(path), r"\.[^.]*$", 0)


def name_part(path: Column, index: int) -> Column:
    """A part of the stem between underscores; negative counts from the end."""
    parts = F.split(stem(path), "_")
    return F.try_element_at(parts, F.lit(index + 1 if index >= 0 else index))


NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity|nan)\s*$"


def is_number(text: Column) -> Column:
    """Whether a text is a decimal number (a suffix as in 1d and hexadecimal digits
    make none), infinity or NaN."""
    return text.rlike(NUMBER)


def number(text: Column, strict: bool = False) -> Column:
    """DOUBLE of a text; NULL where it is NaN or no number, or, where ``strict``, an
    error for what is no number."""
    plain = F.when(is_number(text), text.try_cast("double"))
    if strict:
        # the cast fails with the text in its message
        plain = plain.when(text.isNotNull(), F.concat(F.lit("not a decimal number: "), text).cast("double"))
    return F.nanvl(plain, F.lit(None).cast("double"))


def wall_clock(micros: Column) -> Column:
    """Microseconds since 1970 as a timestamp."""
    return F.timestamp_micros(micros)


def seconds(micros: Column) -> Column:
    return micros / F.lit(1e6)
