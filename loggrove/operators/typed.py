"""Typed value columns and the map from entries to dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loggrove.functions.text import is_number, number

NUMERIC = ["int64", "double", "float"]


def typed_values(records: DataFrame, data_type: str = "data_type", value: str = "value", strict: bool = False) -> DataFrame:
    """Adds boolean_value (text) and numeric_value (double) by declared type;
    other types have neither. Numbers that cannot be parsed are NULL, or raise
    where ``strict``. NaN becomes NULL, so that aggregates skip it."""
    numeric = F.when(F.col(data_type).isin(NUMERIC), F.col(value))
    return records.withColumns({"boolean_value": F.when(F.col(data_type) == "boolean", F.col(value)), "numeric_value": number(numeric, strict)})


def unparsed(records: DataFrame, data_type: str = "data_type", value: str = "value") -> DataFrame:
    """Records of a numeric type whose value is no number."""
    return records.where(no_number(data_type, value))


def no_number(data_type: str = "data_type", value: str = "value") -> Column:
    """Whether a record has a numeric type and a value that is no number."""
    return F.coalesce(F.col(data_type).isin(NUMERIC) & ~is_number(F.col(value)), F.lit(False))


def map_entries(records: DataFrame, entry_map: DataFrame, entry: str = "entry") -> DataFrame:
    """Left join with the entry map; Spark broadcasts the map while it is small."""
    return records.join(entry_map, entry, "left")


def map_lint(records: DataFrame, entry_map: DataFrame, entry: str = "entry") -> DataFrame:
    """entry, problem: rows of the map that no record has, and rows without a
    metric."""
    unused = entry_map.join(records.select(entry).distinct(), entry, "left_anti").select(entry, F.lit("unmatched").alias("problem"))
    return unused.unionByName(entry_map.where("metric is null").select(entry, F.lit("no metric").alias("problem")))


def union_frames(*frames: DataFrame) -> DataFrame:
    """Union by column name; columns that a frame lacks are NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
