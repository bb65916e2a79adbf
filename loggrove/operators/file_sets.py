"""Groups log files into the sets of a match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loggrove.functions.text import extension, last_segment, name_part


def classify_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds kind (system, drive, rio or NULL) and match_id from the file name.
    Files of another kind are kept, never deleted."""
    name, end = last_segment(F.col(path)), extension(F.col(path))
    kind = F.when(end == ".wpilog", "system").when((end == ".hoot") & name.contains("rio"), "rio").when(end == ".hoot", "drive")
    match = F.when(end == ".wpilog", name_part(F.col(path), -1)).when(end == ".hoot", name_part(F.col(path), 1))
    return files.withColumns({"kind": kind, "match_id": match})


def match_file_sets(files: DataFrame, path: str = "path") -> DataFrame:
    """match_id and the sorted files of each kind, for matches with a system
    file."""
    lists = [F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col(path)))).alias(k) for k in ("system", "drive", "rio")]
    return classify_files(files, path).where("kind is not null and match_id is not null").groupBy("match_id").agg(*lists).where(F.size("system") > 0)


def orphan_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Device files of matches without a system file."""
    known = classify_files(files, path)
    return known.where("kind in ('drive', 'rio')").join(known.where("kind = 'system'").select("match_id").distinct(), "match_id", "left_anti")


def metadata_of_files(sets: DataFrame, metadata: DataFrame) -> DataFrame:
    """The metadata of a match for each of its files."""
    each = sets.select("match_id", F.explode(F.concat("system", "drive", "rio")).alias("path"))
    return each.withColumn("filename", last_segment(F.col("path"))).join(metadata.drop("filename"), "match_id", "left")
