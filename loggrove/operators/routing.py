"""Routes long records by entry prefix and gathers session metadata."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loggrove.functions.text import key_value, last_segment, without_prefix

# Names in the logs and the columns of the metadata table.
METADATA_COLUMNS = {
    "Project Name": "project_name", "Build Date": "build_date", "Commit Hash": "commit_hash",
    "Git Date": "git_date", "Git Branch": "git_branch", "GitDirty": "git_dirty",
}
MATCH_COLUMNS = {
    "EventName": "event", "MatchNumber": "match_id", "ReplayNumber": "replay_num",
    "MatchType": "match_type", "IsRedAlliance": "is_red_alliance", "StationNumber": "station_num",
}


@dataclass(frozen=True)
class Prefixes:
    """Entry prefixes of a season. ``vision`` lists those that select vision
    records; ``strip`` those that are cut from their entries."""

    metadata: str
    metrics: str
    preferences: str
    match_info: str
    vision: tuple[str, ...]
    strip: tuple[str, ...]

    @staticmethod
    def read(spark: SparkSession, path: str, both_vision: bool = False) -> Prefixes:
        row = spark.read.option("multiLine", True).json(path).first()
        photon, camera = row["photon_prefix"], row["camerapub_prefix"]
        return Prefixes(row["metadata_prefix"], row["metrics_prefix"], row["preferences_prefix"], row["fms_prefix"], (photon, camera) if both_vision else (photon,), (photon, camera))


def route(records: DataFrame, prefixes: Prefixes, entry: str = "entry") -> dict[str, DataFrame]:
    """The records by kind. A record may take several routes; one whose entry is
    NULL takes none (see ``unrouted``). Filters on a prefix reach the scan."""

    def of(*wanted: str) -> DataFrame:
        return records.where(reduce(or_, [F.col(entry).startswith(p) for p in wanted]))

    return {
        "metadata": of(prefixes.metadata),
        "match_info": of(prefixes.match_info),
        "metrics": of(prefixes.metrics).withColumn(entry, without_prefix(F.col(entry), prefixes.metrics)),
        "vision": of(*prefixes.vision).withColumn(entry, without_prefix(F.col(entry), *prefixes.strip)),
        "preferences": of(prefixes.preferences),
    }


def unrouted(records: DataFrame, entry: str = "entry") -> DataFrame:
    """Records that no route can take because they have no entry."""
    return records.where(F.col(entry).isNull())


def pivot_last(pairs: DataFrame, session: list[str], key: str, value: str, order: str, columns: dict[str, str]) -> DataFrame:
    """One row per session with the last value of each key, even a NULL one.
    ``columns``: key to column name. One aggregation with a map-side part."""
    # a value inside a struct is never skipped for being NULL
    last = [F.max_by(F.struct(F.col(value).alias("v")), F.when(F.col(key) == k, F.col(order)))["v"].alias(c) for k, c in columns.items()]
    return pairs.groupBy(*session).agg(*last)


def session_metadata(metadata: DataFrame, match_info: DataFrame, session: str = "filename", order: str = "seq", strict: bool = False) -> DataFrame:
    """One row per session from 'key: value' lines and match-info entries. Lines
    without exactly one ': ' are left out, or raise where ``strict``."""
    pair = key_value(F.col("value"))
    if strict:
        pair = F.coalesce(pair, F.raise_error(F.concat(F.lit("not a 'key: value' line: "), F.coalesce("value", F.lit("NULL")))))
    lines = metadata.select(session, F.col(order).alias("place"), pair.alias("pair")).select(session, "place", F.col("pair.key").alias("key"), F.col("pair.value").alias("value"))
    info = match_info.select(session, F.col(order).alias("place"), last_segment(F.col("entry")).alias("key"), "value").where(F.col("key").isin(list(MATCH_COLUMNS)))
    # match info overrides lines of the same name, so its place counts higher
    both = lines.withColumn("rank", F.struct(F.lit(0), "place")).unionByName(info.withColumn("rank", F.struct(F.lit(1), "place")))
    return pivot_last(both, [session], "key", "value", "rank", METADATA_COLUMNS | MATCH_COLUMNS)


def malformed_metadata(metadata: DataFrame) -> DataFrame:
    """The lines that ``session_metadata`` leaves out."""
    return metadata.where(key_value(F.col("value")).isNull())


def with_match_keys(frame: DataFrame, metadata: DataFrame, year: str | None = None, session: str = "filename") -> DataFrame:
    """Adds the match keys of each session; NULL where the session has none."""
    keys = ["event", "match_id", "match_type", "replay_num"]
    return frame.join(metadata.select(session, *keys), session, "left").withColumn("event_year", F.lit(year).cast("string"))
