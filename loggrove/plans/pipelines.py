"""The import pipelines, each one lazy plan over any number of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loggrove.functions.text import last_segment
from loggrove.operators.file_sets import match_file_sets, metadata_of_files
from loggrove.operators.period import file_clock, match_period, trim
from loggrove.operators.routing import Prefixes, route, session_metadata, with_match_keys
from loggrove.operators.typed import map_entries, typed_values
from loggrove.operators.wide import camera_stats, electrical_summary, metric_stats, widen
from loggrove.schemas import DEVICE_METRICS, DEVICE_RAW, DEVICE_STATS, DEVICE_TELEMETRY, DIMS, LOG_METADATA, MATCH_KEYS, PREFERENCES, VISION_RAW, VISION_STATS, VISION_TELEMETRY, conform

STATS = {name: metric for metric, name in DEVICE_METRICS.items()}
WIDE = {name: (metric, "numeric_value") for metric, name in DEVICE_METRICS.items()}
VISION = {"hasTarget": ("HAS_TARGET", "boolean_value"), "latency": ("LATENCY", "numeric_value")}


SESSION = ["filename", *MATCH_KEYS]


def device_tables(mapped: DataFrame, session: list[str]) -> tuple[DataFrame, DataFrame]:
    """Telemetry and statistics of mapped, typed and clocked device records."""
    return widen(mapped, [*session, "match_time", *DIMS], WIDE), metric_stats(mapped, [*session, *DIMS], STATS)


def vision_tables(mapped: DataFrame, session: list[str]) -> tuple[DataFrame, DataFrame]:
    return widen(mapped, [*session, "match_time", "camera"], VISION), camera_stats(mapped, session)


def derived_tables(device_raw: DataFrame, vision_raw: DataFrame | None = None) -> dict[str, DataFrame]:
    """Telemetry and statistics of raw rows. An import gives them the raw rows that
    it has stored, so that logs are not read again for each table."""
    telemetry, stats = device_tables(device_raw, SESSION)
    out = {"device_telemetry": conform(telemetry, DEVICE_TELEMETRY), "device_stats": conform(stats, DEVICE_STATS)}
    if vision_raw is not None:
        sights, sight_stats = vision_tables(vision_raw, SESSION)
        out |= {"vision_telemetry": conform(sights, VISION_TELEMETRY), "vision_stats": conform(sight_stats, VISION_STATS)}
    return out


def _whole(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return raw | derived_tables(raw["device_data_raw"], raw.get("vision_data_raw"))


def system_raw(records: DataFrame, device_map: DataFrame, vision_map: DataFrame, prefixes: Prefixes, year: str | None = None, open_end: str = "drop") -> dict[str, DataFrame]:
    """System logs (LONG) to metadata, raw device and vision rows and preferences. A
    file is a session of its own throughout, so many files together give the union of
    single runs."""
    routed = route(records, prefixes)
    metadata = session_metadata(routed["metadata"], routed["match_info"])
    # every file has a row, also one that says nothing about itself
    metadata = records.select("filename").distinct().join(metadata, "filename", "left")
    period = match_period(records, ["filename"])
    keyed = lambda f: with_match_keys(f, metadata, year)
    raw = lambda f, m: keyed(map_entries(typed_values(trim(f, period, ["filename"], open_end=open_end)), m)).drop("seq")
    return {
        "log_metadata": conform(metadata, LOG_METADATA),
        "device_data_raw": conform(raw(routed["metrics"], device_map), DEVICE_RAW),
        "vision_data_raw": conform(raw(routed["vision"], vision_map), VISION_RAW),
        "preferences": conform(keyed(routed["preferences"]).drop("seq", "timestamp"), PREFERENCES),
    }


def ingest_system(records: DataFrame, device_map: DataFrame, vision_map: DataFrame, prefixes: Prefixes, year: str | None = None, open_end: str = "drop") -> dict[str, DataFrame]:
    """System logs (LONG) to their eight tables."""
    return _whole(system_raw(records, device_map, vision_map, prefixes, year, open_end))


def match_raw(system: DataFrame, drive: DataFrame, rio: DataFrame, files: DataFrame, drive_map: DataFrame, rio_map: DataFrame, vision_map: DataFrame, prefixes: Prefixes, year: str | None = None, open_end: str = "drop", kept: Callable[[DataFrame, str], DataFrame] = lambda frame, name: frame) -> dict[str, DataFrame]:
    """Matches of a system log and device logs to metadata, raw rows and
    preferences. ``files`` (path) tells which files belong together; the system log's period
    trims them all and its metadata is theirs. Of several system logs of a match the
    one with the last name counts. System metrics are not used; preferences are not
    trimmed. ``kept`` may store what all tables need of a match (its files, metadata
    and period, a few rows each), so that they are not made anew for each."""
    sets = match_file_sets(files).withColumn("system", F.slice("system", -1, 1))
    sets = kept(sets, "sets")
    of_file = sets.select("match_id", F.explode(F.concat("system", "drive", "rio")).alias("path")).select(F.col("match_id").alias("file_match"), last_segment(F.col("path")).alias("filename"))
    leading = sets.select(F.col("match_id").alias("file_match"), last_segment(F.col("system")[0]).alias("filename"))
    system = system.join(leading, "filename")
    routed = route(system, prefixes)
    own = session_metadata(routed["metadata"], routed["match_info"], session="file_match")
    metadata = kept(of_file.join(own, "file_match", "left").drop("file_match"), "metadata")
    period = kept(match_period(system, ["file_match"]), "period")
    keyed = lambda f: with_match_keys(f, metadata, year)
    inside = lambda f, m: map_entries(typed_values(trim(f, period, ["file_match"], open_end=open_end)), m)
    devices = inside(drive.join(of_file, "filename"), drive_map).unionByName(inside(rio.join(of_file, "filename"), rio_map))
    return {
        "log_metadata": conform(metadata, LOG_METADATA),
        "device_data_raw": conform(keyed(devices).drop("seq", "file_match"), DEVICE_RAW),
        "vision_data_raw": conform(keyed(inside(routed["vision"], vision_map)).drop("seq", "file_match"), VISION_RAW),
        "preferences": conform(keyed(routed["preferences"]).drop("seq", "timestamp", "file_match"), PREFERENCES),
    }


def ingest_matches(system: DataFrame, drive: DataFrame, rio: DataFrame, files: DataFrame, drive_map: DataFrame, rio_map: DataFrame, vision_map: DataFrame, prefixes: Prefixes, year: str | None = None, open_end: str = "drop") -> dict[str, DataFrame]:
    """Matches (LONG of their system, drive and rio logs) to their eight tables."""
    return _whole(match_raw(system, drive, rio, files, drive_map, rio_map, vision_map, prefixes, year, open_end))


def device_raw(records: DataFrame, drive_map: DataFrame, rio_map: DataFrame) -> dict[str, DataFrame]:
    """Standalone device logs to raw rows: a clock per file, no trim and no match
    keys. The file name tells which map applies."""
    typed = file_clock(typed_values(records), ["filename"])
    is_rio = F.coalesce(F.col("filename").contains("rio"), F.lit(False))
    mapped = map_entries(typed.where(~is_rio), drive_map).unionByName(map_entries(typed.where(is_rio), rio_map)).drop("seq")
    return {"device_data_raw": conform(mapped, DEVICE_RAW)}


def ingest_devices(records: DataFrame, drive_map: DataFrame, rio_map: DataFrame) -> dict[str, DataFrame]:
    """Standalone device logs to their three tables."""
    return _whole(device_raw(records, drive_map, rio_map))


def summary_input(device_raw: DataFrame) -> DataFrame:
    """The summary's view of raw device rows: assembly is the part, subassembly
    the type."""
    return device_raw.withColumnsRenamed({"assembly": "part", "subassembly": "type"})


def summarize(device_raw: DataFrame) -> DataFrame:
    """Electrical summary by event, match, subsystem, component, part, type and
    metric."""
    return electrical_summary(summary_input(device_raw), ["event", "match_id", "subsystem", "component", "part", "type", "metric"])


def match_files(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """Every file of every match with the match's metadata."""
    return metadata_of_files(match_file_sets(files), metadata)
