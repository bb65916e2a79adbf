"""Schemas of the telemetry tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {"STRING": T.StringType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType(), "BINARY": T.BinaryType()}


def _schema(columns: str) -> T.StructType:
    """'name TYPE, ..' as a schema; Spark's own parser would need a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])


MATCH_KEYS = ["event_year", "event", "match_id", "match_type", "replay_num"]
DIMS = ["subsystem", "assembly", "subassembly", "component"]
#: Metric of the long table and its column in the wide one.
DEVICE_METRICS = {"VOLTAGE": "voltage", "CURRENT": "current", "VELOCITY": "velocity", "POSITION": "position", "TEMP": "temperature"}

_KEYS = ", ".join(f"{k} STRING" for k in MATCH_KEYS)
_DIMS = ", ".join(f"{d} STRING" for d in DIMS)

RAW_RECORD = _schema("filename STRING, seq BIGINT, entry_id BIGINT, timestamp BIGINT, kind STRING, name STRING, type STRING, metadata STRING, payload BINARY")
LONG = _schema("filename STRING, seq BIGINT, entry STRING, data_type STRING, value STRING, timestamp BIGINT")
STAGED = _schema("entry STRING, data_type STRING, value STRING, timestamp BIGINT")
DEVICE_MAP = _schema(f"entry STRING, {_DIMS}, metric STRING")
VISION_MAP = _schema("entry STRING, camera STRING, metric STRING")
LOG_METADATA = _schema(
    "filename STRING, build_date STRING, commit_hash STRING, git_date STRING, git_branch STRING, project_name STRING, git_dirty STRING, "
    "event STRING, match_id STRING, replay_num STRING, match_type STRING, is_red_alliance STRING, station_num STRING"
)
DEVICE_RAW = _schema(f"filename STRING, {_KEYS}, entry STRING, data_type STRING, value STRING, timestamp BIGINT, match_time BIGINT, {_DIMS}, metric STRING, boolean_value STRING, numeric_value DOUBLE")
DEVICE_TELEMETRY = _schema(f"filename STRING, {_KEYS}, match_time BIGINT, {_DIMS}, position DOUBLE, velocity DOUBLE, voltage DOUBLE, current DOUBLE, temperature DOUBLE")
DEVICE_STATS = _schema(f"filename STRING, {_KEYS}, {_DIMS}, " + ", ".join(f"{s}_{m} DOUBLE" for m in ("velocity", "voltage", "current", "temperature", "position") for s in ("avg", "min", "max", "stddev")))
VISION_RAW = _schema(f"filename STRING, {_KEYS}, entry STRING, data_type STRING, value STRING, timestamp BIGINT, match_time BIGINT, camera STRING, metric STRING, boolean_value STRING, numeric_value DOUBLE")
VISION_TELEMETRY = _schema(f"filename STRING, {_KEYS}, match_time BIGINT, camera STRING, latency DOUBLE, hasTarget STRING")
VISION_STATS = _schema(f"filename STRING, {_KEYS}, camera STRING, avg_latency DOUBLE, min_latency DOUBLE, max_latency DOUBLE, stddev_latency DOUBLE")
PREFERENCES = _schema(f"filename STRING, {_KEYS}, entry STRING, data_type STRING, value STRING")
#: ``outcome``: started, imported, waiting, superseded (another version of the name won) or not a log.
LEDGER = _schema("filename STRING, import_timestamp BIGINT, file_hash STRING, success BOOLEAN, last_attempt_timestamp BIGINT, attempt_id BIGINT, modified BIGINT, outcome STRING")
#: Files that have come in: ``kind`` and ``match_id`` are read from the name.
FILES = _schema("filename STRING, path STRING, file_hash STRING, modified BIGINT, kind STRING, match_id STRING")
COUNTS = _schema("attempt_id BIGINT, counter STRING, n BIGINT")
ELECTRICAL_SUMMARY = _schema("event STRING, match_id STRING, subsystem STRING, component STRING, part STRING, type STRING, metric STRING, max_abs_value DOUBLE, min_abs_value DOUBLE, avg_abs_value DOUBLE")


def conform(frame: DataFrame, schema: T.StructType) -> DataFrame:
    """The frame with the columns and types of ``schema``; columns that it lacks
    are NULL. A column that the schema does not know is an error."""
    unknown = set(frame.columns) - set(schema.names)
    if unknown:
        raise ValueError(f"columns that the table does not have: {sorted(unknown)}")

    def column(f: T.StructField) -> Column:
        return (F.col(f.name) if f.name in frame.columns else F.lit(None)).cast(f.dataType).alias(f.name)

    return frame.select(*map(column, schema.fields))
