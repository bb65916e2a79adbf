"""Active period of a session, trimming to it, and clocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def match_period(records: DataFrame, session: list[str], entry: str = "entry", value: str = "value", timestamp: str = "timestamp", signal: str = "DS:enabled", on: str = "True", off: str = "False") -> DataFrame:
    """session.., enable_ts, terminated_ts: the first ``on`` of the signal and
    the last ``off`` after it (NULL where there is none). Sessions that were
    never on have no row.

    Both bounds come from one aggregation: the last ``off`` of all is the last
    one after the first ``on``, or else none is."""
    marks = records.where((F.col(entry) == signal) & F.col(value).isin(on, off)).select(*session, F.col(value).alias("state"), F.col(timestamp).cast("bigint").alias("at"))
    bounds = marks.groupBy(*session).agg(F.min(F.when(F.col("state") == on, F.col("at"))).alias("enable_ts"), F.max(F.when(F.col("state") == off, F.col("at"))).alias("last_off"))
    ended = F.when(F.col("last_off") > F.col("enable_ts"), F.col("last_off"))
    return bounds.where("enable_ts is not null").select(*session, "enable_ts", ended.alias("terminated_ts"))


def trim(records: DataFrame, period: DataFrame, session: list[str], timestamp: str = "timestamp", open_end: str = "drop") -> DataFrame:
    """The records strictly inside their session's period, with ``match_time``
    since its begin. ``open_end``: what becomes of sessions that never ended.
    The session is an equi-join key, so the range is only a residual test."""
    if open_end not in ("drop", "keep"):
        raise ValueError(open_end)
    at = F.col(timestamp).cast("bigint")
    inside = at < F.col("terminated_ts")
    if open_end == "keep":
        inside = inside | F.col("terminated_ts").isNull()
    joined = records.join(period.select(*session, "enable_ts", "terminated_ts"), session).where((at > F.col("enable_ts")) & inside)
    return joined.withColumn("match_time", at - F.col("enable_ts")).drop("enable_ts", "terminated_ts")


def file_clock(records: DataFrame, session: list[str], timestamp: str = "timestamp", clock: str = "match_time") -> DataFrame:
    """Adds the time since the session's first record. The minimum is
    aggregated before it meets the rows, so a long session is not gathered."""
    first = records.groupBy(*session).agg(F.min(timestamp).alias("first_ts"))
    same = None
    first = first.select(*[F.col(c).alias(f"own_{c}") for c in session], "first_ts")
    for c in session:
        test = F.col(c).eqNullSafe(F.col(f"own_{c}"))
        same = test if same is None else same & test
    return records.join(first, same, "left").withColumn(clock, F.col(timestamp) - F.col("first_ts")).drop("first_ts", *[f"own_{c}" for c in session])


def file_clock_window(records: DataFrame, session: list[str], timestamp: str = "timestamp", clock: str = "match_time") -> DataFrame:
    """As ``file_clock``, by one window: less work where no session is large."""
    return records.withColumn(clock, F.col(timestamp) - F.min(timestamp).over(Window.partitionBy(*session)))
