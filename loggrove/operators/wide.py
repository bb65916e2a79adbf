"""Long records to wide telemetry, and statistics per component.

The spine of a wide table is every distinct key of the mapped records, whatever
their metric; each metric's values are joined to it, NULL keys to NULL keys, and
several values of one metric at one key give several rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loggrove.functions.text import number

def widen(records: DataFrame, keys: list[str], columns: dict[str, tuple[str, str]], metric: str = "metric") -> DataFrame:
    """keys.. and one column for each of ``columns`` (name: (metric, source)).

    One aggregation in place of a join per metric: a key's values are gathered
    per metric and unfolded one metric after the other, which gives the rows of
    the joins. A group is what one component reports at one instant."""
    mapped = records.where(F.col(metric).isNotNull())
    lists = [F.collect_list(F.when(F.col(metric) == m, F.struct(F.col(source).alias("v")))).alias(name) for name, (m, source) in columns.items()]
    out = mapped.groupBy(*keys).agg(*lists)
    for name in columns:
        others = [c for c in columns if c != name]
        out = out.select(*keys, *others, F.explode_outer(name).alias("unfolded")).select(*keys, *others, F.col("unfolded.v").alias(name))
    return out.select(*keys, *columns)


def widen_by_joins(records: DataFrame, keys: list[str], columns: dict[str, tuple[str, str]], metric: str = "metric") -> DataFrame:
    """As ``widen``, by a null-safe left join per metric: more shuffles, but no
    group is gathered, for keys at which very many values meet."""
    mapped = records.where(F.col(metric).isNotNull())
    out = mapped.select(*keys).distinct()
    for name, (m, source) in columns.items():
        own = mapped.where(F.col(metric) == m).select(*[F.col(k).alias(f"own_{k}") for k in keys], F.col(source).alias(name))
        same = F.lit(True)
        for k in keys:
            same = same & out[k].eqNullSafe(own[f"own_{k}"])
        out = out.join(own, same, "left").drop(*[f"own_{k}" for k in keys])
    return out


def metric_stats(records: DataFrame, keys: list[str], columns: dict[str, str], value: str = "numeric_value", metric: str = "metric", absolute: tuple[str, ...] = ("velocity",)) -> DataFrame:
    """keys.. and avg, min, max and sample stddev of each of ``columns`` (name:
    metric). Those in ``absolute`` have avg and stddev of magnitudes. Keys whose
    records have none of the metrics have a row of NULLs. All in one
    aggregation with a map-side part."""
    out = []
    for name, m in columns.items():
        v = F.when(F.col(metric) == m, F.col(value))
        size = F.abs(v) if name in absolute else v
        out += [F.avg(size).alias(f"avg_{name}"), F.min(v).alias(f"min_{name}"), F.max(v).alias(f"max_{name}"), F.stddev_samp(size).alias(f"stddev_{name}")]
    return records.where(F.col(metric).isNotNull()).groupBy(*keys).agg(*out)


def camera_stats(records: DataFrame, session: list[str], camera: str = "camera", metric: str = "metric", value: str = "numeric_value") -> DataFrame:
    """Latency statistics per camera; records without a camera are left out, and
    so are cameras without latencies."""
    own = records.where((F.col(metric) == "LATENCY") & F.col(camera).isNotNull())
    v = F.col(value)
    return own.groupBy(*session, camera).agg(F.avg(v).alias("avg_latency"), F.min(v).alias("min_latency"), F.max(v).alias("max_latency"), F.stddev_samp(v).alias("stddev_latency"))


def electrical_summary(records: DataFrame, keys: list[str], metrics: tuple[str, ...] = ("CURRENT", "TEMP", "VOLTAGE"), floor: float = 0.05, metric: str = "metric", value: str = "value", numeric: str = "numeric_value", data_type: str = "data_type") -> DataFrame:
    """Largest, smallest and mean magnitude per key of the double records above
    the noise floor. A text that is no number counts as 0 for the floor."""
    size = F.abs(F.when(F.col(value).isNotNull(), F.coalesce(number(F.col(value)), F.lit(0.0))))
    own = records.where((F.col(data_type) == "double") & (size > floor) & F.col(metric).isin(*metrics))
    v = F.abs(F.col(numeric).cast("double"))
    return own.groupBy(*keys).agg(F.max(v).alias("max_abs_value"), F.min(v).alias("min_abs_value"), F.avg(v).alias("avg_abs_value"))
