"""Stored tables whose rows are replaced by key.

Rows lie in a fixed number of buckets by a hash of their key. A run writes the
buckets that it touches anew, as ``data/run=<run>/bucket=<bucket>``, and then
appends one file to ``manifest`` that names them: that is the moment at which
readers see the run, all of it. A run that breaks off before leaves folders that
no reader looks at, and the same run done again gives the same table. The number of
folders is at most buckets times the runs that ``clean`` keeps, however many keys
there are. One writer at a time.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loggrove.schemas import conform

MANIFEST = "run long, folder string, bucket int, buckets int"


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The table at ``path``; one without rows where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


@dataclass(frozen=True)
class StoredTable:
    """Where a table lies, its columns, the key by which rows are replaced (NULL is a
    key like others) and its number of buckets, which never changes."""

    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    buckets: int = 64

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _manifest(self, spark: SparkSession) -> DataFrame:
        return read_or_empty(spark, f"{self.path}/manifest", MANIFEST)

    def _current(self, spark: SparkSession) -> tuple[dict[int, str], int]:
        """The folder of each bucket that has been written (at most ``buckets``), and
        the number of the last run."""
        last = self._manifest(spark).groupBy("bucket").agg(F.max(F.struct("run", "folder", "buckets")).alias("last")).collect()
        if any(r["last"]["buckets"] != self.buckets for r in last):
            raise ValueError(f"{self.path} has another number of buckets than {self.buckets}")
        return {r["bucket"]: r["last"]["folder"] for r in last}, max((r["last"]["run"] for r in last), default=0)

    def _touched(self, keys: DataFrame) -> list[int]:
        return sorted(r[0] for r in keys.select(self._bucket()).distinct().collect())

    def read(self, spark: SparkSession, keys: DataFrame | None = None) -> DataFrame:
        """The rows of the last complete run; of ``keys`` only, if given, in which
        case other buckets are not read."""
        current, _ = self._current(spark)
        rows = self._buckets(spark, current, None if keys is None else self._touched(keys))
        return rows if keys is None else rows.join(self._named(keys), self._same(), "left_semi")

    def _buckets(self, spark: SparkSession, current: dict[int, str], wanted: list[int] | None) -> DataFrame:
        current = {b: f for b, f in current.items() if wanted is None or b in wanted}
        if not current:
            return spark.createDataFrame([], self.schema)
        schema = T.StructType([*self.schema.fields, T.StructField("run", T.StringType()), T.StructField("bucket", T.IntegerType())])
        of_run: dict[str, list[int]] = {}
        for bucket, folder in current.items():
            of_run.setdefault(folder, []).append(bucket)
        # a filter on folders alone: others are not read
        chosen = reduce(or_, [(F.col("run") == f) & F.col("bucket").isin(b) for f, b in of_run.items()])
        return spark.read.schema(schema).parquet(f"{self.path}/data").where(chosen).select(*self.schema.names)

    def _named(self, keys: DataFrame) -> DataFrame:
        return keys.select(*[F.col(k).alias(f"own_{k}") for k in self.keys]).distinct()

    def _same(self) -> Column:
        return reduce(and_, [F.col(k).eqNullSafe(F.col(f"own_{k}")) for k in self.keys])

    def replace(self, rows: DataFrame, gone: DataFrame | None = None) -> None:
        """Puts ``rows`` in place of those with a key in ``gone``, which has the keys
        of ``rows`` and maybe others; without it, of those with a key in ``rows``
        (an upsert). Only the buckets of these keys are read and written."""
        spark = rows.sparkSession
        fresh = conform(rows, self.schema)
        keys = (fresh if gone is None else gone).select(*self.keys).distinct()
        touched = self._touched(keys)
        if not touched:
            return
        current, last = self._current(spark)
        folder = f"{last + 1:08d}-{uuid.uuid4().hex[:8]}"
        kept = self._buckets(spark, current, touched).join(self._named(keys), self._same(), "left_anti")
        foreign = F.raise_error(F.lit(f"a row for {self.path} has a key that is not to be replaced")).cast("int")
        bucket = F.when(self._bucket().isin(touched), self._bucket()).otherwise(foreign)
        out = fresh.unionByName(kept).withColumn("bucket", bucket).hint("rebalance", "bucket")
        out.write.partitionBy("bucket").parquet(f"{self.path}/data/run={folder}")
        entries = spark.createDataFrame([(last + 1, folder, b, self.buckets) for b in touched], MANIFEST)
        entries.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def clean(self, spark: SparkSession, keep: int = 2) -> int:
        """Deletes the folders that none of the last ``keep`` states of the table
        needs, those of runs that broke off too; how many it deleted."""
        rows = self._manifest(spark).collect()
        top = max((r["run"] for r in rows), default=0)
        needed = set()
        for state in range(max(top - keep + 1, 0), top + 1):
            last: dict[int, tuple] = {}
            for r in rows:
                if r["run"] <= state:
                    last[r["bucket"]] = max(last.get(r["bucket"], (0, "")), (r["run"], r["folder"]))
            needed |= {f for _, f in last.values()}
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        store = place.getFileSystem(spark._jsc.hadoopConfiguration())
        gone = 0
        for found in store.listStatus(place) if store.exists(place) else []:
            name = found.getPath().getName()
            if name.startswith("run=") and name[4:] not in needed and int(name[4:12]) <= top:
                store.delete(found.getPath(), True)
                gone += 1
        return gone
