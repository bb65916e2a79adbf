"""Helpers that several training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a
    temporary folder is made and set on a single machine (a local master, tests);
    a cluster is asked for it.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="loggrove-")
        context.setCheckpointDir(root)
    return root


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_root(spark)}/loggrove/{label}-{uuid.uuid4().hex}"


def written(frame: DataFrame, label: str, release: bool = False) -> DataFrame:
    """The frame as a table in the shared folder: lineage ends there. With
    ``release`` the shuffle files of this run are removed at its end."""
    path = fresh_path(frame.sparkSession, label)
    conf, switch = frame.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(switch)
    try:
        if release:
            conf.set(switch, "true")
        frame.write.parquet(path)
    finally:
        conf.set(switch, before)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def among(rows: DataFrame, column: str, ids: DataFrame, bits: int = 1 << 24) -> DataFrame:
    """The rows whose ``column`` may be one of ``ids`` (one column): a Bloom
    filter with one hash, so that a join with few of the rows need not shuffle
    all. Its size is fixed: ``bits`` / 64 rows of two numbers are broadcast,
    however many ids there are; the more, the more rows pass. A join decides."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    mask = ids.select(place(F.col(ids.columns[0]).cast("long")).alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))).alias("mask"))
    own = place(rows[column].cast("long"))
    found = (F.shiftright(own, 6) == mask["word"]) & (F.call_function("shiftright", mask["mask"], own.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return rows.join(F.broadcast(mask), found, "left_semi")


def whole_text(name: str = "text") -> Column:
    """Text with null as the empty string."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def remainder(ids: np.ndarray | list, modulus: int) -> np.ndarray:
    """crc32 of each id's decimal text, modulo ``modulus``."""
    return np.array([zlib.crc32(str(i).encode()) % modulus for i in ids], dtype=np.int64)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most_bytes`` of the string column each, so
    that temporary arrays stay small whatever the length of the texts."""
    n = batch.num_rows
    if not n:
        return
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    groups = np.cumsum(lengths) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def no_threads() -> None:
    """One task, one core: libraries must not start threads of their own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def filtered(docs: DataFrame, text_column: str, make) -> DataFrame:
    """The rows of ``docs`` that a mask of their texts keeps; all columns as
    they are, whatever their names. ``make()`` runs once in each task and gives
    a function from an Arrow array of texts (null as empty) to booleans; rows
    with a null text always stay."""
    at = docs.columns.index(text_column)
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])

    def run(batches):
        keep = make()
        for batch in batches:
            for part in slices(batch, f"c{at}"):
                text = part.column(f"c{at}").cast(pa.string())
                mask = np.asarray(keep(pc.fill_null(text, "")), bool) | np.asarray(pc.is_null(text).to_numpy(zero_copy_only=False), bool)
                yield part.filter(pa.array(mask))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
