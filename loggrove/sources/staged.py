"""Staged long records, entry maps, file hashes and table writes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loggrove.functions.text import MISSING, last_segment, null_if_missing
from loggrove.schemas import LONG, STAGED, conform
from loggrove.sources.container import file_facts


def _csv(reader_or_writer):
    return reader_or_writer.option("quote", "|").option("escape", "|")


def write_staged(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header-less CSV of entry, data_type, value, timestamp, pipe-quoted and
    gzipped, in a folder per file. Where the records have ``seq``, a file's records
    go by it over its part files and within each, so that ``read_staged`` gives
    them their order back."""
    rows = records
    if "seq" in records.columns:
        tasks = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = records.repartitionByRange(tasks, "filename", "seq").sortWithinPartitions("filename", "seq")
    _csv(rows.select("filename", *STAGED.names).write.mode(mode).partitionBy("filename")).option("compression", "gzip").csv(path)


def write_staged_parquet(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The splittable form of the staged records, with all their columns."""
    records.write.mode(mode).partitionBy("filename").parquet(path)


def read_staged_parquet(spark: SparkSession, path: str) -> DataFrame:
    """LONG records of ``write_staged_parquet``."""
    return spark.read.schema(LONG).parquet(path).select(*LONG.names)


#: A part file holds less than this many bytes or, compressed, rows: order = part number * PART + place.
PART = 1 << 40


def _unescaped(name: Column) -> Column:
    return F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def _numbered(rows: DataFrame, place: str) -> DataFrame:
    """Adds ``place``, a number for each row that grows along its file: the start of
    the block that holds it plus its number in the block. Blocks start further on
    than the one before has rows, as a row has a byte or more. A task reads a block
    from its start to its end, so counting needs no shuffle."""

    def run(batches):
        block, count = None, 0
        for batch in batches:
            paths, starts = batch.column("file_path").dictionary_encode(), batch.column("block_start").to_numpy()
            code = paths.indices.to_numpy()
            new = np.ones(len(code), bool)
            new[1:] = (code[1:] != code[:-1]) | (starts[1:] != starts[:-1])
            head = np.flatnonzero(new)
            number = np.arange(len(code)) - np.repeat(head, np.diff(np.append(head, len(code))))
            if len(code):
                if (paths[0].as_py(), starts[0]) == block:
                    number[: head[1] if len(head) > 1 else None] += count
                block, count = (paths[len(code) - 1].as_py(), starts[-1]), int(number[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts + number, pa.int64())], names=[*batch.schema.names, place])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(place, T.LongType())]))


def read_staged(spark: SparkSession, path: str, missing: list[str] | None = MISSING) -> DataFrame:
    """LONG records of staged CSV, also gzipped, of ours or others'. All columns are
    text or integers, never inferred; values in ``missing`` are NULL. ``filename`` is that
    of the folder ``write_staged`` made, however many part files it has; where there
    is none, the name of the file that is read. ``seq`` is the order within it: by
    number of the part file, then by place."""
    rows = _csv(spark.read.schema(STAGED)).csv(path).select(*STAGED.names, F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block_start"))
    rows = _numbered(rows, "place")
    folder = F.regexp_extract("file_path", "/filename=([^/]+)/[^/]+$", 1)
    # a folder's name is escaped as a partition, a path as an address
    own = F.when(folder != "", _unescaped(_unescaped(folder))).otherwise(_unescaped(last_segment(F.col("file_path"))))
    part = F.coalesce(F.regexp_extract("file_path", r"/part-(\d+)-[^/]*$", 1).try_cast("bigint"), F.lit(0))
    out = rows.select(own.alias("filename"), (part * PART + F.col("place")).alias("seq"), *STAGED.names)
    return out.withColumn("value", null_if_missing(F.col("value"), missing)) if missing else out


def read_map(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """An entry map: CSV with a header. Blank lines are skipped; short rows are
    filled with NULL."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("ignoreLeadingWhiteSpace", True).csv(path).where("entry is not null")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, filename and SHA-256 of each file under a path or glob, whatever its
    length: files are read as streams."""
    return file_facts(spark.read.format("binaryFile").load(path).select("path")).select("path", "filename", "file_hash")


def append_table(rows: DataFrame, path: str, schema: T.StructType, partitions: list[str] | None = None) -> None:
    """Appends rows with exactly the table's columns and types."""
    conform(rows, schema).write.mode("append").partitionBy(*(partitions or [])).parquet(path)


def replace_partitions(rows: DataFrame, path: str, schema: T.StructType, partitions: list[str]) -> None:
    """Writes rows in place of the partitions that they belong to, so a retried
    import leaves the same table."""
    conform(rows, schema).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def register_tables(spark: SparkSession, root: str, names: list[str]) -> None:
    """Temporary views over the tables under ``root``."""
    for name in names:
        spark.read.parquet(f"{root}/{name}").createOrReplaceTempView(name)
