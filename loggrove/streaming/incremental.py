"""Incremental import: newly arrived files, each content once, one version of a name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loggrove.functions.text import last_segment
from loggrove.operators.ledger import attempt, latest, newest_versions, not_imported, older_versions, one_of_content
from loggrove.schemas import LEDGER, RAW_RECORD, conform
from loggrove.sources.container import stream_records
from loggrove.sources.stored import read_or_empty

#: What Spark's binaryFile source gives; a stream must state it. The content is not read.
BINARY_FILE = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def ledger_attempts(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the ledger; none where there is no ledger yet."""
    return read_or_empty(spark, path, LEDGER)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The last attempt for each file. Attempts at a version that gave way to another
    one of its name say nothing about the file."""
    rows = ledger_attempts(spark, path).where("outcome is null or outcome <> 'superseded'")
    return latest(rows, ["filename"], ["attempt_id", "success"])


def choose(facts: DataFrame, ledger: DataFrame, skip_imported: bool = True) -> dict[str, DataFrame]:
    """What becomes of new files (path, filename, file_hash, modified, is_log), by
    outcome; files whose content is imported already, under whatever name, and further
    copies of one content are in none.

    - ``not a log``: a failed attempt;
    - ``superseded``: another content of the same name was modified later, in this
      batch or in an earlier one;
    - ``chosen``: all others, one for each name and content.
    """
    logs = facts.where("is_log")
    fresh = not_imported(logs, ledger) if skip_imported else logs
    newest = newest_versions(fresh)
    behind = fresh.join(newest.select("path"), "path", "left_anti")
    late = older_versions(newest, ledger)
    chosen = newest.join(late.select("path"), "path", "left_anti")
    columns = ["path", "filename", "file_hash", "modified"]
    return {
        "not a log": facts.where("not is_log").select(columns),
        "superseded": behind.unionByName(late).select(columns),
        "chosen": (one_of_content(chosen) if skip_imported else chosen).select(columns),
    }


def import_new(spark: SparkSession, path: str, root: str, load: Callable[[DataFrame, DataFrame, int], dict[str, DataFrame] | None], skip_imported: bool = True, most_files: int = 1000) -> StreamingQuery:
    """Starts a run over the files under ``path`` that no run has seen, and ends
    when they are done. A batch has at most ``most_files`` files, so their names and hashes
    (never contents) may pass the driver. All of them are read once, to ``root``/raw.

    ``load(files, records, attempt)`` gets the files to import (path, filename,
    file_hash, modified) and their RAW_RECORD; it must write so that a second call
    for the same files replaces the first, and may return ledger rows by outcome
    (imported, waiting) in place of all files as imported. ``root``/ledger has an unsuccessful
    attempt before it and the outcome after it, numbered on from its last one,
    whatever the checkpoint. A run that breaks off leaves an unsuccessful
    attempt and is simply started again."""
    ledger, raw = f"{root}/ledger", f"{root}/raw"

    def enter(session: SparkSession, rows: DataFrame, number: int, success: bool, outcome: str) -> None:
        conform(attempt(rows, number, success, outcome), LEDGER).write.mode("append").parquet(ledger)

    def batch(files: DataFrame, number: int) -> None:
        session = files.sparkSession
        stream_records(files, facts=True).write.mode("overwrite").parquet(raw)
        records = session.read.schema(RAW_RECORD).parquet(raw)
        times = files.select("path", F.unix_micros("modificationTime").alias("modified"))
        facts = records.where("kind = 'file'").select(F.col("name").alias("path"), last_segment(F.col("name")).alias("filename"), F.col("type").alias("file_hash"), (F.col("metadata") != "no log").alias("is_log")).join(times, "path")
        facts = session.createDataFrame(facts.collect(), facts.schema)
        first = 1 + ledger_attempts(session, ledger).agg(F.coalesce(F.max("attempt_id"), F.lit(-1))).first()[0]
        found = {k: session.createDataFrame(v.collect(), v.schema) for k, v in choose(facts, read_ledger(session, ledger), skip_imported).items()}
        for outcome in ("not a log", "superseded"):
            if not found[outcome].isEmpty():
                enter(session, found[outcome], first, False, outcome)
        chosen = found["chosen"]
        if chosen.isEmpty():
            return
        enter(session, chosen, first, False, "started")
        own = records.where("kind <> 'file'").withColumnRenamed("filename", "path").join(F.broadcast(chosen.select("path", "filename")), "path").select(*RAW_RECORD.names)
        outcomes = load(chosen, own, first) or {"imported": chosen}
        for outcome, rows in outcomes.items():
            enter(session, rows, first + 1, outcome == "imported", outcome)

    listed = spark.readStream.schema(BINARY_FILE).format("binaryFile").option("maxFilesPerTrigger", most_files).load(path).select("path", "modificationTime", "length")
    return listed.writeStream.foreachBatch(batch).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
