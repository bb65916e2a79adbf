"""Imports of whole folders: from log files that no run has seen to tables and ledger.

Under ``root`` lie the ledger, the decoded records (``records``), the tables, the
counts of what was left out (``counts``), and for matches the files that have come in (``files``).
Tables are stored in hashed buckets of files (``sources.stored``): the rows of a
file are replaced by rewriting its bucket.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loggrove import schemas
from loggrove.functions.text import key_value
from loggrove.operators.file_sets import classify_files
from loggrove.operators.ledger import attempt
from loggrove.operators.routing import Prefixes
from loggrove.operators.typed import no_number
from loggrove.plans.pipelines import derived_tables, device_raw, match_raw, summarize, system_raw
from loggrove.schemas import COUNTS, FILES, LEDGER, LONG, conform
from loggrove.sources.container import decode_values, entry_intervals, resolve_entries
from loggrove.sources.stored import StoredTable, read_or_empty
from loggrove.streaming.incremental import import_new, ledger_attempts

RAW_TABLES = ("log_metadata", "device_data_raw", "vision_data_raw", "preferences")
SUMMARY_KEYS = ("event", "match_id", "subsystem", "component", "part", "type", "metric")
#: Counters of ``decode_values``.
DECODING = ("decoded", "misfit", "unhandled")
#: Makes raw tables of LONG records.
Raw = Callable[[DataFrame], dict[str, DataFrame]]


def stored(root: str, name: str) -> StoredTable:
    """A table of an import."""
    schema = {"records": LONG, "files": FILES}.get(name) or getattr(schemas, {"device_data_raw": "DEVICE_RAW", "vision_data_raw": "VISION_RAW"}.get(name, name.upper()))
    return StoredTable(f"{root}/{name}", schema, ("filename",))


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The rows of a table under ``root``: those of the eight tables, records, files."""
    return stored(root, name).read(spark)


def read_counts(spark: SparkSession, root: str) -> DataFrame:
    """attempt_id, counter, n: what an attempt read and what it left out."""
    return read_or_empty(spark, f"{root}/counts", COUNTS)


def _conditions(metadata_prefix: str | None) -> dict:
    """Conditions over LONG records that take no part, or only in part, in tables."""
    lines = F.col("entry").startswith(metadata_prefix) & key_value(F.col("value")).isNull() if metadata_prefix else F.lit(False)
    return {"unrouted": F.col("entry").isNull(), "unparsed": no_number(), "malformed_metadata": F.coalesce(lines, F.lit(False))}


def _observed(observation: Observation, names: tuple[str, ...]) -> dict[str, int]:
    """What a pass has counted: nothing where Spark found that it has no rows, and left it
    out together with its counters."""
    try:
        found = observation.get
    except Py4JJavaError as e:
        # an observation without a row cannot be handed over
        if "assertion failed" not in str(e.java_exception):
            raise
        found = {}
    return {n: int(found.get(n) or 0) for n in names}


def _store_records(root: str, records: DataFrame, files: DataFrame, number: int, metadata_prefix: str | None, also: dict[str, int], decoding: Observation | None = None) -> None:
    """Writes the records of ``files`` in place of those they have, and the counts
    that the same pass makes."""
    seen = Observation()
    counted = [F.count(F.when(c, 1)).alias(k) for k, c in _conditions(metadata_prefix).items()]
    stored(root, "records").replace(records.select(*LONG.names).observe(seen, F.count(F.lit(1)).alias("records"), *counted), files.select("filename"))
    counts = also | _observed(seen, ("records", *_conditions(metadata_prefix)))
    if decoding is not None:
        counts |= _observed(decoding, DECODING)
    rows = records.sparkSession.createDataFrame([(number, k, n) for k, n in counts.items()], COUNTS)
    rows.coalesce(1).write.mode("append").parquet(f"{root}/counts")


def _decode(root: str, files: DataFrame, raw: DataFrame, number: int, include_float: bool, metadata_prefix: str | None) -> None:
    """The records of new log files, stored."""
    decoding = Observation()
    # stored, so that Spark knows their size and broadcasts them while they are small
    spans = entry_intervals(raw, ["filename"])
    spans.write.mode("overwrite").parquet(f"{root}/intervals")
    spans = raw.sparkSession.read.schema(spans.schema).parquet(f"{root}/intervals")
    decoded = decode_values(resolve_entries(raw, ["filename"], intervals=spans), include_float, decoding)
    invalid = raw.where(F.col("kind").isin("invalid", "unknown_control")).count()
    _store_records(root, decoded, files, number, metadata_prefix, {"files": files.count(), "invalid_control": invalid}, decoding)


def _store_tables(spark: SparkSession, root: str, files: DataFrame, raw: Raw, records: DataFrame) -> None:
    """Raw tables first; telemetry and statistics are made of the raw rows as
    stored, so that records are scanned once for each raw table and no more. Tables
    do not depend on each other, so some are written at a time."""
    names = files.select("filename")

    def store(made: dict[str, DataFrame]) -> None:
        def one(name: str) -> None:
            stored(root, name).replace(made[name], names)
            stored(root, name).clean(spark)

        with ThreadPoolExecutor(4) as pool:
            list(pool.map(one, made))

    made = raw(records)
    store(made)
    own = {name: stored(root, name).read(spark, names) for name in ("device_data_raw", "vision_data_raw") if name in made}
    store(derived_tables(own["device_data_raw"], own.get("vision_data_raw")))
    stored(root, "records").clean(spark)


def import_folder(spark: SparkSession, path: str, root: str, raw: Raw, include_float: bool = False, metadata_prefix: str | None = None) -> StreamingQuery:
    """Starts the import of the log files under ``path`` that are new, by their
    content, to the tables under ``root``; ``raw`` makes raw tables of LONG records."""

    def load(files: DataFrame, records: DataFrame, number: int) -> None:
        session = files.sparkSession
        _decode(root, files, records, number, include_float, metadata_prefix)
        _store_tables(session, root, files, raw, stored(root, "records").read(session, files.select("filename")))

    return import_new(spark, path, root, load)


def import_systems(spark: SparkSession, path: str, root: str, device_map: DataFrame, vision_map: DataFrame, prefixes: Prefixes, year: str | None = None, open_end: str = "drop") -> StreamingQuery:
    """System logs of a folder to their eight tables."""
    return import_folder(spark, path, root, lambda records: system_raw(records, device_map, vision_map, prefixes, year, open_end), metadata_prefix=prefixes.metadata)


def import_devices(spark: SparkSession, path: str, root: str, drive_map: DataFrame, rio_map: DataFrame) -> StreamingQuery:
    """Standalone device logs of a folder to their three tables."""
    return import_folder(spark, path, root, lambda records: device_raw(records, drive_map, rio_map), include_float=True)


def ready_sets(files: DataFrame, matches: DataFrame, need: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Of the files of ``matches`` (match_id), those of matches that have a file of
    each kind in ``need``, and the others."""
    own = files.join(matches.select("match_id").distinct(), "match_id", "left_semi")
    kinds = own.groupBy("match_id").agg(F.collect_set("kind").alias("kinds"))
    full = kinds.where(F.size(F.array_intersect("kinds", F.array(*map(F.lit, need)))) == len(set(need))).select("match_id")
    return own.join(full, "match_id", "left_semi"), own.join(full, "match_id", "left_anti")


def kept_in(root: str) -> Callable[[DataFrame, str], DataFrame]:
    """Stores a frame under ``root``/work, in place of what has its name there, and
    gives the rows as stored: plans that use them are short, and Spark knows
    their size. A name must not be stored again while it is read."""

    def kept(frame: DataFrame, name: str) -> DataFrame:
        frame.write.mode("overwrite").parquet(f"{root}/work/{name}")
        return frame.sparkSession.read.schema(frame.schema).parquet(f"{root}/work/{name}")

    return kept


def redo_matches(spark: SparkSession, root: str, files: DataFrame, raw: Raw) -> None:
    """The tables of whole matches: the rows of all their ``files`` are replaced,
    those of a system log that another one has followed too."""
    names = files.select("filename")
    _store_tables(spark, root, files, raw, stored(root, "records").read(spark, names))


def match_tables(files: DataFrame, drive_map: DataFrame, rio_map: DataFrame, vision_map: DataFrame, prefixes: Prefixes, year: str | None = None, open_end: str = "drop", root: str | None = None) -> Raw:
    """Makes raw tables of the records of whole matches, told apart by ``files``
    (filename, path, kind). With ``root`` what all tables need of a match is stored there."""
    kept = {} if root is None else {"kept": kept_in(root)}

    def raw(records: DataFrame) -> dict[str, DataFrame]:
        kind = files.select(F.col("filename").alias("own_filename"), "kind")
        typed = records.join(kind, F.col("filename") == F.col("own_filename")).drop("own_filename")
        of = lambda k: typed.where(F.col("kind") == k).drop("kind")
        return match_raw(of("system"), of("drive"), of("rio"), files, drive_map, rio_map, vision_map, prefixes, year, open_end, **kept)

    return raw


def import_matches(spark: SparkSession, path: str, root: str, drive_map: DataFrame, rio_map: DataFrame, vision_map: DataFrame, prefixes: Prefixes, year: str | None = None, open_end: str = "drop", need: tuple[str, ...] = ("system",), skip_imported: bool = False) -> StreamingQuery:
    """Starts the import of the matches that have new files under ``path``. The unit
    of work is a match: its system log and its device logs, which may come one after
    the other. New files are decoded and stored; a match that lacks a kind in
    ``need`` waits, all others are done with every file they have by now, anew if
    a file comes late. The ledger has ``waiting`` or ``imported`` for each file;
    files whose name tells no match are ``unmatched``. By default content that was
    imported under another name is no reason to skip a file."""

    def load(new: DataFrame, records: DataFrame, number: int) -> dict[str, DataFrame]:
        session = new.sparkSession
        known = classify_files(new)
        placed = known.where("kind is not null and match_id is not null")
        if placed.isEmpty():
            return {"unmatched": known}
        _decode(root, placed, records.join(placed.select("filename"), "filename", "left_semi"), number, True, prefixes.metadata)
        stored(root, "files").replace(placed, placed.select("filename"))
        ready, waiting = ready_sets(stored(root, "files").read(session), placed, need)
        # the files of the matches of one batch
        ready, waiting = (session.createDataFrame(f.collect(), f.schema) for f in (ready, waiting))
        if not ready.isEmpty():
            redo_matches(session, root, ready, match_tables(ready, drive_map, rio_map, vision_map, prefixes, year, open_end, root))
        others = known.where("kind is null or match_id is null")
        return {k: f for k, f in (("imported", ready), ("waiting", waiting), ("unmatched", others)) if not f.isEmpty()}

    return import_new(spark, path, root, load, skip_imported)


def import_staged(spark: SparkSession, records: DataFrame, root: str, raw: Raw, metadata_prefix: str | None = None) -> None:
    """Staged records (``read_staged``) to tables and ledger, as if their logs had been
    imported. A file's content is known by a hash over its records; files whose
    content was imported are skipped, and others replace what their name has."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in ("seq", "entry", "data_type", "value", "timestamp")])
    # a sum of hashes needs no order, and a file is not gathered
    half = lambda k: F.sum(F.conv(F.substring(F.sha2(text, 256), 15 * k + 1, 15), 16, 10).cast("decimal(38,0)"))
    hashed = records.groupBy("filename").agg(F.sha2(F.concat_ws("-", *[half(k) for k in range(4)], F.count(F.lit(1))), 256).alias("file_hash"))
    done = ledger_attempts(spark, f"{root}/ledger").where("success").select("file_hash").distinct()
    files = hashed.join(done, "file_hash", "left_anti").select("filename", "file_hash").persist()
    try:
        if files.isEmpty():
            return
        number = 1 + ledger_attempts(spark, f"{root}/ledger").agg(F.coalesce(F.max("attempt_id"), F.lit(-1))).first()[0]
        conform(attempt(files, number, False, "started"), LEDGER).write.mode("append").parquet(f"{root}/ledger")
        own = records.join(files.select("filename"), "filename", "left_semi")
        _store_records(root, own, files, number, metadata_prefix, {"files": files.count()})
        _store_tables(spark, root, files, raw, stored(root, "records").read(spark, files.select("filename")))
        conform(attempt(files, number + 1, True, "imported"), LEDGER).write.mode("append").parquet(f"{root}/ledger")
    finally:
        files.unpersist()


def summary_table(root: str) -> StoredTable:
    return StoredTable(f"{root}/electrical_summaries", schemas.ELECTRICAL_SUMMARY, SUMMARY_KEYS, 8)


def store_summary(spark: SparkSession, root: str, device_rows: DataFrame | None = None) -> None:
    """Summarises the raw device rows under ``root`` (or ``device_rows``) and puts
    the result in place of the rows of the same keys in the stored summary; keys that
    no longer have rows keep theirs. Readers see the old summary or the new one."""
    rows = summarize(read_table(spark, root, "device_data_raw") if device_rows is None else device_rows)
    summary_table(root).replace(rows)
    summary_table(root).clean(spark)
