"""Binary log containers: raw records, entry resolution, typed values.

Files are read as streams, in parallel, one file in a task at a time: record
widths vary, so a single file cannot be split, but a task holds only a block of
it, its longest record and one batch of rows. ``read_log_files`` does so as a Spark data
source, ``stream_records`` for paths that are rows of a DataFrame.
"""

from __future__ import annotations

import hashlib
import io
import json
import math
import re
import struct
from collections import Counter
from collections.abc import Iterator
from fnmatch import fnmatch
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loggrove.functions.text import last_segment, one_line
from loggrove.schemas import RAW_RECORD

# The file header, the oldest version, the control record tags.
MAGIC, OLDEST = b"WPILOG", 0x0100
START, FINISH, SET_METADATA = 0, 1, 2
# The declared types whose payloads are decoded; scalar float is an option.
HANDLED = ("boolean", "int64", "double", "string", "json", "msgpack", "boolean[]", "int64[]", "float[]", "double[]", "string[]")


class NotALog(ValueError):
    """The content does not begin with a container header."""


def _text(data: bytes, at: int) -> tuple[str, int]:
    """A string with its length before it, and where it ends."""
    (n,) = struct.unpack_from("<I", data, at)
    end = at + 4 + n
    if end > len(data):
        raise ValueError("a string is longer than its record")
    return data[at + 4 : end].decode("utf-8", "replace"), end


def _control(data: bytes) -> tuple:
    """kind, entry id, name, type, metadata of a control record."""
    try:
        tag = data[0]
        (entry,) = struct.unpack_from("<I", data, 1)
        if tag == START and len(data) >= 17:
            name, at = _text(data, 5)
            declared, at = _text(data, at)
            return "start", entry, name, declared, _text(data, at)[0]
        if tag == FINISH and len(data) == 5:
            return "finish", entry, None, None, None
        if tag == SET_METADATA and len(data) >= 9:
            return "set_metadata", entry, None, None, _text(data, 5)[0]
        return "unknown_control", entry, None, None, None
    except (struct.error, ValueError, IndexError):
        return "invalid", None, None, None, None


class ByteWindow:
    """A stream read forward in blocks. It holds one block and what has been asked
    for, whatever the length of the stream; ``digest`` takes every byte read."""

    def __init__(self, stream: BinaryIO, length: int, digest=None, block: int = 1 << 20):
        self.stream, self.left, self.digest, self.block = stream, length, digest, block
        self.data, self.at = b"", 0

    def has(self, n: int) -> bool:
        """Whether n more bytes follow; they are read if so. A length that goes
        beyond the end, as a damaged file may state, is not read."""
        short = n - (len(self.data) - self.at)
        if short > self.left:
            return False
        if short > 0:
            parts, self.at = [self.data[self.at :]], 0
            while short > 0:
                part = self._read(max(self.block, short))
                if not part:
                    self.data = b"".join(parts)
                    return False
                parts.append(part)
                short -= len(part)
            self.data = b"".join(parts)
        return True

    def _read(self, n: int) -> bytes:
        part = self.stream.read(min(n, self.left))
        self.left = self.left - len(part) if part else 0
        if self.digest is not None:
            self.digest.update(part)
        return part

    def more(self) -> bool:
        return self.at < len(self.data) or self.left > 0

    def take(self, n: int) -> bytes:
        part = self.data[self.at : self.at + n]
        self.at += n
        return part

    def drain(self) -> None:
        """Reads what is left, for the digest's sake."""
        while self.left and self._read(self.block):
            pass


def walk(content: bytes | ByteWindow, facts: dict | None = None) -> Iterator[tuple]:
    """(seq, entry_id, timestamp, kind, name, type, metadata, payload) of each
    record. A record that the file cuts off ends the walk without an error;
    ``facts`` then says so under ``truncated``."""
    window = content if isinstance(content, ByteWindow) else ByteWindow(io.BytesIO(content), len(content))
    head = window.take(12) if window.has(12) else b""
    if head[:6] != MAGIC or int.from_bytes(head[6:8], "little") < OLDEST:
        raise NotALog("no container header")
    extra = int.from_bytes(head[8:], "little")
    seq = 0
    whole = window.has(extra)
    window.take(extra)
    while whole and window.more():
        whole = window.has(1)
        widths = window.data[window.at]
        a, b, c = (widths & 3) + 1, (widths >> 2 & 3) + 1, (widths >> 4 & 7) + 1
        if not (whole := window.has(1 + a + b + c)):
            break
        head = window.take(1 + a + b + c)
        entry = int.from_bytes(head[1 : 1 + a], "little")
        length = int.from_bytes(head[1 + a : 1 + a + b], "little")
        timestamp = int.from_bytes(head[1 + a + b :], "little")
        if not (whole := window.has(length)):
            break
        payload = window.take(length)
        # timestamps are unsigned in the file; a table has signed ones
        timestamp = timestamp - (1 << 64) if timestamp >= 1 << 63 else timestamp
        if entry:
            yield seq, entry, timestamp, "data", None, None, None, payload
        else:
            kind, own, name, declared, metadata = _control(payload)
            yield seq, own, timestamp, kind, name, declared, metadata, None
        seq += 1
    if facts is not None:
        facts["truncated"] = not whole


def open_file(path: str) -> tuple[BinaryIO, int]:
    """A stream over a file and its length. Paths without a scheme, or with
    ``file:``, are local; others go to the file system that Arrow has for them."""
    local = re.match(r"(?:file:(?://)?)?(/.*)$", path)
    if local:
        store, name = fs.LocalFileSystem(), local[1]
    else:
        store, name = fs.FileSystem.from_uri(quote(path, safe=":/?=&@%+,;~"))
    return store.open_input_stream(name), store.get_file_info(name).size


_ARROW = pa.schema([pa.field(f.name, {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in RAW_RECORD.fields])


def _batches(name: str, records: Iterator[tuple], kinds: tuple[str, ...] | None, rows: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    held = 0
    for r in records:
        if kinds is None or r[3] in kinds:
            out.append((name, *r))
            held += len(r[7] or b"")
        if len(out) >= rows or held >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ARROW.types)], schema=_ARROW)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ARROW.types)], schema=_ARROW)


def _named(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def read_file(path: str, strict: bool = False, kinds: tuple[str, ...] | None = None, rows: int = 20_000, most_bytes: int = 8 << 20, name: str | None = None, facts: bool = False) -> Iterator[pa.RecordBatch]:
    """RAW_RECORD of one log file, read as a stream: in memory are a block, the
    longest record and one batch. With ``facts`` a last record of kind ``file`` has
    the SHA-256 of the file as its type and whether it is a log, and a whole one, as its
    metadata, so that one pass gives both."""
    stream, length = open_file(path)
    name = _named(path) if name is None else name
    with stream:
        digest, found = hashlib.sha256() if facts else None, {}
        window = ByteWindow(stream, length, digest)
        try:
            yield from _batches(name, walk(window, found), kinds, rows, most_bytes)
        except NotALog:
            if strict:
                raise
        if facts:
            window.drain()
            state = "no log" if "truncated" not in found else "truncated" if found["truncated"] else "log"
            yield from _batches(name, iter([(None, None, None, "file", path, digest.hexdigest(), state, None)]), None, rows, most_bytes)


def spread(files: DataFrame, path: str = "path") -> DataFrame:
    """The paths over as many tasks as the session shuffles into; each task reads
    its files one after the other."""
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select(F.col(path).alias("path")).repartition(tasks, "path")


def stream_records(files: DataFrame, strict: bool = False, kinds: tuple[str, ...] | None = None, facts: bool = False) -> DataFrame:
    """RAW_RECORD of the files (path), each read as a stream by one task. Content
    without a header gives no records, or raises where ``strict``. ``kinds``
    selects records while they are read. With ``facts`` (see ``read_file``) the
    whole path stands for the file name, as files of one name are still to be told
    apart."""

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                yield from read_file(path, strict, kinds, name=path if facts else None, facts=facts)

    return spread(files).mapInArrow(run, RAW_RECORD)


FILE_FACTS = "path string, filename string, file_hash string, length long, is_log boolean, records long, invalid long, truncated boolean"


def file_facts(files: DataFrame) -> DataFrame:
    """FILE_FACTS of the files (path): SHA-256 and what a walk finds, in one pass
    over each file as a stream."""
    schema = pa.schema([("path", pa.string()), ("filename", pa.string()), ("file_hash", pa.string()), ("length", pa.int64()), ("is_log", pa.bool_()), ("records", pa.int64()), ("invalid", pa.int64()), ("truncated", pa.bool_())])

    def one(path: str) -> tuple:
        stream, length = open_file(path)
        with stream:
            digest, facts, kinds = hashlib.sha256(), {}, Counter()
            window = ByteWindow(stream, length, digest)
            try:
                for r in walk(window, facts):
                    kinds[r[3]] += 1
            except NotALog:
                pass
            window.drain()
        return path, _named(path), digest.hexdigest(), length, "truncated" in facts, sum(kinds.values()), kinds["invalid"], facts.get("truncated", False)

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(one(path), schema.types)], schema=schema)

    return spread(files).mapInArrow(run, FILE_FACTS)


def read_records(files: DataFrame, strict: bool = False) -> DataFrame:
    """RAW_RECORD of files that are rows already (path, content), each below 2 GB,
    for stores that only Spark reads."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("filename").to_pylist(), batch.column("content").to_pylist()):
                try:
                    yield from _batches(name, walk(content or b""), None, 20_000, 8 << 20)
                except NotALog:
                    if strict:
                        raise

    return files.select(last_segment(F.col("path")).alias("filename"), "content").mapInArrow(run, RAW_RECORD)


class LogFiles(DataSource):
    """``spark.read.format("log_container").load(path)``: RAW_RECORD of the log
    files of a folder or glob, one partition for each file. Options: ``strict``,
    ``kinds`` (comma-joined)."""

    @classmethod
    def name(cls) -> str:
        return "log_container"

    def schema(self):
        return RAW_RECORD

    def reader(self, schema) -> DataSourceReader:
        return LogReader(self.options)


class LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.strict = options.get("strict", "false").lower() == "true"
        self.kinds = tuple(options["kinds"].split(",")) if "kinds" in options else None

    def partitions(self):
        return [InputPartition(p) for p in list_files(self.path)]

    def read(self, partition):
        yield from read_file(partition.value, self.strict, self.kinds)


def list_files(pattern: str) -> list[str]:
    """Paths of the files of a folder or of a glob in its last segment."""
    local = re.match(r"(?:file:(?://)?)?(/.*)$", pattern)
    store, name = (fs.LocalFileSystem(), local[1]) if local else fs.FileSystem.from_uri(quote(pattern, safe=":/?=&@%+,;~*[]!"))
    scheme = "" if local else pattern.split("://")[0] + "://"
    info = store.get_file_info(name)
    if info.type == fs.FileType.File:
        return [scheme + name]
    folder, last = (name, "*") if info.type == fs.FileType.Directory else name.rsplit("/", 1)
    found = [f.path for f in store.get_file_info(fs.FileSelector(folder or "/")) if f.type == fs.FileType.File and fnmatch(f.base_name, last)]
    if not found and info.type == fs.FileType.NotFound and last == name.rsplit("/", 1)[-1] and not re.search(r"[*?\[]", last):
        raise FileNotFoundError(pattern)
    return [scheme + p for p in sorted(found)]


def read_log_files(spark: SparkSession, path: str, strict: bool = False, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """RAW_RECORD of all log files of a folder or glob, through ``LogFiles``."""
    spark.dataSource.register(LogFiles)
    reader = spark.read.format(LogFiles.name()).option("strict", str(strict).lower())
    return (reader.option("kinds", ",".join(kinds)) if kinds else reader).load(path)


def entry_intervals(controls: DataFrame, session: list[str], entry_id: str = "entry_id", order: str = "seq", kind: str = "kind", carry: tuple[str, ...] = ("name", "type")) -> DataFrame:
    """session.., entry_id, from_seq, to_seq and ``carry``: where each start of an
    entry holds, up to the next start or finish of the same entry (NULL: to the
    end). Only control rows are sorted, of which an entry has few."""
    window = Window.partitionBy(*session, entry_id).orderBy("from_seq")
    marks = controls.where(F.col(kind).isin("start", "finish")).select(*session, entry_id, kind, F.col(order).alias("from_seq"), *carry)
    return marks.withColumn("to_seq", F.lead("from_seq").over(window)).where(F.col(kind) == "start").select(*session, entry_id, "from_seq", "to_seq", *carry)


def resolve_entries(records: DataFrame, session: list[str], entry_id: str = "entry_id", order: str = "seq", kind: str = "kind", carry: tuple[str, ...] = ("name", "type"), controls: DataFrame | None = None, intervals: DataFrame | None = None) -> DataFrame:
    """The data rows whose last control row of the same entry is a start, with
    that start's columns. Data rows meet the intervals of ``entry_intervals`` on
    their key and range, so an entry is not gathered: Spark splits one that has most of a
    file. ``controls``: where the control rows are read from, if not from ``records``.
    ``intervals``, as a stored table, spares the data rows their shuffle too while the
    table is small enough for Spark to broadcast it."""
    spans = entry_intervals(records if controls is None else controls, session, entry_id, order, kind, carry) if intervals is None else intervals
    spans = spans.select(*[F.col(c).alias(f"own_{c}") for c in (*session, entry_id)], "from_seq", "to_seq", *[F.col(c).alias(f"live_{c}") for c in carry])
    met = (F.col(order) > F.col("from_seq")) & (F.col("to_seq").isNull() | (F.col(order) < F.col("to_seq")))
    for c in (*session, entry_id):
        met = F.col(c).eqNullSafe(F.col(f"own_{c}")) & met
    data = records.where(F.col(kind) == "data").drop(*carry).join(spans, met)
    return data.drop("from_seq", "to_seq", *[f"own_{c}" for c in (*session, entry_id)]).withColumnsRenamed({f"live_{c}": c for c in carry})


def resolve_entries_window(records: DataFrame, session: list[str], entry_id: str = "entry_id", order: str = "seq", kind: str = "kind", carry: tuple[str, ...] = ("name", "type")) -> DataFrame:
    """As ``resolve_entries``, by a running window over each entry: one shuffle of
    all rows, for control rows that are not few."""
    window = Window.partitionBy(*session, entry_id).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    control = F.when(F.col(kind).isin("start", "finish"), F.struct(F.col(kind).alias("state"), *[F.col(c).alias(f"live_{c}") for c in carry]))
    live = records.withColumn("control", F.last(control, ignorenulls=True).over(window)).where((F.col(kind) == "data") & (F.col("control.state") == "start"))
    return live.drop(*carry).select("*", *[F.col(f"control.live_{c}").alias(c) for c in carry]).drop("control")


def _floats(width: int, code: str):
    def decode(data: bytes) -> list[float]:
        return list(struct.unpack(f"<{len(data) // width}{code}", data)) if len(data) % width == 0 else None

    return decode


def _strings(data: bytes) -> list[str] | None:
    try:
        (n,) = struct.unpack_from("<I", data, 0)
        at, out = 4, []
        if n > (len(data) - 4) // 4:
            return None
        for _ in range(n):
            s, at = _text(data, at)
            out.append(s)
        return out
    except (struct.error, ValueError):
        return None


def _plain(v: float) -> str:
    return "nan" if math.isnan(v) else "inf" if v == math.inf else "-inf" if v == -math.inf else repr(v)


def decode_payload(declared: str, data: bytes, include_float: bool = False) -> tuple[str, float | None, list[str] | None] | None:
    """(text, number, items) of a payload by its declared type; None where the
    type is not handled or the length does not fit it."""
    n = len(data)
    if declared == "boolean":
        return (str(data[0] != 0), None, None) if n == 1 else None
    if declared == "int64":
        return (str(v := int.from_bytes(data, "little", signed=True)), float(v), None) if n == 8 else None
    if declared == "double" or declared == "float" and include_float:
        code, width = ("<d", 8) if declared == "double" else ("<f", 4)
        return (_plain(v := struct.unpack(code, data)[0]), v, None) if n == width else None
    if declared in ("string", "json"):
        return data.decode("utf-8", "replace"), None, None
    if declared == "msgpack":
        return data.hex(), None, None
    items: list | None
    if declared == "boolean[]":
        items = [b != 0 for b in data]
    elif declared == "int64[]":
        items = list(struct.unpack(f"<{n // 8}q", data)) if n % 8 == 0 else None
    elif declared in ("float[]", "double[]"):
        items = _floats(4, "f")(data) if declared == "float[]" else _floats(8, "d")(data)
    elif declared == "string[]":
        items = _strings(data)
    else:
        return None
    if items is None:
        return None
    texts = [x if isinstance(x, str) else str(x) if isinstance(x, (bool, int)) else _plain(x) for x in items]
    return json.dumps(items, ensure_ascii=False), None, texts


DECODED = "filename string, seq long, entry string, data_type string, value string, timestamp long, number double, items array<string>"


def decode_values(records: DataFrame, include_float: bool = False, observed: Observation | None = None) -> DataFrame:
    """DECODED of resolved data records: text, number and items by declared
    type. Payloads that do not fit their type are left out, and so are records
    of types that are not handled and the system clock's own entry. ``observed``
    counts decoded, misfit and unhandled records."""
    schema = pa.schema([("filename", pa.string()), ("seq", pa.int64()), ("entry", pa.string()), ("data_type", pa.string()), ("value", pa.string()), ("timestamp", pa.int64()), ("number", pa.float64()), ("items", pa.list_(pa.string())), ("fits", pa.bool_())])
    handled = HANDLED + ("float",) * include_float

    def run(batches):
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("filename", "seq", "name", "type", "payload", "timestamp"))
            for filename, seq, name, declared, payload, timestamp in zip(*columns):
                v = decode_payload(declared, payload or b"", include_float)
                out.append((filename, seq, name, declared, None, timestamp, None, None, False) if v is None else (filename, seq, name, declared, v[0], timestamp, v[1], v[2], True))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    own = records.where(~((F.col("name") == "systemTime") & (F.col("type") == "int64"))).select("filename", "seq", "name", "type", "payload", "timestamp")
    rows = own.mapInArrow(run, DECODED + ", fits boolean")
    if observed is not None:
        count = lambda c: F.count(F.when(c, 1))
        known = F.coalesce(F.col("data_type").isin(*handled), F.lit(False))
        rows = rows.observe(observed, count(F.col("fits")).alias("decoded"), count(~F.col("fits") & known).alias("misfit"), count(~F.col("fits") & ~known).alias("unhandled"))
    return rows.where("fits").drop("fits").withColumn("value", F.when(F.col("data_type").isin("string", "json"), one_line(F.col("value"))).otherwise(F.col("value")))


def long_records(spark: SparkSession, path: str, include_float: bool = False, strict: bool = False) -> DataFrame:
    """LONG records of log files: read, resolve, decode. Files are walked once for
    their control records and once for the data, which then need no shuffle."""
    controls = read_log_files(spark, path, strict, ("start", "finish"))
    resolved = resolve_entries(read_log_files(spark, path, strict, ("data",)), ["filename"], controls=controls)
    return decode_values(resolved, include_float).select("filename", "seq", "entry", "data_type", "value", "timestamp")
