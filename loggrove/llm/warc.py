"""WARC archives: a writer of one gzip member per record and a sequential reader.

The reader takes an archive as a stream: it inflates block by block, frames
records by their content length and checks block and payload digests, so its
memory is one record. Records with equal payloads are written once as a
response; the others are revisits that refer to it. Archives go to a folder that
all machines share; a table of the archives that succeeded tells which files
count, so what a lost task left behind is never read.

Nulls: a null html is an empty payload; a page with a null id is written too and
never becomes the response of a group that has another id. Empty payloads are
records like any other. Of rows that repeat an id and a payload all are
responses if one is. An empty table gives no archives and no rows. Columns other
than id, url and html are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loggrove.llm.common import fresh_path, written

DATE = "2024-01-01T00:00:00Z"
ARCHIVES = "path string, records long, bytes long"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def name_of(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def id_of(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member. A revisit has the HTTP header of its page alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": name_of(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": "".join((url or "").split()),
        "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}",
        "WARC-Block-Digest": f"sha1:{base32_sha1(block)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if revisit:
        fields |= {"WARC-Refers-To": name_of(refers_to), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", compresslevel=5, mtime=0)


class _Inflated:
    """The inflated bytes of a file of gzip members, as they are needed."""

    def __init__(self, stream: BinaryIO, step: int = 1 << 16):
        self.stream, self.step = stream, step
        self.inflate = zlib.decompressobj(31)
        self.raw, self.ready, self.ended = b"", bytearray(), False

    def more(self) -> bool:
        if self.inflate.eof:  # the next member
            self.raw = self.inflate.unused_data or self.raw
            self.inflate = zlib.decompressobj(31)
        elif self.inflate.unconsumed_tail:
            self.raw = self.inflate.unconsumed_tail
        if not self.raw:
            self.raw = self.stream.read(self.step)
        if not self.raw:
            self.ended = True
            return False
        self.ready += self.inflate.decompress(self.raw, self.step)
        self.raw = b""
        return True

    def until(self, mark: bytes) -> bytes | None:
        at = 0
        while (k := self.ready.find(mark, at)) < 0:
            at = max(0, len(self.ready) - len(mark) + 1)
            if not self.more():
                if self.ready.strip():
                    raise ValueError("the archive ends within a record")
                return None
        out = bytes(self.ready[:k])
        del self.ready[: k + len(mark)]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.ready) < n:
            if not self.more():
                raise ValueError("the archive ends within a record")
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def read_records(stream: BinaryIO) -> Iterator[tuple]:
    """The records of an archive as RECORDS has them, one after the other.
    Raises ValueError where framing or a digest is wrong."""
    source = _Inflated(stream)
    while (head := source.until(b"\r\n\r\n")) is not None:
        if not head.startswith(b"WARC/1."):
            raise ValueError("a record does not begin with its version")
        fields = _fields(head)
        block = source.exactly(int(fields["content-length"]))
        if source.exactly(4) != b"\r\n\r\n":
            raise ValueError("a record is longer than it says")
        if fields.get("warc-block-digest", f"sha1:{base32_sha1(block)}") != f"sha1:{base32_sha1(block)}":
            raise ValueError(f"block digest of {fields['warc-record-id']}")
        kind = fields["warc-type"]
        if kind not in ("response", "revisit"):
            continue
        http, _, payload = block.partition(b"\r\n\r\n")
        length = int(_fields(http)["content-length"])
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and (len(payload) != length or base32_sha1(payload) != digest):
            raise ValueError(f"payload digest of {fields['warc-record-id']}")
        refers = id_of(fields["warc-refers-to"]) if kind == "revisit" else None
        yield id_of(fields["warc-record-id"]), fields["warc-target-uri"], kind, length, digest, refers, payload if kind == "response" else None


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, digest, refers_to of the pages whose payload (of at least
    ``least_bytes``) a page with a larger id has too. Payloads are equal if their
    SHA-256 is, as SHA-1 collisions can be made. Only ids and digests are
    shuffled, and a payload of many pages is split."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    keyed = written(pages.select(F.col("page_id").cast("long").alias("page_id"), F.unhex(F.sha2(payload, 256)).alias("digest"), F.octet_length(payload).alias("n")), "payloads")
    groups = keyed.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    groups = groups.select(F.substring("digest", 1, 32).alias("own"), "refers_to")
    joined = keyed.where(F.col("n") >= least_bytes).withColumn("own", F.substring("digest", 1, 32)).join(groups.hint("merge"), "own")
    return joined.where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = 256 << 20) -> DataFrame:
    """Writes the pages (page_id, url, html) to WARC files under ``folder`` and
    returns the table of the files (ARCHIVES) that all machines may read."""

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        # a second attempt at a task writes files of its own
        stem = f"{root}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"
        out, done, size, records = None, [], 0, 0

        def close():
            nonlocal out, size, records
            if out is not None:
                out.close()
                done.append((f"{stem}-{len(done):04d}.warc.gz", records, size))
                out, size, records = None, 0, 0

        for batch in batches:
            for page, url, html, refers, revisit in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to", "revisit"))):
                if out is None:
                    out = store.open_output_stream(f"{stem}-{len(done):04d}.warc.gz", compression=None)
                data = record(page.as_py(), url.as_py(), html.as_py(), refers.as_py(), revisit.as_py())
                out.write(data)
                size += len(data)
                records += 1
                if size >= archive_bytes:
                    close()
        close()
        if done:
            paths, counts, sizes = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=["path", "records", "bytes"])

    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    known = revisits(pages, least_bytes).select(F.col("page_id").alias("own"), F.col("digest").alias("own_digest"), "refers_to")
    same = rows.page_id.eqNullSafe(known.own) & (F.unhex(F.sha2(rows.payload, 256)) == known.own_digest)
    marked = rows.join(known.hint("shuffle_hash"), same, "left").select("page_id", "url", "payload", "refers_to", F.col("refers_to").isNotNull().alias("revisit"))
    return written(marked.mapInArrow(run, ARCHIVES), "archives")


def read_archives(archives: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """RECORDS of the files that ``archives`` names, one file after the other in
    each task. Without ``payloads`` they are checked but not returned."""

    def run(batches):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        names = [c.split()[0] for c in RECORDS.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                found, size = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for r in read_records(stream):
                        found.append(r if payloads else (*r[:-1], None))
                        size += len(r[-1] or b"") + 200 if payloads else 200
                        if size > 4_000_000:
                            yield rows(found)
                            found, size = [], 0
                if found:
                    yield rows(found)

    width = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("path").repartition(width, "path").mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes the pages to archives and reads them back, without payloads."""
    folder = fresh_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, least_bytes), folder, payloads=False).drop("payload")
