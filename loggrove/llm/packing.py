"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: class k holds pieces of
capacity / k tokens, and each of its bins takes exactly k pieces. A document is
cut into whole sequences first and its rest by the classes capacity/2,
capacity/4, ... down to ``least``; what then remains joins the last class, where
bins are filled one after the other and a piece may be cut at the end of a bin.
Every worker fills its own bins as it encodes, so nothing is shuffled.
Bins that a worker leaves part-filled are closed as sequences whose lengths are
powers of two, which need no padding.

Nulls: a null text is empty; a null id stays null. Every document has at least
its end token, so it has at least one piece. Ties do not matter: documents are
taken in the order in which they are read, repeated rows like any others. An
empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loggrove.llm.common import slices, whole_text
from loggrove.llm.encoding import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: sequence_id = partition * 2**SHIFT + number within the partition.
SHIFT = 36


def cut_lengths(n: int, capacity: int, least: int) -> list[int]:
    """Piece lengths of a document of ``n`` tokens: whole sequences, then one
    piece for each class that its rest contains, then what remains."""
    out = [capacity] * (n // capacity)
    rest, size = n % capacity, capacity // 2
    while size >= least:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return out + [rest] * (rest > 0)


class HarmonicPacker:
    """The open bins of one worker: at most one for each class.

    Full bins are handed out at once; an open one of class k keeps fewer than k
    pieces, so the state is small whatever the number of documents.
    """

    def __init__(self, capacity: int, least: int, first_id: int):
        self.capacity, self.least, self.next_id = capacity, least, first_id
        self.open: dict[int, list[tuple]] = {}
        self.tail: list[tuple] = []
        self.tail_length = 0

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset, sequence = 0, self.next_id
        self.next_id += 1
        for piece in pieces:
            yield (*piece, sequence, offset)
            offset += piece[2]

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[tuple]:
        """Takes one document; yields the pieces of the bins that it fills."""
        start, total = 0, len(ids)
        for length in cut_lengths(total, self.capacity, self.least):
            if length >= self.least:
                piece = (doc, start, length, zlib.crc32(ids[start : start + length]), total)
                waiting = self.open.setdefault(length, [])
                waiting.append(piece)
                if len(waiting) == self.capacity // length:
                    yield from self._close(waiting)
                    self.open[length] = []
            else:
                yield from self._add_tail(doc, start, ids[start : start + length], total)
            start += length

    def _add_tail(self, doc: int | None, start: int, ids: np.ndarray, total: int) -> Iterator[tuple]:
        while len(ids):
            take = min(len(ids), self.capacity - self.tail_length)
            self.tail.append((doc, start, ids[:take].copy(), total))
            self.tail_length += take
            ids, start = ids[take:], start + take
            if self.tail_length == self.capacity:
                yield from self._close([(d, s, len(x), zlib.crc32(x), t) for d, s, x, t in self.tail])
                self.tail, self.tail_length = [], 0

    def finish(self) -> Iterator[tuple]:
        """Closes the open bins by powers of two."""
        for length, waiting in self.open.items():
            while waiting:
                n = 1 << (len(waiting).bit_length() - 1)
                yield from self._close(waiting[:n])
                waiting = waiting[n:]
        rest = self.tail
        left = self.tail_length
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            taken, room = [], size
            while room:
                d, s, x, t = rest[0]
                n = min(len(x), room)
                taken.append((d, s, n, zlib.crc32(x[:n]), t))
                rest = ([(d, s + n, x[n:], t)] if n < len(x) else []) + rest[1:]
                room -= n
            yield from self._close(taken)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 2048, least: int = 64, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each piece: PIECES. ``capacity`` is a power of two."""

    def run(batches):
        context = TaskContext.get()
        packer = HarmonicPacker(capacity, least, context.partitionId() << SHIFT)
        words = encoder(tokenizer_path, True)
        names = [x.split()[0] for x in PIECES.split(", ")]

        def rows(found):
            columns = list(zip(*found)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for batch in batches:
            for part in slices(batch, "text"):
                ids, starts = words.ids(part.column("text").cast(pa.string()))
                out = []
                for k, doc in enumerate(part.column("doc_id").to_pylist()):
                    out.extend(packer.add(doc, np.append(ids[starts[k] : starts[k + 1]], np.uint32(end_id)).astype("<u4")))
                yield rows(out)
        yield rows(list(packer.finish()))

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text")).mapInArrow(run, PIECES)
