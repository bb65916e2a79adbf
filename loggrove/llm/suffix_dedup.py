"""Suffix-array dedup: removes every byte of a repeated string of 100 bytes.

A byte goes if it is covered by a string of ``length`` bytes that also starts
earlier, in a document with a smaller id or further up in the same one.

1. *Suffixes.* Sorting the suffixes at all bytes would move every text a hundred
   times. Every string is stood for by one suffix, chosen by the string's own bytes
   (``suffixes.sampled_suffixes``), so that equal strings meet at equal suffixes:
   three bytes in a hundred begin one. Suffixes whose first 32 bytes
   occur nowhere else stand for no repeated string; hashes of these bytes, one
   for each task and hash, find them. Copies of whole texts are found by digest.
2. *Buckets.* The others move with the bytes that their strings cover. Spark
   samples splitters and range-partitions them by their leading bytes, then by
   place, so that equal suffixes may take several buckets.
3. *Sort and compare.* In a bucket suffixes are sorted by a multikey quicksort.
   Equal ones with equal surroundings are one; of the others that share 32 bytes
   the strings around them are sorted the same way. Of equal strings the first
   stays, byte by byte compared.
4. *Across boundaries.* Suffixes that share their leading bytes with the first or
   the last one of their bucket may have equals in another bucket: of each of
   their strings the first place in the bucket goes to one aggregation over all.

Nulls: a null text is empty; rows with a null id come behind all others. Texts
below ``length`` bytes lose nothing. Rows that share an id and differ in text
come in the order of a digest of the text; rows that are equal in both are one
document, and none loses what the other has. Texts are taken whole, long ones in
blocks. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loggrove.llm.common import slices, whole_text, written
from loggrove.llm.suffixes import GRAM, equal_groups, gather, later, runs, sampled_suffixes

LAST = (1 << 63) - 1
#: Strings of a text handled at a time; suffixes of a task whose hashes are combined; strings sorted at a time.
BLOCK, COMBINED, SORTED = 1 << 19, 1 << 20, 300_000


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, and its offsets."""
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64, len(column) + 1, column.offset * 8)
    n = int(offsets[-1] - offsets[0])
    return np.frombuffer(data, np.uint8, n, int(offsets[0])) if n else np.zeros(0, np.uint8), offsets - offsets[0]


def _blocks(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``sampled_suffixes`` of the texts, a block of strings at a time."""
    for b in range(0, max(len(data) - length + 1, 0), BLOCK):
        part = data[b : b + BLOCK + length - 1]
        own = np.clip(offsets - b, 0, len(part))
        # texts that the block cuts off go on in the next one, where the strings on the cut begin
        text, start, at, size, gram = sampled_suffixes(part, own, length)
        yield text, start + np.maximum(b - offsets[text], 0), at, size, gram


# place of a group of strings in a text, as one number: start, at, size, and whether it is known to recur
def _pack(start, at, size, sure):
    return ((start << 10 | at) << 10 | size) << 1 | sure


def _unpack(span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return span >> 21, span >> 11 & 1023, span >> 1 & 1023, span & 1


def _suffix_hashes(length: int):
    """hash, ord, tag, span of the suffixes: of those of a task with one hash the
    first has it, the others, which are known to recur, have any other, so no
    hash has more rows than there are tasks."""

    def combined(held: list) -> pa.RecordBatch:
        gram, own, tag, span = (np.concatenate([h[k] for h in held]) for k in range(4)) if held else (np.zeros(0, np.int64),) * 4
        order = np.argsort(gram, kind="stable")
        gram, own, tag, span = gram[order], own[order], tag[order], span[order]
        new = np.ones(len(gram), bool)
        new[1:] = gram[1:] != gram[:-1]
        number = np.cumsum(new) - 1
        span = span | (np.bincount(number)[number] > 1 if len(number) else np.zeros(0, bool)).astype(np.int64)
        with np.errstate(over="ignore"):
            hash_ = np.where(new, gram, (own ^ tag ^ (span << 13)) * np.int64(0x9E3779B97F4A7C1))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (hash_, own, tag, span)], names=["hash", "ord", "tag", "span"])

    def run(batches):
        held, count = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                own, tag = part.column("ord").to_numpy(), part.column("tag").to_numpy()
                for text, start, at, size, gram in _blocks(*_buffer(part.column("text")), length):
                    held.append((gram.view(np.int64), own[text], tag[text], _pack(start, at, size, 0)))
                    count += len(text)
                if count >= COMBINED:
                    yield combined(held)
                    held, count = [], 0
        yield combined(held)

    return run


def _recurring(batches):
    """ord, tag, span of the suffixes whose hash occurs twice in the partition, which
    has all of a hash, or which are known to recur."""
    held = [[batch.column(k).to_numpy() for k in range(4)] for batch in batches]
    if not held:
        return
    hash_, own, tag, span = (np.concatenate([h[k] for h in held]) for k in range(4))
    order = np.argsort(hash_, kind="stable")
    hash_, own, tag, span = hash_[order], own[order], tag[order], span[order]
    new = np.ones(len(hash_), bool)
    new[1:] = hash_[1:] != hash_[:-1]
    number = np.cumsum(new) - 1
    keep = (np.bincount(number) > 1)[number] | (np.bincount(number, span & 1) > 0)[number] if len(number) else new
    yield pa.RecordBatch.from_arrays([pa.array(x[keep], pa.int64()) for x in (own, tag, span)], names=["ord", "tag", "span"])


def _cut(length: int):
    """ord, tag, start, at, region: the bytes that a suffix's strings cover."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = _buffer(part.column("text"))
                spans = part.column("spans")
                sizes = np.asarray(spans.value_lengths(), dtype=np.int64)
                own = np.repeat(np.arange(part.num_rows), sizes)
                start, at, size, _ = _unpack(np.asarray(spans.flatten(), dtype=np.int64))
                width = size + length - 1
                out = np.concatenate([[0], np.cumsum(width)])
                region = data[np.repeat(offsets[own] + start - out[:-1], width) + np.arange(out[-1])]
                bytes_ = pa.Array.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(out.astype(np.int64)), pa.py_buffer(region)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.column("ord").to_numpy()[own]), pa.array(part.column("tag").to_numpy()[own]), pa.array(start, pa.int64()), pa.array(at, pa.int32()), bytes_.cast(pa.binary())],
                    names=["ord", "tag", "start", "at", "region"],
                )

    return run


MARKS = "ord long, tag long, start long, size long, string binary"


def _marks(own, tag, start, size, strings=None) -> pa.RecordBatch:
    n = len(own)
    bytes_ = pa.nulls(n, pa.binary()) if strings is None else pa.array(list(strings), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (own, tag, start, size)] + [bytes_], names=["ord", "tag", "start", "size", "string"])


def _compare(length: int):
    """MARKS of one bucket: strings that have an equal one before them in the
    bucket, as runs of starts, and, with their bytes, the first of each string
    that may have equals in other buckets."""
    whole = -(-length // 8) * 8

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        own, tag, start, at = (np.concatenate([b.column(c).to_numpy() for b in held]).astype(np.int64) for c in ("ord", "tag", "start", "at"))
        data, offsets = _buffer(pa.concat_arrays([b.column("region") for b in held]))
        size = np.diff(offsets) - length + 1
        widest = -(-int(np.diff(offsets).max()) // 8) * 8
        data = np.concatenate([data, np.zeros(widest + whole, np.uint8)])
        n = len(own)
        lead = gather(data, offsets[:-1] + at, GRAM)
        group = np.full(n, -1)
        rows, number = equal_groups([lambda r, k=k: lead[r, k] for k in range(GRAM // 8)], n)
        group[rows] = number
        # suffixes that begin like the first or the last of the bucket
        border = np.zeros(n, bool)
        for end in (np.min, np.max):
            found = np.arange(n)
            for k in range(GRAM // 8):
                found = found[lead[found, k] == end(lead[found, k])]
            border[found] = True
            if group[found[0]] < 0:
                group[found] = group.max() + 1

        # suffixes with equal surroundings are one
        rows = np.flatnonzero(group >= 0)

        def word(k):
            def key(r):
                room = offsets[rows[r] + 1] - offsets[rows[r]] - 8 * k
                value = gather(data, offsets[rows[r]] + np.minimum(8 * k, offsets[rows[r] + 1] - offsets[rows[r]]), 8)[:, 0]
                short = np.clip(8 - room, 0, 8).astype(np.uint64) * np.uint64(8)
                # bytes behind the region's end do not count
                return np.where(short >= 64, np.uint64(0), value >> np.minimum(short, np.uint64(63)))

            return key

        same, number = equal_groups([lambda r: at[rows[r]] << 10 | size[rows[r]], *[word(k) for k in range(widest // 8)]], len(rows), group[rows])
        same = rows[same]
        repeat = later(number, own[same], tag[same], start[same])
        gone = same[repeat]
        yield _marks(own[gone], tag[gone], start[gone], size[gone])
        keep = group >= 0
        keep[gone] = False
        # a suffix that is alone now has nothing to be compared with, but at the borders
        rows = np.flatnonzero(keep)
        alone = np.bincount(group[rows])[group[rows]] == 1
        rows = rows[~alone | border[rows]]
        rows = rows[np.argsort(group[rows], kind="stable")]
        found: list[tuple] = []
        for chunk, offset in _portions(rows, group, at, size):
            # every string of these suffixes, or the one that begins so far before each
            if offset is None:
                of = np.repeat(chunk, size[chunk])
                step = np.arange(len(of)) - np.repeat(np.cumsum(size[chunk]) - size[chunk], size[chunk])
            else:
                of = chunk[(at[chunk] >= offset) & (at[chunk] - offset < size[chunk])]
                step = at[of] - offset
            if not len(of):
                continue
            text = gather(data, offsets[of] + step, whole)
            if whole > length:
                text[:, -1] >>= np.uint64(8 * (whole - length))
            begun = group[of] << 10 | (at[of] - step)
            equal, number = equal_groups([lambda r, k=k: text[r, k] for k in range(whole // 8)], len(of), begun)
            at_text = (own[of], tag[of], start[of] + step)
            behind = later(number, *[x[equal] for x in at_text])
            marked = equal[behind]
            found.append(tuple(x[marked] for x in at_text))
            first = border[of]
            first[marked] = False
            first = np.flatnonzero(first)
            if len(first):
                strings = [data[p : p + length].tobytes() for p in offsets[of[first]] + step[first]]
                yield _marks(*[x[first] for x in at_text], np.ones(len(first), np.int64), strings)
        if found:
            yield _marks(*runs(*[np.concatenate(c) for c in zip(*found)]))

    return run


def _portions(rows: np.ndarray, group: np.ndarray, at: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, int | None]]:
    """Whole groups with some SORTED strings together; of a group that has more,
    all strings that begin equally far before their suffix (others are never equal)."""
    if not len(rows):
        return
    edges = np.concatenate([[0], np.flatnonzero(np.diff(group[rows])) + 1, [len(rows)]])
    total = np.concatenate([[0], np.cumsum(size[rows])])
    k = 0
    while k < len(edges) - 1:
        m = max(int(np.searchsorted(total[edges], total[edges[k]] + SORTED, "right")) - 1, k + 1)
        chunk = rows[edges[k] : edges[m]]
        if total[edges[m]] - total[edges[k]] <= SORTED:
            yield chunk, None
        else:
            for offset in range(int((at[chunk] - size[chunk]).min()) + 1, int(at[chunk].max()) + 1):
                yield chunk, offset
        k = m


def _remove(length: int):
    """doc_id, n_bytes, n_removed, n_spans, kept of texts with the starts of their
    repeated strings."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = _buffer(part.column("text"))
                marks = part.column("marks")
                starts, sizes = (np.asarray(marks.flatten().field(k), dtype=np.int64) for k in (0, 1))
                sizes_of = np.asarray(pc.fill_null(marks.value_lengths(), 0), dtype=np.int64)
                own = np.repeat(np.arange(part.num_rows), sizes_of)
                gone = np.zeros(len(data) + 1, bool)
                for a, b in zip((offsets[own] + starts).tolist(), (offsets[own] + starts + sizes + length - 1).tolist()):
                    gone[a:b] = True
                rise = gone[:-1].copy()
                rise[1:] &= ~gone[:-2]
                heads = offsets[:-1][offsets[:-1] < offsets[1:]]
                rise[heads] = gone[heads]
                count = lambda m: np.diff(np.concatenate([[0], np.cumsum(m)])[offsets])
                removed = count(gone[:-1])
                kept = np.concatenate([[0], np.cumsum(np.diff(offsets) - removed)])
                rest = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(kept.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[~gone[:-1]]))])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(count(rise), pa.int64()), rest.cast(pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    return run


def without_repeats(docs: DataFrame, length: int = 100, bucket_rows: int = 200_000, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the
    bytes that stay; a run may begin or end within a character) of every row.
    ``length`` lies between 64 and 1000 bytes."""
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"))
    digest = F.sha2(F.col("text").cast("binary"), 256)
    # ord and tag name a text: 60 bits of its digest tell rows apart that share an id
    texts = texts.withColumns({"ord": F.coalesce("doc_id", F.lit(LAST)), "tag": F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")})
    facts = written(texts.select("ord", "tag", F.unhex(digest).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")).where(F.col("n_bytes") >= length), "texts").distinct()
    first = facts.groupBy("digest").agg(F.min("ord").alias("first_ord"))
    known = written(facts.join(first, "digest").select("ord", "tag", "n_bytes", (F.col("ord") > F.col("first_ord")).alias("copy")), "copies")

    hashes = texts.select("ord", "tag", "text").mapInArrow(_suffix_hashes(length), "hash long, ord long, tag long, span long")
    likely = written(hashes.repartition("hash").mapInArrow(_recurring, "ord long, tag long, span long"), "suffixes", release=True)
    # rows that are equal in id and text have the same places
    spans = likely.groupBy("ord", "tag").agg(F.collect_set("span").alias("spans")).join(known.where("not copy").select("ord", "tag"), ["ord", "tag"])
    cut = texts.select("ord", "tag", "text").dropDuplicates(["ord", "tag"]).join(spans, ["ord", "tag"]).select("ord", "tag", "text", "spans")
    regions = written(cut.mapInArrow(_cut(length), "ord long, tag long, start long, at int, region binary"), "regions", release=True)

    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-regions.count() // bucket_rows))
    placed = regions.repartitionByRange(buckets, F.expr(f"substring(region, at + 1, {GRAM})"), "ord", "tag", "start")
    found = written(placed.mapInArrow(_compare(length), MARKS), "marks", release=True)
    border = found.where("string is not null").select("string", F.struct("ord", "tag", "start").alias("place"))
    late = border.join(border.groupBy("string").agg(F.min("place").alias("first_place")), "string").where("place > first_place").select("place.*", F.lit(1).cast("long").alias("size"))
    copies = known.where("copy").select("ord", "tag", F.lit(0).cast("long").alias("start"), (F.col("n_bytes") - (length - 1)).alias("size"))
    marks = found.where("string is null").select("ord", "tag", "start", "size").unionByName(late).unionByName(copies)
    lists = marks.groupBy("ord", "tag").agg(F.collect_list(F.struct("start", "size")).alias("marks"))
    marked = texts.join(lists, ["ord", "tag"], "left").select("doc_id", "text", "marks")
    return marked.mapInArrow(_remove(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
