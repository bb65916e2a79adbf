"""Document fingerprints: MinHash over word shingles.

A fingerprint has the smallest values of ``VALUES`` permutations over a text's
set of five-word shingles (their low eight bits, as hex); the share of equal
values estimates the Jaccard similarity of two sets. To find like documents, all
values are grouped into ``BANDS`` bands of ``ROWS``. Each band brings documents
with equal values together, sorted by the values after them; neighbours are
candidates, and those of a band that these leave apart are compared with each
other. Candidates are then verified by their full sets as ``canopies``
states: a large band needs neither all its pairs nor a leader. ``class_id`` is
the smallest id that a chain of verified links (or an equal set) reaches.

Nulls: a null text counts as empty; a null id stays null, sorts last and has no
class. The empty text has a fingerprint of its own. Equal texts have equal
fingerprints. Rows that repeat an id are ordered by a hash of their text, then
by the text. Very long texts are shingled whole, in groups of bounded size. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loggrove.llm.canopies import canopies_of, least_share, linked_components
from loggrove.llm.common import slices, whole_text, written
from loggrove.llm.shingles import MinHasher, Shingler, set_digest

VALUES, BANDS, ROWS = 128, 32, 4
#: Neighbours on each side that are candidates.
REACH = 6
FIRST = -(2**63)
RESULT = "doc_id long, n_chars long, edited_sha256 string, values binary, edited_values binary, near_edited double, near_next double, digest binary"


class Fingerprinter:
    """Fingerprints of texts, as rows of bytes."""

    def __init__(self, shingle_words: int = 5):
        self.shingler, self.hasher = Shingler(shingle_words), MinHasher(VALUES, seed=11)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        return self.of_sets(self.shingler.sets(texts))

    def of_sets(self, sets: list[np.ndarray]) -> np.ndarray:
        return (self.hasher.signatures(sets) & np.uint32(255)).astype(np.uint8)


def fingerprints(docs: DataFrame, shingle_words: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, values (binary) of every row."""

    def run(batches):
        make = Fingerprinter(shingle_words)
        for batch in batches:
            for part in slices(batch, "text"):
                found = make(part.column("text").cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([v.tobytes() for v in found], pa.binary())], names=["doc_id", "values"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text")).mapInArrow(run, "doc_id long, values binary")


def _compared(make: Fingerprinter, rows: list[tuple], followers: list[tuple]) -> dict:
    """Columns of RESULT for rows (doc_id, text, values, digest), each with the
    (text, values) that follows it."""
    texts = [r[1] for r in rows]
    edited = [(t[: len(t) - len(t) // 3] + f[0][: len(t) // 3]).encode() for t, f in zip(texts, followers)]
    other = make(edited)
    own = np.array([r[2] for r in rows])
    return {
        "doc_id": pa.array([r[0] for r in rows], pa.int64()),
        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
        "values": pa.array([v.tobytes() for v in own], pa.binary()),
        "edited_values": pa.array([v.tobytes() for v in other], pa.binary()),
        "near_edited": pa.array((own == other).mean(axis=1)),
        "near_next": pa.array((own == np.array([f[1] for f in followers])).mean(axis=1)),
        "digest": pa.array([r[3] for r in rows], pa.binary()),
    }


def edited_fingerprints(docs: DataFrame, shingle_words: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, values, edited_values, near_edited,
    near_next, digest (of the shingle set) of every row: the last third of a text
    gives way to the beginning of the next document's.

    Texts move once, into ranges of descending ids. The first and the last row of
    each range are kept with their texts, and meet their neighbours in a join of
    as many rows as there are ranges; of these, numbers alone come to the driver.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"))
    keyed = texts.withColumn("place", F.coalesce("doc_id", F.lit(FIRST))).withColumn("hash", F.xxhash64("text"))
    order = [F.desc("place"), F.asc("hash")]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order, F.asc("text")).select("doc_id", "text")

    def run(batches):
        make, part = Fingerprinter(shingle_words), TaskContext.get().partitionId()
        head = held = None  # the last row waits for the one after it
        for batch in batches:
            for piece in slices(batch, "text"):
                strings = piece.column("text").to_pylist()
                sets = make.shingler.sets([t.encode() for t in strings])
                rows = list(zip(piece.column("doc_id").to_pylist(), strings, make.of_sets(sets), map(set_digest, sets)))
                if head is None:
                    head = rows[0]
                rows = ([held] if held else []) + rows
                held = rows.pop()
                if rows:
                    columns = _compared(make, rows, [(r[1], r[2]) for r in [*rows[1:], held]])
                    yield pa.RecordBatch.from_pydict(columns | {"part": pa.nulls(len(rows), pa.int32()), "edge": pa.nulls(len(rows), pa.string()), "text": pa.nulls(len(rows), pa.string())})
        if head is not None:
            nothing = {c: pa.nulls(2, t) for c, t in (("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("values", pa.binary()), ("edited_values", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("digest", pa.binary()))}
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([head[0], held[0]], pa.int64())} | nothing | {"part": pa.array([part, part], pa.int32()), "edge": pa.array(["head", "tail"]), "text": pa.array([head[1], held[1]])})

    def join_up(batches):
        make = Fingerprinter(shingle_words)
        for batch in batches:
            for piece in slices(batch, "text", 500_000):
                strings, following = piece.column("text").to_pylist(), piece.column("next_text").to_pylist()
                sets = make.shingler.sets([t.encode() for t in strings])
                rows = list(zip(piece.column("doc_id").to_pylist(), strings, make.of_sets(sets), map(set_digest, sets)))
                if rows:
                    yield pa.RecordBatch.from_pydict(_compared(make, rows, list(zip(following, make([t.encode() for t in following])))))

    table = written(ordered.mapInArrow(run, f"{RESULT}, part int, edge string, text string"), "edited", release=True)
    edges = table.where("edge is not null").select("doc_id", "part", "edge", "text")
    parts = sorted(r["part"] for r in edges.where("edge = 'tail'").select("part").collect())
    # the ring closes: the first document follows the last
    ring = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next int")
    heads = edges.where("edge = 'head'").select(F.col("part").alias("next"), F.col("text").alias("next_text"))
    last = edges.where("edge = 'tail'").join(ring, "part").join(heads, "next").select("doc_id", "text", "next_text").mapInArrow(join_up, RESULT)
    return table.where("edge is null").select(*last.columns).unionByName(last)


def fingerprint_table(docs: DataFrame, part: int = 80, whole: int = 100, shingle_words: int = 5) -> DataFrame:
    """Every row's own and edited fingerprint with their likenesses, and its
    class of like documents (``class_id``)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    table = edited_fingerprints(docs, shingle_words)
    sets = table.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), F.min("values").alias("signature"))
    sets = written(sets, "distinct", release=True)
    canopies = canopies_of(sets, BANDS, ROWS, REACH, least_share(part, whole, VALUES))
    classes = linked_components(texts, sets, canopies, shingle_words, part, whole, VALUES)
    classes = sets.join(classes, "node", "left").select(F.col("digest").alias("own"), F.coalesce("component", "node").alias("class_id"))
    # a key of its own makes Spark shuffle both sides for the join, so that it can split a set of many copies
    found = table.withColumn("key", F.xxhash64("digest")).join(classes.withColumn("key", F.xxhash64("own")).hint("merge"), "key", "left").where("own is null or own = digest")
    return found.select(
        "doc_id", "n_chars", "edited_sha256", F.lower(F.hex("values")).alias("fingerprint"), F.lower(F.hex("edited_values")).alias("edited_fingerprint"), "near_edited", "near_next",
        F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"),
    )
