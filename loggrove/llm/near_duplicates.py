"""MinHash near-duplicates by an LSH forest.

Every distinct shingle set has a signature of ``trees * depth`` values (their low
bytes). Tree t sorts all signatures from value t * depth on, sixteen values deep.
In sorted order the neighbours of a set are those with the longest common prefix;
those that share at least ``depth`` values are candidates. Where many sets share
that much, the nearest ones share more: the denser a region, the deeper it is
searched. A pair at similarity s shares the first values of a tree with probability
s**depth, so one at 0.8 shares none of 24 with probability 3e-6; in a crowd, more
than ``reach`` sets may lie between the two in all trees, so sets that share the first
values of a tree and are still apart are compared with each other.

Candidates are not links but join sets into canopies, and links inside a canopy are
exact (``canopies``); ``tests/llm/test_like_documents.py`` compares crowds with all
their pairs.
Links become components. Copies (equal sets) are one node throughout, however
many rows they are.

Nulls: null and empty texts have the empty set and no links. A row with a null
id gets a null component and stays. Rows that repeat an id and a text belong to
one class and stay or go together. Very long texts are shingled whole, in groups
of bounded size. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loggrove.llm.canopies import canopies_of, least_share, linked_components
from loggrove.llm.common import slices, whole_text, written
from loggrove.llm.shingles import MinHasher, Shingler, set_digest


def signed_sets(docs: DataFrame, shingle_words: int, permutations: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, signature. Of each value the low
    byte is kept: a minimum over a large set is small, so its high bits say
    little."""

    def run(batches):
        shingler, hasher = Shingler(shingle_words), MinHasher(permutations)
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingler.sets(part.column("text").cast(pa.binary()).to_pylist())
                found = (hasher.signatures(sets) & np.uint32(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())],
                    names=["doc_id", "n_shingles", "digest", "signature"],
                )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, signature binary")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, part: int = 80, whole: int = 100, trees: int = 24, depth: int = 4, reach: int = 6, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"))
    signed = written(signed_sets(texts, shingle_words, trees * depth), "signed")
    usable = signed.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    sets = written(usable.groupBy("digest").agg(F.min("doc_id").alias("node"), F.min("signature").alias("signature")), "distinct", release=True)
    canopies = canopies_of(sets, trees, depth, reach, least_share(part, whole, trees * depth))
    components = linked_components(texts, sets, canopies, shingle_words, part, whole, trees * depth)
    classes = sets.select("digest", "node").join(components, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    joined = signed.select("doc_id", "n_shingles", "digest").join(classes.hint("merge"), "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, shingle_words: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """The rows of ``docs`` of which one per class stays, columns as they were."""
    gone = near_duplicates(docs, shingle_words, part, whole).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs.doc_id.cast("long") == gone.gone_id, "left_anti")
