"""A bounded sample of labelled rows, for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loggrove.llm.common import whole_text, written


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, most_rows: int, most_bytes: int | None = None) -> DataFrame:
    """doc_id, text, label of at most ``most_rows`` labelled rows, as a table.

    Rows whose crc32(doc_id) mod ``modulus`` is ``held_out`` never take part.
    Labels without a document count for nothing. Which rows are taken depends on a
    hash of the id only, so the sample is the same in every run. With ``most_bytes``
    a row whose texts do not fit into what is left of so many bytes is passed over,
    and those after it still count. Ids and lengths alone reach the driver and are
    broadcast, and ``most_rows`` bounds them.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(whole_text()).cast("long").alias("bytes"))
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold != held_out))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    first = own.groupBy("doc_id").agg(F.sum("bytes").alias("bytes")).join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    taken, left = [], most_bytes
    for r in first.collect():
        if left is None or r["bytes"] <= left:
            taken.append((r["doc_id"], r["label"]))
            left = None if left is None else left - r["bytes"]
    ids = docs.sparkSession.createDataFrame(taken, "doc_id long, label int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return written(texts.join(F.broadcast(ids), "doc_id"), "labelled")
