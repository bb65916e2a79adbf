"""Token counts through a digest cache.

A text is known by the SHA-256 of its bytes, a tokenizer by the digest of its
vocabulary and library. Counts live in a table keyed by both digests; only the
distinct texts that the table lacks are encoded, and their counts are appended.

Nulls: a null text counts as empty, a null id stays null. Empty texts have 0
tokens. Equal texts are encoded once and share their count; repeated rows each
get a row. Very long texts are encoded whole. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loggrove.llm.common import among, slices, whole_text, written
from loggrove.llm.encoding import encoder, tokenizer_digest

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; none where the table does not exist yet."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, content_digest of every row.

    The text moves through one shuffle at most, and not at all where its count is
    stored (but for the few that a filter of fixed size cannot tell apart). Only ids and
    digests are joined with the cache, where one digest may hold a third of all rows (a
    sort-merge join, which Spark splits).
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"))
    keyed = written(texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("content_digest")), "digests")
    cached = read_cache(spark, cache_path).where(F.col("tokenizer_digest") == version)
    # one row stands for all of a text; rows that share an id, null ones too, are told apart by the digest
    missing = keyed.groupBy("content_digest").agg(F.min("doc_id").alias("doc_id")).join(cached, "content_digest", "left_anti")
    # of the texts only those that may be missing are hashed again and moved; none where all counts are stored
    named = among(texts, "doc_id", missing.select("doc_id")).withColumn("own", F.unhex(F.sha2("text", 256)))
    picked = named.join(missing.hint("shuffle_hash"), named.doc_id.eqNullSafe(missing.doc_id) & (named.own == missing.content_digest)).select("content_digest", "text")

    def encode(batches):
        words = encoder(tokenizer_path, False)
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [part.column("content_digest"), pa.array([version] * part.num_rows, pa.string()), pa.array(words.counts(part.column("text").cast(pa.string())), pa.int64())],
                    names=["content_digest", "tokenizer_digest", "n_tokens"],
                )

    fresh = picked.mapInArrow(encode, CACHE_SCHEMA)
    # rows that repeat an id and its text would store their count twice
    fresh.groupBy("content_digest", "tokenizer_digest").agg(F.max("n_tokens").alias("n_tokens")).write.mode("append").parquet(cache_path)
    stored = read_cache(spark, cache_path).where(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    # a key of its own makes Spark shuffle both sides for the join, so that it can split a text of many copies
    stored = stored.select(F.substring("content_digest", 1, 32).alias("own"), "n_tokens")
    return keyed.withColumn("own", F.substring("content_digest", 1, 32)).join(stored.hint("merge"), "own", "left").select("doc_id", "n_bytes", "n_tokens", "content_digest")
