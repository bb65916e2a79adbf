"""Centroid clustering of small-integer vectors by bit planes.

A vector has 64 components. Bit i of all of them, in two's complement, makes one
unsigned 64-bit number, its plane i. The dot product of two vectors is the sum,
over all pairs of their planes, of the number of bits that both have, times the
planes' weights (2**i, negative for the sign plane). So it is exact, and so are
squared distances and sums: a component's sum over a cluster is a weighted count
of its bits.

Vectors are stored as planes, written once. A round is one pass over them: each
task assigns its vectors and gives one row of sums for each centroid, so at most
tasks x centroids rows move and centroids x 64 numbers reach the driver,
whatever the number of vectors.

Nulls and odd rows: vectors that are null, have another length or a component
that is null or not finite are left out. Rows with a null id are clustered, but
begin no centroid unless all others do. Repeated rows count each. Equal distances go to the
smaller centroid. With fewer than ``k`` vectors there are as many centroids as
vectors; an empty table gives an empty result. Scaled components beyond 27 bits,
for which a squared distance need not fit a long, are an error. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loggrove.llm.common import written

SIZE, MOST_BITS = 64, 27


def to_planes(values: np.ndarray, bits: int) -> np.ndarray:
    """(rows, 64) integers as (rows, bits) planes; component d is bit 63 - d."""
    taken = (values[:, None, :] >> np.arange(bits)[None, :, None]) & 1
    return np.packbits(taken.astype(np.uint8), axis=2).view(">u8")[:, :, 0].astype(np.uint64)


def weights(bits: int) -> list[int]:
    return [1 << i for i in range(bits - 1)] + [-(1 << bits - 1)]


def dots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Dot products of each left vector with each right one, both as planes."""
    out = np.zeros((len(left), len(right)), np.int64)
    for i, u in enumerate(weights(left.shape[1])):
        for j, v in enumerate(weights(right.shape[1])):
            out += np.bitwise_count(left[:, i, None] & right[None, :, j]).astype(np.int64) * (u * v)
    return out


def norms(planes: np.ndarray) -> np.ndarray:
    """Squared lengths."""
    out = np.zeros(len(planes), np.int64)
    for i, u in enumerate(weights(planes.shape[1])):
        for j, v in enumerate(weights(planes.shape[1])):
            out += np.bitwise_count(planes[:, i] & planes[:, j]).astype(np.int64) * (u * v)
    return out


def component_sums(planes: np.ndarray) -> np.ndarray:
    """The sum of each component over all rows."""
    bits = np.unpackbits(planes.astype(">u8").view(np.uint8).reshape(len(planes), -1), axis=1).reshape(len(planes), -1, SIZE)
    return np.array(weights(planes.shape[1]), np.int64) @ bits.sum(0, dtype=np.int64)


def nearest(planes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and the squared distance to it."""
    distance = norms(planes)[:, None] + norms(centroids)[None, :] - 2 * dots(planes, centroids)
    cluster = distance.argmin(1)  # the first of equal ones
    return cluster, distance[np.arange(len(planes)), cluster]


def _unpacked(batch: pa.RecordBatch, bits: int) -> np.ndarray:
    column = batch.column("planes").cast(pa.binary(8 * bits))
    return np.frombuffer(column.buffers()[1], "<u8", len(column) * bits, column.offset * 8 * bits).reshape(-1, bits)


def scaled_vectors(vectors: DataFrame, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """vec_id and v, the integers floor(scale * x), of the vectors that count."""
    x = F.col(vector_column).cast("array<double>")
    own = vectors.select(F.col(id_column).cast("long").alias("vec_id"), x.alias("x")).where(F.size("x") == SIZE)
    odd = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    wide = F.raise_error(F.lit(f"a scaled component has more than {MOST_BITS} bits")).cast("long")
    floor = lambda e: F.when(F.abs(e * scale) < 2**MOST_BITS, F.floor(e * scale).cast("long")).otherwise(wide)
    return own.where(~odd).select("vec_id", F.transform("x", floor).alias("v"))


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each
    vector. Centroids begin as the ``k`` vectors whose ids hash lowest; each of
    ``rounds`` rounds assigns all vectors and moves each centroid to the floor of
    the mean of its own."""
    spark = vectors.sparkSession
    kept = scaled_vectors(vectors, scale, id_column, vector_column)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    widest = kept.select(F.max(F.array_max(F.transform("v", lambda e: F.greatest(e, -1 - e)))).alias("w")).first()["w"]
    if widest is None:
        return spark.createDataFrame([], schema)
    bits = int(widest).bit_length() + 1

    def pack(batches):
        for batch in batches:
            values = np.asarray(batch.column("v").flatten(), dtype=np.int64).reshape(-1, SIZE)
            planes = to_planes(values, bits).astype("<u8").tobytes()
            at = pa.array(np.arange(len(values) + 1) * 8 * bits, pa.int32())
            packed = pa.Array.from_buffers(pa.binary(), len(values), [None, at.buffers()[1], pa.py_buffer(planes)])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), packed], names=["vec_id", "planes"])

    planes = written(kept.mapInArrow(pack, "vec_id long, planes binary"), "planes")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    begin = kept.orderBy(name.asc_nulls_last(), "v").limit(k).collect()
    centroids = [list(r["v"]) for r in begin]

    def step(centroids):
        def run(batches):
            targets = to_planes(np.array(centroids, np.int64), bits)
            sums, counts = np.zeros((len(centroids), SIZE), np.int64), np.zeros(len(centroids), np.int64)
            for batch in batches:
                own = _unpacked(batch, bits)
                cluster, _ = nearest(own, targets)
                counts += np.bincount(cluster, minlength=len(centroids))
                for c in np.unique(cluster):
                    sums[c] += component_sums(own[cluster == c])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(centroids)), pa.int32()), pa.array(counts, pa.int64()), pa.array(list(sums), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

        return planes.select("planes").mapInArrow(run, "cluster int, n long, sums array<long>")

    for _ in range(rounds):
        total = lambda c: F.sum(c.cast("decimal(38,0)"))
        parts = step(centroids).groupBy("cluster").agg(total(F.col("n")).alias("n"), *[total(F.col("sums")[d]).alias(f"s{d}") for d in range(SIZE)])
        for row in parts.collect():
            if row["n"]:
                centroids[row["cluster"]] = [int(row[f"s{d}"]) // int(row["n"]) for d in range(SIZE)]

    def assign(batches):
        targets = to_planes(np.array(centroids, np.int64), bits)
        for batch in batches:
            cluster, distance = nearest(_unpacked(batch, bits), targets)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    assigned = planes.mapInArrow(assign, "vec_id long, cluster int, distance long")
    names = [(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    inertia = dict(assigned.groupBy("cluster").agg(F.sum("distance")).collect())
    # one row for each centroid
    facts = spark.createDataFrame([(c, inertia.get(c, 0), sum(inertia.values()), s) for c, s in names], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
