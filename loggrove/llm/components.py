"""Connected components of a graph that no machine holds.

Large-star and small-star steps in turn: each hangs the neighbours of a node on
the smallest of them, so chains shorten fast and the number of edges never
grows. Every step is a min per node (pre-aggregated before the shuffle) and a
join with it; the join's key is an expression of its own, so that both sides are
shuffled for it and Spark can split the rows of a hub. Before each step the edges are
read by tasks of a million each, as they happen to lie, and joined there to stars: no task
has more, and what one can hold needs no further step. Each round is written to the shared folder, where a lost
executor's successor finds it. Rounds end when all edges lead from a node that no edge
leads to, to a single smallest one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loggrove.llm.common import written


def _joined_with_least(pairs: DataFrame) -> DataFrame:
    """u, v and m, the least v of each u."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").bitwiseXOR(F.lit(-1)).alias("key"), "m")
    return pairs.withColumn("key", F.col("u").bitwiseXOR(F.lit(-1))).join(least.hint("merge"), "key").drop("key")


def local_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node it is connected with) of the nodes of some edges; a
    node without any neighbour but itself keeps its edge."""
    node, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(node))
    while True:
        low = root.copy()
        np.minimum.at(low, root[a], root[b])
        np.minimum.at(low, root[b], root[a])
        while (low[low] != low).any():
            low = low[low]
        new = low[root]
        if (new == root).all():
            break
        root = new
    alone = np.ones(len(node), bool)
    alone[root[root != np.arange(len(node))]] = False
    keep = (root != np.arange(len(node))) | alone
    return node[keep], node[root[keep]]


def _contracted(edges: DataFrame, tasks: int, together: int) -> DataFrame:
    """Stars of the edges that come together in each of ``tasks`` tasks, ``together``
    at a time."""

    def stars(held):
        u, v = local_stars(*(np.concatenate([h[k] for h in held]) for k in range(2)))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if n + batch.num_rows > together and held:
                yield stars(held)
                held, n = [], 0
            held.append([np.asarray(batch.column(k)) for k in ("u", "v")])
            n += batch.num_rows
        if held:
            yield stars(held)

    return edges.select("u", "v").coalesce(tasks).mapInArrow(run, "u long, v long")


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge only, to a node that has none but its own."""
    out = edges.where("u != v")
    ends = out.select(F.col("u").alias("node"), F.lit(1).alias("leads"), F.lit(0).alias("led")).unionByName(out.select(F.col("v").alias("node"), F.lit(0).alias("leads"), F.lit(1).alias("led")))
    odd = ends.groupBy("node").agg(F.sum("leads").alias("leads"), F.max("led").alias("led")).where("leads > 1 or leads = 1 and led = 1")
    return odd.isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60, together: int = 1_000_000) -> DataFrame:
    """node, component (its smallest node) of every node of an edge. Edges may
    repeat or have two equal ends (such an edge stays and makes its node known);
    null ends are left out."""
    edges = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    now = written(edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")), "edges")
    for _ in range(most_rounds):
        # some ``together`` edges a task, so a graph of that size is done in one
        tasks = max(1, -(-now.count() // together))
        now = written(_contracted(now, tasks, together).distinct() if tasks > 1 else _contracted(now, 1, together), "edges")
        if tasks == 1 or _settled(now):
            break
        both = now.where("u != v").unionByName(now.where("u != v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _joined_with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        small = _joined_with_least(large)
        step = small.select("u", F.col("m").alias("v")).unionByName(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = written(step.unionByName(now.where("u = v")).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    tree = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = tree.select(F.col("component").alias("node"), "component")
    return tree.unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))
