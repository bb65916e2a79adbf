"""Exact links between sets that share a canopy, without all pairs of it.

``forest`` finds likely pairs from sorted signature orders, ``likely`` drops
those that cannot be links, and what is left joins sets into canopies. Sets that
share the first values of a tree but are in several canopies are compared with
each other, all with all (``crossings``), so that two sets that share such values
and may be a link are in one canopy, whatever lies between them.
``linked_components`` then confirms links on full sets:

1. A canopy of up to ``BLOCK`` sets is one block. A larger one is sorted by its
   signatures in ``ORDERS`` ways, and each order is cut into blocks of ``BLOCK``
   that overlap, so every set meets its nearest neighbours. Within a block all
   sets are compared in full; a block gives one edge for each set it links.
2. Where a large canopy is still in several components, the rest is exact: a set
   outside its canopy's largest component can only be linked with one that shares
   one of its own rarest shingles (the prefix of a similarity join). Sets that do,
   and are in other components, are compared by signature and then in full.

So a group of n near copies moves each set a fixed number of times and gives
some n edges, and no link inside a canopy depends on who its neighbours are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loggrove.llm.common import among, slices, written
from loggrove.llm.components import connected_components
from loggrove.llm.shingles import Shingler, set_digest

#: Sets in a block; those it shares with the one before; orders of a large canopy.
BLOCK, OVERLAP, ORDERS = 128, 16, 3
#: Sets outside the largest component, and all sets, that meet in one cell of step 2.
STRAYS, OTHERS = 128, 512
#: Sets of a tree's bucket that meet as many others in one cell.
CROWD = 4096


def signature_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def forest(sets: DataFrame, trees: int, depth: int, reach: int) -> tuple[DataFrame, DataFrame]:
    """Two tables. Pairs (a, b) of nodes that follow one another in a tree's order and share
    its first ``depth`` values (4), or are within ``reach`` places and share as long
    a prefix as both share with their nearest neighbours: the depth adapts to how
    crowded a region is. What stands between two rows shares their prefix too, so
    next neighbours make a chain of any region, however many it holds. And (node, bucket) of each
    node that shares its first ``depth`` values of a tree with another one (some rows come twice); equal buckets
    are equal values of one tree. Tree t sorts by the sixteen values from t * depth
    on, wrapping around. Rows at the borders of the sort's partitions meet in a
    step of their own."""
    if not 0 < depth < 8 or trees > 127:
        raise ValueError("a bucket's key has seven values and a tree below 128")

    def shared(x, y, lag):
        """Values of the common prefix of rows that are ``lag`` apart."""
        out = np.zeros(len(x) - lag, np.int64)
        for key, base in ((y, 8), (x, 0)):
            other = (key[lag:] ^ key[:-lag]).view(np.uint64)
            out = np.where(other == 0, out if base == 0 else 16, base + (64 - np.frexp(other.astype(np.float64))[1]) // 8)
        return out

    def expand(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            s, node = signature_rows(batch.column("signature")), batch.column("node")
            for t in range(trees):
                key = s[:, (t * depth + np.arange(16)) % s.shape[1]]
                near, far = (np.ascontiguousarray(key[:, k : k + 8]).view(">i8").ravel().astype(np.int64) for k in (0, 8))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array(near), pa.array(far), node], names=["tree", "near", "far", "node"])

    def neighbours(batches):
        head = kept = None
        for batch in batches:
            own = [np.asarray(batch.column(k)) for k in range(4)]
            if not len(own[0]):
                continue
            head = [x[:reach] for x in own] if head is None else [np.concatenate([x, y])[:reach] for x, y in zip(head, own)]
            fresh = 0 if kept is None else len(kept[0])
            if kept is not None:
                own = [np.concatenate([x, y]) for x, y in zip(kept, own)]
            tree, near, far, node = own
            a, b, best = [], [], np.zeros(len(node), np.int64)
            for lag in range(1, reach + 1):
                if len(node) > lag:
                    prefix = np.where(tree[lag:] == tree[:-lag], shared(near, far, lag), 0)
                    if lag == 1:
                        best[1:], best[:-1] = prefix, np.maximum(best[:-1], prefix)
                        best[1:-1] = np.maximum(prefix[:-1], prefix[1:])
                    same = prefix >= np.maximum(depth, np.maximum(best[lag:], best[:-lag]) if lag > 1 else 0)
                    if lag > 1:  # those that share all values are a chain of next neighbours
                        same &= prefix < 16
                    same[: max(fresh - lag, 0)] = False
                    a.append(node[:-lag][same])
                    b.append(node[lag:][same])
            kept = [x[-reach:] for x in own]
            a, b = np.concatenate([*a, np.zeros(0, np.int64)]), np.concatenate([*b, np.zeros(0, np.int64)])
            # a pair that several lags or batches yield is yielded once
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            none = pa.nulls(len(pairs), pa.int32()), pa.nulls(len(pairs), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none[0], none[1], none[1], none[1]], names=names)
            met = best >= depth
            bucket = (tree[met].astype(np.int64) << 8 * depth) | ((near[met] >> (64 - 8 * depth)) & ((1 << 8 * depth) - 1))
            none = pa.nulls(len(bucket), pa.int32()), pa.nulls(len(bucket), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(node[met]), none[1], none[0], none[1], none[1], pa.array(bucket)], names=names)
        for border in [] if head is None else [head, kept]:
            tree, near, far, node = (pa.array(x) for x in border)
            yield pa.RecordBatch.from_arrays([node, pa.nulls(len(node), pa.int64()), tree, near, far, pa.nulls(len(node), pa.int64())], names=names)

    names = ["a", "b", "tree", "near", "far", "bucket"]
    schema = "a long, b long, tree int, near long, far long, bucket long"
    order = ["tree", "near", "far", "node"]
    rows = sets.select("node", "signature").mapInArrow(expand, "tree int, near long, far long, node long")
    found = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(neighbours, schema), "forest", release=True)
    # 2 * reach rows of each partition
    borders = found.where("tree is not null").select("tree", "near", "far", F.col("a").alias("node")).distinct()
    across = borders.coalesce(1).sortWithinPartitions(*order).mapInArrow(neighbours, schema)
    found = found.unionByName(across)
    return found.where("b is not null and a != b").select("a", "b").distinct(), found.where("bucket is not null").select(F.col("a").alias("node"), "bucket")


def least_share(part: int, whole: int, values: int) -> float:
    """The share of equal values that a link at the threshold has, less five
    standard deviations."""
    share = part / whole
    return share - 5 * (share * (1 - share) / values) ** 0.5


def likely(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs whose signatures agree in a share of at least ``least``."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = signature_rows(batch.column("x")), signature_rows(batch.column("y"))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= least))

    own = sets.select("node", "signature")
    both = pairs.join(own.select(F.col("node").alias("a"), F.col("signature").alias("x")), "a").join(own.select(F.col("node").alias("b"), F.col("signature").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def crossings(buckets: DataFrame, canopies: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) that join all canopies of which two sets are in a bucket and have
    signatures that agree in a share of at least ``least``. Sets of one
    canopy are not compared. A bucket of more than ``CROWD`` sets is dealt over cells, each
    pair of whose parts meets in one; a cell gives one pair for each two canopies that it
    joins at most. So memory is bounded, and only comparisons, not rows that
    leave a cell, have the square of a crowd."""
    rows = buckets.distinct().join(canopies.select("node", F.col("component").alias("canopy")), "node", "left").withColumn("canopy", F.coalesce("canopy", "node"))
    several = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("canopy").alias("low"), F.max("canopy").alias("high")).where("low != high")
    several = several.select(F.col("bucket").bitwiseXOR(F.lit(-1)).alias("key"), F.ceil(F.col("n") / CROWD).cast("int").alias("parts"))
    # the join's own key makes Spark shuffle both sides for it, so that it can split a large bucket
    rows = rows.withColumn("key", F.col("bucket").bitwiseXOR(F.lit(-1))).join(several.hint("merge"), "key")
    rows = rows.select("bucket", "node", "canopy", "parts", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("own")).join(sets.select("node", "signature"), "node")
    # part p meets itself and every other part: cell (i, j) with i <= j has the parts i and j
    cells = rows.select("bucket", "node", "canopy", "own", "signature", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    cells = cells.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "canopy", "own", "signature")

    def compare(batches):
        def of_cell(held, alone):
            node, canopy, own = (np.concatenate([h[k] for h in held]) for k in range(3))
            s = np.concatenate([h[3] for h in held])
            order = np.argsort(canopy, kind="stable")
            node, canopy, own, s = node[order], canopy[order], own[order], s[order]
            name, at = np.unique(canopy, return_inverse=True)
            if len(name) == 1:
                return
            root, first, second = np.arange(len(name)), [], []
            wanted = int(np.ceil(least * s.shape[1] - 1e-9))
            for k in range(len(node) - 1):
                # those of later canopies; sets of one part meet in that part's own cell
                rest = np.searchsorted(at, at[k], side="right")
                fits = root[at[rest:]] != root[at[k]]
                if not alone:
                    fits &= own[rest:] != own[k]
                fits = rest + np.flatnonzero(fits)
                if len(fits):
                    fits = fits[(s[fits] == s[k]).sum(axis=1) >= wanted]
                for x in fits.tolist():
                    if root[at[x]] != root[at[k]]:
                        root[root == root[at[x]]] = root[at[k]]
                        first.append(node[k])
                        second.append(node[x])
            if first:
                a, b = np.array(first, np.int64), np.array(second, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("bucket", "i", "j")], axis=1)
            node, canopy, own = (np.asarray(batch.column(c)) for c in ("node", "canopy", "own"))
            s = signature_rows(batch.column("signature"))
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(at)]
            for x, y in zip(cuts, cuts[1:]):
                if tuple(at[x]) != key:
                    if held:
                        yield from of_cell(held, key[1] == key[2])
                    key, held = tuple(at[x]), []
                held.append((node[x:y], canopy[x:y], own[x:y], s[x:y]))
        if held:
            yield from of_cell(held, key[1] == key[2])

    cell = ["bucket", "i", "j"]
    return cells.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(compare, "a long, b long")


def linked(sets: list[np.ndarray], part: int, whole: int) -> np.ndarray:
    """Root of each set after joining all pairs with whole * |both| >= part *
    |either|."""
    n = len(sets)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    size = np.array([len(s) for s in sets])
    words = np.concatenate(sets)
    doc = np.repeat(np.arange(n), size)
    order = np.argsort(words, kind="stable")
    words, doc = words[order], doc[order]
    new = np.concatenate([[True], words[1:] != words[:-1]])
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    held = np.diff(np.append(first, len(words)))
    # entries by document, of words that several sets have
    shared = np.flatnonzero(held[group] > 1)
    by_doc = shared[np.argsort(doc[shared], kind="stable")]
    bounds = np.searchsorted(doc[by_doc], np.arange(n + 1))
    for i in range(n):
        g = group[by_doc[bounds[i] : bounds[i + 1]]]
        if not len(g):
            continue
        length = held[g]
        ends = np.cumsum(length)
        at = np.arange(ends[-1]) + np.repeat(first[g] - ends + length, length)
        common = np.bincount(doc[at], minlength=n)
        hits = (whole * common >= part * (size[i] + size - common)) & (common > 0)
        for j in np.flatnonzero(hits[i + 1 :]).tolist():
            x, y = find(i), find(i + 1 + j)
            root[max(x, y)] = min(x, y)
    return np.array([find(i) for i in range(n)], np.int64)


def _set_lists(column: pa.Array) -> list[np.ndarray]:
    values, ends = np.asarray(column.flatten()), np.asarray(column.offsets)
    ends = ends - ends[0]
    return [values[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _placed(canopies: DataFrame, sets: DataFrame) -> DataFrame:
    """id, canopy, large, digest, signature of each set in a canopy."""
    sizes = canopies.groupBy("component").agg(F.count("*").alias("n")).select(F.col("component").bitwiseXOR(F.lit(-1)).alias("key"), (F.col("n") > BLOCK).alias("large"))
    # the join's own key makes Spark shuffle both sides for it, so that it can split a large canopy
    rows = canopies.withColumn("key", F.col("component").bitwiseXOR(F.lit(-1))).join(sizes.hint("merge"), "key")
    return rows.select(F.col("node").alias("id"), F.col("component").alias("canopy"), "large").join(sets.select(F.col("node").alias("id"), "digest", "signature"), "id")


def _blocks(placed: DataFrame, values: int) -> DataFrame:
    """id, kind, block: kind 0 is a whole canopy, kind 1 a run of a sorted order."""

    def assign(batches):
        task, key, base, free, at = TaskContext.get().partitionId() << 40, None, 0, 0, 0
        for batch in batches:
            canopy, turn, ids = (np.asarray(batch.column(c)) for c in ("canopy", "turn", "id"))
            fresh = np.flatnonzero((canopy[1:] != canopy[:-1]) | (turn[1:] != turn[:-1])) + 1
            cuts = [0, *fresh.tolist(), len(ids)] if len(ids) else []
            for a, b in zip(cuts, cuts[1:]):
                if (canopy[a], turn[a]) != key:
                    key, base, at = (canopy[a], turn[a]), free, 0
                place = at + np.arange(b - a)
                own = task + base + place // (BLOCK - OVERLAP)
                # the first of a block are the last of the one before it
                again = (place % (BLOCK - OVERLAP) < OVERLAP) & (place >= BLOCK - OVERLAP)
                free, at = base + int(place[-1]) // (BLOCK - OVERLAP) + 1, at + b - a
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[a:b], ids[a:b][again]])), pa.array(np.concatenate([own, own[again] - 1]))], names=["id", "block"])

    turns = F.explode(F.array([F.struct(F.lit(k).alias("turn"), F.substring("signature", k * values // ORDERS + 1, 16).alias("order")) for k in range(ORDERS)]))
    large = placed.where("large").select("id", "canopy", turns.alias("t")).select("canopy", "t.turn", "t.order", "id")
    order = ["canopy", "turn", "order", "id"]
    large = large.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(assign, "id long, block long").withColumn("kind", F.lit(1))
    return placed.where("not large").select("id", F.col("canopy").alias("block"), F.lit(0).alias("kind")).unionByName(large)


def full_sets(docs: DataFrame, wanted: DataFrame, shingle_words: int) -> DataFrame:
    """The rows of ``wanted`` (id, digest, ...) with their sets, from the texts of
    ``docs`` (doc_id, text) that have this id and digest."""
    rest = [c for c in wanted.columns if c not in ("id", "digest")]

    def run(batches):
        shingler = Shingler(shingle_words)
        for batch in batches:
            for piece in slices(batch, "text"):
                found = shingler.sets(piece.column("text").cast(pa.binary()).to_pylist())
                own = pa.array([set_digest(s) == d for s, d in zip(found, piece.column("digest").to_pylist())], pa.bool_())
                words = pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)]).astype(np.int32), np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64))
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("id", *rest)), words], names=["id", *rest, "words"]).filter(own)

    texts = among(docs, "doc_id", wanted.select("id"))
    joined = texts.join(wanted.hint("shuffle_hash"), texts.doc_id == wanted.id).select("id", *rest, "digest", "text")
    return joined.mapInArrow(run, wanted.select("id", *rest).schema.add("words", T.ArrayType(T.LongType())))


def _block_links(full: DataFrame, part: int, whole: int) -> DataFrame:
    """Edges (a, b) that span the links within each block."""

    def verify(batches):
        def of_block(ids, sets):
            ids, first = np.unique(np.array(ids, np.int64), return_index=True)  # rows that repeat an id
            if len(ids) > 1:
                root = linked([sets[k] for k in first], part, whole)
                more = root != np.arange(len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(ids[root[more]]), pa.array(ids[more])], names=["a", "b"])

        key, ids, sets = None, [], []
        for batch in batches:
            for kind, block, node, words in zip(*(batch.column(c).to_pylist() for c in ("kind", "block", "id")), _set_lists(batch.column("words"))):
                if (kind, block) != key:
                    yield from of_block(ids, sets)
                    key, ids, sets = (kind, block), [], []
                ids.append(node)
                sets.append(words.copy())
        yield from of_block(ids, sets)

    each = full.select("id", F.explode("blocks").alias("of"), "words").select("of.kind", "of.block", "id", "words")
    return each.repartition("kind", "block").sortWithinPartitions("kind", "block", "id").mapInArrow(verify, "a long, b long")


def _open_members(placed: DataFrame, components: DataFrame) -> DataFrame:
    """id, canopy, component, stray, signature of the sets in large canopies
    that are still in several components; a stray is outside the largest."""
    rows = placed.where("large").select("id", "canopy", "signature").join(components.select(F.col("node").alias("id"), "component"), "id", "left")
    rows = rows.withColumn("component", F.coalesce("component", "id"))
    sizes = rows.groupBy("canopy", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("canopy").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("n", "component")).alias("main")).where("parts > 1").select(F.col("canopy").bitwiseXOR(F.lit(-1)).alias("key"), "main")
    rows = rows.withColumn("key", F.col("canopy").bitwiseXOR(F.lit(-1))).join(main.hint("merge"), "key")
    return rows.select("id", "canopy", "component", (F.col("component") != F.col("main")).alias("stray"), "signature")


def _tokens(own: DataFrame) -> DataFrame:
    """A row for each shingle of each set, with the key of shingle and canopy."""
    each = own.select("id", "canopy", "component", "stray", "size", F.explode("words").alias("token"))
    return each.withColumn("key", F.xxhash64("canopy", "token"))


def _prefixes(strays: DataFrame, counts: DataFrame, part: int, whole: int) -> DataFrame:
    """The prefix of each stray, a row for each shingle, with its place in the set's
    order (by how many sets of the canopy have it, rare ones first). Left out are
    shingles that one component alone has, and those from which on too little is
    left for a link, even with the smallest set that has them: the first shingle
    that two linked sets share has all they share from there on."""
    shared = _tokens(strays).join(counts.hint("merge"), "key").where("canopy = of and token = shingle")
    by_set = shared.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "token", "mixed", "least"))).alias("rare"))
    by_set = by_set.join(strays.select("id", "canopy", "component", "stray", "signature", "size"), "id")
    prefix = F.col("size") - F.ceil(F.col("size") * part / whole) + 1
    # shingles that no other set has come first
    left = F.greatest(prefix - (F.col("size") - F.size("rare")), F.lit(0)).cast("int")
    rows = by_set.withColumn("place", F.col("size") - F.size("rare")).withColumn("rare", F.slice("rare", 1, left))
    rows = rows.select("id", "canopy", "component", "stray", "signature", "size", "place", F.posexplode("rare").alias("k", "x")).where("x.mixed")
    rows = rows.select("id", "canopy", "component", "stray", "signature", "size", (F.col("place") + F.col("k")).alias("place"), F.col("x.token").alias("token"), "x.least")
    return rows.where((whole + part) * (F.col("size") - F.col("place")).cast("long") >= part * (F.col("size") + F.col("least")).cast("long")).drop("least")


def _prefix_rows(full: DataFrame, members: DataFrame, part: int, whole: int) -> DataFrame:
    """A row for each stray and each shingle of its prefix, and for each set of a
    largest component and each of its shingles that is in the prefix of a stray of
    like size. Only strays are ordered: a set that is linked with one has a shingle
    of the stray's prefix, wherever its own order has it (place 0 stands for any).
    So the sets of a large group of near copies move by the few shingles that
    strays ask for."""
    own = written(full.join(members, "id").withColumn("size", F.size("words")), "open-sets", release=True)
    counts = _tokens(own).groupBy("canopy", "token").agg(F.count("*").alias("df"), F.max("stray").alias("wanted"), (F.min("component") != F.max("component")).alias("mixed"), F.min("size").alias("least")).where("df > 1 and wanted")
    counts = counts.select(F.xxhash64("canopy", "token").alias("key"), F.col("canopy").alias("of"), F.col("token").alias("shingle"), "df", "mixed", "least")
    strays = written(_prefixes(own.where("stray"), counts, part, whole), "strays", release=True)
    asked = strays.groupBy("canopy", "token").agg(F.min("size").alias("least"), F.max("size").alias("most"))
    asked = asked.select(F.xxhash64("canopy", "token").alias("key"), F.col("canopy").alias("of"), F.col("token").alias("shingle"), "least", "most")
    main = own.where("not stray")
    met = _tokens(main).join(asked.hint("merge"), "key").where("canopy = of and token = shingle").where((whole * F.col("size") >= part * F.col("least")) & (part * F.col("size") <= whole * F.col("most")))
    rows = met.select("id", "token").join(main.select("id", "canopy", "component", "stray", "signature", "size", F.lit(0).alias("place")), "id")
    return strays.unionByName(rows.select(*strays.columns))


def _stray_pairs(prefixes: DataFrame, part: int, whole: int, least: float) -> DataFrame:
    """Pairs (a, b) of a stray and a set of another component that share a
    shingle of the stray's prefix and whose signatures, sizes and rests from that
    shingle on (if it is the first they share) allow a link."""
    counts = prefixes.groupBy("canopy", "token").agg(F.count("*").alias("all"), F.count_if("stray").alias("strays")).where("strays > 0 and all > 1")
    counts = counts.select(F.xxhash64("canopy", "token").alias("key"), F.col("canopy").alias("of"), F.col("token").alias("shingle"), F.ceil(F.col("strays") / STRAYS).alias("high"), F.ceil(F.col("all") / OTHERS).alias("wide"))
    rows = prefixes.withColumn("key", F.xxhash64("canopy", "token")).join(counts.hint("merge"), "key").where("canopy = of and token = shingle")
    base = ["key", "canopy", "token", "id", "component", "stray", "size", "place", "signature"]
    up = rows.where("stray").select(*base, F.lit(True).alias("left"), F.pmod(F.xxhash64("id"), F.col("high")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("wide") - 1)).alias("j"))
    side = rows.select(*base, F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("high") - 1)).alias("i"), F.pmod(F.xxhash64("id"), F.col("wide")).alias("j"))
    cell = ["key", "canopy", "token", "i", "j"]

    def compare(batches):
        def of_cell(rows):
            left = [r for r in rows if r[0]]
            right = [r for r in rows if not r[0]]
            if left and right:
                ids, component, stray, size, rest = (np.array([r[k] for r in right]) for k in (1, 2, 3, 4, 5))
                s = np.frombuffer(b"".join(r[6] for r in right), np.uint8).reshape(len(right), -1)
                for _, own, at, _, n, after, signature in left:
                    # a link has part / (whole + part) of both sizes in common
                    fits = (component != at) & (~stray | (ids > own)) & ((whole + part) * np.minimum(rest, after) >= part * (size + n))
                    fits[fits] = (s[fits] == np.frombuffer(signature, np.uint8)).mean(axis=1) >= least
                    if fits.any():
                        other = ids[fits].astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(other, own)), pa.array(np.maximum(other, own))], names=["a", "b"])

        key, rows = None, []
        for batch in batches:
            for *at, left, node, component, stray, size, place, signature in zip(*(batch.column(c).to_pylist() for c in (*cell, "left", "id", "component", "stray", "size", "place", "signature"))):
                if at != key:
                    yield from of_cell(rows)
                    key, rows = at, []
                rows.append((left, node, component, stray, size, size - place, signature))
        yield from of_cell(rows)

    return up.unionByName(side).repartition(*cell).sortWithinPartitions(*cell, "id").mapInArrow(compare, "a long, b long").distinct()


def confirmed(pairs: DataFrame, full: DataFrame, part: int, whole: int) -> DataFrame:
    """a, b, jaccard of the pairs with whole * |both| >= part * |either|."""

    def compare(batches):
        for batch in batches:
            out = []
            for s, t in zip(_set_lists(batch.column("x")), _set_lists(batch.column("y"))):
                both = len(np.intersect1d(s, t, assume_unique=True))
                either = len(s) + len(t) - both
                out.append(both / either if either and whole * both >= part * either else -1.0)
            found = pa.array(out, pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), found], names=["a", "b", "jaccard"]).filter(pa.array([v >= 0 for v in out], pa.bool_()))

    own = full.select("id", "words").dropDuplicates(["id"])
    sides = pairs.join(own.select(F.col("id").alias("a"), F.col("words").alias("x")), "a").join(own.select(F.col("id").alias("b"), F.col("words").alias("y")), "b")
    return sides.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long, jaccard double")


def canopies_of(sets: DataFrame, trees: int, depth: int, reach: int, least: float) -> DataFrame:
    """node, component of the sets (node, signature) that are in a canopy."""
    pairs, buckets = forest(sets, trees, depth, reach)
    near = written(connected_components(likely(pairs, sets, least)), "canopies", release=True)
    more = written(crossings(buckets, near, sets, least), "crossings", release=True)
    if more.isEmpty():
        return near
    return written(connected_components(near.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), "canopies", release=True)


def linked_components(docs: DataFrame, sets: DataFrame, canopies: DataFrame, shingle_words: int, part: int, whole: int, values: int) -> DataFrame:
    """node, component of every set that has a link. ``docs`` are doc_id and
    text, ``sets`` node, digest and signature (``values`` bytes) of distinct sets,
    ``canopies`` node and component of those that may have one."""
    least = least_share(part, whole, values)
    placed = written(_placed(canopies, sets), "placed", release=True)
    blocks = _blocks(placed, values).groupBy("id").agg(F.collect_list(F.struct("kind", "block")).alias("blocks"))
    full = written(full_sets(docs, placed.select("id", "digest").join(blocks, "id"), shingle_words), "sets", release=True)
    first = written(connected_components(_block_links(full, part, whole)), "linked", release=True)
    members = written(_open_members(placed, first), "open", release=True)
    if members.isEmpty():
        return first
    prefixes = written(_prefix_rows(full.select("id", "words").dropDuplicates(["id"]), members, part, whole), "prefixes", release=True)
    more = confirmed(_stray_pairs(prefixes, part, whole, least), full, part, whole).select("a", "b")
    return connected_components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
