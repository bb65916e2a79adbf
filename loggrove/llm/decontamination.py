"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared in lower case with white space as single blanks. An item of m
characters has an error budget of k = m * rate edits and is cut into k + 1
pieces; a passage within k edits of the item holds at least one piece as it is.
An automaton finds the pieces in the whole text, and where one occurs Myers'
bit-parallel distance decides about the item around it.

The items go to the executors in blocks of at most ``block_chars`` characters. A
larger benchmark takes more passes, each written before the next block comes to
the driver, so one block at a time is broadcast.

Nulls: null or empty items match nothing, null texts match nothing and stay. An
item too short for an error is searched exactly and must stand between word
edges. Items that repeat each give their rows, those with a null id too. An empty benchmark leaves all
documents; an empty table gives no rows. Very long texts are searched whole. Other columns are ignored, or kept
unchanged by ``decontaminate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loggrove.llm.common import filtered, slices, whole_text, written

RATE = 1 / 16
BLOCK_CHARS = 4_000_000


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def best_match(item: str, text: str, most: int) -> tuple[int, int] | None:
    """(edits, end) of the part of ``text`` that is nearest to ``item``, if it
    takes at most ``most`` edits; the first of equals (Myers 1999, with Python's
    long integers as bit vectors)."""
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, None
    for end, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (~(xh | plus) & full)
        mh = plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        plus = mh | (~(xv | ph) & full)
        minus = ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, end + 1)
    return best


class ItemMatcher:
    """Finds the items of a block in one text."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        import ahocorasick

        self.items = [(i, n, int(len(n) * rate)) for i, t in items if (n := normalised(t or ""))]
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (_, n, budget) in enumerate(self.items):
            cuts = np.linspace(0, len(n), budget + 2).astype(int).tolist()
            for a, b in zip(cuts, cuts[1:]):
                found.setdefault(n[a:b], []).append((k, a))
        self.seeds = ahocorasick.Automaton()
        for piece, places in found.items():
            self.seeds.add_word(piece, (len(piece), places))
        if found:
            self.seeds.make_automaton()

    def __call__(self, text: str, first_only: bool = False) -> list[tuple[int, int, int, float]]:
        """(item_id, edits, end in the normalised text, similarity), the best
        place of each item that the text holds."""
        if not self.items:
            return []
        text = normalised(text)
        windows: dict[int, list[list[int]]] = {}
        for end, (length, places) in self.seeds.iter(text):
            for k, a in places:
                _, n, budget = self.items[k]
                start = end + 1 - length - a
                lo, hi = max(0, start - budget), start + len(n) + budget
                own = windows.setdefault(k, [])
                if own and lo <= own[-1][1]:
                    own[-1][0], own[-1][1] = min(lo, own[-1][0]), max(hi, own[-1][1])
                else:
                    own.append([lo, hi])
        out = []
        for k, own in windows.items():
            item, n, budget = self.items[k]
            best = None
            for lo, hi in own:
                if budget:
                    found = best_match(n, text[lo:hi], budget)
                else:
                    at, found = text.find(n, lo, hi), None
                    while at >= 0 and not found:
                        inside = at and text[at - 1].isalnum() or text[at + len(n) : at + len(n) + 1].isalnum()
                        found = None if inside else (0, at - lo + len(n))
                        at = text.find(n, at + 1, hi)
                if found and (best is None or found[0] < best[0]):
                    best = (found[0], lo + found[1])
            if best:
                out.append((item, best[0], best[1], 1 - best[0] / len(n)))
                if first_only:
                    break
        return out


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``block_chars`` characters, dealt by a hash
    of the id. Blocks come to the driver one by one."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), whole_text().alias("text")).where("text != ''")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size // block_chars)
    for k in range(n):
        yield sorted(((r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def contaminations(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, edits, end, similarity of every item that a text holds."""
    schema = "doc_id long, item_id long, edits long, end long, similarity double"
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    out, shared = spark.createDataFrame([], schema), None
    for block in item_blocks(benchmark, block_chars):
        if shared:
            out = written(out, "contaminations")
            shared.destroy()
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            match = ItemMatcher(shared.value, rate)
            for batch in batches:
                for part in slices(batch, "text"):
                    rows = [(d, *hit) for d, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()) for hit in match(t)]
                    if rows:
                        types = [pa.int64()] * 4 + [pa.float64()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "item_id", "edits", "end", "similarity"])

        out = out.unionByName(texts.mapInArrow(run, schema))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows whose text holds no item, all columns as they were."""
    shared = None
    for block in item_blocks(benchmark, block_chars):
        if shared:
            docs = written(docs, "decontaminated")
            shared.destroy()
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def make(shared=shared):
            match = ItemMatcher(shared.value, rate)
            return lambda texts: [not match(t, first_only=True) for t in texts.to_pylist()]

        docs = filtered(docs, "text", make)
    return docs
