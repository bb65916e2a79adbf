"""Quality: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are covered by chunks of ``CHUNK`` bytes, each overlapping
the next by half. ``FILTERS`` learned filters of ``WIDTH`` bytes run over every
second byte; each chunk keeps the largest response of each filter. A small hidden
layer turns these into a logit per chunk, and the mean logit of all chunks gives
the text's probability. A filter is a table of one weight per place and byte,
so its response is a sum of lookups.

Fitting takes at most ``most_rows`` labelled rows of ``most_bytes`` together, each
with its whole text; one that does not fit is passed over. Every step of the descent
draws texts, and of each text any of its chunks, so that texts weigh alike and long
ones are seen throughout; there are as many draws as the sample has chunks, and 150,000
at least. Rows set aside calibrate by their mean logit
over all chunks. Scoring covers every byte of every text and needs no shuffle.

Nulls: a null text counts as empty, a null id stays null and is not held out. An
empty text is one chunk of padding and gets that chunk's score. Very long texts are
scored in parts of bounded size. Equal texts have equal scores. Where the rows that
fit lack one of the labels every score is 0.5. An empty table gives no rows. Columns
other than the text never enter a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loggrove.llm.common import slices, whole_text
from loggrove.llm.labelled import labelled_sample

CHUNK, HALF, WIDTH, STRIDE, FILTERS, HIDDEN = 256, 128, 8, 2, 32, 16


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts as one array of bytes, each filled with zeros to whole halves
    of chunks (two halves at least), and the number of halves of each."""
    halves = np.array([max(2, -(-len(t) // HALF)) for t in texts], np.int64)
    raw = np.frombuffer(b"".join(t.ljust(int(h) * HALF, b"\0") for t, h in zip(texts, halves)), np.uint8)
    return raw, halves


@dataclass
class ByteNetwork:
    table: np.ndarray  # WIDTH x 256 x FILTERS
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    scale: float = 1.0
    shift: float = 0.0

    @staticmethod
    def fresh(seed: int = 3) -> ByteNetwork:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, by: rng.normal(0, by, shape).astype(np.float32)
        return ByteNetwork(draw(WIDTH, 256, FILTERS, by=0.35), draw(FILTERS, HIDDEN, by=0.2), np.zeros(HIDDEN, np.float32), draw(HIDDEN, by=0.2), 0.0)

    def responses(self, raw: np.ndarray) -> np.ndarray:
        """Filter responses at every STRIDE-th byte of whole halves; those of a
        half that reach into the next use its bytes."""
        more = np.concatenate([raw, np.zeros(WIDTH, np.uint8)])
        n = len(raw) // STRIDE
        out = self.table[0][more[0 : STRIDE * n : STRIDE]]
        for j in range(1, WIDTH):
            out += self.table[j][more[j : j + STRIDE * n : STRIDE]]
        return out

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """The mean chunk logit of each text."""
        raw, halves = padded(texts)
        step = 512 * HALF
        ends = np.cumsum(halves)
        # places from which a filter would reach into the next text
        over = (ends[:, None] * (HALF // STRIDE) - np.arange(1, WIDTH // STRIDE)).ravel()
        pooled = []
        for i in range(0, len(raw), step):
            r = self.responses(raw[i : i + step + WIDTH])[: min(step, len(raw) - i) // STRIDE]
            first = i // STRIDE
            r[over[(over >= first) & (over < first + len(r))] - first] = -np.inf
            pooled.append(r.reshape(-1, HALF // STRIDE, FILTERS).max(axis=1))
        pooled = np.concatenate(pooled)
        first = np.ones(len(pooled) - 1, bool)
        first[ends[:-1] - 1] = False  # chunks do not go from one text to the next
        at = np.flatnonzero(first)
        chunks = np.maximum(pooled[at], pooled[at + 1])
        z = np.maximum(chunks @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        starts = np.concatenate([[0], np.cumsum(halves - 1)[:-1]])
        return np.add.reduceat(z.astype(np.float64), starts) / (halves - 1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        # rounded: matrix products of batches of different sizes differ in the last digits
        return np.round(1 / (1 + np.exp(-np.clip(self.scale * self.logits(texts) + self.shift, -30, 30))), 6)

    def fit(self, texts: list[bytes], y: np.ndarray, draws: int | None = None, size: int = 128, rate: float = 0.01) -> ByteNetwork:
        """Adam on the cross-entropy of ``draws`` single chunks (as many as there are,
        and 150,000 at least): of a text drawn at random, a chunk drawn at random."""
        rng = np.random.default_rng(5)
        raw, halves = padded(texts)
        draws = max(150_000, int(halves.sum()) - len(texts)) if draws is None else draws
        begins = np.cumsum(halves) - halves
        params = [self.table, self.w1, self.b1, self.w2, np.zeros(1, np.float32)]
        first = [np.zeros_like(p) for p in params]
        second = [np.zeros_like(p) for p in params]
        places = np.arange(0, CHUNK - WIDTH + 1, STRIDE)
        steps = draws // size
        for step in range(1, steps + 1):
            rows = rng.integers(len(texts), size=size)
            chunk = begins[rows] + rng.integers(halves[rows] - 1)
            x = raw[chunk[:, None] * HALF + np.arange(CHUNK)]
            r = self.table[0][x[:, places]]
            for j in range(1, WIDTH):
                r += self.table[j][x[:, places + j]]
            top = r.argmax(axis=1)
            pooled = np.take_along_axis(r, top[:, None, :], axis=1)[:, 0]
            h = np.maximum(pooled @ self.w1 + self.b1, 0)
            z = h @ self.w2 + params[4][0]
            d = ((1 / (1 + np.exp(-z)) - y[rows]) / size).astype(np.float32)
            dh = np.outer(d, self.w2) * (h > 0)
            dp = dh @ self.w1.T
            dt = np.zeros_like(self.table)
            at = places[top]
            f = np.broadcast_to(np.arange(FILTERS), top.shape)
            for j in range(WIDTH):
                np.add.at(dt[j], (x[np.arange(size)[:, None], at + j], f), dp)
            grads = [dt, pooled.T @ dh, dh.sum(axis=0), h.T @ d, d.sum(keepdims=True)]
            slow = rate * (1 - 0.9 * step / steps)
            for p, g, m, v in zip(params, grads, first, second):
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                p -= slow * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        self.b2 = float(params[4][0])
        return self

    def calibrate(self, z: np.ndarray, y: np.ndarray) -> ByteNetwork:
        """The slope (of a fixed grid) and shift of the logistic map from mean
        logits to label 1 with the least cross-entropy. One row of each label at
        logit 0 is added, so separable rows don't drive it to infinity."""
        z, y = np.append(z, [0.0, 0.0]), np.append(y, [0.0, 1.0])
        best = np.inf
        for a in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0):
            b = 0.0
            for _ in range(40):
                p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
                b -= float(np.clip((p - y).sum() / max((p * (1 - p)).sum(), 0.5), -1, 1))
            t = np.clip(a * z + b, -30, 30)
            loss = float((np.logaddexp(0, t) - y * t).mean())
            if loss < best - 1e-9:
                best, self.scale, self.shift = loss, a, b
        return self


def fit_quality(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, most_rows: int = 4000, most_bytes: int = 1 << 26) -> ByteNetwork | None:
    """Fits on labelled rows outside the held-out fold: at most ``most_rows``, in
    the order of a hash of their ids, whose texts have at most ``most_bytes``
    together. Every fifth of them calibrates, the others teach the network."""
    sample = labelled_sample(docs, labels, "quality", modulus, held_out, most_rows, most_bytes)
    rows = sample.select("doc_id", "label", F.col("text").cast("binary").alias("text")).collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["text"])))
    texts, y = [bytes(r["text"]) for r in rows], np.array([r["label"] for r in rows], np.float32)
    aside = np.arange(len(rows)) % 5 == 4
    if not 0 < y[~aside].sum() < (~aside).sum():
        return None
    net = ByteNetwork.fresh().fit([t for t, a in zip(texts, aside) if not a], y[~aside])
    test = [t for t, a in zip(texts, aside) if a]
    return net.calibrate(net.logits(test) if test else np.zeros(0), y[aside])


def score_quality(docs: DataFrame, net: ByteNetwork | None, modulus: int = 4, held_out: int = 2, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                s = net.scores(texts) if net else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus
    return scored.select("doc_id", F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), "score", "predicted")
