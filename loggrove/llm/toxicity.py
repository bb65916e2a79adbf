"""Toxicity: boosted trees over dense features, with isotonic calibration.

The lexicon is a short fixed list and the words and word beginnings that are far
commoner in labelled toxic texts. Features are densities of lexicon words,
closeness of the second person to them, and rates of capitals, punctuation and
obfuscated spelling. A histogram-based gradient boosting over them is fitted on
the driver (rows of some twenty numbers, at most ``most_rows``); scoring runs in
the scan of the documents and needs no shuffle.

Nulls: a null text counts as empty, a null id stays null and is not held out.
Empty texts get a score like any other, very long ones are read whole, in slices. Equal texts have equal scores. With no
labelled row of one of the kinds every score is 0. An empty table gives no rows. Columns other than
the text never enter a score.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loggrove.llm.common import filtered, slices, whole_text, written
from loggrove.llm.labelled import labelled_sample

# Insults, and second-person words of English, French, German and Spanish.
INSULTS = "clown disgusting dumb fool idiot jerk loser moron pathetic scum stupid trash ugly worthless".split()
SECOND_PERSON = "du dein deine dich dir euch euer ihr te tes ti toi ton tu tus tú u ur usted ustedes vos votre vous you your yours yourself".split()
# Letters that are written as other signs.
LOOKALIKES = "013457@$!|€", "oleastasiie"
#: A one stands for an l or for an i.
PLAIN = str.maketrans(*LOOKALIKES), str.maketrans(*LOOKALIKES) | {ord("1"): "i"}

WORD_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’…¡¿–—"
STEMS = (4, 5, 6)
FEATURES = (
    "lexicon_density", "stem_density", "weight_density", "lexicon_count", "heaviest", "second_heaviest", "distinct_hits", "disguised_density",
    "second_person_density", "nearness", "capitals", "exclamations", "punctuation", "obfuscation", "log_words", "mean_length",
)


@dataclass
class Lexicon:
    weights: dict[str, float]  # of whole words
    stems: dict[str, float]  # of the beginnings of words

    def of(self, word: str) -> tuple[float, float]:
        """Weight of the word itself and of its heaviest beginning."""
        return self.weights.get(word, 0.0), max((self.stems.get(word[:n], 0.0) for n in STEMS if len(word) >= n), default=0.0)


def learn_lexicon(sample: DataFrame, least_share: float = 0.01, least_weight: float = 3.0) -> Lexicon:
    """Words and beginnings that at least ``least_share`` of the toxic texts
    have and whose log odds are at least ``least_weight``. Counted by Spark over
    the distinct texts of the sample; only what passes comes to the driver."""
    tokens = F.split(F.lower("text"), r"[^\p{L}]+")
    stems = [F.transform(F.filter(tokens, lambda w, n=n: F.length(w) >= n), lambda w, n=n: F.concat(F.substring(w, 1, n), F.lit("-"))) for n in STEMS]
    distinct = sample.groupBy("text").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["count"] for r in distinct.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    counted = distinct.select("label", F.explode(F.array_distinct(F.concat(tokens, *stems))).alias("token")).groupBy("token").agg(F.sum("label").alias("n"), F.count("*").alias("all"))
    weight = F.log((F.col("n") + 0.5) / (toxic + 1)) - F.log((F.col("all") - F.col("n") + 0.5) / (clean + 1))
    found = counted.where((F.col("n") >= max(3, least_share * toxic)) & (F.length("token") >= 3)).select("token", weight.alias("weight")).where(F.col("weight") >= least_weight).collect() if toxic and clean else []
    words = {w: 4.0 for w in INSULTS} | {r["token"]: r["weight"] for r in found if not r["token"].endswith("-")}
    return Lexicon(words, {r["token"][:-1]: r["weight"] for r in found if r["token"].endswith("-")})


def _word_row(raw: str, lexicon: Lexicon, second: set[str]) -> tuple[float, ...]:
    word = raw.strip(WORD_EDGE)
    low = word.lower()
    own, stem = lexicon.of(low)
    disguised = 0.0
    marks = sum(not c.isalnum() for c in raw)
    odd = bool(word) and not word.isalpha()
    if odd and not own:
        spelled = [low.translate(t) for t in PLAIN]
        disguised = float(any(w in lexicon.weights for w in spelled + [re.sub(r"[\W\d_]", "", w) for w in spelled]))
    return own, stem, disguised, float(low in second), float(len(word) > 1 and word.isupper()), float(raw.count("!")), float(marks), float(odd and not word.isdigit()), float(len(raw))


class FeatureMaker:
    """Dense features of texts; each distinct word of a batch is looked at once."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.second, self.known = lexicon, set(SECOND_PERSON), {}

    def __call__(self, texts: pa.Array) -> np.ndarray:
        split = pc.ascii_split_whitespace(texts)
        ends = split.offsets.to_numpy().astype(np.int64)
        ends -= ends[0]
        coded = split.flatten().dictionary_encode()
        at = coded.indices.to_numpy()
        if len(self.known) > 400_000:
            self.known.clear()
        rows = []
        for w in coded.dictionary.to_pylist():
            if (row := self.known.get(w)) is None:
                row = self.known[w] = _word_row(w, self.lexicon, self.second)
            rows.append(row)
        table = np.array(rows, np.float64).reshape(-1, 9)
        each = table[at]
        n = np.maximum(np.diff(ends), 1)
        sums = np.concatenate([np.zeros((1, 9)), np.cumsum(each, axis=0)])
        total = sums[ends[1:]] - sums[ends[:-1]]
        length = np.maximum(total[:, 8], 1)
        weight = np.maximum(each[:, 0], each[:, 1])
        hit = (weight > 0) | (each[:, 2] > 0)
        out = np.zeros((len(texts), len(FEATURES)))
        counts = np.concatenate([[0], np.cumsum(hit)])
        weights = np.concatenate([[0], np.cumsum(weight)])
        exact = np.concatenate([[0], np.cumsum(each[:, 0] > 0)])
        stem = np.concatenate([[0], np.cumsum(each[:, 1] > 0)])
        over = lambda c: c[ends[1:]] - c[ends[:-1]]
        out[:, 0], out[:, 1], out[:, 2], out[:, 3] = over(exact) / n, over(stem) / n, over(weights) / n, np.log1p(over(counts))
        places, you = np.flatnonzero(hit), np.flatnonzero(each[:, 3] > 0)
        for d in np.flatnonzero(over(counts)):
            own = places[np.searchsorted(places, ends[d]) : np.searchsorted(places, ends[d + 1])]
            heavy = np.sort(weight[own])[::-1]
            out[d, 4], out[d, 5] = heavy[0], heavy[1] if len(heavy) > 1 else 0
            out[d, 6] = len(np.unique(at[own]))
            near = you[np.searchsorted(you, ends[d]) : np.searchsorted(you, ends[d + 1])]
            if len(near):
                k = np.searchsorted(near, own)
                gap = np.minimum(np.abs(own - near[np.maximum(k - 1, 0)]), np.abs(near[np.minimum(k, len(near) - 1)] - own))
                out[d, 9] = 1 / (1 + gap.min())
        out[:, 7], out[:, 8], out[:, 10], out[:, 11] = total[:, 2] / n, total[:, 3] / n, total[:, 4] / n, total[:, 5] / length
        out[:, 12], out[:, 13], out[:, 14], out[:, 15] = total[:, 6] / length, total[:, 7] / n, np.log1p(np.diff(ends)), total[:, 8] / n
        return np.round(out, 9)  # running sums differ in the last digits from batch to batch


@dataclass
class Boosting:
    """Logistic gradient boosting with trees over quantile bins."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    ridge: float = 1.0
    start: float = 0.0
    trees: list[list[tuple[int, float, float]]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosting:
        self.trees = []
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.start = math.log(share / (1 - share))
        # bin edges between distinct values only
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        edges = [e if len(e) else np.array([0.0]) for e in edges]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
        z = np.full(len(y), self.start)
        width = self.bins + 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), np.int64)
            tree = [(-1, 0.0, 0.0)] * (2 ** (self.depth + 1) - 1)
            for level in range(self.depth):
                first = 2**level - 1
                for k in range(first, 2 * first + 1):
                    rows = np.flatnonzero(node == k)
                    best = (1e-6, -1, 0)
                    if len(rows) >= 8:
                        gs, hs = g[rows], h[rows]
                        total, weight = gs.sum(), hs.sum()
                        for f in range(x.shape[1]):
                            b = binned[rows, f]
                            gl, hl = np.cumsum(np.bincount(b, gs, width))[:-1], np.cumsum(np.bincount(b, hs, width))[:-1]
                            gain = gl**2 / (hl + self.ridge) + (total - gl) ** 2 / (weight - hl + self.ridge) - total**2 / (weight + self.ridge)
                            gain[len(edges[f]) :] = 0
                            j = int(gain.argmax())
                            if gain[j] > best[0]:
                                best = (gain[j], f, j)
                    if best[1] >= 0:
                        tree[k] = (best[1], float(edges[best[1]][best[2]]), 0.0)
                        node[rows] = 2 * k + 1 + (binned[rows, best[1]] > best[2])
            for k in np.unique(node):
                rows = node == k
                value = -g[rows].sum() / (h[rows].sum() + self.ridge) * self.rate
                tree[k] = (-1, 0.0, value)
                z[rows] += value
            self.trees.append(tree)
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        for tree in self.trees:
            column, limit, value = (np.array(c) for c in zip(*tree))
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = column[node]
                inner = f >= 0
                node = np.where(inner, 2 * node + 1 + (x[np.arange(len(x)), np.maximum(f, 0)] > limit[node]), node)
            z += value[node]
        return z


def isotonic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots of a non-decreasing map from z to the rate
    of label 1; between knots it is linear. Rates are drawn in by one row of
    each label, so no score is exactly 0 or 1."""
    order = np.argsort(z, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(z[order], y[order]):
        blocks.append([float(b), 1.0, float(a), float(a)])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = hi
    ends = [(x, (s + 0.5 * y.mean()) / (n + 0.5)) for s, n, lo, hi in blocks for x in (lo, hi)]
    xs, ps = np.array([e[0] for e in ends]), np.maximum.accumulate([e[1] for e in ends])
    return xs, np.clip(ps, 1e-4, 1 - 1e-4)


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: Boosting | None
    knots: tuple[np.ndarray, np.ndarray] | None

    def scorer(self):
        """A function from an Arrow array of texts to scores."""
        features = FeatureMaker(self.lexicon)

        def score(texts: pa.Array) -> np.ndarray:
            if self.trees is None:
                return np.zeros(len(texts))
            z = self.trees(features(texts))
            # the tiny slope keeps the order of the trees within a flat part
            return np.clip(np.interp(z, *self.knots) + 1e-6 * np.tanh(z / 8), 0.0, 1.0)

        return score


def _features(sample: DataFrame, lexicon: Lexicon) -> list:
    """doc_id, label, fold, x of the sample's rows."""

    def featurise(batches):
        make = FeatureMaker(lexicon)
        for batch in batches:
            for part in slices(batch, "text"):
                x = make(part.column("text").cast(pa.string()))
                flat = pa.array(list(x), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label").cast(pa.int32()), part.column("fold").cast(pa.int32()), flat], names=["doc_id", "label", "fold", "x"])

    rows = sample.mapInArrow(featurise, "doc_id long, label int, fold int, x array<double>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    return rows


def fit_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, most_rows: int = 8000, folds: int = 3) -> ToxicityModel:
    """Fits on at most ``most_rows`` labelled rows outside the held-out fold.

    The rows of each label are dealt to ``folds`` folds. Each fold is scored by a
    lexicon and trees that know the other folds alone, and these scores of all rows
    calibrate; the lexicon and the trees that are kept are made of all rows. So at
    every size; a label with a single row has no scores of this kind.
    """
    sample = labelled_sample(docs, labels, "toxic", modulus, held_out, most_rows)
    # ids of most_rows rows at most
    turn = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id"))
    dealt = sample.select("doc_id", "label").distinct().select("doc_id", ((turn - 1) % folds).alias("fold"))
    sample = written(sample.join(F.broadcast(dealt), "doc_id"), "dealt")
    lexicon = learn_lexicon(sample)
    rows = _features(sample, lexicon)
    y = np.array([r["label"] for r in rows], float)
    if not len(rows) or not 0 < y.mean() < 1:
        return ToxicityModel(lexicon, None, None)
    trees = Boosting().fit(np.array([r["x"] for r in rows]), y)
    z, apart = [], []
    for k in range(folds):
        own = _features(sample, learn_lexicon(sample.where(F.col("fold") != k)))
        x, fold, label = np.array([r["x"] for r in own]), np.array([r["fold"] for r in own]), np.array([r["label"] for r in own], float)
        others = fold != k
        if others.all() or not 0 < label[others].mean() < 1:
            continue
        z.append(Boosting().fit(x[others], label[others])(x[~others]))
        apart.append(label[~others])
    if not z:
        return ToxicityModel(lexicon, trees, (np.zeros(1), np.array([y.mean()])))
    return ToxicityModel(lexicon, trees, isotonic(np.concatenate(z), np.concatenate(apart)))


def score_toxicity(docs: DataFrame, model: ToxicityModel, modulus: int = 5, held_out: int = 0, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def run(batches):
        score = model.scorer()
        for batch in batches:
            for part in slices(batch, "text"):
                s = score(part.column("text").cast(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus
    return scored.select("doc_id", F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The rows whose score is below ``threshold``, all columns as they were.
    A row with a null text stays, whatever an empty text would score."""

    def make():
        score = model.scorer()
        return lambda texts: score(texts) < threshold

    return filtered(docs, "text", make)
