import random
import zlib

import numpy as np
import pytest

from loggrove.llm.labelled import labelled_sample
from loggrove.llm.quality import CHUNK, FILTERS, HALF, STRIDE, WIDTH, ByteNetwork, fit_quality, padded, score_quality
from loggrove.llm.toxicity import Boosting, drop_toxic, fit_toxicity, isotonic, score_toxicity
from tests.llm.conftest import words


def area(score, label):
    """Probability that a row of label 1 scores higher."""
    order = np.argsort(np.argsort(score))
    one = label == 1
    return (order[one].sum() - one.sum() * (one.sum() - 1) / 2) / (one.sum() * (~one).sum())


@pytest.fixture(scope="module")
def labelled(spark, make_docs):
    r = random.Random(12)
    texts, labels = [], []
    for d in range(500):
        w = words(r.randint(20, 120), d)
        toxic, good = r.random() < 0.25, r.random() < 0.6
        if toxic:
            for k in r.sample(range(len(w)), 3):
                w[k] = r.choice(["idiot", "you moron", "vraku" + r.choice(["s", "te", "mo"]), "st*pid"])
        if not good:
            w = [x.upper() + "!!" for x in w] if r.random() < 0.5 else [x for x in w[:6] for _ in range(20)]
        texts.append((d, " ".join(w)))
        labels.append((d, int(good), int(toxic)))
    texts += [(1000, None), (1001, ""), (None, "you idiot"), (3, texts[3][1])]
    return make_docs(texts), spark.createDataFrame(labels + [(2000, 1, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int"), {d: (q, t) for d, q, t in labels}


@pytest.mark.parametrize("kind", ["quality", "toxicity"])
def test_held_out_rows_are_told_apart(kind, labelled):
    docs, labels, truth = labelled
    if kind == "quality":
        modulus, fold, limit, column, found = 4, 2, 0.7, 0, score_quality(docs, fit_quality(docs, labels))
    else:
        modulus, fold, limit, column, found = 5, 0, 0.5, 1, score_toxicity(docs, fit_toxicity(docs, labels))
    rows = found.collect()
    assert len(rows) == 504 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= limit) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % modulus == fold) for r in rows)
    test = [r for r in rows if r.held_out and r.doc_id in truth]
    label = np.array([truth[r.doc_id][column] for r in test])
    assert area(np.array([r.score for r in test]), label) > 0.9
    assert np.mean([r.predicted for r in test] == label) > 0.85
    again = [r.score for r in rows if r.doc_id == 3]
    assert again[0] == again[1]


def test_labels_of_the_held_out_fold_have_no_part(labelled, spark):
    docs, labels, truth = labelled
    held = {d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0}
    flipped = spark.createDataFrame([(d, q, 1 - t if d in held else t) for d, (q, t) in truth.items()], "doc_id long, quality int, toxic int")
    a, b = (score_toxicity(docs, fit_toxicity(docs, x.dropna())).orderBy("doc_id").collect() for x in (labels, flipped))
    assert [r.score for r in a] == [r.score for r in b]


def test_without_labels_scores_are_constant(labelled, spark, make_docs):
    docs, labels, _ = labelled
    none = labels.limit(0)
    assert {r.score for r in score_quality(docs, fit_quality(docs, none)).collect()} == {0.5}
    assert {r.score for r in score_toxicity(docs, fit_toxicity(docs, none)).collect()} == {0.0}
    assert score_quality(make_docs([]), fit_quality(make_docs([]), labels)).count() == 0
    assert score_toxicity(make_docs([]), fit_toxicity(make_docs([]), labels)).count() == 0


def test_drop_toxic_keeps_columns_and_null_texts(labelled):
    docs, labels, truth = labelled
    model = fit_toxicity(docs, labels)
    kept = drop_toxic(docs, model)
    assert kept.dtypes == docs.dtypes
    bad = {r.doc_id for r in score_toxicity(docs, model).collect() if r.predicted}
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(r.doc_id) for r in docs.collect() if r.doc_id not in bad or r.text is None)
    assert 1000 in {r.doc_id for r in kept.collect()}


def test_network_scores_each_text_as_if_alone():
    net = ByteNetwork.fresh()
    texts = [b"", b"a", b"x" * 127, bytes(range(256)) * 5, b"hello " * 400]
    together = net.scores(texts)
    assert np.allclose(together, [net.scores([t])[0] for t in texts], atol=1e-3)
    raw, halves = padded(texts)
    assert len(raw) == halves.sum() * CHUNK // 2 and halves[0] == 2


def plain_logit(net, text):
    """The network one chunk, filter and place at a time."""
    halves = max(2, -(-len(text) // HALF))
    full = text + bytes(halves * HALF - len(text))
    logits = []
    for c in range(halves - 1):
        # a filter that begins in a chunk may end in what follows it in the text
        places = [p for p in range(c * HALF, c * HALF + CHUNK, STRIDE) if p + WIDTH <= len(full)]
        largest = [max(sum(float(net.table[j][full[p + j], f]) for j in range(WIDTH)) for p in places) for f in range(FILTERS)]
        hidden = [max(sum(v * float(net.w1[f, k]) for f, v in enumerate(largest)) + float(net.b1[k]), 0) for k in range(len(net.b1))]
        logits.append(sum(v * float(net.w2[k]) for k, v in enumerate(hidden)) + net.b2)
    return sum(logits) / len(logits)


def test_network_equals_a_plain_convolution():
    net = ByteNetwork.fresh()
    texts = [b"", b"short", "größer ".encode() * 30, bytes(range(256)) + b"tail"]
    assert np.allclose(net.logits(texts), [plain_logit(net, t) for t in texts], atol=1e-3)


def test_fit_sees_all_of_a_long_text():
    # the only sign of a label stands in the second half of the text
    texts, y = [], []
    for k in range(60):
        pad = [" ".join(words(20, 1000 * k + j)) for j in range(40)]
        for j in range(20, 40):
            pad[j] = "ZZQQXX" * 20 if k % 2 else pad[j]
        texts.append(" ".join(pad).encode())
        y.append(k % 2)
    net = ByteNetwork.fresh().fit(texts[:40], np.array(y[:40], np.float32), draws=20_000)
    z = net.logits(texts[40:])
    assert area(z, np.array(y[40:])) == 1.0


@pytest.mark.parametrize("n", [4, 12, 60])
def test_few_labels_follow_the_same_rule(n, spark, make_docs):
    docs = make_docs([(d, ("good text here " if d % 2 else "BAD!! BAD!! ") * 5) for d in range(4 * n)])
    labels = spark.createDataFrame([(d, d % 2, 1 - d % 2) for d in range(n)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r.score for r in score_quality(docs, fit_quality(docs, labels)).collect()}
    assert found[1] > found[0] and fit_quality(docs, labels, most_bytes=0) is None


def plain_tree(trees, x):
    total = trees.start
    for tree in trees.trees:
        node = 0
        while tree[node][0] >= 0:
            node = 2 * node + (1 if x[tree[node][0]] <= tree[node][1] else 2)
        total += tree[node][2]
    return total


def test_trees_and_calibration_equal_plain_ones():
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(300, 3)), 1)
    y = (x[:, 0] + rng.normal(size=300) > 0).astype(float)
    trees = Boosting(rounds=10).fit(x, y)
    z = trees(x)
    assert np.allclose(z, [plain_tree(trees, r) for r in x])
    # isotonic rates by the min-max formula over distinct order statistics, ties of z kept in their order
    order = np.argsort(z, kind="stable")
    s = y[order]
    best = [max(min(s[a : b + 1].mean() for b in range(k, len(s))) for a in range(k + 1)) for k in range(len(s))]
    knots, rates = isotonic(z, y)
    groups = {}
    for v in best:
        groups[round(v, 9)] = groups.get(round(v, 9), 0) + 1
    expected = [(v * n + 0.5 * y.mean()) / (n + 0.5) for v, n in sorted(groups.items())]
    assert np.allclose(sorted(set(np.round(rates, 6))), sorted(set(np.round(np.clip(np.maximum.accumulate(expected), 1e-4, 1 - 1e-4), 6))))


def test_boosting_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    z = Boosting().fit(x[:1500], y[:1500])(x)
    assert area(z[1500:], y[1500:]) > 0.95
    knots, rates = isotonic(z[1500:], y[1500:])
    assert (np.diff(knots) >= 0).all() and (np.diff(rates) >= 0).all() and 0 < rates[0] and rates[-1] < 1


def test_an_oversized_text_drops_itself_only(spark, make_docs):
    docs = make_docs([(d, ("good text here " if d % 2 else "BAD!! BAD!! ") * (4000 if d == 0 else 5)) for d in range(200)])
    labels = spark.createDataFrame([(d, d % 2, 1 - d % 2) for d in range(200)], "doc_id long, quality int, toxic int")
    taken = labelled_sample(docs, labels, "quality", 4, 2, 4000, 20_000)
    every = labelled_sample(docs, labels, "quality", 4, 2, 4000)
    assert {r.doc_id for r in every.collect()} - {r.doc_id for r in taken.collect()} == {0}
    assert fit_quality(docs, labels, most_bytes=20_000) is not None


@pytest.mark.parametrize("n", [6, 30, 200])
def test_toxicity_is_calibrated_by_rows_that_its_models_do_not_know(n, spark, make_docs):
    # labels that texts say nothing about: scores must stay near their share, at every size
    r = random.Random(n)
    docs = make_docs([(d, " ".join(words(30, d))) for d in range(n)])
    labels = spark.createDataFrame([(d, 1, int(r.random() < 0.4)) for d in range(n)] + [(0, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    scores = [x.score for x in score_toxicity(docs, fit_toxicity(docs, labels)).collect()]
    assert max(scores) < 0.95 or n < 30
    assert abs(np.mean(scores) - 0.4) < 0.35
