import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loggrove.llm import canopies
from loggrove.llm.components import connected_components
from loggrove.llm.fingerprints import Fingerprinter, edited_fingerprints, fingerprint_table
from loggrove.llm.near_duplicates import drop_near_duplicates
from loggrove.llm.near_duplicates import near_duplicates as near
from loggrove.llm.shingles import Shingler
from tests.llm.conftest import words


def brute_classes(texts, size, part=80, whole=100):
    """Smallest id that each text's links reach, by comparing all pairs."""
    sets = {}
    for d, t in texts:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and whole * both >= part * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}, {d: len(s) for d, s in sets.items()}


def edited(w, share, r):
    return [r.choice(words(50, r.random())) if r.random() < share else x for x in w]


def corpus(n_groups=25, big=60):
    """Groups of copies with few edits, one of them big, and texts between."""
    r = random.Random(3)
    texts, d = [], 0
    for g in range(n_groups):
        base = words(r.choice([3, 8, 40, 150]), g)
        for k in range(big if g == 4 else r.randint(1, 5)):
            texts.append((d, " ".join(base if k == 0 or r.random() < 0.3 else edited(base, r.choice([0.01, 0.03, 0.06]), r))))
            d += 1
    return texts


@pytest.mark.parametrize("block", [128, 16])
def test_classes_are_those_of_all_pairs(spark, make_docs, block, monkeypatch):
    monkeypatch.setattr(canopies, "BLOCK", block)
    monkeypatch.setattr(canopies, "OVERLAP", block // 8)
    texts = corpus() + [(900, None), (901, ""), (902, " \n"), (903, "One"), (904, "one"), (905, "one two")]
    want, size = brute_classes(texts, 4)
    got = near(make_docs(texts), shingle_words=4).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == size
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_rows(spark, make_docs, odd_texts):
    got = near(make_docs(odd_texts), shingle_words=4).collect()
    assert len(got) == len(odd_texts)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert by[5] == [(1, 4, False)] * 2 and by[None] == [(1, None, True)] and by[1] == [(0, 1, True)] and by[3] == [(0, 3, True)]
    assert near(make_docs([])).count() == 0
    kept = drop_near_duplicates(make_docs(odd_texts))
    assert kept.columns == make_docs([]).columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "4", "6", "7", "None", "-3"])


@pytest.mark.parametrize("together", [1_000_000, 64])
def test_components_of_chains_hubs_and_loops(spark, together):
    edges = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1100)] + [(7000, 7000), (None, 4), (8, 8), (5, 3), (5, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), together=together).collect()}
    assert all(got[k] == 0 for k in range(201)) and all(got[k] == 1000 for k in range(1000, 1100)) and got[7000] == 7000
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingles_fold_only_ascii_and_split_at_six_bytes():
    sets = Shingler(2).sets([b"A b\x0bC", b"a B\x0cc", "É b".encode(), "é b".encode(), b"a\x1cb c", b"", b" a"])
    assert sets[0].tolist() == sets[1].tolist() and len(sets[0]) == 2
    assert sets[2].tolist() != sets[3].tolist() and len(sets[4]) == 1 and len(sets[5]) == 0 and len(sets[6]) == 1


def test_edited_texts_follow_the_ring_of_ids(spark, make_docs, odd_texts):
    texts = [x for x in odd_texts if x[0] not in (5, None)] + [(50 + 7 * k, " ".join(words(k, k))) for k in range(60)]
    rows = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in edited_fingerprints(make_docs(texts)).collect()}
    make = Fingerprinter()
    own = make([(t or "").encode() for _, t in rows])
    for k, (d, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        new = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        other = make([new.encode()])[0]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert bytes(r["values"]) == own[k].tobytes() and bytes(r.edited_values) == other.tobytes()
        assert (r.near_edited, r.near_next) == ((own[k] == other).mean(), (own[k] == own[(k + 1) % len(rows)]).mean())
    assert edited_fingerprints(make_docs([])).count() == 0
    assert fingerprint_table(make_docs([(1, "x")])).first().near_next == 1.0


def test_like_documents_are_found_and_verified(spark, make_docs):
    base = words(300, 1)
    close, far = base[:295] + words(5, 2), base[:100] + words(200, 3)
    docs = make_docs([(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(close)), (4, " ".join(far)), (None, " ".join(base)), (2, "other")])
    got = {}
    for r in fingerprint_table(docs).collect():
        got.setdefault(r.doc_id, []).append(r.class_id)
    assert got.pop(2) in ([1, 2], [2, 1]) and got == {1: [1], 3: [1], 4: [4], None: [None]}


def test_only_pairs_with_enough_in_common_are_confirmed(spark):
    full = spark.createDataFrame([(1, list(range(10))), (2, list(range(9))), (3, list(range(5))), (4, [])], "id long, words array<bigint>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 4), (4, 4)], "a long, b long")
    assert [tuple(r) for r in canopies.confirmed(pairs, full, 80, 100).collect()] == [(1, 2, 0.9)]
    assert {(r.a, r.b) for r in canopies.confirmed(pairs, full, 50, 100).collect()} == {(1, 2), (1, 3), (2, 3)}


def test_ring_with_null_and_repeated_ids(spark, make_docs):
    texts = [(None, f"null {k} " + " ".join(words(9, k))) for k in range(40)] + [(7, f"seven {k} " + " ".join(words(9, 90 + k))) for k in range(40)] + [(k, " ".join(words(9, 200 + k))) for k in range(20) if k != 7]
    found = edited_fingerprints(make_docs(texts)).collect()
    # each text is edited once, and the heads it is given are those of all texts
    assert sorted(repr(r.doc_id) for r in found) == sorted(repr(d) for d, _ in texts)
    heads = {hashlib.sha256((t[: len(t) - len(t) // 3] + u[: len(t) // 3]).encode()).hexdigest() for _, t in texts for _, u in texts}
    assert all(r.edited_sha256 in heads for r in found)
    by = {r.doc_id: r for r in found if r.doc_id not in (7, None)}
    one, zero = dict(texts)[1], dict(texts)[0]
    assert by[1].edited_sha256 == hashlib.sha256((one[: len(one) - len(one) // 3] + zero[: len(one) // 3]).encode()).hexdigest()
