import random

import numpy as np

from loggrove.llm import canopies, fingerprints
from loggrove.llm.fingerprints import Fingerprinter, fingerprint_table
from loggrove.llm.near_duplicates import near_duplicates
from tests.llm.conftest import words
from tests.llm.test_duplicates import brute_classes, edited


def test_like_documents_are_those_of_all_pairs_in_a_crowd(spark, make_docs):
    # a passage in all documents fills the bands, and the smallest id leads them
    r = random.Random(4)
    shared = words(200, 1)
    texts = [(k, " ".join(shared + words(80, 50 + k))) for k in range(120)]
    for k in range(60):
        base = (shared + words(80, 50 + 2 * k))[:]
        texts.append((1000 + k, " ".join(edited(base, r.choice([0.005, 0.015, 0.02, 0.025, 0.03]), r))))
    want, _ = brute_classes(texts, 5)
    got = {x.doc_id: x.class_id for x in fingerprint_table(make_docs(texts)).collect()}
    assert got == want
    assert 20 < sum(d != c for d, c in want.items()) < 60


def test_pairs_next_to_the_threshold_are_verified_by_their_sets(spark, make_docs):
    # replacing the last k of 200 words leaves 196 - k shingles of 196 + k: 177 of 215 down to 172 of 220
    texts = []
    for g in range(40):
        base, k = words(200, 700 + g), 19 + g % 6
        texts += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(base[: 200 - k] + words(k, 7000 + g)))]
    want, _ = brute_classes(texts, 5)
    assert {c == d for d, c in want.items() if d % 2} == {True, False}
    assert {x.doc_id: x.class_id for x in fingerprint_table(make_docs(texts)).collect()} == want


def test_a_canopy_in_several_components_is_searched_to_the_end(spark, make_docs, monkeypatch):
    # blocks of a few sets leave links to the prefix join
    monkeypatch.setattr(canopies, "BLOCK", 8)
    monkeypatch.setattr(canopies, "OVERLAP", 1)
    monkeypatch.setattr(canopies, "STRAYS", 5)
    monkeypatch.setattr(canopies, "OTHERS", 7)
    r = random.Random(9)
    shared = words(150, 1)
    texts = []
    for k in range(150):
        base = edited(shared, 0.03, random.Random(k // 3)) + words(30, 50 + k // 3)
        texts.append((k, " ".join(edited(base, r.choice([0.0, 0.01, 0.02]), r))))
    want, _ = brute_classes(texts, 4)
    assert 50 <= len(set(want.values())) < 120
    assert {x.doc_id: x.component_id for x in near_duplicates(make_docs(texts), shingle_words=4).collect()} == want


def test_a_block_compares_all_its_pairs():
    sets = [np.array(s, np.int64) for s in ([1, 2, 3, 4, 5], [1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5], [9], [])]
    assert canopies.linked(sets, 80, 100).tolist() == [0, 0, 0, 3, 4]
    assert canopies.linked(sets, 90, 100).tolist() == [0, 1, 0, 3, 4]
    assert canopies.linked([np.zeros(0, np.int64)] * 2, 80, 100).tolist() == [0, 1]


def test_rows_and_moved_sets_grow_with_a_group_of_near_copies(spark, make_docs, monkeypatch):
    moved = []
    links, sets = canopies._block_links, canopies.full_sets

    def counted(full, part, whole):
        edges = links(full, part, whole)
        moved[-1] += [full.selectExpr("sum(size(blocks))").first()[0], edges.count()]
        return edges

    monkeypatch.setattr(canopies, "_block_links", counted)
    for n in (1000, 2000):
        r = random.Random(n)
        base = words(60, 5)
        moved.append([])
        texts = [(k, " ".join(base[:j] + words(1, n + k) + base[j + 1 :])) for k in range(n) if (j := r.randrange(60)) >= 0]
        got = near_duplicates(make_docs(texts), shingle_words=4).select("component_id").distinct().count()
        assert got == 1
    for small, large in zip(*moved):
        assert large <= 2.2 * small


def test_near_copies_move_by_the_shingles_that_strays_ask_for(spark, make_docs, monkeypatch):
    # 400 near copies, five texts less like them, one of which has one near copy's own words
    ordered, moved, prefixes, pairs = [], [], canopies._prefixes, canopies._stray_pairs

    def counted(own, *rest):
        ordered.append(own.count())
        return prefixes(own, *rest)

    def met(rows, *rest):
        moved.append(rows.count())
        return pairs(rows, *rest)

    monkeypatch.setattr(canopies, "_prefixes", counted)
    monkeypatch.setattr(canopies, "_stray_pairs", met)
    r = random.Random(3)
    base = words(60, 5)
    texts = [(k, base[:j] + words(1, 100 + k) + base[j + 1 :]) for k in range(400) if (j := r.randrange(40)) >= 0]
    texts += [(1000 + k, base[:52] + words(8, 900 + k)) for k in range(5)]
    texts.append((2000, texts[7][1][:50] + words(10, 999)))
    texts = [(k, " ".join(t)) for k, t in texts]
    want, _ = brute_classes(texts, 4)
    assert {x.doc_id: x.component_id for x in near_duplicates(make_docs(texts), shingle_words=4).collect()} == want
    assert len(set(want.values())) == 7
    # of 23,000 shingles
    assert ordered == [6] and moved[0] < 1000


def test_a_stray_meets_smaller_and_larger_sets_of_the_largest_component(spark, make_docs, monkeypatch):
    # links at the threshold between sets of other sizes, which no block finds
    monkeypatch.setattr(canopies, "BLOCK", 8)
    monkeypatch.setattr(canopies, "OVERLAP", 1)
    r = random.Random(12)
    base = words(120, 77)
    texts = [(k, base[:j] + words(1, 300 + k) + base[j + 1 :]) for k in range(60) if (j := r.randrange(120)) >= 0]
    texts += [(100 + k, base[: 92 + k % 6] if k % 2 else base + words(20 + k % 9, 400 + k)) for k in range(60)]
    texts = [(k, " ".join(t)) for k, t in texts]
    want, _ = brute_classes(texts, 4)
    assert {x.doc_id: x.component_id for x in near_duplicates(make_docs(texts), shingle_words=4).collect()} == want


def test_links_of_a_band_are_found_whatever_stands_between_them(spark, make_docs, monkeypatch):
    # two bands of a crowd that shares a passage: unlike texts stand between like ones
    monkeypatch.setattr(fingerprints, "BANDS", 2)
    monkeypatch.setattr(canopies, "CROWD", 20, raising=False)
    shared = words(200, 1)
    texts = []
    for k in range(300):
        own = words(70, 50 + k)
        texts.append((2 * k, " ".join(shared + own)))
        if k % 3 == 0:
            texts.append((2 * k + 1, " ".join(shared + own[:45] + words(25, 5000 + k))))
    make = Fingerprinter()
    sets = make.shingler.sets([t.encode() for _, t in texts])
    bands = make.of_sets(sets)[:, :8].reshape(-1, 2, 4)
    near = lambda a, b: len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) >= 0.8
    want = [(texts[k][0], texts[k + 1][0]) for k in range(len(texts) - 1) if texts[k + 1][0] % 2 and near(k, k + 1) and (bands[k] == bands[k + 1]).all(axis=1).any()]
    got = {x.doc_id: x.class_id for x in fingerprint_table(make_docs(texts)).collect()}
    assert len(want) > 40
    assert [p for p in want if got[p[0]] != got[p[1]]] == []
