import hashlib
import random

import numpy as np
import pytest

from loggrove.llm import suffix_dedup
from loggrove.llm.suffix_dedup import without_repeats
from loggrove.llm.suffixes import equal_groups, later, runs, sampled_suffixes
from tests.llm.conftest import words


def tag(text):
    return int(hashlib.sha256(text.encode()).hexdigest()[:15], 16)


def brute(pairs, length=100):
    """(id, bytes, removed, spans, kept) by a dictionary of all strings."""
    place = lambda d, t: (1 << 63 if d is None else d, tag(t))
    texts = sorted({(*place(d, t or ""), (t or "").encode()) for d, t in pairs})
    first = {}
    for own, mark, data in texts:
        for s in range(len(data) - length + 1):
            first.setdefault(data[s : s + length], (own, mark, s))
    out = []
    for d, t in pairs:
        data = (t or "").encode()
        gone = [False] * len(data)
        for s in range(len(data) - length + 1):
            if first[data[s : s + length]] != (*place(d, t or ""), s):
                gone[s : s + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone) if not g)))
    return sorted(out, key=str)


def found(frame, **options):
    return sorted(((*r[:4], bytes(r[4])) for r in without_repeats(frame, **options).collect()), key=str)


def corpus(seed, n=120):
    """Texts that share passages in other surroundings, copies, periods, a hot line."""
    r = random.Random(seed)
    w = words(400, seed)
    prose = lambda k: " ".join(r.choice(w) for _ in range(k))
    passages = [prose(k) for k in (12, 20, 40, 90)]
    line = "This line stands in very many of the texts of this corpus, whatever else they have, so that its strings are hot: ü. "
    texts = []
    for _ in range(n):
        parts = [prose(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            cut = r.randint(0, len(p) // 2)
            parts += [p[cut:] if r.random() < 0.5 else p, prose(r.randint(0, 15))]
        if r.random() < 0.5:
            parts.insert(r.randint(0, len(parts)), line)
        texts.append(" ".join(parts))
    texts += [texts[3]] * 4 + ["ab" * 300, "a" * 500, "ab" * 120 + "c" + "ab" * 90, line * 4, "", "x" * 99, "x" * 100, "x" * 101]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed, bucket_rows, sorted_", [(1, 200_000, 300_000), (2, 40, 300_000), (3, 300, 200)])
def test_rows_are_those_of_all_strings(make_docs, monkeypatch, seed, bucket_rows, sorted_):
    monkeypatch.setattr(suffix_dedup, "SORTED", sorted_)
    pairs = corpus(seed)
    assert found(make_docs(pairs), bucket_rows=bucket_rows) == brute(pairs)


def test_small_blocks_and_combinations(make_docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 333)
    monkeypatch.setattr(suffix_dedup, "COMBINED", 50)
    pairs = corpus(5)
    assert found(make_docs(pairs), bucket_rows=25) == brute(pairs)


def test_odd_texts_ids_and_clashing_columns(make_docs, odd_texts):
    long = odd_texts[6][1]
    pairs = odd_texts + [(None, long[500:4000]), (None, long[500:4000]), (None, None), (5, long[900:3000]), (5, long[800:2500]), (-9, "x" + long[1000:1200])]
    assert found(make_docs(pairs)) == brute(pairs)


@pytest.mark.parametrize("length", [64, 127])
def test_other_lengths(make_docs, length):
    pairs = corpus(7, 50)
    assert found(make_docs(pairs), length=length) == brute(pairs, length)


def test_empty_table(make_docs):
    assert found(make_docs([(1, "a")]).where("doc_id = 2")) == []


def test_equal_strings_are_sampled_at_the_same_place():
    r = np.random.default_rng(3)
    passage = r.integers(97, 123, 400, np.uint8)
    chosen = []
    for before in (0, 17, 90):
        data = np.concatenate([r.integers(97, 123, before, np.uint8), passage, r.integers(97, 123, 50, np.uint8)])
        text, start, at, size, gram = sampled_suffixes(data, np.array([0, len(data)]), 100)
        assert size.sum() == len(data) - 99 and (text == 0).all()
        places = {int(s) + j - before: int(s + a) - before for s, a, n in zip(start, at, size) for j in range(n)}
        chosen.append({k: v for k, v in places.items() if 0 <= k <= 300})
    assert chosen[0] == chosen[1] == chosen[2] and len(chosen[0]) == 301


def test_groups_first_places_and_runs():
    key = [np.array([5, 3, 5, 3, 9, 5]), np.array([1, 1, 1, 2, 1, 2])]
    rows, group = equal_groups([lambda r, k=k: k[r] for k in key], 6)
    assert rows.tolist() == [0, 2] and len(set(group)) == 1
    assert later(np.array([1, 1, 1, 2]), np.array([4, 3, 3, 9])).tolist() == [True, False, False, False]
    assert [c.tolist() for c in runs(np.array([1, 0, 1, 1]), np.array([6, 5, 5, 9]))] == [[0, 1, 1], [5, 5, 9], [1, 2, 1]]
