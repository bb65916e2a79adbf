import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loggrove.llm.packing import HarmonicPacker, cut_lengths, pack
from loggrove.llm.queries import vocabulary
from loggrove.llm.token_counts import read_cache, token_counts

BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


def test_counts_are_the_library_s(spark, make_docs, odd_texts, tmp_path):
    r = random.Random(4)
    parts = ["a", "The", "'s", "é", "İ", ".", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", " ", " ", "　", "12", "!!", "<|endoftext|>", "漢", "😀", "́", "​"]
    texts = odd_texts + [(100 + k, "".join(r.choice(parts) for _ in range(r.randint(0, 12)))) for k in range(3000)]
    docs = make_docs(texts)
    t = library(BYTES)
    got = token_counts(docs, vocabulary(BYTES), str(tmp_path / "cache")).collect()
    assert len(got) == len(texts)
    want = sorted((repr(d), len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for d, x in texts)
    assert sorted((repr(g.doc_id), g.n_bytes, g.n_tokens) for g in got) == want


def test_a_second_run_encodes_only_what_is_new(spark, make_docs, tmp_path):
    cache = str(tmp_path / "cache")
    token_counts(make_docs([(1, "a b"), (2, "a b"), (3, "c")]), vocabulary(BYTES), cache).collect()
    assert read_cache(spark, cache).count() == 2
    got = token_counts(make_docs([(9, "a b"), (8, "new text")]), vocabulary(BYTES), cache)
    assert {r.doc_id: r.n_tokens for r in got.collect()} == {9: 2, 8: 2}
    assert read_cache(spark, cache).count() == 3
    assert token_counts(make_docs([]), vocabulary(BYTES), cache).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 2047, 2048, 2049, 5000])
def test_cut_lengths(n):
    cut = cut_lengths(n, 2048, 64)
    assert sum(cut) == n and all(c in (2048, 1024, 512, 256, 128, 64) for c in cut[:-1])


def test_each_worker_s_bins_are_gapless_and_need_no_padding():
    r = random.Random(1)
    packer, rows, size = HarmonicPacker(2048, 64, 7), [], {}
    for d in range(400):
        size[d] = r.choice([1, 5, 70, 700, 2048, 5000])
        rows += packer.add(d, np.arange(size[d], dtype="<u4"))
    rows += packer.finish()
    bins = {}
    for *_, sequence, offset in sorted(rows, key=lambda x: (x[-2], x[-1])):
        bins.setdefault(sequence, []).append(offset)
    lengths = {}
    for _, _, n, _, _, sequence, offset in sorted(rows, key=lambda x: (x[-2], x[-1])):
        assert offset == lengths.get(sequence, 0)
        lengths[sequence] = offset + n
    assert all(n <= 2048 and n & (n - 1) == 0 for n in lengths.values())
    for d in size:
        own = sorted((s, n) for doc, s, n, *_ in rows if doc == d)
        assert [s for s, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) == size[d]


def test_pack_gives_every_id_once(spark, make_docs, odd_texts):
    texts = [x for x in odd_texts if x[0] != 5]
    got = pack(make_docs(texts).repartition(3), vocabulary(WORDS), end_id=1).collect()
    t = library(WORDS)
    for d, x in texts:
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4")
        own = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got if r.doc_id == d)
        assert own[0][0] == 0 and sum(o[1] for o in own) == len(ids)
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c and total == len(ids) for s, n, c, total in own)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048
    assert pack(make_docs([]), vocabulary(WORDS), end_id=1).agg(F.count("*")).first()[0] == 0


def test_rows_that_share_an_id_do_not_meet_each_other(spark, make_docs, tmp_path):
    # null ids and one id with many texts: each text is encoded once
    docs = make_docs([(None if k % 2 else 3, f"text {k % 4000}") for k in range(8000)])
    counts = token_counts(docs, vocabulary("byte_bpe_50k.json"), str(tmp_path / "cache"))
    assert counts.count() == 8000 and counts.where("n_tokens is null").count() == 0
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 4000
    again = token_counts(docs, vocabulary("byte_bpe_50k.json"), str(tmp_path / "cache"))
    assert again.count() == 8000 and spark.read.parquet(str(tmp_path / "cache")).count() == 4000


def test_a_run_whose_counts_are_stored_moves_no_text(spark, make_docs, tmp_path):
    def written():
        store = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(store.apply(k).totalShuffleWrite() for k in range(store.length()))

    r = random.Random(2)
    docs = make_docs([(k, "".join(chr(r.randint(97, 122)) for _ in range(40_000))) for k in range(100)])
    moved = []
    for _ in range(2):
        before = written()
        token_counts(docs, vocabulary(BYTES), str(tmp_path / "cache")).collect()
        moved.append(written() - before)
    assert moved[0] > 2_000_000 and moved[1] < 200_000
