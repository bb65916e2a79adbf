import zlib

import numpy as np
import pytest

import corpus_pipeline
from loggrove.llm.queries import QUERIES, vocabulary
from tests.llm.test_duplicates import brute_classes


def test_stages_hold_their_rules(spark, sf_dir):
    """Each stage on its own input, against brute force."""
    docs = corpus_pipeline.table(spark, sf_dir, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), name)
        if name != "packing":
            assert docs.columns == columns
            seen[name] = before, {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    before, after = seen["toxicity"]
    labels = {r.doc_id: r.toxic for r in corpus_pipeline.table(spark, sf_dir, "labels").collect()}
    gone = {d for d, _ in before} - set(after)
    assert np.mean([labels[d] for d in gone if d in labels] or [1]) > 0.5
    before, after = seen["near_dedup"]
    classes, _ = brute_classes(before, 5)
    assert set(after) == {d for d, c in classes.items() if d == c}
    before, after = seen["decontamination"]
    items = [" ".join(r.text.lower().split()) for r in corpus_pipeline.table(spark, sf_dir, "benchmark").collect()]
    assert not any(i in " ".join(t.lower().split()) for t in after.values() for i in items)
    assert {d for d, t in before if d not in after} >= {d for d, t in before if any(i in " ".join(t.lower().split()) for i in items)}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    pieces = docs.collect()
    assert {p.doc_id for p in pieces} == set(after)
    for p in pieces[::17]:
        ids = np.array(t.encode(after[p.doc_id] or "", add_special_tokens=False).ids + [1], "<u4")
        assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())


def test_pipeline_of_odd_and_empty_tables(spark, tmp_path):
    for name, rows in (("odd", [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "a b c", "en", "s", 5), (None, "a b c", "en", "s", 5)]), ("none", [])):
        root = str(tmp_path / name)
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
        total = {}
        for r in corpus_pipeline.run(spark, root).collect():  # a document may be cut into pieces
            total[r.doc_id] = total.get(r.doc_id, 0) + r.length
        assert sorted((repr(d), n) for d, n in total.items()) == sorted((repr(d), 1 + len((t or "").split())) for d, t, *_ in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run_and_have_a_row_for_each_input(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    n = got.count()
    if name == "op7_warc":
        assert n == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    elif name not in ("op5_packing", "op6_decontamination"):
        assert n == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    else:
        assert n > 0
