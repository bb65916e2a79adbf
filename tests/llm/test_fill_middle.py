import hashlib
import re

import pytest

from loggrove.llm.fill_middle import fill_in_middle, restore
from pyspark.sql import functions as F

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def expected(doc, text, seed=42):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    spm = h[3] % 100 < 80
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return len(units), "spm" if spm else "psm", len(prefix), len(middle), out


def check(frame, pairs):
    found = fill_in_middle(frame).withColumn("restored", restore(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:-1] == (), str(r))
    want = [(d, *expected(d, t), t or "") for d, t in pairs]
    assert sorted(map(tuple, found), key=key) == sorted(want, key=key)


def test_odd_texts_and_clashing_columns(make_docs, odd_texts):
    check(make_docs(odd_texts), odd_texts)


def test_marks_and_pieces_of_marks(make_docs):
    bits = ["<", "P", ">", "<P", "S>", "<P>", "<S>", "<M>", " ", "\n", "<<", "M>", "ü ", " ", "\x85", "a<S", ">b"]
    pairs = [(k, "".join(bits[(k * 7 + j * (k % 5 + 1)) % len(bits)] for j in range(k % 9))) for k in range(400)]
    check(make_docs(pairs), pairs)


@pytest.mark.parametrize("text", ["", " ", "a", " a", "a ", "\t\r\n", "word " * 50_000, "x" * 300_000])
def test_every_form_restores(make_docs, text):
    check(make_docs([(k, text) for k in range(12)]), [(k, text) for k in range(12)])


def test_empty_table(make_docs, spark):
    frame = make_docs([(1, "a")]).where("doc_id = 2")
    assert fill_in_middle(frame).collect() == []
