import base64
import gzip
import hashlib
import io
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from loggrove.llm.decontamination import ItemMatcher, best_match, contaminations, decontaminate, normalised
from loggrove.llm.license_scan import PHRASES, LicenseScanner, scan_licenses
from loggrove.llm.line_dedup import AROUND, LONGEST, dedup_lines, without_repeated_lines
from loggrove.llm.warc import read_archives, read_records, record, round_trip, write_archives
from tests.llm.conftest import words


# --- line dedup -----------------------------------------------------------------


def brute_line_dedup(texts, least=60):
    """The operator's rule by loops over all chunks."""
    long = lambda b, seed: xxhash.xxh64_intdigest(b, seed)

    def rolled(hashes):
        seed = 42
        for v in hashes:
            seed = long(v.to_bytes(8, "little"), seed)
        return seed

    docs = []
    for d, t in texts:
        lines = [x for x in re.split(r"(?<=\n)|(?<=[.!?,;:|][ \t\n\x0b\f\r])", t or "") if x]
        bare = [x.strip(AROUND) for x in lines]
        hashes = [long(x.encode(), 42) for x in bare]
        roll = [rolled(hashes[i : i + 2]) for i in range(len(lines) - 1)]
        starts = [i for i in range(len(roll)) if i == 0 or roll[i] & 3]
        end = lambda s: next((j for j in range(s + 1, s + LONGEST - 1) if j == len(lines) - 1 or j < len(lines) and roll[j - 1] & 12), min(s + LONGEST - 1, len(lines) - 1))  # noqa: E731, B023
        docs.append((d, t, lines, bare, [(s, end(s)) for s in starts]))
    # of each chunk: who keeps it, and the lines around it there
    keeper = {}
    for d, _, _, bare, chunks in docs:
        for k, (a, b) in enumerate(chunks):
            first = chunks[k - 1][0] + 1 if k else a
            last = chunks[k + 1][1] - 1 if k + 1 < len(chunks) else len(bare) - 1
            key = tuple(bare[a : b + 1])
            if d is not None and (key not in keeper or d < keeper[key][0]):
                keeper[key] = d, bare[first:a][::-1], bare[b + 1 : last + 1]
    out = []
    for d, t, lines, bare, chunks in docs:
        gone, seen = set(), set()
        for a, b in chunks if d is not None else ():
            key = tuple(bare[a : b + 1])
            owner, left, right = keeper[key]
            if owner != d:
                x = next((k for k, w in enumerate(left) if a - 1 - k < 0 or bare[a - 1 - k] != w), len(left))
                y = next((k for k, w in enumerate(right) if b + 1 + k >= len(bare) or bare[b + 1 + k] != w), len(right))
                gone |= set(range(a - x, b + y + 1))
            elif key in seen:
                gone |= set(range(a, b + 1))
            seen.add(key)
        runs = []
        for k in sorted(gone):
            if runs and runs[-1][-1] == k - 1:
                runs[-1].append(k)
            else:
                runs.append([k])
        cut = {k for r in runs if len("".join(lines[r[0] : r[-1] + 1]).strip(AROUND)) >= least for k in r}
        out.append((d, "".join(x for k, x in enumerate(lines) if k not in cut) if cut else t, len(cut)))
    return out


def prose(n, seed):
    r = random.Random(seed)
    w = words(n, seed)
    return "".join(x + r.choice([" ", " ", " ", ", ", ". ", ".\n", " | ", "; "]) for x in w).strip()


def test_line_dedup_is_its_rule(spark, make_docs, odd_texts):
    shared = [prose(70, 100), prose(120, 101)]
    texts = list(odd_texts)
    for k in range(40):
        body = [prose(80, k), shared[k % 2] if k % 3 else "", prose(50, k + 500)]
        texts.append((200 + k, " ".join(body)))
    for k in range(60):
        r = random.Random(k)
        body = [prose(r.randint(0, 20), k), r.choice([*shared, "Ha! " * 40, "a\n" * 33, "b?\tc!\r\n" * 9]), prose(r.randint(0, 9), k + 500), r.choice(shared)[: r.randint(50, 600)], prose(9, k + 700)]
        texts.append((400 + k, " ".join(body)))
    texts += [(500, prose(30, 2) + "\n" + prose(30, 2)), (500, prose(30, 2)), (None, shared[0]), (-9, ""), (-8, "one line only")]
    texts += [(290, "a\x01b. " + shared[0]), (291, "a\x01b. " + shared[0])]
    texts += [(300, prose(90, 1)), (301, prose(90, 1)), (302, prose(40, 2) + "\n" + prose(40, 2))]
    got = sorted((repr(r.doc_id), repr(r.new_text), r.n_removed) for r in dedup_lines(make_docs(texts)).collect())
    want = brute_line_dedup(texts)
    assert got == sorted((repr(d), repr(t), n) for d, t, n in want)
    cut = [(d, t, new) for (d, t), (_, new, n) in zip(texts, want) if n]
    assert len(cut) > 20
    kept = without_repeated_lines(make_docs(texts))
    assert kept.columns == make_docs([]).columns and kept.dtypes == make_docs([]).dtypes
    rows = {repr(r.doc_id): r for r in kept.collect()}
    assert "301" not in rows and "300" in rows and rows["1"].text is None and rows["2"].text == ""
    assert all(r.n_chars == len(r.text) for d, r in rows.items() if r.text is not None)
    assert without_repeated_lines(make_docs([])).count() == 0


def test_a_passage_inside_paragraphs_loses_most_of_its_words(spark, make_docs):
    passage = prose(120, 7)
    texts = [(k, prose(60, 20 + k) + " " + passage + " " + prose(60, 60 + k)) for k in range(6)]
    for r in dedup_lines(make_docs(texts)).collect():
        left = sum(w in r.new_text for w in passage.split()) / len(passage.split())
        assert r.new_text == r.text if r.doc_id == 0 else left < 0.55, (r.doc_id, left)


# --- decontamination ------------------------------------------------------------


def distance(a, b):
    """Fewest edits from ``a`` to a part of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def test_myers_is_the_dynamic_programme():
    r = random.Random(2)
    for _ in range(300):
        a = "".join(r.choice("abc") for _ in range(r.randint(1, 90)))
        b = "".join(r.choice("abc") for _ in range(r.randint(0, 40))) + a[: r.randint(0, 90)] + "".join(r.choice("abc") for _ in range(9))
        want = distance(a, b)
        found = best_match(a, b, len(a))
        assert (found[0] if found else len(a)) == want


def spoiled(text, n, r):
    t = list(text)
    for _ in range(n):
        k = r.randrange(len(t))
        t[k : k + r.choice([0, 1])] = [r.choice("xyz"), ""][r.randrange(2)]
    return "".join(t)


def test_items_within_the_budget_are_found(spark, make_docs):
    r = random.Random(8)
    items = [(k, " ".join(words(r.randint(12, 60), 900 + k))) for k in range(12)] + [(50, "Hi you"), (51, ""), (52, None), (53, " ".join(words(12, 900)))]
    texts = [(1, None), (2, ""), (3, "hi  YOU!"), (4, "thi you"), (None, items[0][1])]
    for k in range(60):
        item = items[k % 12][1]
        texts.append((10 + k, " ".join(words(30, k)) + " " + spoiled(item, r.randint(0, len(item) // 12), r).upper() + "\n" + " ".join(words(30, k + 70))))
    texts += [(100 + k, " ".join(words(200, 3000 + k))) for k in range(20)]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    for block in (4_000_000, 400):
        got = {(g.doc_id, g.item_id): g.edits for g in contaminations(make_docs(texts), bench, block_chars=block).collect()}
        want = {}
        for d, t in texts:
            for i, item in items:
                n = normalised(item or "")
                if n and (e := distance(n, normalised(t or ""))) <= int(len(n) / 16) and i != 50:
                    want[d, i] = e
        want[3, 50] = 0
        assert got == want
    kept = decontaminate(make_docs(texts), bench)
    assert kept.columns == make_docs([]).columns
    assert sorted(repr(k.doc_id) for k in kept.collect()) == sorted(repr(d) for d, _ in texts if not any(x == d for x, _ in want))
    none = bench.where("item_id = 52")
    assert decontaminate(make_docs(texts), none).count() == len(texts) and contaminations(make_docs([]), bench).count() == 0


def test_a_matcher_without_items_finds_nothing():
    assert ItemMatcher([])("any text") == []


# --- licenses -------------------------------------------------------------------


def brute_licenses(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(hits), min((h[0] for h in hits), default=None), max((h[0] for h in hits), default=None), ",".join(sorted({h[1] for h in hits}))


def test_base_phrases_are_those_of_a_word_search(spark, make_docs, odd_texts):
    r = random.Random(6)
    parts = ["mit", "MIT", " license", " ", "-", "License", "general", " Public", "apache ", "é", "x", "\n", "licenseé", " mit license", "..", "mit  license mit license", "gnu general public license"]
    texts = [x for x in odd_texts if x[0] != 5] + [(100 + k, "".join(r.choice(parts) for _ in range(r.randint(0, 9)))) for k in range(2000)]
    got = {x.doc_id: x for x in scan_licenses(make_docs(texts)).collect()}
    for d, t in texts:
        x = got[d]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == brute_licenses(t or "")
        assert set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(",")) and 0 <= x.score <= 1
        assert x.labels.split(",") == sorted(set(x.labels.split(",")))
    assert scan_licenses(make_docs([])).count() == 0


def test_wrong_letters_are_forgiven_within_the_budget():
    scan = LicenseScanner()
    assert scan(b"Relaesed undr the MlT License. and gnu genral pubic license")[5] == "gpl,mit"
    assert scan(b"Licensed under CC BY-NC 4.0.")[5] == "cc-by-nc"
    assert scan(b"a license to nothing at all")[5] == ""


# --- WARC -----------------------------------------------------------------------


def test_records_are_members_of_their_own_and_are_verified():
    members = [record(7, "http://a b/é", "<p>é</p>".encode(), None, False), record(8, None, b"", None, False), record(None, "u", b"x" * 300_000, None, False), record(9, "u", b"abc", 7, True)]
    assert all(gzip.decompress(m).startswith(b"WARC/1.1\r\n") for m in members)
    rows = list(read_records(io.BytesIO(b"".join(members))))
    assert [(r[0], r[2], r[3], r[5]) for r in rows] == [(7, "response", 9, None), (8, "response", 0, None), (None, "response", 300_000, None), (9, "revisit", 3, 7)]
    assert rows[0][6].decode() == "<p>é</p>" and rows[3][6] is None and rows[2][6] == b"x" * 300_000
    broken = gzip.compress(gzip.decompress(members[0]).replace(b"<p>", b"<q>"))
    with pytest.raises(ValueError, match="digest"):
        list(read_records(io.BytesIO(broken)))
    with pytest.raises(ValueError, match="within a record"):
        list(read_records(io.BytesIO(b"".join(members)[:-40])))


def test_pages_come_back_with_revisits(spark, tmp_path):
    rows = [(k, f"http://h/{k}", ["a", "é" * 50, None, "", "b"][k % 5] if k < 40 else f"page {k}", 1) for k in range(80)] + [(200, "u", "single", 1), (200, "u", "single", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = {}
    for r in round_trip(pages).collect():
        got.setdefault(r.page_id, []).append(r)
    payload = {p: (h or "").encode() for p, _, h, _ in rows}
    last = {}
    for p, b in payload.items():
        last[b] = max(last.get(b, p), p)
    assert len(got[200]) == 2
    for p, b in payload.items():
        r = got[p][0]
        assert (r.payload_bytes, r.payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if last[b] == p else ("revisit", last[b]))
    folder = "file://" + str(tmp_path / "w")
    archives = write_archives(pages, folder, least_bytes=50, archive_bytes=500)
    back = read_archives(archives, folder).where("record_type = 'response'").select("page_id", F.col("payload").cast("string").alias("html"))
    assert {r.page_id: r.html for r in back.collect()} == {p: b.decode() for p, b in payload.items() if len(b) < 50 or last[b] == p}
    assert archives.count() > 4 and round_trip(pages.limit(0)).count() == 0


def test_short_items_are_tried_at_each_place():
    find = lambda item, text: [h[:2] for h in ItemMatcher([(1, item)])(text)]
    assert find("a)", "a)a)") == find("a)", "xa) a)") == [(1, 0)] and find("a)", "xa)b a)b") == []
    assert find("ab", "abab xab ab") == [(1, 0)]


def test_blocks_of_a_benchmark_give_what_one_block_gives(spark, make_docs):
    items = [(k, " ".join(words(12, 900 + k))) for k in range(9)] + [(3, " ".join(words(12, 903))), (None, "x y z"), (11, None)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = make_docs([(k, " ".join(words(30, k)) + " " + (items[k % 12][1] or "") + " tail") for k in range(24)] + [(5, items[0][1])] * 2)
    one, many = (sorted(map(tuple, contaminations(docs, benchmark, block_chars=b).collect()), key=repr) for b in (10**6, 300))
    assert one == many and len(one) > 20
    left = [sorted(repr(r) for r in decontaminate(docs, benchmark, block_chars=b).collect()) for b in (10**6, 300)]
    assert left[0] == left[1] and len(left[0]) == 2
