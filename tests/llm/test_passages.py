import random

from loggrove.llm.line_dedup import dedup_lines, without_repeated_lines
from tests.llm.conftest import words

ENDS = [". ", "! ", "? ", ", ", "; ", ": ", " | ", ".\n", "?\t", "!\r\n", "\n"]


def prose(n, seed, ends=ENDS):
    """n words with a line end behind every fourth or so."""
    r = random.Random(seed)
    return "".join(x + (r.choice(ends) if r.random() < 0.25 else " ") for x in words(n, seed))


def test_a_planted_passage_goes_from_its_first_to_its_last_line(spark, make_docs):
    # fifty words in lines of every length, within a paragraph and without a line feed
    texts, planted = [], []
    for k in range(40):
        passage = prose(50, 4000 + k, [". ", "! ", "? ", ", ", "; ", ": "]).strip() + ". "
        planted.append(passage)
        texts += [(2 * k, prose(20, k).strip() + ". " + passage + prose(20, k + 100)), (2 * k + 1, prose(20, k + 200).strip() + ". " + passage + prose(20, k + 300))]
    got = {r.doc_id: r for r in dedup_lines(make_docs(texts)).collect()}
    for k, passage in enumerate(planted):
        first, second = got[2 * k], got[2 * k + 1]
        assert first.new_text == first.text and second.new_text == second.text.replace(passage, "")
    kept = {r.doc_id: r.text for r in without_repeated_lines(make_docs(texts)).collect()}
    assert kept == {d: r.new_text for d, r in got.items()}


def test_a_text_with_control_characters_is_cut_like_others(spark, make_docs):
    passage = "Xa. " + prose(50, 9, [". ", ", "]).strip() + ". "
    texts = [(1, "a\x01b. " + passage), (2, "a\x01b. " + passage), (3, "\x01\x01 c. " + passage + "d\x01e"), (4, "f. " + passage + "g.")]
    got = {r.doc_id: r.new_text for r in dedup_lines(make_docs(texts)).collect()}
    assert got == {1: texts[0][1], 2: "", 3: "\x01\x01 c. d\x01e", 4: "f. g."}


def test_rows_that_share_an_id_are_cut_each_at_its_own_places(spark, make_docs):
    # the passage stands at another place in each row of id 2, and twice in document 3
    passage = "Xa. " + prose(50, 9, [". ", ", "]).strip() + ". "
    texts = [(1, passage), (2, "B. C. D. " + passage), (2, passage + "E."), (3, passage + "F. " + passage), (4, "G. " + passage)]
    got = sorted(r.new_text for r in dedup_lines(make_docs(texts)).collect())
    assert got == sorted([passage, "B. C. D. ", "E.", "F. ", "G. "])


def test_a_very_long_text_that_repeats_itself_and_another_is_cut_in_one_go(spark, make_docs):
    w = words(3000, 5)
    r = random.Random(6)
    lines = [" ".join(r.choice(w) for _ in range(6)) + ".\n" for _ in range(60_000)]
    texts = [(1, "".join(lines[20_000:50_000])), (2, "".join(lines + lines[:100]))]
    got = {r.doc_id: r.new_text for r in dedup_lines(make_docs(texts)).collect()}
    assert got == {1: texts[0][1], 2: "".join(lines[:20_000] + lines[50_000:])}


def test_a_chunk_of_a_text_that_repeats_itself_is_compared_once(spark, make_docs):
    # each comparison stands once in the plan: what a lambda names thrice, Spark computes thrice for each chunk
    passage = "Xa. " + prose(50, 9, [". ", ", "]).strip() + ". "
    found = dedup_lines(make_docs([(1, passage), (2, passage + "F. " + passage + "G.")]))
    assert {r.doc_id: r.new_text for r in found.collect()} == {1: passage, 2: "F. G."}
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("aggregate(") <= 2 * 3 + 1  # two directions: at spots, beside a kept copy, beside an earlier chunk; lines removed
