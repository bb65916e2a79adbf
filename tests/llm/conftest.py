import pytest

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, score double, hash string, row int, `a.b` int"


def words(n, seed=0):
    """n made-up words, the same for the same seed."""
    import random

    r = random.Random(seed)
    return [("".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 4)))) for _ in range(n)]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns whose names clash with internal ones."""

    def make(texts):
        pairs = texts.items() if isinstance(texts, dict) else texts
        return spark.createDataFrame([(d, t, "en", "s", len(t or ""), 0.5, "h", 1, 2) for d, t in pairs], CLASHING)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null and empty texts, white space, copies, a long text, a null id."""
    long = " ".join(words(20_000, 9))
    return [(1, None), (2, ""), (3, " \n\t"), (4, "One text."), (5, "One text."), (5, "One text."), (6, long), (7, "é́ß 漢字 😀\x00 \x1c a b\r\n\r\nc  d"), (None, "One text."), (-3, "it's DON'T <|endoftext|> <|startoftext|>")]
