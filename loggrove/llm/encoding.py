"""Exact token ids with a cache of words.

Both tokenizers used here cut a text at white space before they merge bytes, so
the ids of a text are the ids of its words one after the other. Arrow splits
and numbers the words of a batch; only words that a worker has not met are
handed to the tokenizer.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from loggrove.llm.common import no_threads

#: Words kept by a worker before its cache starts anew.
CACHE_WORDS = 500_000

# What a pattern of a pre-tokenizer calls white space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Texts in which words are divided by one blank or one line feed only.
PLAIN = r"^[^\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{b}]+(?:[ \n][^\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{b}]+)*$"
#: White space and the word after it; a boundary before white space is always one of the pre-tokenizer's.
PART = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Letters of Latin-1 and then ASCII punctuation: two pieces at most for the pre-tokenizer.
SIMPLE = re.compile(r"( ?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")


def tokenizer_digest(path: str) -> str:
    """Names the vocabulary and the library version that made a count."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(tokenizers.__version__.encode() + b"\0" + f.read()).hexdigest()


def _byte_letters() -> list[str]:
    """The visible character that byte-level vocabularies use for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class WordEncoder:
    """ids of words, by the tokenizers library, with a cache.

    ``folds``: the vocabulary is of lower-case words and ignores white space.
    """

    def __init__(self, path: str, folds: bool):
        no_threads()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.folds = folds
        self.cache: dict[str, np.ndarray] = {}
        self.letters = _byte_letters()

    def _piece(self, piece: str) -> list[int]:
        if not piece.isascii() or piece[0] == " ":
            piece = "".join(map(self.letters.__getitem__, piece.encode()))
        return [t.id for t in self.tokenizer.model.tokenize(piece)]

    def words(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each of some distinct words."""
        known = self.cache
        if len(known) > CACHE_WORDS:
            known.clear()
        rest = []
        for w in words:
            if w not in known:
                if m := SIMPLE.fullmatch(w):
                    blank, letters, marks = m.groups()
                    if self.folds:
                        blank, letters = "", letters.lower()
                    ids = self._piece(blank + letters)
                    if marks:
                        ids += self._piece(marks)
                    known[w] = np.array(ids, np.uint32)
                else:
                    rest.append(w)
        if rest:
            for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
                known[w] = np.array(e.ids, np.uint32)
        return [known[w] for w in words]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text, for a vocabulary that keeps white space."""
        out = np.zeros(len(texts), np.int64)
        plain = pc.match_substring_regex(texts, PLAIN)
        mask = np.asarray(plain.to_numpy(zero_copy_only=False), bool)
        if mask.any():
            some = texts.filter(pc.equal(plain, True))
            lines = pc.split_pattern(some, "\n")
            line_ends = lines.offsets.to_numpy().astype(np.int64)
            line_ends -= line_ends[0]
            words = pc.split_pattern(lines.flatten(), " ")
            ends = words.offsets.to_numpy().astype(np.int64)
            ends -= ends[0]
            coded = words.flatten().dictionary_encode()
            at = coded.indices.to_numpy()
            names = coded.dictionary.to_pylist()
            size = np.fromiter(map(len, self.words([" " + w for w in names])), np.int64, len(names))[at]
            first = ends[:-1]
            heads, back = np.unique(at[first], return_inverse=True)
            size[first] = np.fromiter(map(len, self.words([names[i] for i in heads])), np.int64, len(heads))[back]
            total = np.concatenate([[0], np.cumsum(size)])
            spans = ends[line_ends]
            # a line feed between two lines is a piece of its own
            feed = len(self.words(["\n"])[0])
            out[mask] = np.diff(total[spans]) + (np.diff(line_ends) - 1) * feed
        if not mask.all():
            other = [i for i in np.flatnonzero(~mask)]
            parts = [PART.findall(texts[int(i)].as_py() or "") for i in other]
            names = list(dict.fromkeys(chain.from_iterable(parts)))
            size = dict(zip(names, map(len, self.words(names))))
            for i, p in zip(other, parts):
                out[i] = sum(map(size.__getitem__, p))
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts and where each text's ids begin, for a
        vocabulary that drops white space."""
        words = pc.ascii_split_whitespace(texts)
        ends = words.offsets.to_numpy().astype(np.int64)
        ends -= ends[0]
        flat = words.flatten()
        filled = pc.not_equal(pc.binary_length(flat), 0)
        keep = np.asarray(filled.to_numpy(zero_copy_only=False), bool)
        coded = flat.filter(filled).dictionary_encode()
        at = coded.indices.to_numpy()
        ids = self.words(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        start = np.concatenate([[0], np.cumsum(size)])
        table = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        long = size[at]
        total = np.concatenate([[0], np.cumsum(long)])
        where = np.repeat(start[at] - total[:-1], long) + np.arange(total[-1])
        kept = np.concatenate([[0], np.cumsum(keep)])
        return table[where], total[kept[ends]]


@lru_cache(maxsize=2)
def encoder(path: str, folds: bool) -> WordEncoder:
    """One encoder for each vocabulary and worker."""
    return WordEncoder(path, folds)
