"""License scans: fuzzy search for short notices.

Words are runs of digits, letters a-z (A-Z count as such) and characters above
U+007F. The base finds each place where a phrase's words stand one after the
other. The fuzzy search adds notices with a few wrong letters: a notice with an
error budget of e is cut into e + 1 pieces, of which at least one must be intact
(pigeonhole); an automaton finds the pieces, and at each the ``regex`` library
matches the whole notice with at most e edits in a window around it.

Nulls: a null text counts as empty; a null id stays null. A text without hits
has n_base 0, empty labels, null places and score 0. Equal texts have equal
results; repeated rows each get a row. Very long texts are scanned whole. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loggrove.llm.common import slices, whole_text

# The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Short notices, their labels and error budgets.
NOTICES = (
    ("released under the mit license", "mit", 4),
    ("licensed under the mit license", "mit", 4),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 8),
    ("licensed under the apache license version 2 0", "apache", 5),
    ("gnu general public license", "gpl", 3),
    ("gnu lesser general public license", "lgpl", 4),
    ("gnu affero general public license", "agpl", 4),
    ("redistribution and use in source and binary forms", "bsd", 6),
    ("mozilla public license", "mpl", 3),
    ("licensed under cc by nc", "cc-by-nc", 1),
    ("licensed under cc by sa", "cc-by-sa", 1),
    ("creative commons attribution", "cc", 3),
    ("all rights reserved", "reserved", 2),
)

SEPARATORS = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
WORD = rb"0-9a-z\x80-\xff"


class LicenseScanner:
    """Finds base phrases and fuzzy notices in one text (bytes of UTF-8)."""

    def __init__(self, phrases: dict[str, str] = PHRASES, notices=NOTICES):
        import ahocorasick
        import regex

        self.fold = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
        self.is_word = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])
        self.phrases = [(re.compile(rb"(?<![" + WORD + rb"])" + SEPARATORS.join(re.escape(w.encode()) for w in p.split()) + rb"(?![" + WORD + rb"])"), p.split()[-1].encode(), label) for p, label in phrases.items()]
        self.notices = [(regex.compile(f"(?e)(?<![^ ])(?:{regex.escape(n, literal_spaces=True)}){{e<={e}}}(?![^ ])"), n, label, e) for n, label, e in notices]
        self.seeds = ahocorasick.Automaton()
        found: dict[str, list] = {}
        for k, (_, n, _, e) in enumerate(self.notices):
            cuts = np.linspace(0, len(n), e + 2).astype(int)
            for a, b in zip(cuts, cuts[1:]):
                found.setdefault(n[a:b], []).append((k, int(a)))
        for piece, places in found.items():
            self.seeds.add_word(piece, (len(piece), places))
        self.seeds.make_automaton()

    def base(self, low: bytes) -> list[tuple[int, str]]:
        """(byte offset, label) of every place of a phrase."""
        return [(m.start(), label) for pattern, last, label in self.phrases if last in low for m in pattern.finditer(low)]

    def fuzzy(self, words: str) -> list[tuple[int, int, str, int, int]]:
        """(start, end, label, edits, length of the notice) in words joined by blanks."""
        windows: dict[int, list[list[int]]] = {}
        for end, (length, places) in self.seeds.iter(words):
            for k, a in places:
                _, n, _, e = self.notices[k]
                start = end + 1 - length - a
                lo, hi = max(0, start - e), start + len(n) + e
                own = windows.setdefault(k, [])
                # places that overlap are searched once
                if own and lo <= own[-1][1]:
                    own[-1][:] = min(lo, own[-1][0]), max(hi, own[-1][1])
                else:
                    own.append([lo, hi])
        out = []
        for k, own in windows.items():
            pattern, n, label, _ = self.notices[k]
            for lo, hi in own:
                lo = words.rfind(" ", 0, lo) + 1
                stop = words.find(" ", hi)
                for m in pattern.finditer(words, lo, len(words) if stop < 0 else stop):
                    out.append((m.start(), m.end(), label, sum(m.fuzzy_counts), len(n)))
        return out

    def __call__(self, text: bytes) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
        low = text.translate(self.fold)
        raw = np.frombuffer(low, np.uint8)
        inside = self.is_word[raw]
        starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        base = self.base(low)
        places = np.searchsorted(starts, [p for p, _ in base]) if base else []
        labels = {label for _, label in base}
        words = re.sub(SEPARATORS, b" ", low).strip().decode("utf-8", "replace")
        spans = self.fuzzy(words)
        best = max([1.0] * bool(base) + [1 - edits / n for _, _, _, edits, n in spans], default=0.0)
        more = labels | {s[2] for s in spans}
        return len(starts), len(base), (int(min(places)) if base else None), (int(max(places)) if base else None), ",".join(sorted(labels)), ",".join(sorted(more)), best, [words[a:b] for a, b, *_ in spans]


@lru_cache(maxsize=1)
def _scanner() -> LicenseScanner:
    return LicenseScanner()


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score and the matched passages of every row."""
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "passages"]
    types = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), pa.list_(pa.string())]

    def run(batches):
        scan = _scanner()
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [(d, *scan(t)) for d, t in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, passages array<string>")
