"""Word shingles and MinHash signatures in vectorised numpy.

A word is a run of bytes other than blank, tab, line feed, vertical tab, form
feed and carriage return; A-Z count as a-z. A text's set holds the 64-bit hashes
of its distinct shingles of ``size`` words, of all its words as one where there
are fewer, of nothing where there is no word.
"""

from __future__ import annotations

import hashlib

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 2**64))


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finishing steps: each input bit moves each output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Shingle sets of texts, a group of texts at a time."""

    def __init__(self, size: int, group_bytes: int = 1 << 19):
        self.size, self.group_bytes = size, group_bytes
        self.spaces = np.zeros(256, bool)
        self.spaces[[9, 10, 11, 12, 13, 32]] = True
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32
        rng = np.random.default_rng(20)
        self.weights = rng.integers(1, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers = np.ones(1, np.uint64)
        self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            grow = 1 << int(n).bit_length()
            for name, base in (("powers", MULTIPLIER), ("inverses", INVERSE)):
                factors = np.full(grow, base, np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors))

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text."""
        out: list[np.ndarray] = []
        group: list[bytes] = []
        size = 0
        for t in texts:
            group.append(t)
            size += len(t) + 1
            if size > self.group_bytes:
                out += self._group(group)
                group, size = [], 0
        return out + (self._group(group) if group else [])

    def _group(self, texts: list[bytes]) -> list[np.ndarray]:
        raw = self.fold[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        self._grow(len(raw) + 1)
        space = self.spaces[raw]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate([[0], edge])
        starts, ends = edge[0::2], edge[1::2]
        # hash of bytes s..e as a polynomial, from running sums modulo 2**64
        sums = np.empty(len(raw) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.powers[: len(raw)], out=sums[1:])
        words = mixed((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        n = len(words)
        k = self.size
        sums = np.zeros(max(n - k + 1, 0), np.uint64)
        for j in range(k if n >= k else 0):
            sums += words[j : n - k + 1 + j] * self.weights[j]
        shingles = mixed(sums)
        bounds = np.concatenate([[0], np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))])
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= k:
                own = np.sort(shingles[a : b - k + 1])
                fresh = np.empty(len(own), bool)
                fresh[0] = True
                np.not_equal(own[1:], own[:-1], out=fresh[1:])
                out.append(own[fresh])
            elif b > a:
                out.append(mixed((words[a:b] * self.weights[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def set_digest(s: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


class MinHasher:
    """Signatures by multiply-add permutations of 32-bit words."""

    def __init__(self, permutations: int, seed: int = 7, block: int = 1 << 15):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 2**31, permutations, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 2**32, permutations, dtype=np.uint32)
        self.block = block

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row for each set; of an empty set all values are 2**32 - 1."""
        out = np.full((len(sets), len(self.a)), 0xFFFFFFFF, np.uint32)
        i = 0
        while i < len(sets):
            j, n = i, 0
            while j < len(sets) and (j == i or n + len(sets[j]) <= self.block):
                n += len(sets[j])
                j += 1
            rows = [k for k in range(i, j) if len(sets[k])]
            if rows:
                x = np.concatenate([sets[k] for k in rows])
                x = (x >> np.uint64(32)).astype(np.uint32)
                at = np.concatenate([[0], np.cumsum([len(sets[k]) for k in rows])[:-1]])
                y = np.empty_like(x)
                for p, (a, b) in enumerate(zip(self.a, self.b)):
                    np.multiply(x, a, out=y)
                    np.add(y, b, out=y)
                    # further mixing: min of a plain multiply-add favours regular sets
                    np.bitwise_xor(y, y >> np.uint32(15), out=y)
                    np.multiply(y, np.uint32(0x2C1B3C6D), out=y)
                    out[rows, p] = np.minimum.reduceat(y, at)
            i = j
        return out
