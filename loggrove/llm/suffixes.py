"""Arrays of suffixes: where they begin, how they sort, what equal ones share.

Everything here is numpy on one block or bucket, whose size the caller bounds.
"""

from __future__ import annotations

import numpy as np

#: Bytes that sampled suffixes share when they are compared at all.
GRAM = 32
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def sampled_suffixes(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """text, start, at, size, gram of the suffixes that stand for all strings of
    ``length`` bytes of the texts, which lie in ``data`` one behind the other.

    A string is stood for by the suffix that begins at the one of its 32-byte
    grams with the lowest hash (the first of equal ones). That place depends on
    the string's own bytes alone, so equal strings meet at it, and neighbouring strings mostly
    share it. ``start`` is the first of ``size`` neighbouring strings, ``at`` how far
    behind it their suffix begins, ``gram`` a hash of that suffix's first bytes."""
    n, span = len(data), length - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.astype(np.uint64)
    word = np.ndarray((n - 7,), "<u8", np.ascontiguousarray(data), 0, (1,)).copy()
    with np.errstate(over="ignore"):
        gram = word[: n - 31] * _MIX[0]
        for k in (1, 2, 3):
            gram += word[8 * k : n - 31 + 8 * k] * _MIX[k]
        gram ^= gram >> np.uint64(32)
        gram *= _MIX[1]
        gram ^= gram >> np.uint64(29)
    low = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(n - GRAM + 1, dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if span > width:
        low = np.minimum(low[: width - span], low[span - width :])
    # strings that would go on into the next text are none
    across = np.zeros(n + 1, np.int32)
    ends = offsets[1:]
    np.add.at(across, np.maximum(offsets[:-1], ends - length + 1), 1)
    np.add.at(across, ends, -1)
    begins = np.flatnonzero(np.cumsum(across[: n - length + 1]) == 0)
    if not len(begins):
        return none, none, none, none, none.astype(np.uint64)
    anchor = (low[begins] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, [len(anchor)]])
    first, place = begins[cut[:-1]], anchor[cut[:-1]]
    text = np.searchsorted(offsets, first, "right") - 1
    return text, first - offsets[text], place - first, np.diff(cut), gram[place]


def equal_groups(keys, n: int, groups: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, group): the rows that are equal to another one in all of ``keys``,
    sorted, with a number for each group of equal ones.

    A multikey quicksort: the rows of a segment share all keys so far and are sorted by
    the next one, which splits the segment; only segments of two rows or more go
    on to the key after it. ``keys`` are arrays of n values, made when needed;
    ``groups``: segments to begin with."""
    rows = np.arange(n)
    segment = np.zeros(n, np.int64) if groups is None else groups
    for key in keys:
        if not len(rows):
            break
        value = key(rows)
        order = np.lexsort((value, segment))
        rows, segment, value = rows[order], segment[order], value[order]
        new = np.ones(len(rows), bool)
        new[1:] = (segment[1:] != segment[:-1]) | (value[1:] != value[:-1])
        segment = np.cumsum(new) - 1
        company = np.bincount(segment)[segment] > 1
        rows, segment = rows[company], segment[company]
    return rows, segment


def gather(data: np.ndarray, begins: np.ndarray, width: int) -> np.ndarray:
    """(len(begins), width / 8) words, as big-endian numbers, of the bytes from
    each of ``begins`` on; ``width`` is a multiple of 8 and ``data`` long enough."""
    taken = np.lib.stride_tricks.sliding_window_view(data, width)[begins]
    return np.ascontiguousarray(taken).view(">u8").astype(np.uint64)


def later(group: np.ndarray, *position: np.ndarray) -> np.ndarray:
    """Which rows do not stand first in their group. Rows that tie for the first
    place all count as first."""
    order = np.lexsort((*position[::-1], group))
    head = np.ones(len(order), bool)
    head[1:] = group[order][1:] != group[order][:-1]
    leader = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    out = np.zeros(len(order), bool)
    out[order] = np.logical_or.reduce([p[order] != p[leader] for p in position])
    return out


def runs(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorts rows of (.., place) and joins neighbouring places: (.., start, size)."""
    if not len(columns[0]):
        return (*columns, columns[-1])
    order = np.lexsort(columns[::-1])
    own = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in own[:-1]] + [own[-1][1:] > own[-1][:-1] + 1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(order)) - 1
    return (*[c[head] for c in own], own[-1][tail] - own[-1][head] + 1)
