"""Simple-8b: as many ids to a 64-bit word as its selector's width allows.

The four high bits of a word select how many ids follow and how wide each is; the first id is in the
lowest bits. Selector 0 is the escape: the next word is one id of up to 64 bits. Values are coded in blocks of
a fixed count, each of which begins with a word of its own, so blocks decode alone by the offsets kept beside them.
"""

from __future__ import annotations

import numpy as np

#: Ids in a word and bits for each, by selector from 1 on; selector 1 packs zeros.
SELECTORS = ((120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
BLOCK = 4096
_WIDEST = np.uint64((1 << 60) - 1)


def _fitting(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position of the block-shaped values, the selector of the word that would begin there and how many values it takes."""
    n = len(values)
    at = np.arange(n) % BLOCK
    left = np.minimum(np.minimum(BLOCK - at, n - np.arange(n)), 255).astype(np.uint8)  # a word that reaches past its block's end holds only what is left of it
    class_ = np.zeros(n, dtype=np.uint8)  # the least width that a value fits, counted in SELECTORS
    for _, width in SELECTORS:
        class_ += values >= np.uint64(1 << width)
    # the greatest class of as many values from each position on: of a power of two first, then of two such stretches that overlap
    widest = {1: class_}
    for k in (1, 2, 4, 8, 16, 32):
        widest[2 * k] = np.maximum(widest[k][: max(0, len(widest[k]) - k)], widest[k][k:])
    selector = np.zeros(n, dtype=np.uint8)
    for s in range(len(SELECTORS), 0, -1):  # from few values to many, so the densest that fits stays
        count = SELECTORS[s - 1][0]
        half = 1 << (count.bit_length() - 1)
        if n >= count:
            over = widest[half]
            most = np.maximum(over[: n - count + 1], over[count - half : n - half + 1])
            selector[: n - count + 1][(most < s) & (left[: n - count + 1] >= count)] = s
    taken = np.array([1, *(c for c, _ in SELECTORS)], dtype=np.int64)[selector]
    return selector, taken


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words uint64, offset of each block's first word uint32)."""
    values = values.astype(np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    selector, taken = _fitting(values)
    step, starts, i = taken.tolist(), [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    start = np.array(starts, dtype=np.int64)
    sel = selector[start]
    place = np.cumsum(1 + (sel == 0)) - 1 - (sel == 0)
    words = np.zeros(len(start) + int((sel == 0).sum()), dtype=np.uint64)
    for s, (count, width) in enumerate(SELECTORS, 1):
        mine = np.flatnonzero(sel == s)
        if not len(mine):
            continue
        word = np.full(len(mine), s << 60, dtype=np.uint64)
        if width:
            for k in range(count):
                word |= values[start[mine] + k] << np.uint64(k * width)
        words[place[mine]] = word
    words[place[sel == 0] + 1] = values[start[sel == 0]]
    return words, place[np.searchsorted(start, np.arange(0, n, BLOCK))].astype(np.uint32)


def decode(words: np.ndarray, n: int, offsets: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
    """Values of blocks ``first`` to ``last`` (not included), all by default."""
    last = len(offsets) if last is None else last
    if not n or first >= last:
        return np.zeros(0, np.uint64)
    lo, hi = int(offsets[first]), int(offsets[last]) if last < len(offsets) else len(words)
    part = words[lo:hi]
    sel = (part >> np.uint64(60)).astype(np.uint8)
    # words after an escape are raw; they can look like any selector, so escapes are settled from the left
    raw = np.zeros(len(part), dtype=bool)
    for i in np.flatnonzero(sel == 0).tolist():
        if not raw[i]:
            raw[i + 1] = True
    at = np.flatnonzero(~raw)
    sel = sel[at]
    count = np.array([1, *(c for c, _ in SELECTORS)], dtype=np.int64)[sel]
    place = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), dtype=np.uint64)
    for s, (many, width) in enumerate(SELECTORS, 1):
        mine = sel == s
        if width and mine.any():
            word, to = part[at[mine]] & _WIDEST, place[mine]
            for k in range(many):
                out[to + k] = (word >> np.uint64(k * width)) & np.uint64((1 << width) - 1)
    out[place[sel == 0]] = part[at[sel == 0] + 1]
    return out
