"""Simple-8b: runs of small integers packed into 64-bit words.

The top four bits of a word are its selector; the other 60 hold as many values
as the selector says, each in an equal number of bits.  Values of 60 bits or
more are escaped: their word holds the number of an entry in a side list.
Encoding is greedy (the fullest selector that fits the values ahead); decoding
treats all words of a selector at once.
"""

from __future__ import annotations

import numpy as np

# fixed values of the format: (values in a word, bits of each) by selector; selector 0 is the escape
SELECTORS = ((1, 60), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10),
             (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 0
COUNT = np.array([c for c, _ in SELECTORS], np.int64)
BITS = np.array([b for _, b in SELECTORS], np.int64)
PAD = int(COUNT.max())


_LIMITS = np.array(sorted({1 << b for b in BITS.tolist()}), np.uint64)
_KNOWN = np.array([*sorted(set(BITS.tolist())), 61], np.uint8)
_SMALL = _KNOWN[np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64), side="right")]


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that the narrowest fitting selector gives each value (61 for those that must be escaped)."""
    if not int(values.max()) >> 16:
        return _SMALL[values.astype(np.uint16)]
    return _KNOWN[np.searchsorted(_LIMITS, values, side="right")]


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escapes) of uint64 ``values``; the tail is padded with zeros."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    padded = np.concatenate((values, np.zeros(PAD, np.uint64)))
    need = _widths(padded)
    # widest value among the next 1, 2, 4, .. positions; any count is covered by two such windows
    top, width = {1: need}, 1
    while width * 2 <= PAD:
        t = top[width]
        top[width * 2] = np.maximum(t[:len(t) - width], t[width:])
        width *= 2
    choice = np.full(n, ESCAPE, np.int8)
    for s in range(len(SELECTORS) - 1, 0, -1):  # fuller selectors overwrite
        c, b = SELECTORS[s]
        half = 1 << (c.bit_length() - 1)
        t = top[half]
        fits = (t[:n] if c == half else np.maximum(t[:n], t[c - half:c - half + n])) <= b
        if fits.any():
            np.putmask(choice, fits, s)
    step, at, starts = (COUNT[choice] + np.arange(n)).tolist(), 0, []
    while at < n:
        starts.append(at)
        at = step[at]
    pos = np.array(starts, np.int64)
    sel = choice[pos]
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in np.unique(sel):
        at = np.flatnonzero(sel == s)
        if s == ESCAPE:
            words[at] |= np.arange(len(at), dtype=np.uint64)
        elif BITS[s]:
            lane = np.arange(COUNT[s])
            words[at] |= np.bitwise_or.reduce(
                padded[pos[at][:, None] + lane] << (lane * BITS[s]).astype(np.uint64), axis=1)
    return words, values[pos[sel == ESCAPE]]


def decode(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` values held in ``words``."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(COUNT[sel])
    if n > (ends[-1] if len(ends) else 0):
        raise ValueError("fewer values than stated")
    first = ends - COUNT[sel]
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s in np.unique(sel):
        at = np.flatnonzero(sel == s)
        if s == ESCAPE:
            out[first[at]] = escapes[(words[at] & np.uint64((1 << 60) - 1)).astype(np.int64)]
        elif BITS[s]:
            lane = np.arange(COUNT[s])
            out[first[at][:, None] + lane] = (words[at][:, None] >> (lane * BITS[s]).astype(np.uint64)
                                              ) & np.uint64((1 << int(BITS[s])) - 1)
    return out[:n]
