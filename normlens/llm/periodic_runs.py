"""Maximal periodic runs of words, found by multi-scale minimizers.

A run is a maximal stretch of words with smallest period q and length of at
least ``max(least, times * q)``.

1. Direct lag scans find the runs of periods below ``SHORT``: stretches where
   words q apart are equal.
2. For longer periods there is one scale per power of two w, for w <= q < 2w.
   Every window of w consecutive 2w-word strings marks its smallest hash.
   Inside a run of such a period these strings differ from phase to phase
   and windows one period apart mark positions one period apart; so some
   marked strings are equal and, as marked neighbours of equal hash, q apart.
   Such pairs (p, p + d), w <= d < 2w, are the seeds.
3. Seeds of equal lag that overlap form one region, which is extended word by
   word.  Equal strings that overlap are runs of exponent above 2, so regions
   of a scale have a total length in proportion to the text.
4. A run found under a multiple of its smallest period has the same ends as
   under the period itself, so the smallest period of equal ends is kept.

Words are compared as numbers that stand for equal words exactly; hashes (64
bits, built by doubling) only choose seeds.

Defined cases: a null, empty or blank text has no words, no runs and an empty
collapsed text; a null id is kept; repeated rows are treated alike, one by one;
an empty table gives no rows; a text of any length is taken whole (its words
are held in one task); only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normlens.llm.common import binary_column, mix64

SHORT = 8
TEXT_BYTES = 2 << 20
RUNS = ("id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def _stretches(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of every stretch of true values."""
    at = np.flatnonzero(mask)
    if not len(at):
        return at, at
    cut = np.flatnonzero(np.diff(at) > 1)
    return at[np.concatenate(([0], cut + 1))], at[np.concatenate((cut, [len(at) - 1]))] + 1


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over every ``width`` consecutive values; ``width`` is a power of two."""
    done = 1
    while done < width:
        x = op(x[:-done], x[done:])
        done *= 2
    return x


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring strings from theirs."""
    return mix64(a * np.uint64(0x9E3779B97F4A7C15) + mix64(b + np.uint64(0x632BE59BD9B4E019)))


def _seeds(grams: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, lag) of neighbouring marked grams of equal hash with w <= lag < 2w."""
    low = _sliding(grams, w, np.minimum)
    # a gram is marked when it is the smallest of one of the windows that hold it
    edge = np.zeros(w - 1, np.uint64)
    best = _sliding(np.concatenate((edge, low, edge)), w, np.maximum)
    marked = np.flatnonzero(best == grams)
    order = np.argsort(grams[marked], kind="stable")
    p, h = marked[order], grams[marked][order]
    d = p[1:] - p[:-1]
    ok = (h[1:] == h[:-1]) & (d >= w) & (d < 2 * w)
    return p[:-1][ok], d[ok]


def _extended(words: np.ndarray, d: int, first: int, end: int, lo: int, hi: int, margin: int):
    """Stretches of words[i] == words[i + d] that meet first..end, whole inside the text lo..hi."""
    a, b = max(lo, first - margin), min(hi - d, end + margin)
    while True:
        s, e = _stretches(words[a:b] == words[a + d:b + d])
        left = len(s) and s[0] == 0 and a > lo
        right = len(e) and e[-1] == b - a and b < hi - d
        if not (left or right):
            return s + a, e + a
        margin *= 2  # still equal at an end: look further
        a, b = (max(lo, a - margin) if left else a), (min(hi - d, b + margin) if right else b)


def find_runs(words: np.ndarray, off: np.ndarray, least: int = 6, times: int = 4
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of texts words[off[i]:off[i + 1]], by start, then period.

    Word numbers of different texts must differ.  ``times`` must be 4 or more:
    seeds of a scale are sure only for runs that long.
    """
    if times < 4:
        raise ValueError("runs of fewer than four periods have no sure seeds")
    found = [(np.zeros(0, np.int64),) * 3]
    longest = int(np.diff(off).max(initial=0))

    def add(s, e, q):
        ok = e - s >= max(least, times * q) - q
        found.append((s[ok], e[ok] + q, np.full(int(ok.sum()), q, np.int64)))

    for q in range(1, min(SHORT, longest // times + 1)):
        add(*_stretches(words[:-q] == words[q:]), q)
    grams, k, w = mix64(words.astype(np.uint64) + np.uint64(1)), 1, SHORT
    while times * w <= longest:
        while k < 2 * w:
            grams, k = _joined(grams[:-k], grams[k:]), 2 * k
        p, d = _seeds(grams, w)
        order = np.lexsort((p, d))
        p, d = p[order], d[order]
        new = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (p[1:] - p[:-1] > k)))) if len(p) else p
        last = np.concatenate((new[1:], [len(p)])) - 1 if len(p) else p
        text = np.searchsorted(off, p[new], side="right") - 1
        for lag, first, end, t in zip(d[new].tolist(), p[new].tolist(), (p[last] + k).tolist(), text.tolist()):
            add(*_extended(words, lag, first, end, int(off[t]), int(off[t + 1]), w), lag)
        w *= 2
    s, e, q = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((q, e, s))
    s, e, q = s[order], e[order], q[order]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    s, e, q = s[keep], e[keep], q[keep]
    order = np.lexsort((q, s))
    return s[order], e[order], q[order]


def _task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        flat, at = binary_column(b, "text")
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + TEXT_BYTES, side="right")) - 1)
            texts, numbers, off = [], [], [0]
            for k in range(i, j):
                words = flat[at[k]:at[k + 1]].tobytes().split()  # ASCII white space
                first: dict[bytes, int] = {}
                # a word's number is the place of its first occurrence in the block
                numbers.append(np.fromiter(map(first.setdefault, words, range(off[-1], off[-1] + len(words))),
                                           np.int64, len(words)))
                texts.append(words)
                off.append(off[-1] + len(words))
            bounds = np.array(off, np.int64)
            s, e, q = find_runs(np.concatenate(numbers), bounds)
            owner = np.searchsorted(bounds, s, side="right") - 1
            depth = np.zeros(off[-1] + 1, np.int64)  # a word is dropped after the first period of a run
            np.add.at(depth, s + q, 1)
            np.add.at(depth, e, -1)
            keep = np.cumsum(depth) == 0
            hit = set(owner.tolist())
            kept = [b" ".join(compress(x, keep[off[n]:off[n + 1]].tolist()) if n in hit else x)
                    for n, x in enumerate(texts)]
            runs = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)),
                pa.StructArray.from_arrays([pa.array(s - bounds[owner]), pa.array(e - s), pa.array(q)],
                                           names=["start", "length", "period"]))
            yield pa.record_batch([b.column("id").slice(i, j - i), pa.array(np.diff(bounds)), runs,
                                   pa.array(kept, pa.binary()).cast(pa.string())],
                                  names=["id", "n_words", "runs", "collapsed"])
            i = j


def periodic_runs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, runs, collapsed): runs by start and period; the text without all but the first period of each."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_task, RUNS)
