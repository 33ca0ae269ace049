"""Exact repeated byte strings by hash-compared suffix sorting.

Every byte that lies in a ``window``-byte string which also starts anywhere
else (same text included) is marked.  Matches never cross texts.

1. Anchors.  Each window start picks the ``gram``-byte string of smallest hash
   inside its window (a minimizer), so equal windows pick the same one and
   about 2 / (window - gram + 2) of all positions become anchors.  An anchor
   serves a run of window starts; its hull is the bytes those windows cover.
2. Anchors whose gram hash occurs once are dropped.  Anchors whose whole hull
   occurs twice serve only repeated windows.  Both are grouped counts.
3. What is left are hulls that agree in the gram but differ further out: the
   edges of repeats.  Their bytes are fetched once and, for each gram, the
   suffixes from the gram to the right and the mirrored ones to the left are
   sorted by merging runs.  A comparison finds the common extension by binary
   search on prefix polynomial hashes, so it costs logarithmic time; common
   lengths of neighbours are verified on the bytes.  A window is repeated when
   another hull of its gram is in the same left class and right class.
   A gram with more than ``hot`` distinct hulls is not put in one task: its
   windows are counted by a pair of 64-bit hashes, combined before the shuffle.

Hashes are polynomials modulo 2^64, mixed.  Steps 2 and the hot path compare
128 bits (gram and hull, or two bases).

Defined cases: a null or short text has no windows; empty tables give no rows;
a repeated row is text that starts elsewhere, so all its windows are marked;
ids may be null only if texts are to be told apart by nothing else (such rows
are dropped from matching); only the two named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normlens.llm.common import byte_blocks, checked_broadcast, materialize, mix64, ragged_index

BASE = 0x9E3779B97F4A7C15 | 1
BASE2 = 0xC2B2AE3D27D4EB4F | 1
ANCHORS = "h long, g long, doc_id long, p long, a int, c int"
CONTEXTS = "h long, doc_id long, p long, a int, c int, own boolean, ctx binary"
SPANS = "doc_id long, s long, e long"


#: Powers of a base and of its inverse, as long as the longest block met so far, but never above KEPT_POWERS.
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
KEPT_POWERS = 1 << 20


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(base^0.., base^-0..) of at least ``n`` terms; tables for longer blocks are not kept."""
    known = _POWERS.get(base)
    if known is not None and len(known[0]) >= n:
        return known
    made = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, dtype=np.uint64)
        p[:1] = 1
        made.append(np.cumprod(p, out=p))
    if n <= KEPT_POWERS:
        _POWERS[base] = (made[0], made[1])
    return made[0], made[1]


class PrefixHash:
    """Polynomial hash of any substring of ``data`` from one prefix sum."""

    def __init__(self, data: np.ndarray, base: int = BASE):
        power, self.inv = _powers(len(data) + 1, base)
        self.sum = np.zeros(len(data) + 1, dtype=np.uint64)
        terms = data.astype(np.uint64)
        terms += np.uint64(1)
        terms *= power[:len(data)]
        np.cumsum(terms, out=self.sum[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sum[end] - self.sum[start]) * self.inv[start]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64(self.raw(start, end) + (end - start).astype(np.uint64))


def _sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of every ``width`` consecutive values, the first where several are equal."""
    at, done = np.arange(len(x), dtype=np.int32 if len(x) < 1 << 31 else np.int64), 1
    while done < width:
        step = min(done, width - done)
        right = x[step:] < x[:-step]  # a later value counts only when it is smaller
        at = np.where(right, at[step:], at[:-step])
        x = np.where(right, x[step:], x[:-step])
        done += step
    return at


def block_anchors(data: np.ndarray, off: np.ndarray, window: int, gram: int):
    """(row, anchor, first start, last start) of every anchor; positions are in ``data``."""
    none = np.zeros(0, np.int64)
    n, width = len(data), window - gram + 1
    if n < window:
        return none, none, none, none, None
    ph = PrefixHash(data)
    grams = mix64((ph.sum[gram:] - ph.sum[:-gram]) * ph.inv[:n - gram + 1])
    low = _sliding_argmin(grams, width)
    lens = np.diff(off)
    rows = np.flatnonzero(lens >= window)
    if not len(rows):
        return none, none, none, none, None
    starts = ragged_index(off[rows], lens[rows] - window + 1)
    owner = np.repeat(rows, lens[rows] - window + 1)
    pick = low[starts].astype(np.int64)
    new = np.ones(len(pick), dtype=bool)
    new[1:] = (pick[1:] != pick[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(pick)])) - 1
    return owner[first], pick[first], starts[first], starts[last], ph


def _anchor_task(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for i, _, data, off in byte_blocks(b, "text"):
                row, p, a, c, ph = block_anchors(data, off, window, gram)
                if not len(row):
                    continue
                h = ph.of(p, p + gram)
                g = mix64(ph.raw(a, c + window) ^ mix64(((p - a) << 32 | (c - a)).astype(np.uint64)))
                yield pa.record_batch(
                    [pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array(ids[i + row].astype(np.int64)),
                     pa.array(p - off[row]), pa.array((p - a).astype(np.int32)), pa.array((p - c).astype(np.int32))],
                    names=["h", "g", "doc_id", "p", "a", "c"])
    return run


def _context_task(window: int):
    """Bytes of the hulls asked for: anchor p, first start p - a, last start p - c."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                text = (b.column("text")[k].as_py() or "").encode()
                want = b.column("want")[k].values
                cols = [want.field(x).to_numpy(zero_copy_only=False) for x in ("h", "p", "a", "c", "own")]
                doc = b.column("doc_id")[k].as_py()
                ctx = [text[p - a:p - c + window] for p, a, c in zip(cols[1].tolist(), cols[2].tolist(), cols[3].tolist())]
                yield pa.record_batch(
                    [pa.array(cols[0]), pa.array(np.full(len(ctx), doc, np.int64)), pa.array(cols[1]),
                     pa.array(cols[2]), pa.array(cols[3]), pa.array(cols[4].astype(bool)), pa.array(ctx, pa.binary())],
                    names=["h", "doc_id", "p", "a", "c", "own", "ctx"])
    return run


class _Suffixes:
    """Suffixes of contexts, all read from their gram in one direction."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray):
        self.data, self.start, self.length, self.group = data, start, length, group
        self.hash = PrefixHash(data)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common extension of suffixes i and j: binary search on prefix hashes."""
        lo = np.zeros(len(i), np.int64)
        hi = np.minimum(self.length[i], self.length[j])
        si, sj = self.start[i], self.start[j]
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi + 1) >> 1
            same = self.hash.raw(si, si + mid) == self.hash.raw(sj, sj + mid)
            lo = np.where(open_ & same, mid, lo)
            hi = np.where(open_ & ~same, mid - 1, hi)

    def before(self, i: np.ndarray, j: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix i sorts before j (or is equal where ``or_equal``)."""
        n = self.common(i, j)
        li, lj = self.length[i], self.length[j]
        top = len(self.data) - 1
        ci = np.where(n < li, self.data[np.minimum(self.start[i] + n, top)].astype(np.int16), -1)
        cj = np.where(n < lj, self.data[np.minimum(self.start[j] + n, top)].astype(np.int16), -1)
        return (ci < cj) | (or_equal & (ci == cj))

    def sort(self) -> np.ndarray:
        """Suffix numbers, sorted inside each group, by merging runs of doubling width."""
        order = np.argsort(self.group, kind="stable")
        g = self.group[order]
        first = np.concatenate(([True], g[1:] != g[:-1]))
        base = np.maximum.accumulate(np.where(first, np.arange(len(g)), 0))
        size = np.bincount(np.cumsum(first) - 1)[np.cumsum(first) - 1]
        place = np.arange(len(g)) - base
        width = 1
        while True:
            active = np.flatnonzero(size > width)
            if not len(active):
                return order
            run = place[active] // width
            pair0 = base[active] + (run & ~1) * width
            is_right = (run & 1).astype(bool)
            other = np.where(is_right, pair0, pair0 + width)
            end = base[active] + size[active]
            lo = np.minimum(other, end)
            other_end = np.minimum(other + width, end)
            hi, begin = other_end.copy(), lo.copy()
            me = order[active]
            while True:
                look = np.flatnonzero(lo < hi)
                if not len(look):
                    break
                mid = (lo[look] + hi[look]) >> 1
                # a left suffix goes before equal right ones
                less = self.before(order[mid], me[look], is_right[look])
                lo[look] = np.where(less, mid + 1, lo[look])
                hi[look] = np.where(less, hi[look], mid)
            mine = place[active] - np.where(is_right, (run & ~1) * width + width, (run & ~1) * width)
            merged = order.copy()
            merged[pair0 + mine + (lo - begin)] = me
            order = merged
            width *= 2

    def neighbours(self, order: np.ndarray) -> np.ndarray:
        """Verified common length of each sorted suffix with the one before it (-1: first of its group)."""
        out = np.full(len(order), -1, np.int64)
        if len(order) < 2:
            return out
        i, j = order[:-1], order[1:]
        same = np.flatnonzero(self.group[i] == self.group[j])
        i, j = i[same], j[same]
        n = self.common(i, j)
        # collision check: the claimed lengths are compared byte by byte
        step = 50_000
        for k in range(0, len(i), step):
            m = n[k:k + step]
            at, row = ragged_index(np.zeros(len(m), np.int64), m), np.repeat(np.arange(len(m)), m)
            differ = np.flatnonzero(self.data[self.start[i[k:k + step]][row] + at]
                                    != self.data[self.start[j[k:k + step]][row] + at])
            if len(differ):
                np.minimum.at(m, row[differ], at[differ])
        out[same + 1] = n
        return out


def repeated_windows(ctx: list[bytes], h: np.ndarray, a: np.ndarray, c: np.ndarray, window: int
                     ) -> tuple[np.ndarray, np.ndarray]:
    """(context, t) of every window start p - t that another context of the same gram hash shares."""
    n = len(ctx)
    length = np.array([len(x) for x in ctx], dtype=np.int64)
    end = np.cumsum(length)
    data = np.frombuffer(b"".join(ctx), dtype=np.uint8)
    mid = end - length + a
    _, group = np.unique(h, return_inverse=True)
    right = _Suffixes(data, mid, end - mid, group)
    order_r = right.sort()
    lcp_r = right.neighbours(order_r)
    mirrored = data[::-1].copy()
    left = _Suffixes(mirrored, len(data) - mid, a.astype(np.int64), group)
    order_l = left.sort()
    lcp_l = left.neighbours(order_l)
    who, when = [], []
    cls = np.empty(n, np.int64)
    for t in range(int(c.min()), int(a.max()) + 1):
        on = (a >= t) & (c <= t)
        if not on.any():
            continue
        cls_r = np.empty(n, np.int64)
        cls_r[order_r] = np.cumsum(lcp_r < window - t)
        cls[order_l] = np.cumsum(lcp_l < t)
        sel = np.flatnonzero(on)
        both = cls_r[sel] * (n + 1) + cls[sel]
        order = np.argsort(both, kind="stable")
        v = both[order]
        same = v[1:] == v[:-1]
        dup = np.zeros(len(v), dtype=bool)
        dup[1:] |= same
        dup[:-1] |= same
        hit = sel[order[dup]]
        who.append(hit)
        when.append(np.full(len(hit), t, np.int64))
    if not who:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(who), np.concatenate(when)


def _runs(doc: np.ndarray, start: np.ndarray, window: int) -> pa.RecordBatch:
    """Byte spans of runs of consecutive window starts, sorted by (doc, start)."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(doc)])) - 1 if len(doc) else first
    return pa.record_batch([pa.array(doc[first]), pa.array(start[first]), pa.array(start[last] + window)],
                           names=["doc_id", "s", "e"])


def _sort_task(window: int, block: int = 1 << 20):
    """Rows come sorted by gram hash; whole groups are sorted together, about ``block`` bytes at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def solve(rows: pa.Table) -> pa.RecordBatch:
            h, doc, p, a, c = (rows.column(x).to_numpy().astype(np.int64) for x in ("h", "doc_id", "p", "a", "c"))
            own = rows.column("own").to_numpy(zero_copy_only=False).astype(bool)
            who, t = repeated_windows(rows.column("ctx").to_pylist(), h, a, c, window)
            mine = own[who]
            return _runs(doc[who[mine]], (p[who] - t)[mine], window)

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.nbytes
            if size < block:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            h = rows.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1], side="left"))
            if cut:
                yield solve(rows.slice(0, cut))
                rest = rows.slice(cut)
                held, size = rest.combine_chunks().to_batches(), rest.nbytes
        if held:
            yield solve(pa.Table.from_batches(held))
    return run


def _window_task(window: int):
    """Hot grams: two hashes of every window of a context."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            doc, p, a, c = (b.column(x).to_numpy().astype(np.int64) for x in ("doc_id", "p", "a", "c"))
            ctx = b.column("ctx").to_pylist()
            data = np.frombuffer(b"".join(ctx), dtype=np.uint8)
            length = np.array([len(x) for x in ctx], dtype=np.int64)
            at = np.cumsum(length) - length
            n = a - c + 1
            s = ragged_index(at, n)
            row = np.repeat(np.arange(len(n)), n)
            own = b.column("own").to_numpy(zero_copy_only=False).astype(bool)[row]
            yield pa.record_batch(
                [pa.array(PrefixHash(data).of(s, s + window).view(np.int64)),
                 pa.array(PrefixHash(data, BASE2).of(s, s + window).view(np.int64)),
                 pa.array(doc[row]), pa.array(p[row] - a[row] + s - at[row]), pa.array(own)],
                names=["w1", "w2", "doc_id", "start", "own"])
    return run


def repeated_spans(texts: DataFrame, window: int, gram: int, hot: int) -> DataFrame:
    """(doc_id, s, e) byte spans of repeated windows; spans of a text may touch or overlap."""
    anchors = materialize(texts.mapInArrow(_anchor_task(window, gram), ANCHORS), "sa-anchors")
    twice = anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    live = materialize(anchors.join(twice, "h", "left_semi"), "sa-live")
    hulls = materialize(
        live.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "p", "a", "c")).alias("one"))
        .select("h", "g", "n", "one.*"), "sa-hulls")
    whole = (live.join(hulls.where("n > 1").select("h", "g"), ["h", "g"], "left_semi")
             .select("doc_id", (F.col("p") - F.col("a")).alias("s"), (F.col("p") - F.col("c") + window).alias("e")))
    mixed = (hulls.groupBy("h").agg(F.count(F.lit(1)).alias("hulls"), F.min("n").alias("least"))
             .where("hulls > 1 AND least = 1").select("h", (F.col("hulls") > hot).alias("hot")))
    edges = materialize(hulls.join(mixed, "h").select("h", "doc_id", "p", "a", "c", (F.col("n") == 1).alias("own"), "hot"),
                        "sa-edges")
    wanted = edges.groupBy("doc_id").agg(F.collect_list(F.struct("h", "p", "a", "c", "own")).alias("want"))
    ids = edges.select("doc_id").distinct()
    near = texts.join(checked_broadcast(ids, ids.count(), 2_000_000), "doc_id", "left_semi")
    contexts = materialize(near.join(wanted, "doc_id").select("doc_id", "text", "want")
                           .mapInArrow(_context_task(window), CONTEXTS), "sa-contexts")
    hot_h = mixed.where("hot").select("h")
    n_hot = hot_h.count()
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cool = contexts.join(checked_broadcast(hot_h, n_hot, 100_000), "h", "left_anti") if n_hot else contexts
    spans = whole.unionByName(cool.repartition(parts, "h").sortWithinPartitions("h")
                              .mapInArrow(_sort_task(window), SPANS))
    if n_hot:
        warm = materialize(contexts.join(checked_broadcast(hot_h, n_hot, 100_000), "h", "left_semi").mapInArrow(
            _window_task(window), "w1 long, w2 long, doc_id long, start long, own boolean"), "sa-windows")
        common = warm.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2")
        spans = spans.unionByName(
            warm.where("own").join(materialize(common, "sa-common"), ["w1", "w2"], "left_semi")
            .select("doc_id", F.col("start").alias("s"), (F.col("start") + window).alias("e")))
    return spans


def _cut_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for k in range(b.num_rows):
            text = (b.column("text")[k].as_py() or "").encode()
            spans = b.column("spans")[k].values
            s, e = spans.field("s").to_numpy(), spans.field("e").to_numpy()
            order = np.argsort(s, kind="stable")
            s, e = s[order], np.maximum.accumulate(e[order])
            new = np.concatenate(([True], s[1:] > e[:-1]))  # touching spans are one run
            s, e = s[new], e[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(e) - 1]))]
            kept = bytearray()
            for x, y in zip([0, *e.tolist()], [*s.tolist(), len(text)]):
                kept += text[x:y]
            out.append((len(text), int((e - s).sum()), len(s), hashlib.sha256(kept).hexdigest(), bytes(kept)))
        cols = list(zip(*out)) or [[]] * 5
        yield pa.record_batch([b.column("doc_id"), pa.array(list(cols[0]), pa.int64()), pa.array(list(cols[1]), pa.int64()),
                               pa.array(list(cols[2]), pa.int64()), pa.array(list(cols[3]), pa.string()),
                               pa.array(list(cols[4]), pa.binary())],
                              names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(df: DataFrame, id_col: str, text_col: str, window: int = 200, gram: int = 60,
                   hot: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary) for every row of ``df``.

    Ids must be unique.
    """
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spans = materialize(repeated_spans(texts.where("doc_id IS NOT NULL"), window, gram, hot)
                        .groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "sa-spans")
    ids = spans.select("doc_id")
    few = checked_broadcast(ids, ids.count(), 2_000_000)
    cut = (texts.join(few, "doc_id", "left_semi").join(spans, "doc_id").select("doc_id", "text", "spans")
           .mapInArrow(_cut_task, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"))
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rest = texts.join(few, "doc_id", "left_anti").select(
        "doc_id", F.octet_length(raw).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256"), raw.alias("kept"))
    return cut.unionByName(rest)
