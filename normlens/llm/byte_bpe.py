"""Byte-level BPE by corpus-level merge replay.

Texts are split by the pre-token pattern; the distinct pre-tokens ("words") of
a block of texts are encoded together.  An inverted index maps the rank of a
mergeable pair to the symbol positions where it stands; ranks are taken from a
heap in order, each is applied to all its positions at once, and only the two
neighbours of every merged symbol are looked up and indexed again.

A block is a bounded slice of a partition (``block_chars``), so a task needs
no shuffle, holds a bounded index, and can be run again anywhere; a word's ids
depend on the word alone, so results are the same for any block layout.

Defined cases: a null text is empty (no ids, digests of the empty string);
repeated rows are encoded alike; an empty table gives no rows; only the id and
text columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normlens.llm.common import ragged_index

NO_RANK = np.int64(1 << 40)
BLOCK_CHARS = 3_000_000


class MergeTable:
    """Rank file as arrays: byte -> id, (left id, right id) -> rank, id -> bytes."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for t, r in self.ranks.items():
            tokens[r] = t
        self.tokens = tokens
        self.base = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.token_len = np.array([len(t) for t in tokens], dtype=np.int64)
        self.token_start = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        keys, vals = [], []
        for t, r in self.ranks.items():
            for cut in range(1, len(t)):
                left, right = self.ranks.get(t[:cut]), self.ranks.get(t[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    vals.append(r)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.vals = np.array(vals, dtype=np.int64)[order]

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.vals[at], NO_RANK)


@lru_cache(maxsize=4)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


@lru_cache(maxsize=4)
def splitter(pattern: str):
    return regex.compile(pattern)


def _leftmost(pos: np.ndarray, prv: np.ndarray, flag: np.ndarray) -> np.ndarray:
    """Of overlapping occurrences (each sharing a symbol with the next) every other one, from the left."""
    flag[pos] = True
    before = prv[pos]
    chained = (before >= 0) & flag[before]
    flag[pos] = False
    if not chained.any():
        return pos
    taken, last = [], -2
    for p, b in zip(pos.tolist(), before.tolist()):
        if b != last:
            taken.append(p)
            last = p
    return np.array(taken, dtype=np.int64)


def replay(words: list[bytes], table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in one array, and the number of ids of each word."""
    whole = np.array([table.ranks.get(w, -1) for w in words], dtype=np.int64)
    lens = np.array([len(w) for w in words], dtype=np.int64)
    todo = np.flatnonzero((whole < 0) & (lens > 0))
    raw = np.frombuffer(b"".join([words[i] for i in todo.tolist()]), dtype=np.uint8)
    n = len(raw)
    sym = table.base[raw]
    part_end = np.cumsum(lens[todo])
    nxt = np.arange(1, n + 1, dtype=np.int64)
    prv = np.arange(-1, n - 1, dtype=np.int64)
    if n:
        nxt[part_end - 1] = -1
        prv[(part_end - lens[todo])] = -1
    rank = np.full(n, NO_RANK)
    live = np.ones(n, dtype=bool)
    flag = np.zeros(n + 1, dtype=bool)
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def put(pos: np.ndarray) -> None:
        r = rank[pos]
        pos, r = pos[r < NO_RANK], r[r < NO_RANK]
        if not len(pos):
            return
        order = np.argsort(r, kind="stable")
        pos, r = pos[order], r[order]
        cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
        for k, group in zip(r[np.concatenate(([0], cuts))].tolist(), np.split(pos, cuts)):
            if k in index:
                index[k].append(group)
            else:
                index[k] = [group]
                heapq.heappush(heap, k)

    first = np.flatnonzero(nxt >= 0)
    rank[first] = table.pair_rank(sym[first], sym[nxt[first]])
    put(first)
    while heap:
        r = heapq.heappop(heap)
        groups = index.pop(r)
        pos = np.unique(np.concatenate(groups)) if len(groups) > 1 else groups[0]
        pos = pos[live[pos] & (rank[pos] == r)]
        if not len(pos):
            continue
        pos = _leftmost(pos, prv, flag)
        gone = nxt[pos]
        after = nxt[gone]
        sym[pos] = r
        live[gone] = False
        rank[gone] = NO_RANK
        nxt[pos] = after
        prv[after[after >= 0]] = pos[after >= 0]
        left = prv[pos]
        touched = np.concatenate((pos, left[left >= 0]))
        has = nxt[touched] >= 0
        rank[touched[~has]] = NO_RANK
        touched = touched[has]
        rank[touched] = table.pair_rank(sym[touched], sym[nxt[touched]])
        put(touched)
    counts = np.where(lens > 0, 1, 0)
    word_of = np.repeat(todo, lens[todo])
    counts[todo] = np.bincount(word_of[live], minlength=len(words))[todo] if n else 0
    ids = np.empty(int(counts.sum()), dtype=np.int64)
    start = np.cumsum(counts) - counts
    single = np.flatnonzero(whole >= 0)
    ids[start[single]] = whole[single]
    ids[ragged_index(start[todo], counts[todo])] = sym[live]
    return ids, counts


class _Numbering(dict):
    """Gives each new key the next number."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def encode_texts(texts: list[str], table: MergeTable, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and the number of ids of each text."""
    split, seen = splitter(pattern).findall, _Numbering()
    number = seen.__getitem__
    occ, per_text = [], np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        words = split(t)
        occ.append(np.fromiter(map(number, words), np.int64, len(words)))
        per_text[i] = len(words)
    ids, counts = replay([w.encode() for w in seen], table)
    at = np.concatenate(occ) if occ else np.zeros(0, np.int64)
    start = np.cumsum(counts) - counts
    flat = ids[ragged_index(start[at], counts[at])]
    ends = np.concatenate(([0], np.cumsum(counts[at])))
    bounds = ends[np.concatenate(([0], np.cumsum(per_text)))]
    return flat, np.diff(bounds)


def decode_ids(ids: np.ndarray, table: MergeTable) -> bytes:
    return table.token_bytes[ragged_index(table.token_start[ids], table.token_len[ids])].tobytes()


def _blocks(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    i, size = 0, 0
    for j, t in enumerate(texts):
        if j > i and size + len(t) > limit:
            yield i, j
            i, size = j, 0
        size += len(t)
    if i < len(texts):
        yield i, len(texts)


def _encoder(path: str, pattern: str, block_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = merge_table(path)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for i, j in _blocks(texts, block_chars):
                ids, counts = encode_texts(texts[i:j], table, pattern)
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                yield pa.record_batch(
                    [b.column("id").slice(i, j - i),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))],
                    names=["id", "ids"])
    return run


def encode(df: DataFrame, id_col: str, text_col: str, path: str, pattern: str,
           block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, ids array<int>) for every row of ``df``."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encoder(path, pattern, block_chars), "id long, ids array<int>")


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = merge_table(path)
        for b in batches:
            out = [decode_ids(np.asarray(x.values, dtype=np.int64), table) for x in b.column("ids")]
            yield pa.record_batch([b.column("id"), pa.array(out, pa.binary())], names=["id", "data"])
    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(id, data binary): the bytes that the ids of each row stand for."""
    return encoded.select("id", "ids").mapInArrow(_decoder(path), "id long, data binary")


def _digester(path: str, pattern: str, block_chars: int, with_ids: bool):
    """Encode, digest the ids, decode them again and digest the bytes, block by block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = merge_table(path)
        for b in _encoder(path, pattern, block_chars)(batches):
            lists = b.column("ids")
            flat = np.asarray(lists.values, dtype=np.int64)
            off = np.asarray(lists.offsets, dtype=np.int64)
            data = memoryview(decode_ids(flat, table))
            size = np.concatenate(([0], np.cumsum(table.token_len[flat])))[off]
            le = memoryview(flat.astype("<u4").tobytes())
            out = pa.record_batch(
                [b.column("id"), pa.array(np.diff(off)),
                 pa.array([hashlib.sha256(le[4 * x:4 * y]).hexdigest() for x, y in zip(off[:-1], off[1:])], pa.string()),
                 pa.array([hashlib.sha256(data[x:y]).hexdigest() for x, y in zip(size[:-1], size[1:])], pa.string())],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])
            if with_ids:
                out = out.append_column("ids", lists)
            yield out
    return run


def round_trip_digests(df: DataFrame, id_col: str, text_col: str, path: str, pattern: str,
                       block_chars: int = BLOCK_CHARS, with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids]): encode, then decode the ids, in one pass."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(_digester(path, pattern, block_chars, with_ids), schema)
