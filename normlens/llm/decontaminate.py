"""Benchmark decontamination by greedy string tiling.

Tokens are runs of ASCII letters and digits, underscores and non-ASCII bytes,
A-Z lowered.  A document and a benchmark item that share a run of ``least``
tokens (found by Karp-Rabin hashes of all runs) are tiled: the longest common
run of unmarked tokens is marked on both sides, again and again, until no run
of ``least`` tokens is left.  Tiles may lie in any order, so passages whose
sentences were moved about are found too.  The share of an item's tokens under
tiles is its coverage; a document that covers ``threshold`` of an item or more
is contaminated by it.

The benchmark is taken in blocks of at most ``block_tokens`` tokens; each block
is held by all tasks while every document passes by once, so its size, not the
benchmark's, bounds memory.

Defined cases: a null or empty document matches nothing; an item without
tokens never matches; an item shorter than ``least`` tokens must occur whole;
repeated items each count; repeated documents get equal results; empty tables
give no matches; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normlens.llm.common import byte_blocks, mix64
from normlens.llm.minhash_dedup import LOWER
from normlens.llm.suffix_dedup import PrefixHash

WORD = np.zeros(256, dtype=bool)
WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), 0x5F, *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
CHAIN = np.uint64(0x9FB21C651E98DF25)
PAIRS = "doc_id long, item_id long, covered long, item_tokens long, coverage double"


def token_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token of a block of texts, and the offsets of the texts in it."""
    word = WORD[data]
    starts, ends = word.copy(), word.copy()
    starts[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    starts[edge] |= word[edge]
    ends[edge - 1] |= word[edge - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return PrefixHash(LOWER[data]).of(s, e), np.searchsorted(s, off)


def run_hashes(tokens: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin style hash of every run of ``length`` tokens."""
    m = len(tokens) - length + 1
    out = np.zeros(max(m, 0), dtype=np.uint64)
    for k in range(length):
        if m > 0:
            out = mix64(out * CHAIN + tokens[k:k + m])
    return out


def tile(doc: np.ndarray, item: np.ndarray, starts: list[tuple[int, int]], least: int) -> int:
    """Item tokens under tiles; ``starts`` are the (doc, item) positions of common runs of ``least`` tokens."""
    free_d, free_i = np.ones(len(doc), bool), np.ones(len(item), bool)
    n, m = len(doc), len(item)

    def reach(i: int, j: int) -> int:
        k = 0
        while i + k < n and j + k < m and free_d[i + k] and free_i[j + k] and doc[i + k] == item[j + k]:
            k += 1
        return k

    known = set(starts)
    heads = [p for p in starts if (p[0] - 1, p[1] - 1) not in known]  # runs start here; inner starts lie in them
    by_length: dict[int, list[tuple[int, int]]] = {}
    for p in heads:
        by_length.setdefault(reach(*p), []).append(p)
    covered = 0
    while by_length:
        length = max(by_length)
        for i, j in sorted(by_length.pop(length)):
            k = reach(i, j)
            if k == length:
                if k >= least:
                    free_d[i:i + k] = False
                    free_i[j:j + k] = False
                    covered += k
                continue
            if k >= least:
                by_length.setdefault(k, []).append((i, j))
            # the rest of the run, past what was marked meanwhile
            at = k
            while at < length and not (free_d[i + at] and free_i[j + at]):
                at += 1
            if length - at >= least:
                by_length.setdefault(reach(i + at, j + at), []).append((i + at, j + at))
    return covered


class Benchmark:
    """A block of items: token arrays and an index of their runs."""

    def __init__(self, ids: list[int], tokens: list[np.ndarray], least: int):
        keep = [k for k, t in enumerate(tokens) if len(t)]
        self.ids, self.tokens, self.least = [ids[k] for k in keep], [tokens[k] for k in keep], least
        self.index: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in sorted({min(least, len(t)) for t in self.tokens}):
            rows = [(run_hashes(t, length), k) for k, t in enumerate(self.tokens) if min(least, len(t)) == length]
            h = np.concatenate([r for r, _ in rows])
            item = np.concatenate([np.full(len(r), k) for r, k in rows])
            pos = np.concatenate([np.arange(len(r)) for r, _ in rows])
            order = np.argsort(h, kind="stable")
            self.index[length] = (h[order], item[order], pos[order])

    def matches(self, doc: np.ndarray, runs: dict[int, np.ndarray]) -> Iterator[tuple[int, int, int]]:
        """(item number, covered tokens, item tokens) of every item that shares a run with ``doc``."""
        found: dict[int, list[tuple[int, int]]] = {}
        for length, (h, item, pos) in self.index.items():
            own = runs[length]
            lo = np.searchsorted(h, own, side="left")
            hits = np.flatnonzero((lo < len(h)) & (h[np.minimum(lo, len(h) - 1)] == own))
            for i in hits.tolist():
                k = int(lo[i])
                while k < len(h) and h[k] == own[i]:
                    found.setdefault(int(item[k]), []).append((i, int(pos[k])))
                    k += 1
        for k, starts in found.items():
            t = self.tokens[k]
            yield k, tile(doc, t, starts, min(self.least, len(t))), len(t)


def _match_task(held, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_, tokens_ = held.value
        bench = Benchmark(ids_, tokens_, least)
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            out: list[tuple] = []
            for i, j, data, off in byte_blocks(b, "text", 1 << 20):
                tokens, at = token_hashes(data, off)
                runs = {n: run_hashes(tokens, n) for n in bench.index}
                any_hit = np.zeros(len(tokens) + 1, bool)
                for n, r in runs.items():
                    any_hit[:len(r)] |= np.isin(r, bench.index[n][0])
                hits = np.flatnonzero(any_hit)
                texts = np.unique(np.searchsorted(at, hits, side="right") - 1)
                for k in texts[texts < j - i].tolist():
                    s, e = int(at[k]), int(at[k + 1])
                    own = {n: r[s:max(s, e - n + 1)] for n, r in runs.items()}
                    for item, covered, size in bench.matches(tokens[s:e], own):
                        out.append((ids[i + k], bench.ids[item], covered, size, covered / size))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.record_batch([pa.array(list(c), pa.int64()) for c in cols[:4]] + [pa.array(list(cols[4]), pa.float64())],
                                  names=["doc_id", "item_id", "covered", "item_tokens", "coverage"])
    return run


def _token_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, data, off in byte_blocks(b, "text"):
            tokens, at = token_hashes(data, off)
            yield pa.record_batch([b.column("item_id").slice(i, j - i),
                                   pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(tokens.view(np.int64)))],
                                  names=["item_id", "tokens"])


def _blocks(items: DataFrame, block_tokens: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Items streamed to the driver, one block held at a time."""
    ids, tokens, size = [], [], 0
    for r in items.toLocalIterator():
        t = np.array(r["tokens"], dtype=np.int64).view(np.uint64)
        if ids and size + len(t) > block_tokens:
            yield ids, tokens
            ids, tokens, size = [], [], 0
        ids.append(r["item_id"])
        tokens.append(t)
        size += len(t)
    if ids:
        yield ids, tokens


def matches(docs: DataFrame, id_col: str, text_col: str, benchmark: DataFrame, item_col: str, item_text_col: str,
            least: int = 5, block_tokens: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, covered, item_tokens, coverage) of every pair that shares a run of ``least`` tokens."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    items = (benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
             .mapInArrow(_token_task, "item_id long, tokens array<long>"))
    out = spark.createDataFrame([], PAIRS)
    for block in _blocks(items, block_tokens):
        out = out.unionByName(texts.mapInArrow(_match_task(spark.sparkContext.broadcast(block), least), PAIRS))
    return out


def contaminated(pairs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(doc_id, n_items, items, max_coverage) of documents that cover an item by ``threshold`` or more."""
    return (pairs.where(F.col("coverage") >= threshold).groupBy("doc_id")
            .agg(F.count(F.lit(1)).alias("n_items"), F.sort_array(F.collect_list("item_id")).alias("items"),
                 F.max("coverage").alias("max_coverage")))
