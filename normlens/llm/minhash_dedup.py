"""Near-duplicate documents by MinHash: minima of odd multiples, banding, verification, star components.

Words are runs of bytes other than ASCII white space, A-Z lowered.  A text's
set holds its distinct ``words``-word shingles (64-bit hashes); a text with
fewer words has its whole word sequence as the only member.  Texts with equal
sets are one class, represented by the smallest id.  Each class gets
``bands`` * ``rows`` minima of 32 bits of its hashes times random odd numbers; classes that
agree on a band share a bucket.  Candidates are verified on the full sets
(linking.py) and components are found by alternating large-star and small-star.

At a similarity of 0.8, 32 bands of 4 miss a pair with probability 5e-8.

Defined cases: null, empty and white-space-only texts have empty sets and link
with nothing; repeated rows form one class; an empty table gives no rows; only
the two named columns are read.  Ids must be unique and not null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normlens.llm.common import byte_blocks, checked_broadcast, component_ids, materialize, mix64
from normlens.llm.linking import anchored, link
from normlens.llm.suffix_dedup import PrefixHash

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
CHAIN = np.uint64(0x9FB21C651E98DF25)
BAND_RUN = 1 << 16  # shingles
SIGNED = "id long, n long, d1 long, d2 long, keys binary"


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a block of texts, and the number of words of each text."""
    space = SPACE[data]
    starts, ends = ~space, ~space
    starts[1:] &= space[:-1]
    ends[:-1] &= space[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]  # texts end words too
    starts[edge] |= ~space[edge]
    ends[edge - 1] |= ~space[edge - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    per_text = np.diff(np.searchsorted(s, off))
    return PrefixHash(LOWER[data]).of(s, e), per_text


def shingle_sets(data: np.ndarray, off: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text of a block."""
    w, count = word_hashes(data, off)
    end = np.cumsum(count)
    m = len(w) - words + 1
    run = np.zeros(max(m, 0), dtype=np.uint64)
    for k in range(words):
        if m > 0:
            run = mix64(run * CHAIN + w[k:k + m])
    run = mix64(run + np.uint64(words))
    out = []
    for n, e in zip(count.tolist(), end.tolist()):
        if n >= words:
            out.append(np.unique(run[e - n:e - words + 1]))
        elif n:
            h = np.zeros(1, np.uint64)
            for x in w[e - n:e]:
                h = mix64(h * CHAIN + x)
            out.append(mix64(h + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def universal(count: int, seed: int) -> np.ndarray:
    """Odd factors: shingle hashes are mixed before, so a product by an odd number orders them anew."""
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(flat: np.ndarray, start: np.ndarray, bands: int, rows: int, seed: int) -> np.ndarray:
    """Keys of the bands of every set; sets stand one after another in ``flat``, none empty: shape (sets, bands)."""
    mul = universal(bands * rows, seed).astype(np.uint32)
    low = np.empty((bands * rows, len(start)), np.uint32)
    run = np.flatnonzero(np.diff(start // BAND_RUN, prepend=-1)).tolist()  # runs of sets that stay in the cache
    for i, j in zip(run, [*run[1:], len(start)]):
        part = (flat[start[i]:start[j] if j < len(start) else len(flat)] >> np.uint64(32)).astype(np.uint32)
        at, hashed = start[i:j] - start[i], np.empty_like(part)
        for k in range(bands * rows):
            np.multiply(part, mul[k], out=hashed)
            np.minimum.reduceat(hashed, at, out=low[k, i:j])
    keys = np.zeros((len(start), bands), dtype=np.uint64)
    for k in range(bands * rows):
        keys[:, k // rows] = mix64(keys[:, k // rows] * CHAIN + low[k] + np.uint64(k // rows))
    return keys


def _sign_task(words: int, bands: int, rows: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in byte_blocks(b, "text", 1 << 20):
                sets = shingle_sets(data, off, words)
                n = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(n)
                digest = np.zeros((len(sets), 2), dtype=np.int64)
                for k in full.tolist():
                    digest[k] = np.frombuffer(hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest(), np.int64)
                start = (np.cumsum(n) - n)[full]
                keys = band_keys(np.concatenate(sets), start, bands, rows, seed) if len(full) else np.zeros((0, bands))
                offsets = np.concatenate(([0], np.cumsum(np.where(n > 0, 8 * bands, 0)))).astype(np.int32)
                yield pa.record_batch(
                    [b.column("id").slice(i, j - i), pa.array(n), pa.array(digest[:, 0]), pa.array(digest[:, 1]),
                     pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets),
                                                                 pa.py_buffer(keys.astype(np.uint64).tobytes())])],
                    names=["id", "n", "d1", "d2", "keys"])
    return run


def _set_task(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in byte_blocks(b, "text", 1 << 20):
                sets = shingle_sets(data, off, words)
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                yield pa.record_batch([b.column("id").slice(i, j - i),
                                       pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))],
                                      names=["id", "items"])
    return run


def near_duplicates(df: DataFrame, id_col: str, text_col: str, words: int = 5, num: int = 80, den: int = 100,
                    bands: int = 32, rows: int = 4, seed: int = 7) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row; links need den * inter >= num * union."""
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = materialize(texts.mapInArrow(_sign_task(words, bands, rows, seed), SIGNED), "mh-signed")
    classes = (signed.where("n > 0").groupBy("d1", "d2")
               .agg(F.min(F.struct("id", "n", "keys")).alias("r"), F.count(F.lit(1)).alias("copies")))
    classes = materialize(classes.select("d1", "d2", "copies", "r.*"), "mh-classes")
    members = anchored(classes.select("id", "keys"), bands, "mh")
    wanted = members.select("id").distinct()
    wanted = checked_broadcast(wanted, wanted.count(), 2_000_000)
    sets = materialize(texts.join(wanted, "id", "left_semi").mapInArrow(_set_task(words), "id long, items array<long>")
                       .select("id", F.size("items").alias("n"), "items"), "mh-sets")
    _, comps = link(members, sets, num, den, "mh")
    # a class is known by its smallest id; copies follow their representative
    of_class = component_ids(classes.where("copies > 1").select("d1", "d2", F.col("id").alias("rep")), "rep", comps)
    copies = (signed.select("id", "d1", "d2", "n").where("n > 0")
              .join(of_class.select("d1", "d2", F.col("component_id").alias("of_copy")), ["d1", "d2"], "left"))
    rows_ = copies.select("id", "n", "of_copy").unionByName(
        signed.where("n = 0").select("id", "n", F.lit(None).cast("long").alias("of_copy")))
    out = component_ids(rows_, "id", comps)
    comp = F.coalesce("of_copy", "component_id")
    return out.select("id", F.col("n").alias("n_shingles"), comp.alias("component_id"), (F.col("id") == comp).alias("kept"))

