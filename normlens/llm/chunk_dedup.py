"""Repeated passages by content-defined chunking.

A gear rolling hash (each byte's random word, shifted once per step) cuts a
text where its top ``bits`` bits are zero, at least ``least`` bytes after the
last cut and at most ``most``.  Cuts depend on the last 32 bytes only, so they
fall back in step after an insertion.  Chunks are compared by a 96-bit digest
(BLAKE2b; 64 bits select, all 96 decide) over all texts; a chunk seen before, in order of (id, position), is a
repeat.  A run of chunks that all occur elsewhere, each next to the one before it
in some other place too, is a repeated passage when it is at least ``min_run``
bytes long; shorter runs, and stock phrases that stand in a row only once, are
chance and stay.  Neighbours are compared by 64 bits of both digests.  Of a
passage the first occurrence of each chunk stays.

Defined cases: a null text is empty; an empty table gives no rows; repeated
rows lose all but the first; short texts are one chunk; ids must be unique;
only the two named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normlens.llm.common import byte_blocks, checked_broadcast, materialize

GEAR = np.random.default_rng(20240607).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """Rolling hash at every byte: sum of gear[b] << age over the last 32 bytes, by doubling."""
    h = GEAR[data]
    step = 1
    while step < 32:
        add = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += add
        step *= 2
    return h


def cut_points(data: np.ndarray, bits: int, least: int, most: int) -> list[int]:
    """Ends of the chunks of one text."""
    n = len(data)
    if not n:
        return []
    hits = np.flatnonzero(gear_hash(data) >> np.uint32(32 - bits) == 0) + 1
    out, last = [], 0
    for x in hits.tolist():
        while x - last > most:
            last += most
            out.append(last)
        if x - last >= least:
            out.append(x)
            last = x
    while n - last > most:
        last += most
        out.append(last)
    if last < n:
        out.append(n)
    return out


def _chunk_task(bits: int, least: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for i, _, data, off in byte_blocks(b, "text"):
                doc, pos, size, digest = [], [], [], bytearray()
                raw = data.tobytes()
                for k in range(len(off) - 1):
                    ends = cut_points(data[off[k]:off[k + 1]], bits, least, most)
                    if not ends:
                        continue
                    starts = [0, *ends[:-1]]
                    doc.append(np.full(len(ends), ids[i + k], np.int64))
                    pos.append(np.array(starts, np.int64))
                    size.append(np.diff(np.array([0, *ends], np.int64)))
                    base = int(off[k])
                    for x, y in zip(starts, ends):
                        digest += hashlib.blake2b(raw[base + x:base + y], digest_size=12).digest()
                if doc:
                    d = np.frombuffer(bytes(digest), np.dtype([("d1", "<i8"), ("d2", "<i4")]))
                    yield pa.record_batch([pa.array(np.concatenate(doc)), pa.array(np.concatenate(pos).astype(np.int32)),
                                           pa.array(np.concatenate(size).astype(np.int32)),
                                           pa.array(d["d1"].copy()), pa.array(d["d2"].copy())],
                                          names=["doc_id", "pos", "len", "d1", "d2"])
    return run


def _pair_task(min_run: int):
    """Neighbouring repeated chunks; ``long`` where their whole run has ``min_run`` bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(ids)), b.column("chunks").value_lengths().to_numpy(zero_copy_only=False))
            rep = b.column("chunks").flatten()
            pos, size, d1 = (rep.field(x).to_numpy(zero_copy_only=False) for x in ("pos", "len", "d1"))
            order = np.lexsort((pos, row))
            row, pos, size, d1 = row[order], pos[order], size[order], d1[order]
            meets = (row[1:] == row[:-1]) & (pos[1:] == pos[:-1] + size[:-1])
            run_id = np.concatenate(([0], np.cumsum(~meets)))[:len(row)]
            total = np.bincount(run_id, weights=size)
            k = np.flatnonzero(meets) + 1
            yield pa.record_batch([pa.array(ids[row[k]]), pa.array(pos[k]), pa.array(d1[k - 1]), pa.array(d1[k]),
                                   pa.array(total[run_id[k]] >= min_run)], names=["doc_id", "pos", "a", "b", "long"])
    return run


def _cut_task(min_run: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k in range(b.num_rows):
                text = (b.column("text")[k].as_py() or "").encode()
                rep = b.column("chunks")[k].values
                pos, size, later = (rep.field(x).to_numpy(zero_copy_only=False) for x in ("pos", "len", "later"))
                order = np.argsort(pos, kind="stable")
                pos, size, later = pos[order].astype(np.int64), size[order].astype(np.int64), later[order].astype(bool)
                new = np.concatenate(([True], pos[1:] != pos[:-1] + size[:-1]))
                new |= np.isin(pos, b.column("breaks")[k].as_py() or [])
                run_id = np.cumsum(new) - 1
                total = np.bincount(run_id, weights=size).astype(np.int64)
                passage = total[run_id] >= min_run
                drop = passage & later
                spans, kept, at = 0, bytearray(), 0
                last = -1
                for x, n in zip(pos[drop].tolist(), size[drop].tolist()):
                    spans += x != last
                    kept += text[at:x]
                    at = last = x + n
                kept += text[at:]
                out.append((len(text), int(size[passage].sum()), int(size[drop].sum()), spans,
                            int(np.unique(run_id[passage]).size), hashlib.sha256(kept).hexdigest(), bytes(kept)))
            cols = list(zip(*out)) or [[]] * 7
            longs = [pa.array(list(c), pa.int64()) for c in cols[:5]]
            yield pa.record_batch([b.column("doc_id"), *longs, pa.array(list(cols[5]), pa.string()),
                                   pa.array(list(cols[6]), pa.binary())],
                                  names=["doc_id", "n_bytes", "n_repeated", "n_removed", "n_spans", "n_passages",
                                         "kept_sha256", "kept"])
    return run


def remove_repeated_chunks(df: DataFrame, id_col: str, text_col: str, bits: int = 4, least: int = 8,
                           most: int = 256, min_run: int = 100) -> DataFrame:
    """One row per text: bytes in repeated passages, bytes removed (later occurrences), what is kept.

    (doc_id, n_bytes, n_repeated, n_removed, n_spans, n_passages, kept_sha256, kept binary)
    """
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chunks = materialize(texts.mapInArrow(_chunk_task(bits, least, most),
                                          "doc_id long, pos int, len int, d1 long, d2 int"), "cdc-chunks")
    # stored, so that the joins can split the rows of a very common chunk
    twice = materialize(chunks.groupBy("d1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("d1"), "cdc-twice")
    live = materialize(chunks.join(twice, "d1", "left_semi"), "cdc-live")
    common = materialize(live.groupBy("d1", "d2")
                         .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "pos")).alias("first"))
                         .where("n > 1").select("d1", "d2", "first"), "cdc-common")
    repeated = (live.join(common, ["d1", "d2"])
                .select("doc_id", "pos", "len", (F.struct("doc_id", "pos") > F.col("first")).alias("later"), "d1"))
    lists = materialize(repeated.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "len", "later", "d1")).alias("chunks"),
                                                       F.sum("len").alias("bytes")), "cdc-repeats")
    # a pair of neighbours that stands in one place only breaks the run there
    once = (lists.select("doc_id", "chunks").mapInArrow(_pair_task(min_run), "doc_id long, pos int, a long, b long, long boolean")
            .groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"), F.min("pos").alias("pos"),
                                   F.max("long").alias("long")).where("n = 1 AND long"))
    breaks = materialize(once.groupBy("doc_id").agg(F.collect_list("pos").alias("breaks")), "cdc-breaks")
    long = lists.where(F.col("bytes") >= min_run)
    per_text = long.select("doc_id", "chunks").join(breaks, "doc_id", "left")
    ids = long.select("doc_id")
    few = checked_broadcast(ids, ids.count(), 2_000_000)
    cut = (texts.join(few, "doc_id", "left_semi").join(per_text, "doc_id").select("doc_id", "text", "chunks", "breaks")
           .mapInArrow(_cut_task(min_run), "doc_id long, n_bytes long, n_repeated long, n_removed long, n_spans long, "
                                           "n_passages long, kept_sha256 string, kept binary"))
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    zero = F.lit(0).cast("long")
    rest = texts.join(few, "doc_id", "left_anti").select(
        "doc_id", F.octet_length(raw).cast("long").alias("n_bytes"), zero.alias("n_repeated"), zero.alias("n_removed"),
        zero.alias("n_spans"), zero.alias("n_passages"), F.sha2(raw, 256).alias("kept_sha256"), raw.alias("kept"))
    return cut.unionByName(rest)
