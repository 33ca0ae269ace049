"""From hash buckets to verified links, without all pairs of a bucket.

Every member of a bucket is verified against the bucket's most central member
(one candidate a member).  The verified links already join almost all of a
group of copies.  Only buckets whose members then lie in several components
need more.  There, members outside the bucket's largest component meet some of
its members in rounds, then all members of other components that an exact bound
allows.  The bound comes from parity sketches: bit j says whether the set has an
odd number of elements of hash j, so the bits in which two sketches differ are at most the
elements in which the sets differ.  In the end two members of a bucket are
connected by verified links or known to be unlike: nothing is capped or sampled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normlens.llm.common import BLOCK_BYTES, checked_broadcast, local_forest, materialize, merged_components, star_components

PARITY_BITS = 4096
DEALT = 1024  # pairs (key, id) in a row at most, so that a batch of rows stays small
FOLD_PAIRS = 1_000_000
SIZED = "a long, b long, inter long, total long"


def stored_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sets kept as sorted lists of hashes: (flat values, offsets)."""
    return np.asarray(column.values), np.asarray(column.offsets)


def _bounded(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in runs whose kept sets take about ``BLOCK_BYTES``, one row at least.

    A set kept as text is decoded to eight times its size and more, and a batch holds rows of any length.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.zeros(batch.num_rows, np.int64)
        for c in columns:
            lists = pa.types.is_list(batch.schema.field(c).type)
            n = pc.list_value_length(batch.column(c)) if lists else pc.binary_length(batch.column(c))
            size += n.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) * (8 if lists else 1)
        run = np.cumsum(size) // BLOCK_BYTES
        edge = np.concatenate(([0], np.flatnonzero(np.diff(run)) + 1, [batch.num_rows]))
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
            yield batch.slice(i, j - i)


def _verify_task(decode):
    """Sizes of intersection and union of two sorted sets of 64-bit hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _bounded(batches, "sa", "sb"):
            (va, oa), (vb, ob) = decode(batch.column("sa")), decode(batch.column("sb"))
            inter = np.empty(batch.num_rows, np.int64)
            for k in range(batch.num_rows):
                x = np.concatenate((va[oa[k]:oa[k + 1]], vb[ob[k]:ob[k + 1]]))
                x.sort(kind="stable")
                inter[k] = np.count_nonzero(x[1:] == x[:-1])
            total = np.diff(oa) + np.diff(ob) - inter
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(inter), pa.array(total.astype(np.int64))],
                                  names=["a", "b", "inter", "total"])
    return run


def _parity_task(decode):
    """PARITY_BITS bits of every set, packed into 64-bit words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = PARITY_BITS // 64
        for batch in _bounded(batches, "items"):
            values, off = decode(batch.column("items"))
            low = (values.view(np.int64) & (PARITY_BITS - 1))
            out = np.zeros((batch.num_rows, words), np.int64)
            for k in range(batch.num_rows):
                odd = np.bincount(low[off[k]:off[k + 1]], minlength=PARITY_BITS) & 1
                out[k] = np.packbits(odd.astype(np.uint8)).view(np.int64)
            bounds = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * words)
            yield pa.record_batch([batch.column("id"), pa.ListArray.from_arrays(bounds, pa.array(out.ravel()))],
                                  names=["id", "par"])
    return run


def set_verifier(sets: DataFrame, decode) -> Callable[[DataFrame], DataFrame]:
    """Verifier over stored sets (id, items)."""
    def run(pairs: DataFrame) -> DataFrame:
        half = pairs.join(sets.select(F.col("id").alias("b"), F.col("items").alias("sb")), "b")
        full = half.join(sets.select(F.col("id").alias("a"), F.col("items").alias("sa")), "a")
        return full.select("a", "b", "sa", "sb").mapInArrow(_verify_task(decode), SIZED)
    return run


def _deal_task(slots: int):
    """Pairs (key, id) of a batch by key, many to a row: slot, then keys and ids one after another."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            b = b.take(pa.array(np.unique(b.column("id").to_numpy(), return_index=True)[1]))  # one id, one list of keys
            each = pc.binary_length(b.column("keys")).to_numpy() // 8
            key = np.frombuffer(b"".join(b.column("keys").to_pylist()), np.int64)
            ids = np.repeat(b.column("id").to_numpy(), each)
            slot = (key.view(np.uint64) % np.uint64(slots)).astype(np.int32)
            order = np.argsort(slot, kind="stable")
            key, ids, slot = key[order], ids[order], slot[order]
            edge = np.flatnonzero(np.diff(slot, prepend=-1))
            edge = np.concatenate([np.arange(x, y, DEALT) for x, y in zip(edge, [*edge[1:], len(slot)])] + [[len(slot)]])
            edge = edge.astype(np.int64)
            yield pa.record_batch([pa.array(slot[edge[:-1]]), pa.array(
                [key[x:y].tobytes() + ids[x:y].tobytes() for x, y in zip(edge[:-1].tolist(), edge[1:].tolist())], pa.binary())],
                names=["slot", "pairs"])
    return run


def _shared_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (key, id) of keys with two or more ids; what is kept meanwhile is one id of every key."""
    known, first, told = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def folded(parts):
        nonlocal known, first, told
        key = np.concatenate((known, *(p[:len(p) // 2] for p in parts)))
        ids = np.concatenate((first, *(p[len(p) // 2:] for p in parts)))
        order = np.argsort(key, kind="stable")
        key, ids = key[order], ids[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        start = np.flatnonzero(new)
        size = np.diff(start, append=len(key))
        old = order < len(known)  # stable: the id kept so far stands first
        said = np.zeros(len(key), bool)
        said[old] = told[order[old]]
        other = ids != np.repeat(ids[start], size)
        now = np.maximum.reduceat(other, start) & ~said[start]
        known, first, told = key[start], ids[start], said[start] | now
        out = np.concatenate((start[now], np.flatnonzero(other)))
        return pa.record_batch([pa.array(key[out]), pa.array(ids[out])], names=["key", "id"])

    parts, waiting = [], 0
    for b in batches:
        for x in b.column("pairs"):
            parts.append(np.frombuffer(x.as_buffer(), np.int64))
            waiting += len(parts[-1]) // 2
            if waiting >= max(FOLD_PAIRS, len(known)):
                yield folded(parts)
                parts, waiting = [], 0
    if parts:
        yield folded(parts)


def anchored(signed: DataFrame, bands: int, name: str) -> DataFrame:
    """Members (key, id, low) of every bucket of two or more ids of the stored frame ``signed`` (id, keys).

    ``keys`` holds ``bands`` 64-bit numbers one after another, or null; rows may repeat, an id's keys are the same in all of them.  ``low`` is the bucket's
    most central member: the one that shares the most bucket places with others (ties: the smallest id).  Originals
    score higher than their variants, so variants meet the original first.
    """
    tasks = max(1, math.ceil(signed.count() * bands / FOLD_PAIRS))
    dealt = signed.where("keys IS NOT NULL").mapInArrow(_deal_task(4 * tasks), "slot int, pairs binary").repartition(tasks, "slot")
    shared = materialize(dealt.select("pairs").mapInArrow(_shared_task, "key long, id long").distinct(), f"{name}-shared")
    sizes = materialize(shared.groupBy("key").agg(F.count(F.lit(1)).alias("m")), f"{name}-sizes")
    score = shared.join(sizes, "key").groupBy("id").agg(F.sum("m").alias("score"))
    # stored, so that the join can split the rows of a large bucket
    top = materialize(shared.join(score, "id").groupBy("key")
                      .agg(F.max(F.struct("score", (-F.col("id")).alias("neg"))).alias("t"))
                      .select("key", (-F.col("t.neg")).alias("low")), f"{name}-top")
    return materialize(shared.join(top, "key"), f"{name}-members")


def _placed(members: DataFrame, comps: DataFrame, name: str) -> DataFrame:
    """Members of buckets that still hold several components: (key, id, n, low, comp, top)."""
    placed = members.join(comps.select(F.col("node").alias("id"), "component_id"), "id", "left").select(
        "key", "id", "n", "low", F.coalesce("component_id", "id").alias("comp"))
    by_comp = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"))
    split = materialize(by_comp.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("m", "comp")).alias("top"))
                        .where("k > 1").select("key", F.col("top.comp").alias("top")), f"{name}-split")
    return materialize(placed.join(split, "key"), f"{name}-open")


def link(members: DataFrame, sets: DataFrame, num: int, den: int, name: str, decode=stored_sets,
         rounds: int = 1) -> tuple[DataFrame, DataFrame]:
    """Verified links and components of bucket members.

    ``members`` is a stored frame (key, id, low), ``low`` being the bucket's
    anchor; ``sets`` the stored sets (id, n, items), ``n`` the size and ``decode``
    what turns a column of items into (flat sorted hashes, offsets).  A link needs den * inter >= num * total.  Returns
    (links (u, v), components (node, component_id)).
    """
    verify = set_verifier(sets, decode)
    ok = F.col("inter") * den >= F.col("total") * num
    sized = lambda p, q: F.least(p, q) * den >= F.greatest(p, q) * num
    pair = lambda p, q: (F.least(p, q).alias("a"), F.greatest(p, q).alias("b"))
    size = sets.select("id", "n")
    members = materialize(members.join(size, "id"), f"{name}-sized")
    star = (members.where("id <> low").select("id", "n", "low").distinct()
            .join(size.select(F.col("id").alias("low"), F.col("n").alias("n_low")), "low")
            .where(sized("n", "n_low")).select(*pair("low", "id")).distinct())
    tested = materialize(verify(star), f"{name}-tested")
    links = tested.where(ok).select(F.col("a").alias("u"), F.col("b").alias("v"))
    comps = star_components(local_forest(links), f"{name}-c0")
    open_ = _placed(members, comps, f"{name}-p0")
    for r in range(1, rounds + 1):
        if open_.isEmpty():
            return links, comps
        # each member outside the largest component meets one other member of that component
        hub = materialize(open_.where("comp = top").groupBy("key").agg(F.min(F.struct(F.xxhash64("id", F.lit(r)).alias("o"), "id", "n")).alias("h"))
                          .select("key", F.col("h.id").alias("hub"), F.col("h.n").alias("n_hub")), f"{name}-hub")
        tries = (open_.where("comp <> top").join(hub, "key").where(sized("n", "n_hub"))
                 .select(*pair("id", "hub")).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti"))
        more = materialize(verify(tries), f"{name}-more")
        tested = tested.unionByName(more)
        found = more.where(ok).select(F.col("a").alias("u"), F.col("b").alias("v"))
        if found.isEmpty():
            continue
        links = links.unionByName(found)
        comps = merged_components(comps, found, f"{name}-c{r}")
        open_ = _placed(open_.select("key", "id", "n", "low"), comps, f"{name}-p{r}")
    if open_.isEmpty():
        return links, comps
    sketch = materialize(sets.join(open_.select("id").distinct(), "id", "left_semi").select("id", "items")
                         .mapInArrow(_parity_task(decode), "id long, par array<long>"), f"{name}-parity")
    open_ = materialize(open_.join(sketch, "id"), f"{name}-sketched")
    x, y = open_.where("comp <> top").alias("x"), open_.alias("y")
    differ = F.aggregate(F.zip_with("x.par", "y.par", lambda p, q: F.bit_count(p.bitwiseXOR(q))),
                         F.lit(0), lambda t, c: t + c)
    both = F.col("x.n") + F.col("y.n")
    rest = (x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp"))
                   & ((F.col("y.comp") == F.col("y.top")) | (F.col("x.id") < F.col("y.id")))
                   & sized("x.n", "y.n")
                   & (differ * (num + den) <= both * (den - num))).select(*pair("x.id", "y.id")).distinct()
            .join(tested.select("a", "b"), ["a", "b"], "left_anti"))
    more = materialize(verify(rest).where(ok).select(F.col("a").alias("u"), F.col("b").alias("v")), f"{name}-rest")
    if more.isEmpty():
        return links, comps
    links = links.unionByName(more)
    return links, merged_components(comps, more, f"{name}-end")
