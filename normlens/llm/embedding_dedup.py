"""Near-duplicate vectors by hierarchical navigable small-world graphs per shard.

Equal vectors form one class.  Classes are dealt over shards by hash; each shard
(at most ``shard_rows`` vectors) becomes one layered graph: a vector's top layer
comes from its hash, and in every layer it is joined to near vectors chosen so
that they spread out.  Every vector queries every shard: a walk down the layers from
the first one small enough to be looked through whole, a beam over the bottom one, and from the beam a flood through all vectors of
cosine ``cosine - slack`` or more.  Every vector of the shard first seeks itself; those not found so are added to the
layer that is looked through whole.  An audit holds sampled vectors against the
whole shard; while it misses any link, the beam doubles and the slack grows (past
WIDEST the bounded shard is scanned whole).  Links are verified in double
precision.  A task holds one shard and streams its queries past it,
``query_rows`` at a time: the links of a few hundred queries are counted and
merged into one forest over the shard before the next ones are sought, so a
tight group never turns into all its pairs.  Components join the forests.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different lengths are never compared;
repeated rows are copies and link; an empty table gives no rows; only the two
named columns are read.  Ids must be unique.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normlens.llm.common import component_ids, local_forest, materialize, mix64, star_components

WIDEST = 256
LAYER = 16  # one vector in LAYER of a layer is also in the next one up
FLAT = 4096  # a walk starts at the lowest upper layer of so many vectors at most, all of them compared
SLACK = 0.05  # what the first flood allows below the cosine asked for
STEP = 4  # vectors of a beam that are followed at once
HITS = "id long, n_links long, u long, v long"


def _near(x: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """The k nearest of ``rows`` (itself left out) for every one of them, nearest first."""
    out = np.full((len(rows), k), -1, np.int64)
    sub = x[rows]
    for i in range(0, len(rows), 1024):
        sim = sub[i:i + 1024] @ sub.T
        sim[np.arange(len(sim)), np.arange(i, i + len(sim))] = -3
        m = min(k, len(rows) - 1)
        if m <= 0:
            continue
        top = np.argpartition(-sim, m - 1, axis=1)[:, :m]
        order = np.argsort(-np.take_along_axis(sim, top, 1), axis=1, kind="stable")
        out[i:i + 1024, :m] = rows[np.take_along_axis(top, order, 1)]
    return out


def _spread(x: np.ndarray, rows: np.ndarray, near: np.ndarray, degree: int) -> np.ndarray:
    """Of the near ones those closer to the vector than to any one chosen before; then the nearest others."""
    n, k = near.shape
    ok = near >= 0
    cand = x[np.maximum(near, 0)]
    own = np.einsum("nd,nkd->nk", x[rows], cand)
    between = np.einsum("nkd,nld->nkl", cand, cand)
    chosen = np.zeros((n, k), bool)
    for c in range(k):
        worst = np.where(chosen, between[:, c, :], -3).max(axis=1)
        chosen[:, c] = ok[:, c] & (own[:, c] >= worst) & (chosen.sum(axis=1) < degree)
    rank = np.where(chosen, 0, 1) * k + np.arange(k)
    rank = np.where(ok, rank, 10 * k)
    order = np.argsort(rank, axis=1)[:, :degree]
    return np.take_along_axis(near, order, 1)


def build_graph(x: np.ndarray, key: np.ndarray, degree: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers bottom up: (members, neighbours of every vector in that layer; -1 where none)."""
    height = np.zeros(len(x), np.int64)
    h = mix64(key.view(np.uint64))
    for level in range(1, 12):
        height[(h % np.uint64(LAYER ** level)) == 0] = level
    layers = []
    for level in range(int(height.max()) + 1 if len(x) else 1):
        rows = np.flatnonzero(height >= level)
        if level and len(rows) < 2:
            break
        table = np.full((len(x), 2 * degree), -1, np.int64)
        near = _near(x, rows, 2 * degree)
        for i in range(0, len(rows), 2048):
            table[rows[i:i + 2048], :degree] = _spread(x, rows[i:i + 2048], near[i:i + 2048], degree)
        # links back, as many as there is room for
        src = np.repeat(rows, degree)
        dst = table[rows, :degree].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        place = np.arange(len(dst)) - np.searchsorted(dst, dst, side="left")
        fits = place < degree
        table[dst[fits], degree + place[fits]] = src[fits]
        layers.append((rows, table))
    return layers


def _beam(q: np.ndarray, x: np.ndarray, table: np.ndarray, entry: np.ndarray, ef: int, seen: np.ndarray, floor: float,
          found: list) -> np.ndarray:
    """Beam search of all queries at once; everything of similarity ``floor`` or more goes to ``found``."""
    nq = len(q)
    nodes = np.full((nq, ef), -1, np.int64)
    sims = np.full((nq, ef), -3.0, q.dtype)
    done = np.ones((nq, ef), bool)
    w = min(entry.shape[1], ef)
    nodes[:, :w] = entry[:, :w]
    valid = nodes[:, :w] >= 0
    sims[:, :w] = np.where(valid, np.einsum("qd,qwd->qw", q, x[np.maximum(nodes[:, :w], 0)]), -3)
    done[:, :w] = ~valid
    width, step = table.shape[1], min(STEP, ef)
    place = np.zeros(seen.shape, np.min_scalar_type(width * step))
    r, c = np.nonzero(valid)
    seen[r, nodes[r, c]] = True
    hit = sims[r, c] >= floor
    found.append((r[hit], nodes[r[hit], c[hit]], sims[r[hit], c[hit]]))
    while True:
        live = np.flatnonzero(~done.all(axis=1))
        if not len(live):
            return nodes
        open_ = np.where(done[live], -3, sims[live])
        best = np.argpartition(-open_, step - 1, axis=1)[:, :step]
        at = nodes[live[:, None], best]
        at[done[live[:, None], best]] = -1
        done[live[:, None], best] = True
        nb = np.where(at[:, :, None] >= 0, table[np.maximum(at, 0)], -1).reshape(len(live), step * width)
        rr, cc = np.nonzero((nb >= 0) & ~seen[live[:, None], np.maximum(nb, 0)])
        # a vector may be a neighbour of several, or stand in both halves of a row: the last place counts
        place[live[rr], nb[rr, cc]] = cc
        once = place[live[rr], nb[rr, cc]] == cc
        rr, cc = rr[once], cc[once]
        v = nb[rr, cc]
        seen[live[rr], v] = True
        s = np.einsum("nd,nd->n", q[live[rr]], x[v])
        hit = s >= floor
        found.append((live[rr[hit]], v[hit], s[hit]))
        # only what is nearer than the worst of the beam can enter it
        enter = s > sims.min(axis=1)[live[rr]]
        rr, v, s = rr[enter], v[enter], s[enter]
        if not len(rr):
            continue
        col = np.arange(len(rr)) - np.searchsorted(rr, rr, side="left")
        put = np.unique(rr)
        row = np.searchsorted(put, rr)
        k = int(col.max()) + 1
        all_s = np.concatenate((sims[live[put]], np.full((len(put), k), -3.0, q.dtype)), axis=1)
        all_n = np.concatenate((nodes[live[put]], np.full((len(put), k), -1, np.int64)), axis=1)
        all_d = np.concatenate((done[live[put]], np.ones((len(put), k), bool)), axis=1)
        all_s[row, ef + col], all_n[row, ef + col], all_d[row, ef + col] = s, v, False
        top = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
        sims[live[put]] = np.take_along_axis(all_s, top, 1)
        nodes[live[put]] = np.take_along_axis(all_n, top, 1)
        done[live[put]] = np.take_along_axis(all_d, top, 1)


def _first(layers: list) -> int:
    """The layer where a walk starts."""
    return next((k for k in range(1, len(layers)) if len(layers[k][0]) <= FLAT), len(layers) - 1)


def search(q: np.ndarray, x: np.ndarray, layers: list, cosine: float, ef: int, slack: float
           ) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) pairs of similarity about ``cosine`` or more that the graph search reaches."""
    nq, n = len(q), len(x)
    if ef >= n:
        return tuple(np.nonzero(q @ x.T >= cosine - 1e-4))
    floor = cosine - slack
    high = _first(layers)
    top = layers[high][0]
    wide = max(8, min(ef, n) // 2)
    keep = min(wide, len(top))
    sim = q @ x[top].T
    entry = top[np.argpartition(-sim, keep - 1, axis=1)[:, :keep]]
    for _, table in reversed(layers[1:high]):
        entry = _beam(q, x, table, entry, wide, np.zeros((nq, n), bool), 3.0, [])
    seen = np.zeros((nq, n), bool)
    found: list = []
    table = layers[0][1]
    _beam(q, x, table, entry, min(ef, n), seen, floor, found)
    at = 0
    while at < len(found):  # flood through everything above the floor
        r, v, _ = found[at]
        at += 1
        for i in range(0, len(r), 20_000):
            rows = np.repeat(r[i:i + 20_000], table.shape[1])
            nb = table[v[i:i + 20_000]].ravel()
            ok = nb >= 0
            rows, nb = rows[ok], nb[ok]
            fresh = ~seen[rows, nb]
            key = np.unique(rows[fresh] * n + nb[fresh])
            if not len(key):
                continue
            rows, nb = key // n, key % n
            seen[rows, nb] = True
            s = np.einsum("nd,nd->n", q[rows], x[nb])
            hit = s >= floor
            found.append((rows[hit], nb[hit], s[hit]))
    r, v, s = (np.concatenate(c) for c in zip(*found))
    good = s >= cosine - 1e-4
    return r[good], v[good]


def reachable(x: np.ndarray, layers: list, cosine: float, ef: int, block: int = 256) -> list:
    """``layers``, where the layer of a walk's start also holds the vectors that a search for themselves does not find.

    One such vector among thousands would make the audit double the beam of all queries.
    """
    high, found = _first(layers), np.zeros(len(x), bool)
    if not high or ef >= len(x):
        return layers
    for i in range(0, len(x), block):
        r, v = search(x[i:i + block], x, layers, cosine, ef, SLACK)
        found[v[i + r == v]] = True
    rows, table = layers[high]
    return [*layers[:high], (np.union1d(rows, np.flatnonzero(~found)), table), *layers[high + 1:]]


def tuned(x: np.ndarray, layers: list, cosine: float, ef: int, audit: int) -> tuple[int, float]:
    """Beam and slack for which audited vectors find all their links in the shard."""
    slack = SLACK
    pick = np.unique(np.linspace(0, len(x) - 1, min(audit, len(x))).astype(np.int64))
    want = np.flatnonzero(x[pick] @ x.T >= cosine)
    while ef < min(len(x), WIDEST + 1):
        r, v = search(x[pick], x, layers, cosine, ef, slack)
        if np.isin(want, r * len(x) + v).all():
            return ef, slack
        ef, slack = ef * 2, min(0.3, slack * 1.5)
    return len(x), 2.0


def _unit(b) -> np.ndarray:
    x = np.asarray(b.flatten(), dtype=np.float64).reshape(len(b), -1)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _merge(root: np.ndarray, r: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Roots of the shard's vectors after those (``v``) that share a query (``r``) are joined."""
    if not len(r):
        return root
    n, at = len(root), root[v]
    low = np.full(int(r.max()) + 1, n)
    np.minimum.at(low, r, at)
    u, w = _forest(*np.divmod(np.unique(at[at != low[r]] * n + low[r][at != low[r]]), n))
    move = np.arange(n)
    move[u] = w
    return move[root]


def _hits(qid, counts, u, v) -> pa.RecordBatch:
    nul = lambda n: pa.nulls(n, pa.int64())
    return pa.record_batch({"id": pa.concat_arrays([pa.array(qid), nul(len(u))]),
                            "n_links": pa.concat_arrays([pa.array(counts), nul(len(u))]),
                            "u": pa.concat_arrays([nul(len(qid)), pa.array(u)]),
                            "v": pa.concat_arrays([nul(len(qid)), pa.array(v)])})


class _Shard:
    """One shard: its graph, and a forest of the links found so far."""

    def __init__(self, members: pa.Table, cosine: float, degree: int, ef: int, audit: int):
        self.sid = members.column("id").to_numpy()
        self.copies = members.column("copies").to_numpy()
        self.exact = _unit(members.column("vec").combine_chunks())
        self.x = self.exact.astype(np.float32)
        self.cosine = cosine
        self.layers = reachable(self.x, build_graph(self.x, self.sid, degree), cosine, ef)
        self.width, self.slack = tuned(self.x, self.layers, cosine, ef, audit)
        self.root = np.arange(len(self.sid))

    def links(self, queries: pa.RecordBatch, block: int = 256) -> pa.RecordBatch:
        """Link counts of the queries, and for each that has links one of them."""
        qid = queries.column("id").to_numpy()
        qv = _unit(queries.column("vec"))
        counts = np.zeros(len(qid), np.int64)
        one = np.full(len(qid), -1, np.int64)
        step = max(1, (8 << 20) // qv.shape[1])
        for i in range(0, len(qid), block):
            r, v = search(qv[i:i + block].astype(np.float32), self.x, self.layers, self.cosine, self.width, self.slack)
            ok = qid[i + r] != self.sid[v]
            r, v = r[ok], v[ok]
            ok = np.concatenate([np.einsum("nd,nd->n", qv[i + r[k:k + step]], self.exact[v[k:k + step]]) >= self.cosine
                                 for k in range(0, max(1, len(r)), step)])
            r, v = r[ok], v[ok]
            counts += np.bincount(i + r, weights=self.copies[v], minlength=len(qid)).astype(np.int64)
            one[i + r] = v
            self.root = _merge(self.root, r, v)
        has = one >= 0
        return _hits(qid, counts, qid[has], self.sid[one[has]])

    def forest(self) -> pa.RecordBatch:
        far = self.root != np.arange(len(self.root))
        return _hits(self.sid[:0], self.sid[:0], self.sid[far], self.sid[self.root[far]])


def _link_task(cosine: float, degree: int, ef: int, audit: int, query_rows: int):
    """Rows come sorted by (dim, shard, block), the shard's members before the queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members, shard = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("dim", "shard", "block", "query")])
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            for i, j in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows]):
                if tuple(key[:3, i]) != group:
                    if shard is not None:
                        yield shard.forest()
                    group, members, shard = tuple(key[:3, i]), [], None
                if not key[3, i]:
                    members.append(b.slice(i, j - i))
                    continue
                if shard is None and members:
                    shard, members = _Shard(pa.Table.from_batches(members), cosine, degree, ef, audit), []
                if shard is not None:
                    for k in range(i, j, query_rows):
                        yield shard.links(b.slice(k, min(query_rows, j - k)))
        if shard is not None:
            yield shard.forest()
    return run


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star per component of the links (u, v)."""
    if not len(u):
        return u, v
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    label = np.arange(len(nodes))
    while True:  # smallest label of the neighbours, with pointer jumping
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = np.minimum(low, low[low])
        if (low == label).all():
            break
        label = low
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def near_vectors(df: DataFrame, id_col: str, vec_col: str, cosine: float = 0.9, shards: int = 8,
                 shard_rows: int = 50_000, query_rows: int = 4_000, degree: int = 16, ef: int = 32, audit: int = 1000,
                 task_rows: int = 100_000) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``df``.

    A task builds the graph of its shard for about ``task_rows`` queries; fewer a task would build it more often.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    fine = (F.col("vec").isNotNull() & (F.size("vec") > 0)
            & F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
            & F.exists("vec", lambda c: c != 0))
    rows = rows.withColumn("ok", F.coalesce(fine, F.lit(False)))
    good = rows.where("ok").select("id", "vec")
    classes = materialize(good.groupBy("vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
                          .select("id", "copies", "vec", F.size("vec").alias("dim")), "em-classes")
    n = classes.count()
    shards = max(1, shards, math.ceil(n / shard_rows))
    blocks = max(1, math.ceil(n / task_rows))
    seq = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    members = classes.select("id", "copies", "vec", "dim", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"))
    queries = classes.select("id", "copies", "vec", "dim", seq(shards).alias("shard"),
                             F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("query"))
    held = members.select("*", seq(blocks).alias("block"), F.lit(0).alias("query"))
    dealt = (held.unionByName(queries).repartitionById(shards * blocks, F.col("shard") * blocks + F.col("block"))
             .sortWithinPartitions("dim", "shard", "block", "query", "id"))
    hits = materialize(dealt.mapInArrow(_link_task(cosine, degree, ef, audit, query_rows), HITS), "em-hits")
    comps = star_components(local_forest(hits.where("u IS NOT NULL").select("u", "v")), "em")
    linked = hits.where("id IS NOT NULL").groupBy("id").agg(F.sum("n_links").alias("n_links"))
    per_class = component_ids(classes.join(linked, "id"), "id", comps).select(
        F.col("vec").alias("vec"), (F.col("n_links") + F.col("copies") - 1).alias("n_links"), "component_id")
    alone = rows.where("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = good.join(per_class, "vec").select("id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("id") == F.col("component_id"))
