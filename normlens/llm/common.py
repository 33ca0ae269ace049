"""Helpers shared by the corpus operators."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normlens.session import materialize, scratch_path
from normlens.sources.tables import read_table

__all__ = ["materialize", "scratch_path", "read_table", "byte_blocks", "star_components",
           "local_forest", "merged_components", "component_ids", "checked_broadcast", "mix64", "ragged_index"]

BLOCK_BYTES = 512 << 10
FOREST_EDGES = 1_000_000


def binary_column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column: (flat uint8 array, int64 offsets); null is empty."""
    col = batch.column(name).cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0]:offsets[-1]], offsets - offsets[0]


def byte_blocks(batch: pa.RecordBatch, name: str, limit: int = BLOCK_BYTES
                ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of at most ``limit`` bytes: (first row, end row, bytes, offsets).

    A row longer than ``limit`` comes alone and whole; nothing is cut.
    """
    flat, off = binary_column(batch, name)
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, j, flat[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mixer on uint64 (every input bit reaches every output bit)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def ragged_index(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices start..start+len-1 of every run, one after another."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)


def checked_broadcast(small: DataFrame, n_rows: int, limit: int) -> DataFrame:
    """Hint a broadcast only when the counted size is within ``limit`` rows."""
    return F.broadcast(small) if n_rows <= limit else small


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    def flush():
        us = np.fromiter(parent.keys(), np.int64, len(parent))
        vs = np.fromiter((find(int(u)) for u in us), np.int64, len(us))
        keep = us != vs
        parent.clear()
        return pa.record_batch([pa.array(us[keep]), pa.array(vs[keep])], names=["u", "v"])

    for b in batches:
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist()):
            ru, rv = find(u), find(v)
            if ru != rv:
                lo, hi = min(ru, rv), max(ru, rv)
                parent[hi] = lo
                parent.setdefault(lo, lo)
        if len(parent) > 2_000_000:  # bounded memory: emit what is joined so far
            yield flush()
    yield flush()


def local_forest(edges: DataFrame, block: int = FOREST_EDGES) -> DataFrame:
    """Union-find inside every task: its edges become a spanning forest (node, root).

    ``edges`` is a stored frame; its partitions are put together to about
    ``block`` edges a task, so that a forest spans as much as a task can hold.
    """
    tasks = max(1, math.ceil(edges.count() / block))
    return edges.select("u", "v").coalesce(tasks).mapInArrow(_forest, "u long, v long")


def star_components(edges: DataFrame, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(node, component_id) for every node of ``edges`` (u, v), by alternating stars.

    Large-star points every larger neighbour of a node at the smallest member of
    its neighbourhood, small-star every smaller one and the node itself; the
    edge set turns into one star per component around its smallest id.  Each
    half is a grouped minimum (combined before the shuffle) joined back to
    stored edges, so a hub of any degree is split by the skew join, never
    gathered.  Edge sets are written to the shared folder after each round.
    Rounds end when all edges are stars: no node points at two others, and none
    that is pointed at points on.
    """
    cur = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                      .where("u <> v").distinct(), f"{name}-e")
    for _ in range(max_rounds):
        ends = (cur.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
                .unionByName(cur.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
        ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not ends.agg(F.bool_or(F.expr("up > 1 OR up = 1 AND down = 1"))).first()[0]:
            break
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m"))
                          .select("u", F.least("u", "m").alias("m")), f"{name}-m")
        # one row per edge at most, so it may hold repeats until the last step drops them
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v"))
        large = materialize(large, f"{name}-l")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-m")
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v"))
        cur = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                          .distinct(), f"{name}-e")
    else:
        raise RuntimeError("components did not settle")
    nodes = cur.select(F.col("u").alias("node"), F.col("v").alias("component_id"))
    return nodes.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct())


def merged_components(comps: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Components (node, component_id) after more ``links`` (u, v) join those of ``comps``.

    Only links between components go through the stars, each end replaced by
    its component.
    """
    at = lambda c: comps.select(F.col("node").alias(c), F.col("component_id").alias(f"c{c}"))
    between = (links.join(at("u"), "u", "left").join(at("v"), "v", "left")
               .select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")).where("u <> v"))
    up = star_components(local_forest(materialize(between, f"{name}-b")), name)
    moved = (comps.join(up.select(F.col("node").alias("component_id"), F.col("component_id").alias("top")),
                        "component_id", "left").select("node", F.coalesce("top", "component_id").alias("component_id")))
    return materialize(moved.unionByName(up.join(comps.select("node"), "node", "left_anti")), f"{name}-all")


def component_ids(rows: DataFrame, id_col: str, comps: DataFrame) -> DataFrame:
    """Left-join component ids; a row without links is its own component."""
    c = comps.select(F.col("node").alias(id_col), "component_id")
    return (rows.join(c, id_col, "left")
            .withColumn("component_id", F.coalesce("component_id", id_col))
            .withColumn("kept", F.col(id_col) == F.col("component_id")))

