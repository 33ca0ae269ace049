"""Prefix trie of sequences by van Emde Boas recursion over depth.

Sequences are rows (conv_id, depth 1.., symbol, weight).  The depth range is
cut at half, again and again, and all parts of one level are worked on at once:

1. Bottom-up, the symbols of every aligned block of 2^k depths get one digest
   from the digests of its halves.
2. Top-down, a range holds the digest of the prefix in front of it.  Its upper
   half keeps that prefix; its lower half, for the sequences that reach it,
   starts from the name of the cut prefix (prefix and upper block digested
   together).  Ranges of one depth name every node.
3. Nodes are grouped counts: members, the smallest member (which with the
   depth is the node's key from then on), parent and children.
4. Bottom-up, totals are grafted: the trees below a cut are summed under each
   node at the cut, and that sum is added to this node and its ancestors inside
   the upper half, found from the path of the node's smallest member.

Every step is a grouped aggregate with partial sums, or an equi-join of stored
rows; levels are log2 of the greatest depth and each touches every row at most
once, so a sequence or a node of any size is spread over tasks.  Digests are
128 bits of SHA-256.

Defined cases: a sequence without turns is a member of the root alone; null
sequence ids are dropped; an empty table gives no nodes; repeated rows of one
depth are not allowed (``ranked_turns`` gives every row its own depth).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normlens.functions.index import row_ranks
from normlens.llm.common import materialize

PIECE_IDS = 1 << 16
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _digest(*cols) -> F.Column:
    return F.unhex(F.substring(F.sha2(F.concat(*cols), 256), 1, 32))


def symbol(role, text) -> F.Column:
    """128-bit digest of a turn; the byte length of the role keeps the two parts apart."""
    return _digest(F.octet_length(role).cast("string").cast("binary"), F.lit(b":"),
                   F.encode(role, "UTF-8"), F.encode(text, "UTF-8"))


def ranked_turns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, pos 1.., sym, chars): turns in order (null first; equal turns by role, then digest)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    rows = df.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"),
                     symbol(role, text).alias("sym"), F.length(text).cast("long").alias("chars"))
    return row_ranks(rows.where("conv_id IS NOT NULL"), ["conv_id"], ["turn", "role", "sym"], "pos").select(
        "conv_id", (F.col("pos") + 1).alias("pos"), "sym", "chars")


def _levels(turns: DataFrame) -> int:
    deepest = turns.agg(F.max("depth")).first()[0] or 0
    return max(0, deepest - 1).bit_length()


def _block_digests(turns: DataFrame, levels: int) -> list[DataFrame]:
    """Per level k < ``levels``: (conv_id, j, name) of the whole blocks of depths j*2^k+1 .. (j+1)*2^k."""
    out = [turns.select("conv_id", (F.col("depth") - 1).alias("j"), F.col("sym").alias("name"))]
    for _ in range(1, levels):
        half = lambda odd: F.max(F.when(F.col("j") % 2 == odd, F.col("name")))
        up = (out[-1].groupBy("conv_id", F.shiftright("j", 1).alias("j"))
              .agg(half(0).alias("a"), half(1).alias("b")).where("a IS NOT NULL AND b IS NOT NULL"))
        out.append(materialize(up.select("conv_id", "j", _digest("a", "b").alias("name")), "trie-blocks"))
    return out


def _named_prefixes(turns: DataFrame, lens: DataFrame, levels: int) -> DataFrame:
    """(conv_id, depth, node): the digest of the first ``depth`` symbols, by halving ranges."""
    blocks = _block_digests(turns, levels)
    ranges = lens.select("conv_id", "n", F.lit(0).cast("long").alias("r"), F.lit(b"").alias("pre"))
    for k in range(levels - 1, -1, -1):
        upper = ranges.select("conv_id", "n", (F.col("r") * 2).alias("r"), "pre")
        cut = upper.where(F.col("n") > (F.col("r") + 1) * (1 << k)).join(
            blocks[k].select("conv_id", F.col("j").alias("r"), "name"), ["conv_id", "r"])
        lower = cut.select("conv_id", "n", (F.col("r") + 1).alias("r"), _digest("pre", "name").alias("pre"))
        ranges = materialize(upper.unionByName(lower), "trie-ranges")
    last = turns.select("conv_id", (F.col("depth") - 1).alias("r"), "sym", "chars")
    return ranges.join(last, ["conv_id", "r"]).select(
        "conv_id", (F.col("r") + 1).alias("depth"), _digest("pre", "sym").alias("node"), "chars", "n")


def _grafted(paths: DataFrame, own: DataFrame, levels: int) -> DataFrame:
    """(conv_id, depth, leaves, saved) over each node's subtree.

    ``own`` holds the nodes (conv_id, depth, parent, leaf, saved); ``paths``
    (conv_id, depth, node_conv) the node at each depth of every owner.
    """
    parts = [own.select("conv_id", "depth", "leaves", "saved")]
    for k in range(levels):
        # ranges of 2^(k+1) depths; the cut lies 2^k below their start: children stand right under it
        under = (F.col("depth") - 1) % (1 << (k + 1)) == (1 << k)
        heads = own.where(under).select("conv_id", "depth", "parent_conv_id")
        sums = None
        for p in parts:
            p = p.where(under)
            sums = p if sums is None else sums.unionByName(p)
        sums = sums.groupBy("conv_id", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        roots = (heads.join(sums, ["conv_id", "depth"]).where("leaves <> 0 OR saved <> 0")
                 .groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 2).alias("top"))
                 .agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
        roots = materialize(roots.withColumn("block", F.shiftright("top", k)).drop("top"), "trie-cuts")
        # the upper half of a range is the aligned block of 2^k depths that ends at the cut
        above = roots.join(paths.withColumn("block", F.shiftright(F.col("depth") - 1, k)), ["conv_id", "block"])
        add = above.groupBy(F.col("node_conv").alias("conv_id"), "depth").agg(
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        parts.append(materialize(add, "trie-grafts"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("conv_id", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def prefix_trie(turns: DataFrame, conv_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of the trie over ``turns`` (conv_id, depth 1.., sym, chars).

    ``conv_ids`` (conv_id) lists all sequences, those without turns too.  Nodes:
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens.  Ends: the node (conv_id, depth) where each
    sequence ``member`` stops.
    """
    turns = materialize(turns, "trie-turns")
    convs = materialize(conv_ids.where("conv_id IS NOT NULL").distinct(), "trie-convs")
    levels = _levels(turns)
    lens = materialize(turns.groupBy("conv_id").agg(F.max("depth").cast("long").alias("n")), "trie-lens")
    named = materialize(_named_prefixes(turns, lens, levels), "trie-named")
    groups = named.groupBy("node", "depth").agg(
        F.min("conv_id").alias("node_conv"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"))
    groups = materialize(groups, "trie-groups")
    paths = materialize(named.select("conv_id", "depth", "node", "n").join(
        groups.select("node", "depth", "node_conv"), ["node", "depth"]).drop("node"), "trie-paths")

    up = paths.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node_conv").alias("parent_conv_id"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
                       "n_convs", F.lit(0).cast("long").alias("chars"))
    inner = groups.select(F.col("node_conv").alias("conv_id"), F.col("depth").cast("long"), "n_convs", "chars")
    first = inner.where("depth = 1").withColumn("parent_conv_id", root.select("conv_id").scalar())
    deeper = inner.where("depth > 1").join(up, ["conv_id", "depth"])
    nodes = root.unionByName(first).unionByName(deeper)
    nodes = materialize(nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "chars"), "trie-nodes")
    kids = (nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
            .agg(F.count(F.lit(1)).alias("n_children")))
    nodes = nodes.join(kids, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = materialize(nodes.select(
        "*", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")), "trie-own")

    owners = nodes.where("depth > 0").select("conv_id").distinct()
    owned = materialize(paths.join(owners, "conv_id", "left_semi").select("conv_id", "depth", "node_conv"), "trie-owned")
    totals = materialize(_grafted(owned, nodes.where("depth > 0"), levels), "trie-totals")
    below = nodes.where("depth = 1").select("conv_id", "depth").join(totals, ["conv_id", "depth"]).agg(
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    top = nodes.where("depth = 0").select("conv_id", "depth", F.lit(1).alias("_")).join(
        below.withColumn("_", F.lit(1)), "_").select(
        "conv_id", "depth", F.coalesce("leaves", F.lit(1)).alias("leaves"), F.coalesce("saved", F.lit(0)).alias("saved"))
    totals = totals.unionByName(top).select("conv_id", "depth", F.col("leaves").alias("n_leaves"),
                                            F.col("saved").alias("saved_tokens"))
    out = nodes.drop("leaves", "saved", "chars").join(totals, ["conv_id", "depth"])

    ends = paths.where("depth = n").select(F.col("node_conv").alias("conv_id"), F.col("depth").cast("long"),
                                           F.col("conv_id").alias("member"))
    bare = convs.join(lens, "conv_id", "left_anti").select(F.col("conv_id").alias("member"))
    bare = bare.select(root.select("conv_id").scalar().alias("conv_id"), F.lit(0).cast("long").alias("depth"), "member")
    return out, ends.unionByName(bare)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv_id, depth, member) rows -> (conv_id, depth, first, ids): members joined by commas, in pieces."""
    key, ids, out = None, [], []

    def flush():
        if ids:
            out.append((*key, ids[0], ",".join(map(str, ids))))
            ids.clear()

    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    for b in batches:
        for c, d, m in zip(*(b.column(x).to_pylist() for x in ("conv_id", "depth", "member"))):
            if (c, d) != key or len(ids) >= PIECE_IDS:
                flush()
                key = (c, d)
            ids.append(m)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out), schema)], schema=schema)
            out.clear()
    flush()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out), schema)], schema=schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces -> (conv_id, depth, ends_sha256), one hash running over the pieces of a node."""
    key, sha, done = None, None, []
    names = ["conv_id", "depth", "ends_sha256"]

    def batch():
        out = pa.record_batch([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.int64()),
                               pa.array([x[2] for x in done], pa.string())], names=names)
        done.clear()
        return out

    for b in batches:
        for c, d, ids in zip(*(b.column(x).to_pylist() for x in ("conv_id", "depth", "ids"))):
            if (c, d) == key:
                sha.update(b"," + ids.encode())
            else:
                if key:
                    done.append((*key, sha.hexdigest()))
                key, sha = (c, d), hashlib.sha256(ids.encode())
        yield batch()
    if key:
        done.append((*key, sha.hexdigest()))
    yield batch()


def with_end_digests(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """``nodes`` with the SHA-256 of the ascending, comma-joined members that end at each.

    Members are range-sorted with their node, so that a node's members of any
    number lie over many tasks; each task joins its stretch, and the hash of a node
    runs over these pieces (SHA-256 has no parallel form), one piece in memory at a time.
    """
    spark = nodes.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["conv_id", "depth", "member"]
    pieces = (ends.select(*keys).repartitionByRange(shards, *keys).sortWithinPartitions(*keys)
              .mapInArrow(_pieces, "conv_id long, depth long, first long, ids string"))
    sums = (pieces.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first")
            .mapInArrow(_hashed, "conv_id long, depth long, ends_sha256 string"))
    return nodes.join(materialize(sums, "trie-ends"), ["conv_id", "depth"], "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)))
