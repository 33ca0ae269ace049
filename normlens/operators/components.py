"""Connected parts of a two-sided table (rows link a level of one side to one of the other)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normlens.functions.index import row_ranks
from normlens.session import materialize


def bipartite_labels(links: DataFrame, a: str, b: str, max_rounds: int = 200) -> DataFrame:
    """(a, part) for every level of ``a``: parts are equal where levels are linked through levels of ``b``.

    Levels start as their own part.  Each round takes the smallest part met
    through a level of ``b``, hooks the old part's root to it, and lets every
    level point at its part's part; paths halve, so rounds grow with the
    logarithm of a part's width.  Rounds are grouped minima and equi-joins of
    stored tables; it ends when no label moves.
    """
    pairs = materialize(links.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct(), "part-links")
    ids = materialize(row_ranks(pairs.select("a").distinct(), [], ["a"], "id"), "part-ids")
    pairs = materialize(pairs.join(ids, "a").select("id", "b"), "part-pairs")
    label = ids.select("id", F.col("id").alias("part"))
    for _ in range(max_rounds):
        near = pairs.join(label, "id").groupBy("b").agg(F.min("part").alias("low"))
        met = pairs.join(near, "b").groupBy("id").agg(F.min("low").alias("low"))
        now = materialize(label.join(met, "id"), "part-met")
        hooks = now.groupBy(F.col("part").alias("id")).agg(F.min("low").alias("hook"))
        hooked = materialize(now.join(hooks, "id", "left").select(
            "id", F.least("low", "part", F.coalesce("hook", "part")).alias("part"),
            F.col("part").alias("before")), "part-hooked")
        up = hooked.select(F.col("id").alias("part"), F.col("part").alias("top"))
        after = materialize(hooked.join(up, "part").select("id", F.col("top").alias("part"), "before"), "part-labels")
        if after.where("part <> before").isEmpty():
            return ids.join(after, "id").select(F.col("a").alias(a), "part")
        label = after.select("id", "part")
    raise RuntimeError("parts did not settle")


def bipartite_parts(links: DataFrame, a: str, b: str, n_a: int, n_b: int) -> int:
    """Number of connected parts of distinct (a, b) links with ``n_a`` and ``n_b`` levels."""
    if not n_a or not n_b:
        return 0
    for one, n in ((b, n_a), (a, n_b)):  # a level linked to all of the other side joins everything
        widest = links.groupBy(one).agg(F.count(F.lit(1)).alias("k")).agg(F.max("k")).first()[0]
        if widest == n:
            return 1
    small, large = (a, b) if n_a <= n_b else (b, a)
    return bipartite_labels(links, small, large).select("part").distinct().count()
