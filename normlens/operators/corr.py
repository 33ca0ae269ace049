"""Score merging, z-scores and Pearson correlations.

* ``score_correlations``: r of each score column with accuracy, from
  ``covar_samp / (stddev_samp * stddev_samp)`` (stable online updates);
  a constant column gives NULL instead of a division error.
* ``community_similarity``: r between the z-scored metric vectors of two
  communities.  Each vector is centred and scaled to unit length once, so
  r is a dot product.  Pairs come from an equi-join on block numbers.
* ``community_centrality``: the mean r of a community with all others is
  ``(u_i . S - 1) / (n - 1)`` where ``S`` is the sum of all unit vectors,
  so it needs no pairs at all (linear in the number of communities).
* ``extreme_pairs``: the few most or least similar pairs, from blocks of
  vectors whose bounds on r leave most pairs of blocks out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normlens.functions.index import row_ranks
from normlens.functions.text import strip_paren_suffix
from normlens.operators.matrix import paired
from normlens.session import materialize


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Names of numeric columns, minus ``exclude`` (schema inspection only)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in set(exclude)]


def merge_scores(accuracy: DataFrame, meta: DataFrame, scores: DataFrame,
                 communities: DataFrame, name_col: str = "name",
                 display_col: str = "display_name_prefixed",
                 acc_label_col: str = "subreddit", acc_col: str = "accuracy",
                 score_key: str = "subreddit", strict: bool = False,
                 acc_order: str | None = None, meta_order: str | None = None,
                 score_order: str | None = None) -> DataFrame:
    """Accuracy x metadata x scores by cleaned community name.

    Accuracy labels ``'r/x (id)'`` are cleaned to ``'r/x'``.  Duplicates:
    the last accuracy row wins, and the first metadata and score rows, by the
    load-order columns ``acc_order``, ``meta_order`` and ``score_order``;
    without one the greatest label, the least name and the least row win.  Output: ``community, subreddit,
    accuracy, <score columns>``; communities missing any part are dropped.
    ``strict=True`` raises when nothing merges (names did not line up).
    """
    acc = (accuracy.withColumn("_clean", strip_paren_suffix(F.col(acc_label_col)))
           .groupBy("_clean").agg(F.max_by(F.col(acc_col), F.col(acc_order or acc_label_col)).alias("accuracy")))
    m = meta.groupBy(name_col).agg(F.min_by(display_col, meta_order or display_col).alias("subreddit"))
    comm = communities.select(name_col).distinct().join(m, name_col)
    score_cols = [c for c in scores.columns if c not in (score_key, score_order)]
    row = F.struct(*score_cols)
    sc = scores.groupBy(score_key).agg(
        (F.min_by(row, score_order) if score_order else F.min(row)).alias("_s"))
    sc = sc.select(F.col(score_key).alias("subreddit"), *[F.col("_s")[c].alias(c) for c in score_cols])
    j = (comm.join(acc, comm["subreddit"] == acc["_clean"]).drop("_clean")
         .join(sc, "subreddit"))
    out = j.select(F.col(name_col).alias("community"), "subreddit", "accuracy", *score_cols)
    if strict and out.isEmpty():
        raise ValueError("no rows after merging accuracy, metadata and scores")
    return out


def to_long(df: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """``(key, metric, value double)`` rows for the given metric columns."""
    return df.select(key, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        key, list(metrics), "metric", "value")


def _zwide(df: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """``(key, <metric z-scores>)``: sample-std z-scores per column.

    Means and stds are one global aggregate, attached as a struct scalar
    subquery (no join, no single-partition window).  Zero or undefined std
    gives NULL z.
    """
    stats = df.agg(F.struct(*[F.struct(F.avg(F.col(m).cast("double")).alias("mu"),
                                       F.stddev_samp(F.col(m).cast("double")).alias("sd")).alias(m)
                              for m in metrics]).alias("s")).scalar()
    wide = df.select(key, *[F.col(m).cast("double").alias(m) for m in metrics]).withColumn("_st", stats)
    zs = [F.try_divide(F.col(m) - F.col("_st")[m]["mu"],
                       F.when(F.col("_st")[m]["sd"] != 0, F.col("_st")[m]["sd"])).alias(m)
          for m in metrics]
    return wide.select(key, *zs)


def zscores(df: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Long form ``(key, metric, value, z)`` of the column z-scores."""
    z = to_long(_zwide(df, key, metrics), key, metrics).withColumnRenamed("value", "z")
    return z.join(to_long(df, key, metrics), [key, "metric"])


def unit_vectors(df: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Per row: the z-scored metric vector centred and scaled to length 1.

    ``u`` is NULL when any z is NULL or the vector is constant (r undefined).
    """
    k = float(len(metrics))
    zw = _zwide(df, key, metrics).select(key, F.array(*[F.col(m) for m in metrics]).alias("v"))
    complete = F.forall("v", lambda x: x.isNotNull())
    mean = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x) / k
    zw = zw.withColumn("_m", F.when(complete, mean))
    zw = zw.withColumn("_d", F.transform("v", lambda x: x - F.col("_m")))
    zw = zw.withColumn("_n", F.sqrt(F.aggregate("_d", F.lit(0.0), lambda acc, x: acc + x * x)))
    u = F.when(F.col("_n") > 0, F.transform("_d", lambda x: x / F.col("_n")))
    return zw.select(key, u.alias("u"))


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def community_similarity(df: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Pearson r for every unordered pair ``key_A < key_B`` (n(n-1)/2 rows by definition)."""
    u = unit_vectors(df, key, metrics)
    left = u.select(F.col(key).alias(f"{key}_A"), F.col("u").alias("_ua"))
    right = u.select(F.col(key).alias(f"{key}_B"), F.col("u").alias("_ub"))
    pairs = paired(left, right, f"{key}_B").filter(F.col(f"{key}_A") < F.col(f"{key}_B"))
    return pairs.select(f"{key}_A", f"{key}_B", _dot(F.col("_ua"), F.col("_ub")).alias("correlation"))


def community_centrality(df: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Mean pairwise r of each community with every other one (NULL pairs skipped)."""
    u = unit_vectors(df, key, metrics)
    k = len(metrics)
    tot = u.filter(F.col("u").isNotNull()).agg(
        F.struct(F.count(F.lit(1)).alias("n"),
                 F.array(*[F.sum(F.col("u")[i]) for i in range(k)]).alias("s")).alias("t")).scalar()
    x = u.withColumn("_t", tot)
    mean = F.try_divide(_dot(F.col("u"), F.col("_t")["s"]) - _dot(F.col("u"), F.col("u")),
                        (F.col("_t")["n"] - 1).cast("double"))
    return x.select(key, F.when(F.col("u").isNotNull() & (F.col("_t")["n"] > 1), mean)
                    .alias("mean_correlation"))


def score_correlations(df: DataFrame, target: str, metrics: Sequence[str]) -> DataFrame:
    """Pearson r of each metric with ``target`` over pairwise-complete rows."""
    long = to_long(df.withColumn("_y", F.col(target).cast("double")), "_y", metrics)
    ok = long.filter(F.col("value").isNotNull() & F.col("_y").isNotNull() & ~F.isnan("value")
                     & ~F.isnan("_y"))
    g = ok.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n"),
        F.covar_samp("value", "_y").alias("_c"),
        F.stddev_samp("value").alias("_sx"), F.stddev_samp("_y").alias("_sy"))
    den = F.col("_sx") * F.col("_sy")
    return g.select("metric", "n", F.try_divide(F.col("_c"), F.when(den > 0, den)).alias("r"))


PAIR_BLOCK = 2048


def extreme_pairs(df: DataFrame, key: str, metrics: Sequence[str], n: int = 10, ascending: bool = False,
                  block_rows: int = PAIR_BLOCK) -> DataFrame:
    """``n`` pairs ``key_A < key_B`` with the highest (or lowest) Pearson r of their z-scored metrics, with their rank.

    Equal to sorting :func:`community_similarity` (NULL r last, ties by keys)
    without making all pairs.  Vectors are ordered by their largest component
    and dealt into blocks of ``block_rows``; a block knows its mean direction and
    greatest angle to it, which bounds r between any two of its vectors and those of another.
    The blocks' own pairs give a first n-th best r; only pairs of blocks whose
    bound reaches it are looked at, and at most ``n`` rows leave each.
    """
    u = materialize(unit_vectors(df, key, metrics), "unit-vectors")
    a, b = f"{key}_A", f"{key}_B"
    sign = -1.0 if ascending else 1.0
    best = _best_of_blocks(u.where("u IS NOT NULL"), key, len(metrics), n, sign, block_rows)
    order = [F.col("s").desc(), F.col(a), F.col(b)]
    best = best.orderBy(*order).limit(n).select(a, b, (F.col("s") * sign).alias("correlation"), F.lit(0).alias("_null"))
    # pairs without r stand behind all others; the first n need only the first keys
    every, none = u.select(key), u.where("u IS NULL").select(key)
    heads = every.orderBy(key).limit(n + 1).unionByName(none.orderBy(key).limit(2 * n + 1)).distinct().join(
        none.withColumn("_v", F.lit(True)), key, "left")
    left, right = heads.select(F.col(key).alias(a), F.col("_v").alias("_va")), heads.select(F.col(key).alias(b), F.col("_v").alias("_vb"))
    empty = paired(left, right, b, blocks=1).where((F.col(a) < F.col(b)) & (F.col("_va") | F.col("_vb")))
    empty = empty.orderBy(a, b).limit(n).select(a, b, F.lit(None).cast("double").alias("correlation"), F.lit(1).alias("_null"))
    value = F.col("correlation").asc() if ascending else F.col("correlation").desc()
    last = [F.col("_null"), value, F.col(a), F.col(b)]
    out = best.unionByName(empty).orderBy(*last).limit(n)
    return out.withColumn("rank", F.row_number().over(Window.orderBy(*last))).drop("_null")  # n rows


def _angle(x, y):
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(x, y))))


def _placed(u: DataFrame, key: str, block_rows: int) -> DataFrame:
    """Vectors with their block, in the order of their largest component."""
    size = F.transform("u", lambda x: F.abs(x))
    at = F.array_position(size, F.array_max(size))
    lead = u.select(key, "u", at.alias("_at"), F.element_at("u", at.cast("int")).alias("_lead"))
    placed = row_ranks(lead, [], ["_at", "_lead", key], "_row")
    return materialize(placed.select(key, "u", F.floor(F.col("_row") / block_rows).alias("block")), "pair-blocks")


def _bounds(placed: DataFrame, k: int) -> DataFrame:
    """Per block the mean direction ``c`` and the greatest angle ``r`` to it."""
    means = placed.groupBy("block").agg(F.array(*[F.avg(F.col("u")[i]) for i in range(k)]).alias("m"))
    norm = F.sqrt(_dot(F.col("m"), F.col("m")))
    # without a mean direction (vectors that cancel out) any unit vector serves as centre
    axis = F.array(*[F.lit(1.0 if i == 0 else 0.0) for i in range(k)])
    means = means.withColumn("_n", norm).select(
        "block", F.when(F.col("_n") > 1e-9, F.transform("m", lambda x: x / F.col("_n"))).otherwise(axis).alias("c"))
    wide = placed.join(means, "block").groupBy("block").agg(F.max(_angle(F.col("u"), F.col("c"))).alias("r"))
    return materialize(means.join(wide, "block"), "pair-bounds")


def _best_of_blocks(u: DataFrame, key: str, k: int, n: int, sign: float, block_rows: int) -> DataFrame:
    """(key_A, key_B, s) of at least the ``n`` best pairs of vectors of ``k`` parts; s is r times ``sign``."""
    placed = _placed(u, key, block_rows)
    own = _block_pairs(placed, placed.select(F.col("block").alias("x"), F.col("block").alias("y")).distinct(), key, n, sign)
    own = materialize(own, "pairs-own")
    if not placed.agg(F.max("block")).first()[0]:  # a single block has no others
        return own
    bounds = _bounds(placed, k)
    floor = own.orderBy(F.col("s").desc()).limit(n).agg(F.min("s"), F.count(F.lit(1))).first()
    least = floor[0] if floor[1] == n else -2.0
    left, right = (bounds.select(F.col("block").alias(v), F.col("c").alias(f"c{v}"), F.col("r").alias(f"r{v}")) for v in "xy")
    apart = paired(left, right, "y").where("x < y").withColumn("_t", _angle(F.col("cx"), F.col("cy")))
    near = F.greatest(F.lit(0.0), F.col("_t") - F.col("rx") - F.col("ry"))
    far = F.least(F.lit(math.pi), F.col("_t") + F.col("rx") + F.col("ry"))
    bound = F.cos(near) if sign > 0 else -F.cos(far)
    open_ = apart.where(bound >= least - 1e-9).select("x", "y")  # rounding of angles
    return own.unionByName(_block_pairs(placed, open_, key, n, sign))


def _block_pairs(placed: DataFrame, pairs: DataFrame, key: str, n: int, sign: float) -> DataFrame:
    """The ``n`` best pairs of vectors of every pair of blocks (x, y)."""
    side = lambda v, first: pairs.join(placed.withColumnRenamed("block", v), v).select(
        "x", "y", F.lit(first).alias("first"), key, "u")
    rows = side("x", True).unionByName(side("y", False).where("x <> y"))
    kind = placed.schema[key].dataType.simpleString()

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, ignore_index=True)  # row numbers stand for keys in order
        one = pdf.index[pdf["first"]].to_numpy()
        two = pdf.index[~pdf["first"]].to_numpy()
        two = two if len(two) else one
        v = np.stack(pdf["u"].to_list())
        s = np.zeros((len(one), len(two)))
        for i in range(v.shape[1]):  # summed in order, like the expression of the same product
            s += v[one, i][:, None] * v[two, i][None, :]
        s *= sign
        lo, hi = np.minimum(one[:, None], two[None, :]), np.maximum(one[:, None], two[None, :])
        keep = (lo < hi) if two is not one else (one[:, None] < two[None, :])
        s, code = s[keep], (lo.astype(np.int64) * len(pdf) + hi)[keep]
        if len(s) > n:
            cut = np.partition(s, len(s) - n)[len(s) - n]
            above, ties = np.flatnonzero(s > cut), np.flatnonzero(s == cut)
            ties = ties[np.argsort(code[ties], kind="stable")[:n - len(above)]]
            pick = np.concatenate((above, ties))
            s, code = s[pick], code[pick]
        names = pdf[key].to_numpy()
        return pd.DataFrame({"a": names[code // len(pdf)], "b": names[code % len(pdf)], "s": s})

    return rows.groupBy("x", "y").applyInPandas(best, f"a {kind}, b {kind}, s double").select(
        F.col("a").alias(f"{key}_A"), F.col("b").alias(f"{key}_B"), "s")


def top_pairs(pairs: DataFrame, n: int = 10, ascending: bool = False, value: str = "correlation",
              keys: Sequence[str] = ()) -> DataFrame:
    """``n`` pairs with the highest (or lowest) value, NULLs last, ties by keys."""
    v = F.col(value).asc_nulls_last() if ascending else F.col(value).desc_nulls_last()
    order = [v, *[F.col(k).asc() for k in keys]]
    return pairs.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def rank_within(df: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Per metric, rank of every row by value descending (ties by key)."""
    long = to_long(df, key, metrics)
    w = Window.partitionBy("metric").orderBy(F.col("value").desc_nulls_last(), F.col(key).asc())
    return long.withColumn("rank", F.row_number().over(w))
