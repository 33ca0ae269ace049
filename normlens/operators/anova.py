"""Two-way additive ANOVA (type II) with eta squared, solved on DataFrames.

One pass gives per (a, b) cell the count, mean and within-cell sum of squares
(stable moment aggregates).  With the other factor's effects eliminated, factor
x has the normal equations

    S e = u,   S = D_x - C D_z^-1 C',   u = y_x - C D_z^-1 y_z

(C the cell counts, D the level counts, y the centred level sums).  They are
solved by conjugate gradients scaled by D_x: a product with S is two joins of
the stored cell table with a vector over levels, vectors are stored tables, and
only scalars reach the driver.  Then

    SS_x = u' S^+ u,   RSS = T - sum(y_z^2 / n_z) - SS_x,
    SS_z = sum(y_z^2 / n_z) + SS_x - sum(y_x^2 / n_x)

with T the centred total sum of squares; these are the differences of residual
sums of squares of the least squares fits with and without each factor, also
for unbalanced, incomplete or disconnected grids.  x is the factor with
fewer levels, so a factor of few levels ends after as many steps.  Degrees of freedom count the
connected parts of the grid.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normlens.operators.components import bipartite_parts
from normlens.session import materialize

ANOVA_SCHEMA = T.StructType([
    T.StructField("term", T.StringType()),
    T.StructField("sum_sq", T.DoubleType()),
    T.StructField("df", T.DoubleType()),
    T.StructField("F", T.DoubleType()),
    T.StructField("p_value", T.DoubleType()),
    T.StructField("eta_sq", T.DoubleType()),
])


def cell_stats(df: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """Per (a, b) cell: count, mean and within-cell sum of squares of y, in one pass.

    ``avg`` and ``var_pop`` merge central moments across partitions, so the
    sums of squares stay free of cancellation without a separate pass for
    the overall mean; centring happens on the reduced cell table.
    """
    yv = F.col(y).cast("double")
    clean = df.filter(F.col(y).isNotNull() & ~F.isnan(yv)
                      & F.col(a).isNotNull() & F.col(b).isNotNull())
    return clean.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"), F.avg(yv).alias("mean"),
                                   (F.var_pop(yv) * F.count(F.lit(1))).alias("ssw"))


def _times_schur(cells: DataFrame, levels: DataFrame, counts_z: DataFrame) -> DataFrame:
    """``levels`` (x, n, p, ..) with ``sp`` = S p: down to the other factor and up again."""
    down = (cells.join(levels.select("x", "p"), "x").groupBy("z").agg(F.sum(F.col("n") * F.col("p")).alias("v"))
            .join(counts_z, "z").select("z", (F.col("v") / F.col("nz")).alias("v")))
    up = cells.join(down, "z").groupBy("x").agg(F.sum(F.col("n") * F.col("v")).alias("w"))
    return levels.join(up, "x").select("*", (F.col("n") * F.col("p") - F.col("w")).alias("sp")).drop("w")


def adjusted_ss(cells: DataFrame, x_levels: DataFrame, z_levels: DataFrame, scale: float,
                tol: float = 1e-13, max_rounds: int = 10_000) -> float:
    """u' S^+ u by conjugate gradients; each step adds its share, so the solution is never stored.

    ``cells`` (x, z, n), ``x_levels`` (x, n, s), ``z_levels`` (z, n, s) are
    stored tables.  It ends when the scaled residual is ``tol`` of the first,
    or nothing against ``scale`` (the total sum of squares).
    """
    nz = z_levels.select("z", F.col("n").alias("nz"))
    other = z_levels.select("z", (F.col("s") / F.col("n")).alias("m"))
    gone = cells.join(other, "z").groupBy("x").agg(F.sum(F.col("n") * F.col("m")).alias("g"))
    state = materialize(x_levels.join(gone, "x").select("x", "n", (F.col("s") - F.col("g")).alias("r"),
                                                        ((F.col("s") - F.col("g")) / F.col("n")).alias("p")), "anova-state")
    size = lambda t: t.agg(F.sum(F.col("r") * F.col("r") / F.col("n"))).first()[0] or 0.0
    rz = first = size(state)
    total = 0.0
    for _ in range(max_rounds):
        if rz <= max(first * tol * tol, scale * 1e-28):
            return total
        work = materialize(_times_schur(cells, state, nz), "anova-product")
        bend = work.agg(F.sum(F.col("p") * F.col("sp"))).first()[0]
        if not bend > 0.0:  # only rounding of the null space is left
            return total
        step = rz / bend
        total += step * rz
        moved = work.withColumn("r", F.col("r") - F.lit(step) * F.col("sp"))
        before, rz = rz, size(moved)
        state = moved.select("x", "n", "r", (F.col("r") / F.col("n") + F.lit(rz / before) * F.col("p")).alias("p"))
    raise RuntimeError("the normal equations did not settle")


def f_tail(spark: SparkSession, f: float, d1: float, d2: float) -> float | None:
    """P(F > f) of the F distribution, by the regularised beta function of Spark's class path."""
    if f is None or math.isnan(f) or d1 <= 0 or d2 <= 0:
        return None
    beta = spark.sparkContext._jvm.org.apache.commons.math3.special.Beta
    return float(beta.regularizedBeta(d2 / (d2 + d1 * f), d2 / 2.0, d1 / 2.0))


def anova_two_way(spark: SparkSession, df: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """``term, sum_sq, df, F, p_value, eta_sq`` for ``y ~ C(a) + C(b)`` (type II).

    Undefined statistics (F and p of the residual row, tests without degrees of
    freedom or without residual) are NULL; a table without rows gives zeros.
    """
    raw = cell_stats(df, y, a, b).select(F.col(a).alias("a"), F.col(b).alias("b"), "n", "mean", "ssw")
    raw = materialize(raw, "anova-cells")
    n, mu = raw.agg(F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")).first()
    n, mu = n or 0, mu or 0.0
    dev = F.col("mean") - F.lit(mu)
    cells = materialize(raw.select("a", "b", "n", (F.col("n") * dev).alias("s"),
                                   (F.col("ssw") + F.col("n") * dev * dev).alias("ss")), "anova-centred")
    total = cells.agg(F.sum("ss")).first()[0] or 0.0
    levels, between, count = {}, {}, {}
    for c in ("a", "b"):
        levels[c] = materialize(cells.groupBy(c).agg(F.sum("n").alias("n"), F.sum("s").alias("s")), f"anova-{c}")
        count[c], between[c] = levels[c].agg(
            F.count(F.lit(1)), F.coalesce(F.sum(F.col("s") * F.col("s") / F.col("n")), F.lit(0.0))).first()
    x, z = ("a", "b") if count["a"] <= count["b"] else ("b", "a")
    ss = {x: adjusted_ss(cells.select(F.col(x).alias("x"), F.col(z).alias("z"), "n"),
                         levels[x].withColumnRenamed(x, "x"), levels[z].withColumnRenamed(z, "z"), total)}
    rss = max(total - between[z] - ss[x], 0.0)
    ss[z] = max(between[z] + ss[x] - between[x], 0.0)
    if rss <= 1e-14 * total:
        rss = 0.0
    parts = bipartite_parts(cells, "a", "b", count["a"], count["b"])
    d = {c: float(count[c] - parts) for c in ("a", "b")}
    d_r = float(n - count["a"] - count["b"] + parts)
    every = ss["a"] + ss["b"] + rss
    share = lambda v: v / every if every > 0 else None
    out = []
    for c, term in (("a", a), ("b", b)):
        f = (ss[c] / d[c]) / (rss / d_r) if d[c] > 0 and d_r > 0 and rss > 0 else None
        out.append((term, ss[c], d[c], f, f_tail(spark, f, d[c], d_r), share(ss[c])))
    out.append(("Residual", rss, d_r, None, None, share(rss)))
    return spark.createDataFrame(out, ANOVA_SCHEMA)
