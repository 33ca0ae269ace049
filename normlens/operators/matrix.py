"""Cross-community accuracy grid in long form ``(prompt, eval, accuracy)``.

The grid is never a dense matrix and never built with a keyless join: the
full (prompt x eval) axis is an equi-join on block numbers (:func:`paired`),
then joined to the cells.
``pivot`` is only used for the display matrix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normlens.functions.index import row_ranks
from normlens.functions.text import community_label

P, E, A = "prompt_community", "eval_community", "accuracy"


def paired(left: DataFrame, right: DataFrame, by: str, blocks: int | None = None) -> DataFrame:
    """Every row of ``left`` beside every row of ``right``, as an equi-join.

    Rows of ``right`` are dealt over blocks by the hash of ``by``; ``left``, the
    smaller side, is copied once per block.  No list of names is collected and
    no axis size is bounded; the pairs are made by as many tasks as blocks.
    """
    n = blocks or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = right.withColumn("_block", F.pmod(F.xxhash64(by), F.lit(n)).cast("int"))
    copied = left.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return copied.join(dealt, "_block").drop("_block")


def _axes(communities: DataFrame, name_col: str) -> DataFrame:
    names = communities.select(name_col).distinct()
    return paired(names.where(F.col(name_col).isNotNull()).withColumnRenamed(name_col, P),
                  names.withColumnRenamed(name_col, E), E)


def axis_size(communities: DataFrame, name_col: str = "name") -> Column:
    return communities.select(F.count_distinct(name_col)).scalar()


def full_grid(cells: DataFrame, communities: DataFrame, name_col: str = "name") -> DataFrame:
    """Every (prompt, eval) pair of the community list with its accuracy or NULL."""
    return _axes(communities, name_col).join(cells.select(P, E, A), [P, E], "left")


def pending_cells(communities: DataFrame, finished: DataFrame, name_col: str = "name") -> DataFrame:
    """Grid cells without a finished run (anti join on prompt and eval)."""
    return _axes(communities, name_col).join(finished.select(P, E), [P, E], "left_anti")


def normalize_by_diagonal(cells: DataFrame) -> DataFrame:
    """Divide each eval row by its own (e, e) cell when that cell is > 0.

    The window is partitioned by eval community, so a partition holds one
    grid row (at most one cell per prompt community).
    """
    diag = F.max(F.when(F.col(P) == F.col(E), F.col(A))).over(Window.partitionBy(E))
    return (cells.withColumn("diag", diag)
            .withColumn("norm_accuracy",
                        F.when(F.col("diag") > 0, F.col(A) / F.col("diag")).otherwise(F.col(A))))


def eval_means(cells: DataFrame, communities: DataFrame, value: str = A,
               name_col: str = "name") -> DataFrame:
    """Mean per eval community over the whole axis; NULL when any cell is missing."""
    n = axis_size(communities, name_col)
    g = cells.filter(F.col(value).isNotNull()).groupBy(E).agg(
        F.count(F.lit(1)).alias("n_cells"), F.avg(value).alias("_m"))
    axis = communities.select(F.col(name_col).alias(E)).distinct()
    return axis.join(g, E, "left").select(
        E, F.coalesce(F.col("n_cells"), F.lit(0)).alias("n_cells"),
        F.when(F.col("n_cells") == n, F.col("_m")).alias("mean_accuracy"))


def prompt_means(cells: DataFrame, communities: DataFrame, value: str = A,
                 name_col: str = "name") -> DataFrame:
    """Mean per prompt community, missing cells skipped (NULL if none)."""
    g = cells.filter(F.col(value).isNotNull()).groupBy(P).agg(
        F.count(F.lit(1)).alias("n_cells"), F.avg(value).alias("mean_accuracy"))
    axis = communities.select(F.col(name_col).alias(P)).distinct()
    return axis.join(g, P, "left").select(
        P, F.coalesce(F.col("n_cells"), F.lit(0)).alias("n_cells"), "mean_accuracy")


def accuracy_matrix(grid: DataFrame, communities: DataFrame, value: str = A,
                    name_col: str = "name") -> DataFrame:
    """Display matrix: one row per eval community, one column per prompt community.

    A column list is schema, so the names come to the driver; the long grid
    needs none of that.
    """
    names = [r[0] for r in communities.select(name_col).distinct().orderBy(name_col).collect()]
    return grid.groupBy(E).pivot(P, names).agg(F.first(value))


def axis_ranks(df: DataFrame, key: str, values: dict[str, str]) -> DataFrame:
    """``key`` with the 1-based position by each value column: ``values`` maps a column to the name of its rank.

    Descending, NULLs last, ties by ``key``.  All columns are ranked together as
    groups of one long table, each spread over as many tasks as it needs.
    """
    long = df.select(key, *[F.col(c).cast("double").alias(c) for c in values]).unpivot(key, list(values), "_axis", "_v")
    ranked = row_ranks(long, ["_axis"], [F.col("_v").desc_nulls_last(), F.col(key).asc()], "_r")
    return ranked.groupBy(key).agg(*[F.max(F.when(F.col("_axis") == c, F.col("_r") + 1)).alias(n) for c, n in values.items()])


def ordered_grid(grid: DataFrame, ranks: DataFrame, key: str, rows: dict[str, str], cols: dict[str, str]) -> DataFrame:
    """The long grid with the position of its eval community among rows and of its prompt community among columns.

    ``rows`` and ``cols`` map columns of ``ranks`` to output names.
    """
    r = ranks.select(F.col(key).alias(E), *[F.col(c).alias(n) for c, n in rows.items()])
    c = ranks.select(F.col(key).alias(P), *[F.col(x).alias(n) for x, n in cols.items()])
    return grid.join(r, E).join(c, P)


def community_labels(communities: DataFrame, counts: DataFrame, name_col: str = "name",
                     display_col: str = "display_name_prefixed",
                     count_key: str = "subreddit_id", count_col: str = "n") -> DataFrame:
    """``'<display> (<id>) | n=<count>'`` per community, count 0 when absent."""
    j = communities.join(counts.select(F.col(count_key).alias(name_col), count_col), name_col, "left")
    n = F.coalesce(F.col(count_col), F.lit(0))
    return j.select(name_col, n.alias("n_comments"),
                    community_label(F.col(display_col), F.col(name_col), n).alias("label"))


def label_grid(cells: DataFrame, communities: DataFrame, name_col: str = "name",
               display_col: str = "display_name_prefixed") -> DataFrame:
    """Cells with ``'<display> (<id>)'`` labels for both roles (two dimension joins)."""
    dim = communities.select(name_col, display_col)
    pl = dim.select(F.col(name_col).alias(P),
                    community_label(F.col(display_col), F.col(name_col)).alias("prompt_label"))
    el = dim.select(F.col(name_col).alias(E),
                    community_label(F.col(display_col), F.col(name_col)).alias("eval_label"))
    return cells.join(pl, P, "left").join(el, E, "left")


def top_pairs(cells: DataFrame, n: int = 20, value: str = A) -> DataFrame:
    """Top ``n`` cells by value (missing dropped), ties by (prompt, eval)."""
    order = [F.col(value).desc(), F.col(P).asc(), F.col(E).asc()]
    top = cells.filter(F.col(value).isNotNull()).orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
