"""Label counts and label rates per group.

All rates are computed with conditional aggregates in one pass (no
separate scans per label and no join between them).  Each is a hash
aggregation with map-side partial aggregation, so a hot group does not
pile its rows into a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from normlens.constants import NEGATIVE, POSITIVE
from normlens.functions.text import (bin_edges, ends_with_question, equal_width_bin,
                                     equal_width_params, is_restrictive)


def label_counts(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Rows per label value (NULL labels not counted)."""
    return (df.filter(F.col(label_col).isNotNull()).groupBy(label_col)
            .agg(F.count(F.lit(1)).alias("n")))


def filter_label(df: DataFrame, label_col: str = "label", value: str = POSITIVE) -> DataFrame:
    return df.filter(F.col(label_col) == value)


def count_by(df: DataFrame, group_col: str, label_col: str = "label",
             value: str | None = POSITIVE) -> DataFrame:
    """Rows per non-NULL group, optionally only rows with ``label == value``."""
    src = df if value is None else filter_label(df, label_col, value)
    return (src.filter(F.col(group_col).isNotNull()).groupBy(group_col)
            .agg(F.count(F.lit(1)).alias("n")))


def rate_by(df: DataFrame, group_col: str, label_col: str = "label",
            positive: str = POSITIVE, negative: str = NEGATIVE,
            null_rule: str = "positive") -> DataFrame:
    """Positive-label rate per group over rows labelled positive or negative.

    Groups appear when they have at least one such row (NULL group dropped).
    ``null_rule='positive'``: rate NULL when the group has no positive row;
    ``null_rule='both'``: rate NULL unless both labels occur.
    Output: ``group, n_<positive>, n_<negative>, total, rate``.
    """
    lab = F.col(label_col)
    g = (df.filter(F.col(group_col).isNotNull() & lab.isin(positive, negative))
         .groupBy(group_col)
         .agg(F.count_if(lab == positive).alias(f"n_{positive}"),
              F.count_if(lab == negative).alias(f"n_{negative}")))
    npos, nneg = F.col(f"n_{positive}"), F.col(f"n_{negative}")
    total = npos + nneg
    raw = npos.cast("double") / total.cast("double")
    if null_rule == "positive":
        rate = F.when(npos > 0, raw)
    elif null_rule == "both":
        rate = F.when((npos > 0) & (nneg > 0), raw)
    else:
        raise ValueError("null_rule must be 'positive' or 'both'")
    return g.select(group_col, f"n_{positive}", f"n_{negative}",
                    total.alias("total"), rate.alias("rate"))


def top_rates(rates: DataFrame, group_col: str, n: int, rate_col: str = "rate") -> DataFrame:
    """Highest ``n`` rates (NULLs last, ties by group) with 1-based ``rank``."""
    top = rates.orderBy(F.col(rate_col).desc_nulls_last(), F.col(group_col).asc()).limit(n)
    w = Window.orderBy(F.col(rate_col).desc_nulls_last(), F.col(group_col).asc())
    return top.withColumn("rank", F.row_number().over(w))


def tail_rates(rates: DataFrame, group_col: str, n: int, rate_col: str = "rate") -> DataFrame:
    """Lowest ``n`` positive rates, ranked as shown (descending)."""
    low = (rates.filter(F.col(rate_col) > 0)
           .orderBy(F.col(rate_col).asc(), F.col(group_col).desc()).limit(n))
    w = Window.orderBy(F.col(rate_col).desc(), F.col(group_col).asc())
    return low.withColumn("rank", F.row_number().over(w))


def questions(df: DataFrame, body_col: str = "body") -> DataFrame:
    return df.filter(ends_with_question(body_col))


def restrictive(df: DataFrame, reason_col: str = "target_reason",
                word_boundary: bool = False) -> DataFrame:
    return df.filter(is_restrictive(reason_col, word_boundary=word_boundary))


def unrestrictive(df: DataFrame, reason_col: str = "target_reason",
                  word_boundary: bool = False) -> DataFrame:
    """Complement of :func:`restrictive` (NULL reasons belong here)."""
    return df.filter(~is_restrictive(reason_col, word_boundary=word_boundary))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def length_counts(df: DataFrame, text_col: str = "body", label_col: str = "label",
                  positive: str = POSITIVE) -> DataFrame:
    """One pass over the texts: rows and positive rows per exact text length.

    NULL text has no length and is left out.  The result has one row per
    distinct length, so everything after it works on a small table.
    """
    ln = F.length(F.col(text_col))
    return (df.select(ln.alias("length"), F.col(label_col).alias("_lab"))
            .filter(F.col("length").isNotNull())
            .groupBy("length").agg(F.count(F.lit(1)).alias("n"),
                                   F.count_if(F.col("_lab") == positive).alias("n_positive")))


def bin_rates(counts: DataFrame, spark: SparkSession, n_bins: int = 20,
              positive: str = POSITIVE) -> DataFrame:
    """Positive rate per equal-width length bin from :func:`length_counts`.

    Min and max come from a scalar subquery; the bin spine ``1..n_bins`` is
    left-joined so empty bins stay (rate NULL).
    """
    params = counts.agg(equal_width_params(F.min("length"), F.max("length"), n_bins)
                        .alias("p")).scalar()
    binned = (counts.withColumn("_pp", params)
              .select(equal_width_bin(F.col("length"), F.col("_pp"), n_bins).alias("bin"),
                      "n", "n_positive"))
    per_bin = binned.groupBy("bin").agg(F.sum("n").alias("n_comments"),
                                        F.sum("n_positive").alias(f"n_{positive}"))
    spine = (spark.range(1, n_bins + 1).select(F.col("id").cast("int").alias("bin"))
             .withColumn("_p", params))
    left, right = bin_edges(F.col("_p"), n_bins, F.col("bin"))
    return spine.join(per_bin, "bin", "left").select(
        "bin", left.alias("bin_left"), right.alias("bin_right"),
        F.coalesce(F.col("n_comments"), F.lit(0)).alias("n_comments"),
        F.try_divide(F.col(f"n_{positive}").cast("double"),
                     F.col("n_comments").cast("double")).alias("rate"))


def length_bin_rates(df: DataFrame, spark: SparkSession, text_col: str = "body",
                     label_col: str = "label", positive: str = POSITIVE,
                     n_bins: int = 20) -> DataFrame:
    """Positive rate per equal-width bin of text length; empty bins kept (rate NULL).

    Lazy composition of :func:`length_counts` and :func:`bin_rates`; for very
    large inputs write the length counts once (``session.materialize``) and
    bin that, so the texts are read a single time.
    """
    return bin_rates(length_counts(df, text_col, label_col, positive), spark, n_bins, positive)
