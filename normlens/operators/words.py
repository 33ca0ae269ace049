"""Word statistics per label over whole comment texts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from normlens.constants import ALL_STOPWORDS, NEGATIVE, POSITIVE
from normlens.functions.text import clean_text, split_whitespace


def word_counts(df: DataFrame, text_col: str = "body", label_col: str = "label",
                positive: str = POSITIVE, negative: str = NEGATIVE) -> DataFrame:
    """Occurrences of each cleaned word in positive and in negative rows.

    Texts are HTML-decoded, stripped of punctuation, lower-cased and split on
    whitespace; a NULL text yields no words.  One ``explode`` + one hash
    aggregation with two conditional counts; hot words are pre-aggregated
    map-side.  Words seen only in rows with other labels are left out.
    """
    lab = F.col(label_col)
    # explode first, drop empty tokens after: cheaper than filtering arrays
    exploded = (df.filter(lab.isin(positive, negative))
                .select(F.explode(split_whitespace(clean_text(F.col(text_col)))).alias("word"),
                        lab.alias("_lab"))
                .filter(F.col("word") != ""))
    return exploded.groupBy("word").agg(
        F.count_if(F.col("_lab") == positive).alias(f"n_{positive}"),
        F.count_if(F.col("_lab") == negative).alias(f"n_{negative}"),
    ).withColumn("total", F.col(f"n_{positive}") + F.col(f"n_{negative}"))


def word_rates(counts: DataFrame, positive: str = POSITIVE, min_total: int = 20,
               stopwords: Iterable[str] | None = ALL_STOPWORDS) -> DataFrame:
    """``P(positive | word)`` for words with ``total >= min_total``, stopwords removed."""
    out = counts.filter(F.col("total") >= min_total)
    if stopwords:
        out = out.filter(~F.col("word").isin(sorted(stopwords)))
    return out.withColumn("rate", F.col(f"n_{positive}").cast("double") / F.col("total"))


def top_words(rates: DataFrame, n: int = 50) -> DataFrame:
    """Highest rates (ties by word) with 1-based ``rank``."""
    order = [F.col("rate").desc(), F.col("word").asc()]
    return rates.orderBy(*order).limit(n).withColumn(
        "rank", F.row_number().over(Window.orderBy(*order)))


def low_words(rates: DataFrame, n: int = 50) -> DataFrame:
    """Lowest non-zero rates (ties by word) with 1-based ``rank``."""
    order = [F.col("rate").asc(), F.col("word").asc()]
    return rates.filter(F.col("rate") > 0).orderBy(*order).limit(n).withColumn(
        "rank", F.row_number().over(Window.orderBy(*order)))


def unique_words(counts: DataFrame, positive: str = POSITIVE, negative: str = NEGATIVE,
                 n: int = 10, stopwords: Iterable[str] | None = None) -> DataFrame:
    """Most frequent words seen under one label only, ``n`` per label.

    Output ``label, word, n, rank``.  Stopwords are kept unless given.
    """
    c = counts
    if stopwords:
        c = c.filter(~F.col("word").isin(sorted(stopwords)))
    npos, nneg = F.col(f"n_{positive}"), F.col(f"n_{negative}")
    side = (F.when((nneg == 0) & (npos > 0), F.lit(positive))
            .when((npos == 0) & (nneg > 0), F.lit(negative)))
    both = (c.select(side.alias("label"), "word", F.greatest(npos, nneg).alias("n"))
            .filter(F.col("label").isNotNull()))
    w = Window.partitionBy("label").orderBy(F.col("n").desc(), F.col("word").asc())
    # filter on row_number: Spark inserts a partial per-label limit before the shuffle
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
