"""Dimension helpers: first-row-per-key and counts with names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_by_key(df: DataFrame, key: str, order_col: str,
                 keep: Sequence[str] | None = None) -> DataFrame:
    """One row per ``key``: the row with the smallest ``order_col`` (unique).

    A hash aggregation with ``min_by`` (partial aggregation map-side), so
    a key with very many rows never lands in one sort.
    """
    keep = [c for c in (keep or df.columns) if c != key]
    picked = df.groupBy(key).agg(F.min_by(F.struct(*keep), F.col(order_col)).alias("_r"))
    return picked.select(key, *[F.col("_r")[c].alias(c) for c in keep])


def distinct_rows(df: DataFrame) -> DataFrame:
    """Full-row distinct with a 32-byte digest of the row as key of the shuffle.

    Equal rows meet by digest; one of them (they are equal) carries the values,
    combined before the shuffle, so long texts are neither compared nor hashed
    again as grouping keys.
    """
    digest = F.unhex(F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256))
    one = df.select(digest.alias("_k"), F.struct(*df.columns).alias("_r")).groupBy("_k").agg(F.first("_r").alias("_r"))
    return one.select("_r.*")


def distinct_counts(df: DataFrame, key: str, cols: Sequence[str] | None = None,
                    out: str = "count") -> DataFrame:
    """Distinct rows per ``key`` without shuffling the rows themselves.

    Each row is reduced to a SHA-256 digest of its canonical JSON form
    (NULLs encoded explicitly), and digests are counted per key; only
    (key, digest) pairs cross the shuffle, not long text columns.  Spark
    plans the distinct count as a two-phase aggregation, so a hot key is
    spread over (key, digest) before the final count.
    """
    cols = [c for c in (cols or df.columns)]
    digest = F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)
    return df.groupBy(key).agg(F.count_distinct(digest).alias(out))


def counts_with_names(df: DataFrame, dim: DataFrame, key: str = "subreddit_id",
                      dim_key: str = "name", names: Sequence[str] = ("display_name_prefixed",)) -> DataFrame:
    """Rows per key, left-joined to a (deduplicated) dimension for names."""
    c = df.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    d = dim.select(F.col(dim_key).alias(key), *names)
    return c.join(d, key, "left")
