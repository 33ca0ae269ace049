"""Prepared splits: a Parquet dataset by community and split, and CSV files per community."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from normlens.sources.named_files import file_path, relative_path, write_named
from normlens.sources.readers import csv_header, read_csv

SPLIT_FILES = {"test": "tests.csv", "shots": "shots.csv"}
EXAMPLE_SCHEMA = T.StructType([
    T.StructField("comment_id", T.LongType()),
    T.StructField("body", T.StringType()),
    T.StructField("norm", T.StringType()),
    T.StructField("true_label", T.StringType()),
])


def write_splits(df: DataFrame, path: str, community_col: str = "subreddit_id") -> str:
    """Write prepared examples partitioned by (community, split).

    Rows are clustered by the partition columns first so each task writes
    few files per partition directory.
    """
    (df.repartition(community_col, "split")
       .write.mode("overwrite").partitionBy(community_col, "split").parquet(path))
    return path


def read_split(spark: SparkSession, path: str, split: str | None = None,
               communities: list[str] | DataFrame | None = None,
               community_col: str = "subreddit_id", schema=None) -> DataFrame:
    """Read prepared examples; filters on the partition columns prune directories.

    ``communities`` is a list of ids or a frame with ``community_col``.  A frame
    of any size is joined, and its ids prune directories while the query runs
    (dynamic partition pruning), so no id list passes through the driver.
    Pass the written schema to read an empty dataset (no partition dirs).
    """
    r = spark.read.schema(schema) if schema is not None else spark.read
    df = r.parquet(path)
    if split is not None:
        df = df.filter(F.col("split") == split)
    if isinstance(communities, DataFrame):
        df = df.join(communities.select(community_col), community_col, "left_semi")
    elif communities:
        df = df.filter(F.col(community_col).isin(list(communities)))
    return df


def _csv_field(name: str) -> F.Column:
    """A quoted CSV field; NULL is an empty field (read back, an empty text is NULL too)."""
    text = F.col(name).cast("string")
    return F.coalesce(F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"')), F.lit(""))


def write_split_csv(df: DataFrame, base: str, community_col: str = "subreddit_id") -> str:
    """``<base>/<community>/tests.csv`` and ``shots.csv``, rows by id (a file holds one draw)."""
    names = EXAMPLE_SCHEMA.fieldNames()
    line = F.concat_ws(",", *[_csv_field(c) for c in names])
    per = df.where(F.col("split").isin(*SPLIT_FILES)).groupBy(community_col, "split").agg(
        F.array_sort(F.collect_list(F.struct("comment_id", line.alias("line")))).alias("rows"))
    file = F.concat(F.col(community_col), F.lit("/"),
                    *[F.when(F.col("split") == s, F.lit(f)).otherwise(F.lit("")) for s, f in SPLIT_FILES.items()])
    text = F.concat(F.lit(",".join(names) + "\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n"))
    write_named(per.select(file.alias("file"), text.alias("content")), base)
    return base


def read_split_csv(spark: SparkSession, base: str, split: str | None = None,
                   community_col: str = "subreddit_id") -> DataFrame:
    """Examples of every ``tests.csv`` and ``shots.csv`` below ``base``, community and split from the path.

    One recursive scan for all communities.  The community is the folder of the
    file.  A folder without such files, or not there, has no rows.
    """
    files = [SPLIT_FILES[split]] if split else list(SPLIT_FILES.values())
    options = {"recursiveFileLookup": "true", "pathGlobFilter": "{" + ",".join(files) + "}"}
    try:
        csv_header(spark, base, **options)
    except AnalysisException:
        return spark.createDataFrame([], T.StructType([T.StructField(community_col, T.StringType()),
                                                       T.StructField("split", T.StringType()), *EXAMPLE_SCHEMA.fields]))
    df = read_csv(spark, base, EXAMPLE_SCHEMA, extra={"path": file_path()}, **options)
    parts = F.split(relative_path(F.col("path"), base), "/")
    name = F.element_at(parts, -1)
    kind = F.coalesce(*[F.when(name == f, F.lit(s)) for s, f in SPLIT_FILES.items()])
    return df.select(F.get(parts, F.size(parts) - 2).alias(community_col), kind.alias("split"), *EXAMPLE_SCHEMA.fieldNames())
