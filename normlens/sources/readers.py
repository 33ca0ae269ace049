"""CSV / JSON readers with explicit schemas (no inference)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normlens.functions.literal import parse_rule_literal
from normlens.functions.text import trim_or_empty
from normlens.session import materialize
from normlens.sources.named_files import file_path, relative_path

COMMENTS_SCHEMA = T.StructType([
    T.StructField("comment_id", T.LongType()),
    T.StructField("subreddit_id", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("target_reason", T.StringType()),
    T.StructField("assigned_rule_cluster", T.StringType()),
])

COMMUNITIES_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("display_name_prefixed", T.StringType()),
    T.StructField("public_description", T.StringType()),
])

SCORES_SCHEMA = T.StructType([
    T.StructField("subreddit", T.StringType()),
    T.StructField("n_items", T.LongType()),
    *[T.StructField(c, T.DoubleType()) for c in (
        "in_cluster_sim_mean", "in_cluster_sim_std", "cross_cluster_sim_mean",
        "cross_cluster_sim_std", "contrastive_score_mean", "contrastive_score_std")],
])

# CSV dialect of the corpus files: header row, RFC-4180 quoting with doubled
# quotes, bodies that span lines, whitespace kept.
_CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"',
        "mode": "FAILFAST", "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType,
             extra: dict[str, Column] | None = None, **options) -> DataFrame:
    """CSV with an explicit schema, bound by header name; NaN in double columns becomes NULL.

    Columns may stand in any order and others are left out; an absent column
    raises, and so does a file whose header differs from the first one's.
    ``extra`` names expressions over the file's metadata to add.  ``multiLine``
    is on by default, for bodies that span lines; a file is then read by one
    task.  Without such bodies, ``multiLine=False`` lets large files be split.
    """
    opts = dict(_CSV, enforceSchema="false", **{k: str(v).lower() if isinstance(v, bool) else str(v)
                                                 for k, v in options.items()})
    header = csv_header(spark, path, **options)
    absent = [f.name for f in schema.fields if f.name not in header]
    if absent:
        raise ValueError(f"columns not in the CSV header: {absent}")
    types = {f.name: f.dataType for f in schema.fields}
    whole = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])
    df = spark.read.options(**opts).schema(whole).csv(path)
    df = df.select(*schema.fieldNames(), *[c.alias(n) for n, c in (extra or {}).items()])
    return nan_to_null(df)


def csv_header(spark: SparkSession, path: str, **options) -> list[str]:
    """Column names of the first file's header line."""
    return spark.read.options(**dict(_CSV, **{k: str(v) for k, v in options.items()})).csv(path).columns


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN -> NULL in every floating column (NaN compares greater than any number)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.nanvl(c, F.lit(None).cast(f.dataType))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def with_row_ids(spark: SparkSession, path: str, schema: T.StructType, id_col: str = "comment_id",
                 **options) -> DataFrame:
    """CSV rows with an id that depends on the file's path below ``path`` and the row's place in it.

    Adding other files, moving the base folder or reading in other splits leaves
    ids as they are.  Rows are stored once in reading order; rows of one file
    block are numbered by their order, and the counts of earlier blocks of the
    file are added.  A file's ids are consecutive from a 62-bit hash of its path, so
    files overlap only by accident (about files^2 x rows / 2^62); that is checked and raises.
    Columns ``source_file`` and ``source_row`` (0-based) hold the place itself.
    """
    rows = read_csv(spark, path, schema, extra={
        "source_file": relative_path(file_path(), path), "_block": F.col("_metadata.file_block_start"),
        "_seq": F.monotonically_increasing_id()}, **options)
    rows = materialize(rows, "csv-rows")
    blocks = rows.groupBy("source_file", "_block").agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("source_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = materialize(blocks.select(
        "*", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.col("_first").alias("_start"), F.xxhash64("source_file").bitwiseAND((1 << 62) - 1).alias("_base")).drop("_first"),
        "csv-blocks")
    files = blocks.groupBy("source_file", "_base").agg(F.sum("_n").alias("n")).select(
        "source_file", "_base", (F.col("_base") + F.col("n")).alias("_end"))
    # ranges meet inside the stretches of 2^48 ids that they touch
    stretch = F.sequence(F.shiftright("_base", 48), F.shiftright("_end", 48))
    later = Window.partitionBy("_stretch").orderBy("_base", "source_file")
    met = files.withColumn("_stretch", F.explode(stretch)).withColumn("_next", F.lead("_base").over(later)).where("_next < _end")
    if not met.isEmpty():
        raise ValueError("ids of two files overlap; rename one of them")
    place = (F.col("_seq") - F.col("_start") + F.col("_before")).alias("source_row")
    out = rows.join(blocks, ["source_file", "_block"]).select("*", place)
    return out.select((F.col("_base") + F.col("source_row")).alias(id_col), *schema.fieldNames(), "source_file", "source_row")


def read_comments(spark: SparkSession, path: str, **options) -> DataFrame:
    """Labelled comments; files without ``comment_id`` get ids by file and row (see :func:`with_row_ids`)."""
    if "comment_id" in csv_header(spark, path, **options):
        return read_csv(spark, path, COMMENTS_SCHEMA, **options)
    rest = T.StructType([f for f in COMMENTS_SCHEMA.fields if f.name != "comment_id"])
    return with_row_ids(spark, path, rest, **options).select(*COMMENTS_SCHEMA.fieldNames())


def read_communities(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, COMMUNITIES_SCHEMA)


def read_scores(spark: SparkSession, path: str, schema: T.StructType = SCORES_SCHEMA) -> DataFrame:
    return read_csv(spark, path, schema)


def write_csv(df: DataFrame, path: str) -> str:
    """CSV in the same dialect (quotes doubled, whitespace kept, '' for NULL)."""
    (df.write.mode("overwrite").options(**{k: v for k, v in _CSV.items() if k != "mode"})
       .option("quoteAll", "false").csv(path))
    return path


def parsed_rules(df: DataFrame, community_col: str = "subreddit_id", rules_col: str = "rules") -> DataFrame:
    """(community, parsed struct<rules, error, bad>) of every cell, parsed once and stored.

    Rules and rejects are both read from it.
    """
    cells = df.select(F.trim(F.col(community_col)).alias(community_col), parse_rule_literal(F.col(rules_col)).alias("parsed"))
    return materialize(cells, "parsed-rules")


def rule_rejects(parsed: DataFrame, community_col: str = "subreddit_id") -> DataFrame:
    """(community, error, rule_place): cells that hold no rule list, and list elements that are no rule.

    ``rule_place`` is NULL for a whole cell.
    """
    cells = parsed.where("parsed.error IS NOT NULL").select(
        community_col, F.col("parsed.error").alias("error"), F.lit(None).cast("bigint").alias("rule_place"))
    bad = parsed.select(community_col, F.explode("parsed.bad").alias("p"))
    return cells.unionByName(bad.select(community_col, F.lit("not_a_rule").alias("error"),
                                        F.col("p").cast("bigint").alias("rule_place")))


def rule_rows(parsed: DataFrame, community_col: str = "subreddit_id") -> DataFrame:
    """One row per readable rule: ``community, rule_no, short_name, violation_reason, rule_text``.

    ``rule_text = '<short_name>: <violation_reason>'`` (missing -> '').
    """
    ex = parsed.select(community_col, F.posexplode("parsed.rules").alias("rule_no", "_r"))
    name = trim_or_empty(F.col("_r.short_name"))
    reason = trim_or_empty(F.col("_r.violation_reason"))
    return ex.select(community_col, F.col("rule_no").cast("bigint").alias("rule_no"),
                     F.col("_r.short_name").alias("short_name"),
                     F.col("_r.violation_reason").alias("violation_reason"),
                     F.concat(name, F.lit(": "), reason).alias("rule_text"))


def explode_rules(df: DataFrame, community_col: str = "subreddit_id",
                  rules_col: str = "rules") -> DataFrame:
    """Python-literal rule lists -> one row per rule (see :func:`rule_rows`; rejects are lost here)."""
    return rule_rows(parsed_rules(df, community_col, rules_col), community_col)


def read_rule_cells(spark: SparkSession, path: str) -> DataFrame:
    """Rules CSV with padded headers and cells (``subreddit_id, rules``), as text."""
    raw = (spark.read.option("header", "true").option("multiLine", "true")
           .option("escape", '"').option("ignoreLeadingWhiteSpace", "true")
           .csv(path))
    return raw.toDF(*[c.strip() for c in raw.columns])


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rule rows of a rules CSV; :func:`rule_rejects` of the same parse lists what cannot be read."""
    return explode_rules(read_rule_cells(spark, path))


def write_rules_csv(rules: DataFrame, path: str, community_col: str = "subreddit_id",
                    rules_col: str = "rules") -> str:
    """Rules as CSV text files with a space after each delimiter, a header in each."""
    quoted = F.concat(F.lit('"'), F.replace(F.col(rules_col), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat(F.col(community_col), F.lit(", "), F.coalesce(quoted, F.lit("")))
    (rules.select(line.alias(f"{community_col}, {rules_col}")).write.mode("overwrite")
     .option("header", "true").option("quote", "").option("delimiter", "\u0001").csv(path))
    return path
