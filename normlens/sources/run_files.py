"""Run outputs on disk: result rows and run metrics as JSON, and their scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normlens.sources.named_files import file_path, relative_path, write_named

RUN_METRICS_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("directory", T.StringType()),
    T.StructField("num_tests", T.LongType()),
    T.StructField("num_successes", T.LongType()),
    T.StructField("batch_size", T.LongType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("violation_precision", T.DoubleType()),
    T.StructField("non_violation_precision", T.DoubleType()),
    T.StructField("violation_recall", T.DoubleType()),
    T.StructField("non_violation_recall", T.DoubleType()),
    T.StructField("confusion_matrix", T.ArrayType(T.ArrayType(T.LongType()))),
])


OPEN_FILES = 64


def write_json(df: DataFrame, path: str, partition_cols: Sequence[str] = (), compression: str | None = None) -> str:
    """JSON lines, NULL fields kept, one directory per partition value.

    A task writes up to ``OPEN_FILES`` partition values at once, so rows need no
    sort by them (with long texts it spills more than is written); rows of
    further values are sorted.  ``compression`` is a codec of Spark's JSON writer.
    """
    w = df.write.mode("overwrite").option("ignoreNullFields", "false")
    if compression:
        w = w.option("compression", compression)
    if not partition_cols:
        w.json(path)
        return path
    conf, key = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(key)
    conf.set(key, str(max(OPEN_FILES, int(before))))
    try:
        w.partitionBy(*partition_cols).json(path)
    finally:
        conf.set(key, before)
    return path


def scan_run_metrics(spark: SparkSession, base: str, layout: str = "partitioned",
                     schema: T.StructType = RUN_METRICS_SCHEMA) -> DataFrame:
    """Every run-metrics record under ``base`` with keys taken from its path.

    ``layout='partitioned'``: files written by :func:`write_json` with
    ``model_folder=<m>`` directories (JSON lines).
    ``layout='nested'``: ``<base>/<directory...>/<model_folder>/metrics.json``,
    one pretty-printed object per file; ``directory`` is the path between
    ``base`` and the model folder.  One recursive scan, no per-file opens.
    """
    r = spark.read.schema(schema).option("recursiveFileLookup", "true")
    if layout == "nested":
        r = r.option("multiLine", "true").option("pathGlobFilter", "metrics.json")
    else:
        r = r.option("pathGlobFilter", "*.json")
    df = r.json(base).withColumn("path", file_path())
    if layout == "nested":
        parts = F.split(relative_path(F.col("path"), base), "/")
        return (df.withColumn("model_folder", F.element_at(parts, -2))
                .withColumn("directory_path", F.array_join(F.slice(parts, 1, F.size(parts) - 2), "/")))
    return df.withColumn("model_folder", F.regexp_extract("path", r"model_folder=([^/]+)", 1))


def pretty_record(columns: Sequence[str], indent: int = 2) -> F.Column:
    """The named columns as one indented JSON object (nested values on one line)."""
    pad = " " * indent
    fields = [F.concat(F.lit(f'{pad}"{c}": '), _json_value(c)) for c in columns]
    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *fields), F.lit("\n}"))


def _json_value(name: str) -> F.Column:
    """JSON text of a column, NULL as ``null``: an array of one, without its brackets."""
    text = F.to_json(F.array(F.col(name)), {"ignoreNullFields": "false"})
    return F.substr(text, F.lit(2), F.length(text) - 2)


def write_run_records(df: DataFrame, base: str, directory: str = "directory", model_folder: str = "model_folder",
                      columns: Sequence[str] = tuple(f.name for f in RUN_METRICS_SCHEMA.fields)) -> str:
    """One pretty-printed ``<base>/<directory>/<model_folder>/metrics.json`` per run row."""
    rows = df.select(F.concat_ws("/", directory, model_folder, F.lit("metrics.json")).alias("file"),
                     pretty_record(columns).alias("content"))
    write_named(rows, base)
    return base
