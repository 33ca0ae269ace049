"""Audit-log files: written per run, scanned back into rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_audit_logs(logs: DataFrame, path: str, run_cols: Sequence[str]) -> str:
    """One text file per run directory (``<run col>=<value>/part-*.txt``)."""
    (logs.repartition(*run_cols).write.mode("overwrite").partitionBy(*run_cols).text(path))
    return path


def read_audit_logs(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """Whole files under ``path`` (recursively), with the decoded file path."""
    df = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
          .text(path, wholetext=True))
    return df.select(F.try_url_decode(F.col("_metadata.file_path")).alias("path"), "value")
