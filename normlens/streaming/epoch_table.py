"""A table rewritten as a whole by every micro-batch, safe against stops at any moment.

Layout: ``<path>/epochs/epoch=<id>`` holds a complete version,
``<path>/pointers/epoch=<id>`` one row that names it, written after it.  A
reader takes the newest version that has a pointer, so a job killed while it
writes leaves the version before in place, and the restarted stream writes the
same epoch again.  Nothing is deleted before its successor is complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

POINTER = "rows long"


def write_version(batch: DataFrame, path: str, epoch_id: int) -> None:
    """The data of an epoch; not visible yet."""
    batch.write.mode("overwrite").parquet(f"{path}/epochs/epoch={epoch_id}")


def write_pointer(spark: SparkSession, path: str, epoch_id: int) -> None:
    """Make an epoch visible, with its row count read back from what was written."""
    rows = spark.read.parquet(f"{path}/epochs/epoch={epoch_id}").agg(F.count(F.lit(1)).alias("rows"))
    rows.write.mode("overwrite").parquet(f"{path}/pointers/epoch={epoch_id}")


def current_epoch(spark: SparkSession, path: str) -> int | None:
    """The newest epoch with a pointer, or None."""
    try:
        pointers = spark.read.schema(POINTER + ", epoch long").parquet(f"{path}/pointers")
    except AnalysisException:
        return None
    return pointers.agg(F.max("epoch")).first()[0]


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version; raises before the first one is complete."""
    epoch = current_epoch(spark, path)
    if epoch is None:
        raise FileNotFoundError(f"no complete version under {path}")
    return spark.read.parquet(f"{path}/epochs/epoch={epoch}")


def drop_versions(spark: SparkSession, path: str, before: int) -> None:
    """Remove epochs older than ``before``: pointer first, then data, so that no pointer dangles."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for part in ("pointers", "epochs"):
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{part}")
        fs = folder.getFileSystem(conf)
        for entry in fs.listStatus(folder) if fs.exists(folder) else []:
            name = entry.getPath().getName()
            if name.startswith("epoch=") and int(name[6:]) < before:
                fs.delete(entry.getPath(), True)


def epoch_writer(path: str, keep: int = 3):
    """``foreachBatch`` function: version, then pointer; the last ``keep`` versions stay for running readers."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        write_version(batch, path, epoch_id)
        write_pointer(spark, path, epoch_id)
        drop_versions(spark, path, epoch_id - keep + 1)
    return write
