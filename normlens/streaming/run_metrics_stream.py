"""Run metrics kept current while replies arrive.

Reply files (one JSON row per batch: run keys, ``batch_no``, ``content``)
land in a folder.  A file-source stream parses them with the same
expressions as the batch job, joins the static truth (stream-static
equi-join), and maintains per-run counts in state.  Each micro-batch
writes the complete result as a new version of an epoch table, visible once it
is whole (``epoch_table``), and result rows can be appended to a second sink.
Progress lives in the checkpoint folder, so a stopped or failed job resumes
where it left off.  The state holds one row per run, bounded by the
experiment grid, so no watermark is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from normlens.constants import BATCH_SIZE
from normlens.operators.metrics import join_truth, run_metrics, unmatched_predictions
from normlens.operators.parse import parse_outputs, predictions
from normlens.streaming.epoch_table import epoch_writer, read_current


def reply_schema(run_cols: Sequence[str]) -> T.StructType:
    return T.StructType([*[T.StructField(c, T.StringType()) for c in run_cols],
                         T.StructField("batch_no", T.IntegerType()),
                         T.StructField("content", T.StringType())])


def stream_results(spark: SparkSession, landing: str, truth: DataFrame,
                   run_cols: Sequence[str] = ("run",), batch_size: int = BATCH_SIZE,
                   max_files_per_trigger: int | None = None, keys: Sequence[str] | None = None,
                   rejects: bool = False) -> DataFrame:
    """Streaming frame of result rows (prediction joined to truth).

    ``keys`` are columns of both sides, by default ``comment_id`` and those
    ``run_cols`` that the truth has, as ids restart in every scope.
    ``rejects`` gives the predictions without truth instead.
    """
    if keys is None:
        keys = [*(c for c in run_cols if c in truth.columns), "comment_id"]
    reader = spark.readStream.schema(reply_schema(run_cols))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    replies = reader.json(landing)
    parsed = parse_outputs(replies, "content", batch_size)
    preds = predictions(parsed, [*run_cols, "batch_no"])
    return (unmatched_predictions if rejects else join_truth)(preds, truth, list(keys))


def start_run_metrics_stream(spark: SparkSession, landing: str, truth: DataFrame,
                             metrics_path: str, checkpoint: str,
                             run_cols: Sequence[str] = ("run",), batch_size: int = BATCH_SIZE,
                             max_files_per_trigger: int | None = None,
                             available_now: bool = True, keys: Sequence[str] | None = None,
                             writer: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Start the metrics stream into the epoch table ``metrics_path`` (see :func:`read_run_metrics`).

    ``available_now`` processes what has landed, then stops.
    """
    res = stream_results(spark, landing, truth, run_cols, batch_size, max_files_per_trigger, keys)
    metrics = run_metrics(res, list(run_cols), batch_size=batch_size)

    w = (metrics.writeStream.outputMode("complete").foreachBatch(writer or epoch_writer(metrics_path))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_run_metrics(spark: SparkSession, metrics_path: str) -> DataFrame:
    """The newest complete metrics that a stream has written."""
    return read_current(spark, metrics_path)


def start_results_stream(spark: SparkSession, landing: str, truth: DataFrame,
                         results_path: str, checkpoint: str,
                         run_cols: Sequence[str] = ("run",), batch_size: int = BATCH_SIZE,
                         available_now: bool = True, keys: Sequence[str] | None = None) -> StreamingQuery:
    """Append result rows to a Parquet sink partitioned by run (exactly once via checkpoint)."""
    res = stream_results(spark, landing, truth, run_cols, batch_size, keys=keys)
    w = (res.writeStream.outputMode("append").format("parquet").partitionBy(*run_cols)
         .option("path", results_path).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
