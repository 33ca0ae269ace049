"""Scoring boundary: a caller-supplied scorer applied to request batches.

``score_batches`` runs the scorer inside ``mapInPandas`` (Arrow batches,
one call per request row).  Concurrency is the number of partitions of
the request frame; a failure becomes an ``error`` value on its row
instead of losing the run.  A retry loop with exponential back-off is
available for flaky remote scorers.

``score_resumable`` keeps what has been scored: replies are committed to a
shared folder while tasks run, and a later call scores only requests without a
committed reply, so a run that dies half-way loses at most the replies of
open chunks.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Sequence

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from normlens.operators.metrics import join_truth, unmatched_predictions
from normlens.operators.parse import parse_outputs, predictions
from normlens.session import materialize
from normlens.sources.named_files import commit_bytes

Scorer = Callable[[list[dict]], str]


def score_batches(requests: DataFrame, scorer: Scorer, keys: Sequence[str],
                  messages_col: str = "messages", num_partitions: int | None = None,
                  retries: int = 0, backoff: Callable[[int], float] = lambda a: 2.0 ** a) -> DataFrame:
    """``keys..., content, error`` per request row."""
    keys = list(keys)
    fields = [f for f in requests.schema.fields if f.name in keys]
    schema = T.StructType([*fields, T.StructField("content", T.StringType()),
                           T.StructField("error", T.StringType())])
    src = requests.select(*keys, messages_col)
    if num_partitions:
        src = src.repartition(num_partitions)

    def run(it):
        for pdf in it:
            out = [_call(scorer, m, retries, backoff) for m in pdf[messages_col]]
            res = pdf[keys].copy()
            res["content"] = [o[0] for o in out]
            res["error"] = [o[1] for o in out]
            yield res

    return src.mapInPandas(run, schema)


def _call(scorer: Scorer, msgs, retries: int, backoff: Callable[[int], float]) -> tuple[str | None, str | None]:
    """(reply, None), or (None, error) once all attempts have failed."""
    messages = [{"role": m["role"], "content": m["content"]} for m in msgs]
    for attempt in range(retries + 1):
        try:
            return scorer(messages), None
        except Exception as e:  # noqa: BLE001 - reported per row
            error = f"{type(e).__name__}: {e}"
            if attempt < retries:
                time.sleep(backoff(attempt))
    return None, error


def _reply_schema(requests: DataFrame, keys: Sequence[str]) -> T.StructType:
    return T.StructType([*(requests.schema[k] for k in keys), T.StructField("content", T.StringType()),
                         T.StructField("error", T.StringType()), T.StructField("attempt", T.LongType())])


def scored_attempts(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Every committed reply or error under ``folder``; no rows before the first."""
    try:
        return spark.read.schema(schema).json(f"{folder}/replies")
    except AnalysisException:  # the folder is not there yet
        return spark.createDataFrame([], schema)


def latest_replies(attempts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys..., content, error`` per request: its first reply, else its latest error.

    A chunk that ran twice (a repeated task) gives the same request two rows;
    one of them counts.
    """
    # replies before errors, then the earlier reply or the later error
    order = F.struct(F.col("error").isNotNull(), F.when(F.col("error").isNull(), F.col("attempt")).otherwise(-F.col("attempt")),
                     F.coalesce("content", "error"))
    picked = attempts.groupBy(*keys).agg(F.min_by(F.struct("content", "error"), order).alias("_r"))
    return picked.select(*keys, F.col("_r.content").alias("content"), F.col("_r.error").alias("error"))


def score_resumable(requests: DataFrame, scorer: Scorer, keys: Sequence[str], folder: str,
                    messages_col: str = "messages", num_partitions: int | None = None, commit_every: int = 1,
                    retries: int = 0, backoff: Callable[[int], float] = lambda a: 2.0 ** a) -> DataFrame:
    """``keys..., content, error`` per request, resuming from the replies committed under ``folder``.

    Requests with a committed reply are skipped (anti join); those that failed
    are tried again, and every failure stays among :func:`scored_attempts`.
    Each task commits ``commit_every`` replies at a time: one file, written under
    a temporary name and renamed.  Keys must be unique and not NULL; ``folder``
    must be shared by driver and executors.
    """
    spark, keys = requests.sparkSession, list(keys)
    schema = _reply_schema(requests, keys)
    before = scored_attempts(spark, folder, schema)
    attempt = (before.agg(F.max("attempt")).first()[0] or 0) + 1
    done = before.where("error IS NULL").select(*keys).distinct()
    pending = requests.select(*keys, messages_col).join(done, keys, "left_anti")
    if num_partitions:
        pending = pending.repartition(num_partitions)

    def run(it):
        fs, root = pafs.FileSystem.from_uri(folder)
        for pdf in it:
            for start in range(0, len(pdf), commit_every):
                chunk = pdf.iloc[start:start + commit_every]
                rows = chunk[keys].copy()
                out = [_call(scorer, m, retries, backoff) for m in chunk[messages_col]]
                rows["content"], rows["error"], rows["attempt"] = [o[0] for o in out], [o[1] for o in out], attempt
                lines = rows.to_json(orient="records", lines=True, force_ascii=False)
                name = hashlib.sha256(chunk[keys].to_json(orient="records").encode()).hexdigest()
                commit_bytes(fs, f"{root}/replies/{attempt:06d}-{name}.json", lines.encode())
                yield pd.DataFrame({"rows": [len(rows)]})

    materialize(pending.mapInPandas(run, "rows long"), "scored")
    return latest_replies(scored_attempts(spark, folder, schema), keys)


def result_rows(scored: DataFrame, tests: DataFrame, keys: Sequence[str], scope: Sequence[str],
                batch_size: int) -> tuple[DataFrame, DataFrame]:
    """(results, rejects) of scored batches against their tests.

    ``tests`` hold ``scope`` columns, ``comment_id``, ``body``, ``norm`` and
    ``true_label``; ``scope`` (among ``keys``) is where ids restart; ``keys``
    hold ``batch_no`` too.  Results: one row per recovered prediction with its
    norm, truth, label and evidence, and one row per test of a failed batch with
    the error and no prediction.  Rejects: recovered items without a test.
    """
    keys, scope = list(keys), list(scope)
    ok = parse_outputs(scored.where("error IS NULL"), "content", batch_size)
    preds = predictions(ok, keys)
    truth = tests.select(*scope, "comment_id", "body", "norm", "true_label")
    cols = [*keys, "comment_id", "body", "norm", "true_label", "pred_label", "evidence", "error"]
    found = join_truth(preds, truth, [*scope, "comment_id"]).withColumn("error", F.lit(None).cast("string"))
    numbered = truth.withColumn("batch_no", F.floor(F.col("comment_id") / batch_size).cast(scored.schema["batch_no"].dataType))
    none = F.lit(None).cast("string")
    failed = (scored.where("error IS NOT NULL").select(*keys, "error").join(numbered, [*scope, "batch_no"])
              .withColumns({"pred_label": none, "evidence": none}))
    return (found.select(*cols).unionByName(failed.select(*cols)),
            unmatched_predictions(preds, truth, [*scope, "comment_id"]))


def keyword_scorer(keywords: Sequence[str]) -> Scorer:
    """Deterministic scorer: ``violation`` when a keyword occurs in the comment.

    Reads the JSON batch from the last message (first ``[`` to last ``]``)
    and answers with a JSON array — a stand-in for a model in tests.
    """
    kws = [k.lower() for k in keywords]

    def score(messages: list[dict]) -> str:
        text = messages[-1]["content"]
        items = json.loads(text[text.index("["): text.rindex("]") + 1])
        out = []
        for it in items:
            body = (it.get("comment") or "").lower()
            hit = next((k for k in kws if k in body), None)
            out.append({"comment_id": it["comment_id"],
                        "label": "violation" if hit else "non_violation",
                        "evidence": hit or ""})
        return json.dumps(out, ensure_ascii=False)

    return score
