"""Prediction-to-truth join and per-run classification metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normlens.constants import BATCH_SIZE, NEGATIVE, NUM_TESTS, POSITIVE


def join_truth(pred: DataFrame, truth: DataFrame, keys: Sequence[str],
               truth_keys: Sequence[str] | None = None, strict: bool = False) -> DataFrame:
    """Inner equi-join of predictions to truth rows.

    ``keys`` are the prediction columns, ``truth_keys`` the matching truth
    columns (same names when omitted; renamed to ``keys`` in the output).
    Ids are only unique within a run or community, so the keys must
    include that scope.  Predictions without truth are returned by
    :func:`unmatched_predictions` instead of aborting the run;
    ``strict=True`` raises when any exist, or when a truth key repeats and
    would multiply predictions (two check jobs).

    Always a sort-merge join (batch frames): predictions repeat few values, so
    their files are small for their rows (4 million in 2 MB), and Spark would
    copy them whole to every executor as a hash table.
    """
    truth_keys = list(truth_keys or keys)
    if strict and not unmatched_predictions(pred, truth, keys, truth_keys).isEmpty():
        raise ValueError("predictions reference ids without truth rows")
    if strict and not truth.groupBy(*truth_keys).count().where("count > 1").isEmpty():
        raise ValueError("truth rows repeat a key")
    t = truth
    for k, tk in zip(keys, truth_keys):
        if k != tk:
            t = t.withColumnRenamed(tk, k)
    if not pred.isStreaming:
        t = t.hint("merge")
    return pred.join(t, list(keys), "inner")


def unmatched_predictions(pred: DataFrame, truth: DataFrame, keys: Sequence[str],
                          truth_keys: Sequence[str] | None = None) -> DataFrame:
    """Predictions whose id has no truth row (or is NULL): the rejects."""
    truth_keys = list(truth_keys or keys)
    t = truth.select(*[F.col(tk).alias(k) for k, tk in zip(keys, truth_keys)])
    # NULL keys never match an equi-join, so they land here as well
    return pred.join(t, list(keys), "left_anti")


def run_metrics(results: DataFrame, run_cols: Sequence[str],
                true_col: str = "true_label", pred_col: str = "pred_label",
                positive: str = POSITIVE, negative: str = NEGATIVE,
                num_tests: int = NUM_TESTS, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Accuracy, per-label precision/recall and confusion counts per run.

    * accuracy is over the parsed (joined) predictions, not ``num_tests``;
    * precision and recall are 0 when their denominator is 0;
    * the confusion matrix is ordered ``[negative, positive]``, rows = true;
      pairs involving any other label are left out of it, and predictions
      with another label count as wrong (``n_unknown_label``).

    One hash aggregation keyed by the run columns (map-side partial
    aggregation, so a hot run does not concentrate rows in one task).
    """
    t, p = F.col(true_col), F.col(pred_col)

    def cnt(cond):
        return F.count_if(F.coalesce(cond, F.lit(False)))

    agg = results.groupBy(*run_cols).agg(
        F.count(F.lit(1)).alias("num_successes"),
        cnt(t == p).alias("_hits"),
        cnt(p == positive).alias("_pp"), cnt(p == negative).alias("_pn"),
        cnt(t == positive).alias("_tp_all"), cnt(t == negative).alias("_tn_all"),
        cnt((t == negative) & (p == negative)).alias("cm_nn"),
        cnt((t == negative) & (p == positive)).alias("cm_np"),
        cnt((t == positive) & (p == negative)).alias("cm_pn"),
        cnt((t == positive) & (p == positive)).alias("cm_pp"),
        cnt(~p.isin(positive, negative) | p.isNull()).alias("n_unknown_label"),
    )

    def ratio(num, den):
        return F.coalesce(F.try_divide(F.col(num).cast("double"), F.col(den).cast("double")),
                          F.lit(0.0))

    return agg.select(
        *run_cols,
        F.lit(num_tests).cast("bigint").alias("num_tests"),
        "num_successes",
        F.lit(batch_size).cast("bigint").alias("batch_size"),
        ratio("_hits", "num_successes").alias("accuracy"),
        ratio("cm_pp", "_pp").alias(f"{positive}_precision"),
        ratio("cm_nn", "_pn").alias(f"{negative}_precision"),
        ratio("cm_pp", "_tp_all").alias(f"{positive}_recall"),
        ratio("cm_nn", "_tn_all").alias(f"{negative}_recall"),
        "cm_nn", "cm_np", "cm_pn", "cm_pp", "n_unknown_label",
        F.array(F.array("cm_nn", "cm_np"), F.array("cm_pn", "cm_pp")).alias("confusion_matrix"),
    )
