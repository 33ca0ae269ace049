"""Run metrics: predictions -> truth join -> per-run metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from normlens.operators import metrics as M
from normlens.plans import fixtures as fx
from normlens.plans.oracle_fixtures import with_fixtures
from normlens.plans.registry import query

RUN = ["prompt_community", "eval_community"]
_METRIC_COLS = ["num_tests", "num_successes", "batch_size", "accuracy",
                "violation_precision", "non_violation_precision",
                "violation_recall", "non_violation_recall"]


def scored_results(spark, d):
    """Predictions (without their truth) joined back to the comment truth."""
    pred = fx.predictions(spark, d).drop("true_label")
    truth = fx.comments(spark, d).select(
        "subreddit_id", "comment_id", "body", F.col("label").alias("true_label"))
    return M.join_truth(pred, truth, ["eval_community", "comment_id"],
                        ["subreddit_id", "comment_id"])


_RESULTS_SQL = """
, results AS (
  SELECT p.prompt_community, p.eval_community, p.comment_id, p.pred_label, c.body, c.label AS true_label
  FROM predictions p JOIN comments c ON p.eval_community = c.subreddit_id AND p.comment_id = c.comment_id)
"""

_METRICS_SQL = """
, m AS (
  SELECT prompt_community, eval_community, count(*) AS n,
    count(*) FILTER (WHERE true_label = pred_label) AS hits,
    count(*) FILTER (WHERE pred_label = 'violation') AS pp,
    count(*) FILTER (WHERE pred_label = 'non_violation') AS pn,
    count(*) FILTER (WHERE true_label = 'violation') AS tp_all,
    count(*) FILTER (WHERE true_label = 'non_violation') AS tn_all,
    count(*) FILTER (WHERE true_label = 'non_violation' AND pred_label = 'non_violation') AS cm_nn,
    count(*) FILTER (WHERE true_label = 'non_violation' AND pred_label = 'violation') AS cm_np,
    count(*) FILTER (WHERE true_label = 'violation' AND pred_label = 'non_violation') AS cm_pn,
    count(*) FILTER (WHERE true_label = 'violation' AND pred_label = 'violation') AS cm_pp,
    count(*) FILTER (WHERE pred_label IS NULL OR pred_label NOT IN ('violation', 'non_violation')) AS n_unknown_label
  FROM results GROUP BY prompt_community, eval_community)
"""


def _ratio(num, den):
    return f"round(CASE WHEN {den} = 0 THEN 0.0 ELSE {num}::DOUBLE / {den} END, 6)"


@query("run_metrics", with_fixtures(["predictions", "comments"], _RESULTS_SQL + _METRICS_SQL + f"""
SELECT prompt_community, eval_community, 100::BIGINT AS num_tests, n AS num_successes, 10::BIGINT AS batch_size,
  {_ratio('hits', 'n')} AS accuracy,
  {_ratio('cm_pp', 'pp')} AS violation_precision, {_ratio('cm_nn', 'pn')} AS non_violation_precision,
  {_ratio('cm_pp', 'tp_all')} AS violation_recall, {_ratio('cm_nn', 'tn_all')} AS non_violation_recall,
  n_unknown_label
FROM m"""))
def q_run_metrics(spark, d):
    """Flagship: accuracy / precision / recall per (prompt, eval) run."""
    m = M.run_metrics(scored_results(spark, d), RUN)
    return m.select(*RUN, *_METRIC_COLS, "n_unknown_label")


@query("confusion", with_fixtures(["predictions", "comments"], _RESULTS_SQL + _METRICS_SQL + """
SELECT prompt_community, eval_community, cm_nn, cm_np, cm_pn, cm_pp FROM m"""))
def q_confusion(spark, d):
    """Confusion counts per run, order [non_violation, violation], rows = true."""
    m = M.run_metrics(scored_results(spark, d), RUN)
    return m.select(*RUN, "cm_nn", "cm_np", "cm_pn", "cm_pp")


@query("join_truth", with_fixtures(["predictions", "comments"], _RESULTS_SQL + """
SELECT prompt_community, eval_community, comment_id, pred_label, true_label, length(body)::BIGINT AS body_chars
FROM results"""))
def q_join_truth(spark, d):
    """Result rows: each prediction with its truth (body length stands in for the body)."""
    r = scored_results(spark, d)
    return r.select(*RUN, "comment_id", "pred_label", "true_label",
                    F.length("body").cast("bigint").alias("body_chars"))
