"""Streaming run metrics: the final state equals the batch metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from normlens.plans import fixtures as fx
from normlens.plans.oracle_fixtures import with_fixtures
from normlens.plans.queries_parse import _PARSE_SQL, replies
from normlens.plans.registry import query
from normlens.session import scratch_path
from normlens.streaming import run_metrics_stream as ST

LANDING_FILES = 4


@query("stream_run_metrics", with_fixtures(["raw_outputs", "reply_truth"], _PARSE_SQL + """
, res AS (SELECT p.run, p.pred_label, t.true_label FROM preds p JOIN reply_truth t ON t.comment_id = p.comment_id),
  m AS (SELECT run, count(*) AS n, count(*) FILTER (WHERE true_label = pred_label) AS hits,
          count(*) FILTER (WHERE pred_label = 'violation') AS pp,
          count(*) FILTER (WHERE pred_label = 'non_violation') AS pn,
          count(*) FILTER (WHERE true_label = 'violation') AS tp_all,
          count(*) FILTER (WHERE true_label = 'non_violation') AS tn_all,
          count(*) FILTER (WHERE true_label = 'violation' AND pred_label = 'violation') AS cm_pp,
          count(*) FILTER (WHERE true_label = 'non_violation' AND pred_label = 'non_violation') AS cm_nn,
          count(*) FILTER (WHERE true_label = 'non_violation' AND pred_label = 'violation') AS cm_np,
          count(*) FILTER (WHERE true_label = 'violation' AND pred_label = 'non_violation') AS cm_pn
        FROM res GROUP BY run)
SELECT run, n AS num_successes, round(hits::DOUBLE / n, 6) AS accuracy,
  round(CASE WHEN pp = 0 THEN 0 ELSE cm_pp::DOUBLE / pp END, 6) AS violation_precision,
  round(CASE WHEN pn = 0 THEN 0 ELSE cm_nn::DOUBLE / pn END, 6) AS non_violation_precision,
  round(CASE WHEN tp_all = 0 THEN 0 ELSE cm_pp::DOUBLE / tp_all END, 6) AS violation_recall,
  round(CASE WHEN tn_all = 0 THEN 0 ELSE cm_nn::DOUBLE / tn_all END, 6) AS non_violation_recall,
  cm_nn, cm_np, cm_pn, cm_pp FROM m"""))
def q_stream_run_metrics(spark, d):
    """Replies land as files; a checkpointed stream keeps per-run metrics current, version by version."""
    landing = scratch_path(spark, "replies-landing")
    (replies(spark, d).select("run", "batch_no", "content")
     .repartitionByRange(LANDING_FILES, "batch_no").write.mode("overwrite").json(landing))
    out = scratch_path(spark, "stream-metrics")
    # several files a trigger, so that versions follow each other
    q = ST.start_run_metrics_stream(spark, landing, fx.reply_truth(spark, d), out,
                                    scratch_path(spark, "stream-ckpt"), run_cols=["run"],
                                    batch_size=10, max_files_per_trigger=LANDING_FILES // 2)
    q.awaitTermination()
    m = ST.read_run_metrics(spark, out)
    return m.select("run", "num_successes", "accuracy", "violation_precision", "non_violation_precision",
                    "violation_recall", "non_violation_recall", "cm_nn", "cm_np", "cm_pn", "cm_pp")
