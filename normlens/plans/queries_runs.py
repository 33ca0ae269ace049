"""Run-level outputs: result and metric files, model filters, long metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from normlens.functions.text import safe_name, strip_paren_suffix
from normlens.operators import matrix as X
from normlens.operators import metrics as M
from normlens.plans import fixtures as fx
from normlens.plans.oracle_fixtures import with_fixtures
from normlens.plans.queries_core import _METRICS_SQL, _RESULTS_SQL, RUN, scored_results
from normlens.plans.registry import query
from normlens.session import scratch_path
from normlens.sources import run_files as RF

REF_METRICS = ["accuracy", "violation_precision", "non_violation_precision",
               "violation_recall", "non_violation_recall"]
MODEL_A, MODEL_B = "org/model-a:free", "org/model-b"
EXPERIMENT = "cross_community"


def _model(prompt):
    return F.when(F.substring(F.md5(prompt), 1, 1) < "8", F.lit(MODEL_A)).otherwise(F.lit(MODEL_B))


def run_table(spark, d):
    """Run metrics with the simulated model of each prompt community and the run directory."""
    m = M.run_metrics(scored_results(spark, d), RUN)
    return (m.withColumn("model", _model(F.col("prompt_community")))
            .withColumn("directory", F.concat_ws("/", F.lit(EXPERIMENT), "prompt_community", "eval_community")))


_RUNS_SQL = _RESULTS_SQL + _METRICS_SQL + f"""
, runs AS (SELECT prompt_community, eval_community,
             CASE WHEN substr(md5(prompt_community), 1, 1) < '8' THEN '{MODEL_A}' ELSE '{MODEL_B}' END AS model,
             '{EXPERIMENT}/' || prompt_community || '/' || eval_community AS directory,
             100::BIGINT AS num_tests, n AS num_successes, 10::BIGINT AS batch_size,
             CASE WHEN n = 0 THEN 0.0 ELSE hits::DOUBLE / n END AS accuracy,
             CASE WHEN pp = 0 THEN 0.0 ELSE cm_pp::DOUBLE / pp END AS violation_precision,
             CASE WHEN pn = 0 THEN 0.0 ELSE cm_nn::DOUBLE / pn END AS non_violation_precision,
             CASE WHEN tp_all = 0 THEN 0.0 ELSE cm_pp::DOUBLE / tp_all END AS violation_recall,
             CASE WHEN tn_all = 0 THEN 0.0 ELSE cm_nn::DOUBLE / tn_all END AS non_violation_recall
           FROM m)
"""
_FX = ["predictions", "comments"]
_SAFE_SQL = "regexp_replace(model, '[<>:\"/\\\\|?*]', '_', 'g')"


@query("write_run_metrics", with_fixtures(_FX, _RUNS_SQL + f"""
SELECT model, directory, num_tests, num_successes, batch_size, {", ".join(REF_METRICS)},
  {_SAFE_SQL} AS model_folder FROM runs"""))
def q_write_run_metrics(spark, d):
    """Write run metrics as JSON partitioned by file-safe model folder; read back."""
    t = run_table(spark, d).withColumn("model_folder", safe_name(F.col("model")))
    out = t.select("model", "directory", "num_tests", "num_successes", "batch_size",
                   *REF_METRICS, "confusion_matrix", "model_folder")
    path = RF.write_json(out, scratch_path(spark, "run-metrics"), ["model_folder"])
    back = spark.read.schema(out.schema).json(path)
    return back.select("model", "directory", "num_tests", "num_successes", "batch_size",
                       *REF_METRICS, "model_folder")


@query("scan_run_metrics", with_fixtures(_FX, _RUNS_SQL + f"""
SELECT model, directory, num_successes, {", ".join(REF_METRICS)}, {_SAFE_SQL} AS model_folder,
  n AS cm_total FROM runs JOIN m USING (prompt_community, eval_community)"""))
def q_scan_run_metrics(spark, d):
    """Recursive scan of run-metric files; model folder from the path."""
    t = run_table(spark, d).withColumn("model_folder", safe_name(F.col("model")))
    path = RF.write_json(t.select("model", "directory", "num_tests", "num_successes", "batch_size",
                                  *REF_METRICS, "confusion_matrix", "model_folder"),
                         scratch_path(spark, "run-metrics"), ["model_folder"])
    s = RF.scan_run_metrics(spark, path)
    cm_total = F.aggregate(F.flatten("confusion_matrix"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return s.select("model", "directory", "num_successes", *REF_METRICS, "model_folder",
                    cm_total.alias("cm_total"))


@query("write_results", with_fixtures(_FX, _RESULTS_SQL + """
SELECT prompt_community, eval_community, comment_id, pred_label, true_label FROM results"""))
def q_write_results(spark, d):
    """Write result rows as JSON per prompt community; read them back.

    Every prompt community's rows repeat the bodies, so the files are compressed.
    """
    r = scored_results(spark, d).select(*RUN, "comment_id", "body", "pred_label", "true_label")
    path = RF.write_json(r, scratch_path(spark, "results"), ["prompt_community"], "snappy")
    back = spark.read.schema(r.schema).json(path)
    return back.select(*RUN, "comment_id", "pred_label", "true_label")


@query("runs_for_model", with_fixtures(_FX, _RUNS_SQL + f"""
SELECT prompt_community, eval_community, model, {", ".join(REF_METRICS)} FROM runs WHERE model = '{MODEL_A}'"""))
def q_runs_for_model(spark, d):
    """Run metrics of one model."""
    t = run_table(spark, d).filter(F.col("model") == MODEL_A)
    return t.select(*RUN, "model", *REF_METRICS)


@query("run_metrics_long", with_fixtures(_FX, _RUNS_SQL + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT prompt_community, eval_community, model, '{m}' AS metric, {m} AS value FROM runs"
    for m in REF_METRICS) + ") WHERE value IS NOT NULL AND NOT isnan(value)"))
def q_run_metrics_long(spark, d):
    """Metric columns of every run as long (metric, value) rows for comparison."""
    t = run_table(spark, d).select(*RUN, "model", *REF_METRICS)
    long = t.unpivot([*RUN, "model"], REF_METRICS, "metric", "value")
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value"))


@query("clean_names", with_fixtures(["accuracy"], """
SELECT subreddit, regexp_replace(subreddit, '\\s*\\(.*\\)', '') AS clean FROM accuracy"""))
def q_clean_names(spark, d):
    """Accuracy labels with the '(id)' suffix removed."""
    a = fx.accuracy(spark, d)
    return a.select("subreddit", strip_paren_suffix(F.col("subreddit")).alias("clean"))


@query("safe_model_name", with_fixtures(_FX, _RUNS_SQL + f"""
SELECT DISTINCT model, {_SAFE_SQL} AS model_folder FROM runs"""))
def q_safe_model_name(spark, d):
    """File-safe folder name of every model that has runs."""
    t = run_table(spark, d).select("model").distinct()
    return t.select("model", safe_name(F.col("model")).alias("model_folder"))


@query("grid_probe", with_fixtures(_FX + ["communities"], _RUNS_SQL + f"""
SELECT p.name AS prompt_community, e.name AS eval_community, r.accuracy
FROM communities p CROSS JOIN communities e
LEFT JOIN runs r ON r.prompt_community = p.name AND r.eval_community = e.name AND r.model = '{MODEL_A}'"""))
def q_grid_probe(spark, d):
    """Grid of one model's accuracy read from metrics.json files (absent file -> NULL).

    One recursive scan of every metrics file, run keys and model folder from
    the path alone, a model filter, then a left join onto the full community grid.
    """
    runs = RF.scan_run_metrics(spark, nested_records(spark, d), layout="nested")
    runs = runs.filter(F.col("model_folder") == safe_name(F.lit(MODEL_A)))
    parts = F.split("directory_path", "/")
    cells = runs.select(F.element_at(parts, -2).alias("prompt_community"),
                        F.element_at(parts, -1).alias("eval_community"), "accuracy")
    return X.full_grid(cells, fx.communities(spark, d))


def nested_records(spark, d):
    """Every run written as ``<experiment>/<prompt>/<eval>/<model folder>/metrics.json``."""
    t = run_table(spark, d).withColumn("model_folder", safe_name(F.col("model")))
    return RF.write_run_records(t, scratch_path(spark, "run-records"))


@query("scan_nested_metrics", with_fixtures(_FX, _RUNS_SQL + f"""
SELECT directory AS directory_path, {_SAFE_SQL} AS model_folder, model, num_tests, num_successes, batch_size,
  {", ".join(REF_METRICS)}, cm_nn, cm_np, cm_pn, cm_pp FROM runs JOIN m USING (prompt_community, eval_community)"""))
def q_scan_nested_metrics(spark, d):
    """Run records written as one pretty-printed file per run; keys from the path, whole confusion matrix."""
    r = RF.scan_run_metrics(spark, nested_records(spark, d), layout="nested")
    cm = F.col("confusion_matrix")
    return r.select("directory_path", "model_folder", "model", "num_tests", "num_successes", "batch_size", *REF_METRICS,
                    cm[0][0].alias("cm_nn"), cm[0][1].alias("cm_np"), cm[1][0].alias("cm_pn"), cm[1][1].alias("cm_pp"))
