"""Reply parsing, audit and reply-based run metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from normlens.operators import metrics as M
from normlens.operators import parse as PR
from normlens.plans import fixtures as fx
from normlens.plans.oracle_fixtures import with_fixtures
from normlens.plans.queries_prep import eligible_comments
from normlens.plans.registry import query
from normlens.session import scratch_path
from normlens.sources import audit_logs as AL
from normlens.sources import run_files as RF

BATCHES_PER_RUN = 10


def replies(spark, d):
    """Raw replies with their run: 10 batches of 10 items make one 100-test run."""
    r = fx.raw_outputs(spark, d)
    return r.withColumn("run", F.concat(F.lit("run"), F.floor(F.col("batch_no") / BATCHES_PER_RUN)
                                        .cast("string")))


def parsed(spark, d):
    return PR.parse_outputs(replies(spark, d), "content", batch_size=10)


_PARSE_SQL = """
, r AS (SELECT batch_no::BIGINT AS batch_no, content, 'run' || CAST(floor(batch_no / 10) AS BIGINT) AS run,
               coalesce(regexp_matches(content, '^\\s*$'), true) AS blank FROM raw_outputs),
  c AS (SELECT *, CASE WHEN NOT blank THEN
          CASE WHEN regexp_extract(content, '(?s)\\[.*\\]', 0) <> '' THEN regexp_extract(content, '(?s)\\[.*\\]', 0)
               WHEN regexp_extract(content, '(?s)\\{.*\\}', 0) <> '' THEN regexp_extract(content, '(?s)\\{.*\\}', 0)
          END END AS candidate FROM r),
  s AS (SELECT *, CASE WHEN candidate IS NULL THEN false
                       WHEN json_valid('[' || candidate || ']') THEN json_array_length('[' || candidate || ']') = 1
                       ELSE false END AS strict FROM c),
  n AS (SELECT *, CASE WHEN strict THEN CASE WHEN candidate LIKE '[%' THEN json_array_length(candidate)::BIGINT
                  ELSE 1::BIGINT END END AS n_parsed FROM s),
  f AS (SELECT *, regexp_extract_all(coalesce(candidate, ''), '(?s)\\{.*?\\}') AS frags FROM n),
  g AS (SELECT *, list_filter(frags, lambda x: CASE WHEN json_valid('[' || x || ']')
                                               THEN json_array_length('[' || x || ']') = 1 ELSE false END) AS good
        FROM f),
  e AS (SELECT *, CASE WHEN candidate IS NULL THEN []::VARCHAR[] WHEN strict AND n_parsed = 10 THEN
                         (CASE WHEN candidate LIKE '[%' THEN json_extract(candidate, '$[*]')::VARCHAR[] ELSE [candidate] END)
                       ELSE good END AS lst FROM g),
  l AS (SELECT *, list_transform(lst, lambda j: CASE
            WHEN json_type(j, '$.comment_id') IN ('BIGINT', 'UBIGINT') THEN json_extract(j, '$.comment_id')::BIGINT
            WHEN json_type(j, '$.comment_id') = 'DOUBLE'
                 AND json_extract(j, '$.comment_id')::DOUBLE = floor(json_extract(j, '$.comment_id')::DOUBLE)
            THEN json_extract(j, '$.comment_id')::DOUBLE::BIGINT END) AS ids FROM e),
  o AS (SELECT *, len(list_filter(ids, lambda i: i IS NULL))::BIGINT AS n_null_id,
               CASE WHEN blank THEN 'empty' WHEN candidate IS NULL THEN 'no_json'
                    WHEN strict AND n_parsed = 10 THEN
                      CASE WHEN len(list_filter(ids, lambda i: i IS NULL)) > 0 THEN 'lost_ids' ELSE 'success' END
                    WHEN strict THEN 'wrong_size' ELSE 'decode_error' END AS outcome FROM l),
  items AS (SELECT run, batch_no, unnest(range(len(lst))) AS item_no, unnest(lst) AS j, unnest(ids) AS comment_id FROM o),
  preds AS (SELECT run, batch_no, item_no, comment_id,
                   json_extract_string(j, '$.label') AS pred_label, json_extract_string(j, '$.evidence') AS evidence
            FROM items)
"""
_FX = ["raw_outputs", "reply_truth"]


@query("json_candidate", with_fixtures(_FX, _PARSE_SQL + "SELECT run, batch_no, candidate FROM o"))
def q_json_candidate(spark, d):
    """Most plausible JSON block of each reply (NULL when none)."""
    return parsed(spark, d).select("run", "batch_no", "candidate")


@query("parse_outputs", with_fixtures(_FX, _PARSE_SQL + """
SELECT run, batch_no, outcome, n_parsed, 10::BIGINT AS n_expected, len(lst)::BIGINT AS n_items FROM o"""))
def q_parse_outputs(spark, d):
    """Outcome and item counts of the strict parse / salvage of every reply."""
    return parsed(spark, d).select("run", "batch_no", "outcome", "n_parsed", "n_expected", "n_items")


@query("salvage_objects", with_fixtures(_FX, _PARSE_SQL + """
SELECT run, batch_no, len(frags)::BIGINT AS n_fragments, len(good)::BIGINT AS n_salvaged
FROM o WHERE outcome IN ('wrong_size', 'decode_error')"""))
def q_salvage_objects(spark, d):
    """Fragments found and kept when salvaging non-accepted replies."""
    p = parsed(spark, d).filter(F.col("outcome").isin("wrong_size", "decode_error"))
    return p.select("run", "batch_no", PR.fragment_count().alias("n_fragments"),
                    F.col("n_items").alias("n_salvaged"))


@query("predictions", with_fixtures(_FX, _PARSE_SQL + "SELECT * FROM preds"))
def q_predictions(spark, d):
    """One row per recovered prediction item."""
    return PR.predictions(parsed(spark, d), ["run", "batch_no"])


@query("parse_audit", with_fixtures(_FX, _PARSE_SQL + """
SELECT run, batch_no, outcome, n_parsed, 10::BIGINT AS n_expected, len(lst)::BIGINT AS n_items, n_null_id,
  outcome IN ('success', 'lost_ids', 'wrong_size', 'decode_error') AS logged FROM o"""))
def q_parse_audit(spark, d):
    """Audit rows: outcome, parsed vs expected size, recovered items and those without id, logged flag."""
    return PR.audit(parsed(spark, d), ["run", "batch_no"])


@query("audit_log_scan", with_fixtures(_FX, _PARSE_SQL + """
, att AS (SELECT run, batch_no, replace(outcome, 'lost_ids', 'success') AS outcome, n_parsed,
                 unnest(CASE WHEN outcome IN ('success', 'lost_ids') THEN [0] ELSE [0, 1] END) AS attempt
          FROM o WHERE outcome IN ('success', 'lost_ids', 'wrong_size', 'decode_error'))
SELECT run, row_number() OVER (PARTITION BY run ORDER BY batch_no, attempt) - 1 AS line_no, attempt::BIGINT AS attempt,
  outcome, CASE WHEN outcome = 'wrong_size' THEN n_parsed END AS n_parsed,
  CASE WHEN outcome = 'wrong_size' THEN 10::BIGINT END AS n_expected
FROM att"""))
def q_audit_log_scan(spark, d):
    """Write per-run audit logs as text files, then scan them back into rows."""
    logs = PR.audit_logs(parsed(spark, d), ["run"])
    path = AL.write_audit_logs(logs, scratch_path(spark, "audit-logs"), ["run"])
    scanned = PR.scan_audit_text(AL.read_audit_logs(spark, path))
    return scanned.select(F.regexp_extract("path", r"run=([^/]+)", 1).alias("run"),
                          "line_no", "attempt", "outcome", "n_parsed", "n_expected")


def reply_results(spark, d):
    preds = PR.predictions(parsed(spark, d), ["run", "batch_no"])
    return M.join_truth(preds, fx.reply_truth(spark, d), ["comment_id"])


@query("reply_run_metrics", with_fixtures(_FX, _PARSE_SQL + """
, res AS (SELECT p.run, p.pred_label, t.true_label FROM preds p JOIN reply_truth t ON t.comment_id = p.comment_id),
  m AS (SELECT run, count(*) AS n, count(*) FILTER (WHERE true_label = pred_label) AS hits,
          count(*) FILTER (WHERE pred_label = 'violation') AS pp,
          count(*) FILTER (WHERE true_label = 'violation') AS tp_all,
          count(*) FILTER (WHERE true_label = 'violation' AND pred_label = 'violation') AS cm_pp,
          count(*) FILTER (WHERE true_label = 'non_violation' AND pred_label = 'non_violation') AS cm_nn
        FROM res GROUP BY run)
SELECT run, n AS num_successes, round(hits::DOUBLE / n, 6) AS accuracy,
  round(CASE WHEN pp = 0 THEN 0 ELSE cm_pp::DOUBLE / pp END, 6) AS violation_precision,
  round(CASE WHEN tp_all = 0 THEN 0 ELSE cm_pp::DOUBLE / tp_all END, 6) AS violation_recall,
  cm_nn, cm_pp FROM m"""))
def q_reply_run_metrics(spark, d):
    """Parse replies -> join truth -> metrics per run (the whole scoring tail)."""
    m = M.run_metrics(reply_results(spark, d), ["run"])
    return m.select("run", "num_successes", "accuracy", "violation_precision", "violation_recall",
                    "cm_nn", "cm_pp")


@query("unmatched_predictions", with_fixtures(_FX + ["comments"], _PARSE_SQL + """
, elig AS (SELECT subreddit_id FROM comments GROUP BY subreddit_id HAVING count(*) > 18),
  truth AS (SELECT comment_id FROM comments WHERE subreddit_id IN (SELECT subreddit_id FROM elig))
SELECT run, batch_no, item_no, comment_id FROM preds
WHERE comment_id IS NULL OR comment_id NOT IN (SELECT comment_id FROM truth)"""))
def q_unmatched_predictions(spark, d):
    """Recovered items whose id is not a comment of an evaluated community (rejects)."""
    preds = PR.predictions(parsed(spark, d), ["run", "batch_no"])
    truth = eligible_comments(spark, d).select("comment_id")
    return M.unmatched_predictions(preds, truth, ["comment_id"]).select(
        "run", "batch_no", "item_no", "comment_id")


@query("write_raw_outputs", with_fixtures(_FX, _PARSE_SQL + """
SELECT run, batch_no, content FROM r"""))
def q_write_raw_outputs(spark, d):
    """Raw reply texts written per run as JSON (NULLs and whitespace kept); read back."""
    r = replies(spark, d).select("run", F.col("batch_no").cast("bigint").alias("batch_no"), "content")
    path = RF.write_json(r, scratch_path(spark, "raw-outputs"), ["run"])
    return spark.read.schema(r.schema).json(path).select("run", "batch_no", "content")


@query("audit_summary", with_fixtures(_FX, _PARSE_SQL + """
SELECT run, count(*) AS n_logged, count(*) FILTER (WHERE outcome IN ('success', 'lost_ids')) AS n_accepted,
  count(*) FILTER (WHERE outcome = 'wrong_size') AS n_wrong_size,
  count(*) FILTER (WHERE outcome = 'decode_error') AS n_decode_error,
  round(count(*) FILTER (WHERE outcome IN ('success', 'lost_ids')) / count(*), 6) AS accept_rate
FROM o WHERE outcome IN ('success', 'lost_ids', 'wrong_size', 'decode_error') GROUP BY run"""))
def q_audit_summary(spark, d):
    """Accept rate of logged batches per run, read back from the written audit logs."""
    logs = PR.audit_logs(parsed(spark, d), ["run"])
    path = AL.write_audit_logs(logs, scratch_path(spark, "audit-logs"), ["run"])
    lines = PR.scan_audit_text(AL.read_audit_logs(spark, path)).withColumn(
        "run", F.regexp_extract("path", r"run=([^/]+)", 1))
    return PR.audit_summary(lines, ["run"])
