"""The fixture views as DuckDB SQL (CTE bodies), for the oracle queries."""

from __future__ import annotations

_NORMS = ("CASE WHEN d.doc_id % 11 = 0 THEN NULL WHEN d.doc_id % 8 = 0 THEN 'no spam' "
          "WHEN d.doc_id % 8 = 1 THEN 'be nice' WHEN d.doc_id % 8 = 2 THEN 'do not troll' "
          "WHEN d.doc_id % 8 = 3 THEN 'stay on topic' WHEN d.doc_id % 8 = 4 THEN 'NO self promotion' "
          "WHEN d.doc_id % 8 = 5 THEN 'know the rules' WHEN d.doc_id % 8 = 6 THEN 'be civil' "
          "ELSE 'respect others' END")

CTE = {
    "all_comments": f"""
SELECT d.doc_id AS comment_id, CASE WHEN d.doc_id % 9 = 0 THEN d.text || '?'
  WHEN d.doc_id % 10 = 1 THEN '&lt;b&gt; &amp;amp; ' || d.text ELSE d.text END AS body,
  d.source AS subreddit_id, d.lang AS assigned_rule_cluster, {_NORMS} AS target_reason,
  CASE WHEN l.toxic = 1 THEN 'violation' WHEN l.toxic IS NOT NULL THEN 'non_violation' END AS label
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "comments": "SELECT * FROM all_comments WHERE label IS NOT NULL",
    "language_comments": "SELECT * REPLACE (assigned_rule_cluster AS subreddit_id) FROM all_comments",
    "communities": """
SELECT DISTINCT source AS name, 'r/' || source AS display_name_prefixed, 'About ' || source AS public_description
FROM documents""",
    "predictions": """
SELECT p.name AS prompt_community, c.subreddit_id AS eval_community, c.comment_id, c.label AS true_label,
  CASE WHEN substr(md5(p.name || ':' || CAST(c.comment_id AS VARCHAR)), 1, 1) < substr(md5(p.name), 1, 1)
       THEN CASE WHEN c.label = 'violation' THEN 'non_violation' ELSE 'violation' END
       ELSE c.label END AS pred_label
FROM communities p CROSS JOIN comments c""",
    "cells": """
SELECT prompt_community, eval_community, AVG(CASE WHEN true_label = pred_label THEN 1.0E0 ELSE 0.0E0 END) AS accuracy
FROM predictions
WHERE substr(md5(prompt_community || '/' || eval_community), 1, 1) <> '0'
GROUP BY prompt_community, eval_community""",
    "accuracy": """
SELECT c.display_name_prefixed || ' (' || e.eval_community || ')' AS subreddit, AVG(e.accuracy) AS accuracy
FROM cells e JOIN communities c ON c.name = e.eval_community GROUP BY c.display_name_prefixed, e.eval_community""",
    "scores": """
SELECT 'r/src' || CAST(label AS VARCHAR) AS subreddit, count(*) AS n_items,
  avg(x) AS in_cluster_sim_mean, stddev_samp(x) AS in_cluster_sim_std,
  avg(y) AS cross_cluster_sim_mean, stddev_samp(y) AS cross_cluster_sim_std,
  avg(z) AS contrastive_score_mean, stddev_samp(z) AS contrastive_score_std
FROM (SELECT label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
             CAST(embedding[3] AS DOUBLE) AS z FROM embeddings) GROUP BY label""",
    "raw_outputs": """
SELECT batch_no, CASE WHEN batch_no % 13 = 9 THEN 'I cannot judge these comments.'
  WHEN batch_no % 5 = 1 THEN '[' || body WHEN batch_no % 5 = 2 THEN 'Sure: [' || body || '] ok'
  WHEN batch_no % 7 = 3 THEN '' WHEN batch_no % 5 = 4 THEN body || ',{bad}' ELSE '[' || body || ']' END AS content
FROM (SELECT b AS batch_no, string_agg(j, ',' ORDER BY rn) FILTER (WHERE b % 9 <> 5 OR rn % 10 < 9) AS body
      FROM (SELECT b, rn,
                   '{' || CASE WHEN b % 11 = 6 AND doc_id % 7 = 3 THEN '' ELSE '"comment_id":' ||
                     CASE WHEN b % 11 = 6 AND doc_id % 7 = 1 THEN '"' || doc_id || '"'
                          WHEN b % 11 = 6 AND doc_id % 7 = 2 THEN doc_id || '.5'
                          WHEN b % 11 = 8 OR b % 11 = 6 THEN doc_id || '.0' ELSE doc_id || '' END || ',' END ||
                   '"label":"' || CASE WHEN doc_id % 23 = 5 THEN 'unclear' WHEN quality = 0 THEN 'violation'
                                       ELSE 'non_violation' END || '","evidence":"' ||
                   CASE WHEN doc_id % 3 = 0 THEN 'see \\"word ' || doc_id || '\\"' ELSE '' END || '"}' AS j
            FROM (SELECT *, CAST(floor(rn / 10) AS INT) AS b
                  FROM (SELECT doc_id, quality, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM labels)))
      GROUP BY b)""",
    "reply_truth": """
SELECT doc_id AS comment_id, CASE WHEN toxic = 1 THEN 'violation' ELSE 'non_violation' END AS true_label
FROM labels""",
}

DEPS = {
    "all_comments": [], "comments": ["all_comments"], "language_comments": ["all_comments"], "communities": [], "predictions": ["comments", "communities"],
    "cells": ["predictions"], "accuracy": ["cells", "communities"], "scores": [],
    "raw_outputs": [], "reply_truth": [],
}


def with_fixtures(names: list[str], body: str) -> str:
    """``WITH <fixtures and their deps> <body>``; body may start with more CTEs
    as ``, name AS (...) SELECT ...`` when it begins with a comma."""
    order: list[str] = []

    def add(n):
        for dep in DEPS[n]:
            add(dep)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    body = body.strip()
    if not order:
        return ("WITH " + body.lstrip(", \n") if body.startswith(",") else body) + "\n"
    head = "WITH " + ",\n".join(f"{n} AS ({CTE[n]}\n)" for n in order)
    if body.startswith(","):
        return head + body + "\n"
    return head + "\n" + body + "\n"
