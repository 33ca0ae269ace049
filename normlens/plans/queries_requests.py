"""Request building, scoring and the CSV sources of the corpus."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from normlens.constants import BATCH_SIZE
from normlens.operators import metrics as M
from normlens.operators import parse as PR
from normlens.operators import requests as RQ
from normlens.operators import scoring as SC
from normlens.plans import fixtures as fx
from normlens.plans.oracle_fixtures import with_fixtures
from normlens.plans.queries_prep import _NORMS_SQL, MIN_COUNT, REFERENCE_SQL, eligible, eligible_draw, reference_prepared, with_norms
from normlens.plans.registry import query
from normlens.session import materialize, scratch_path
from normlens.sources import readers as RD
from normlens.sources import run_files as RF

# scoring runs draw more tests so a community spans several batches
SCORE_N_TEST = 5
SCORE_N_SHOTS = 1
SCORE_BATCH = 4
KEYWORDS = ["no", "nicht"]


def scoring_split(spark, d):
    # stored: batches, shots and truth all read the same draw
    return materialize(with_norms(spark, d, eligible_draw(spark, d, SCORE_N_TEST, SCORE_N_SHOTS)), "scoring-split")


def scoring_batches(spark, d, split=None):
    split = split if split is not None else scoring_split(spark, d)
    tests = split.filter(F.col("split") == "test")
    return RQ.batches(tests, ["subreddit_id"], batch_size=SCORE_BATCH)


def rules_table(spark, d):
    return RD.explode_rules(fx.rules_literal(spark, d))


def context(spark, d, split):
    shots = split.filter(F.col("split") == "shots")
    return RQ.request_context(fx.communities(spark, d), rules_table(spark, d), shots)


def cell_requests(spark, d, split=None):
    split = split if split is not None else scoring_split(spark, d)
    b = scoring_batches(spark, d, split)
    elig = eligible(spark, d)
    return RQ.request_messages(RQ.cell_requests(b, context(spark, d, split), elig))


_SPLIT_SQL = f"""
, elig AS (SELECT subreddit_id FROM comments GROUP BY subreddit_id HAVING count(*) > {MIN_COUNT}),
  ec AS (SELECT * FROM comments WHERE subreddit_id IN (SELECT subreddit_id FROM elig)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY subreddit_id, label
                 ORDER BY md5('21:' || CAST(comment_id AS VARCHAR)), comment_id) AS draw_rank
             FROM ec WHERE label IN ('violation', 'non_violation')),
  split AS (SELECT *, CASE WHEN draw_rank <= {SCORE_N_TEST} THEN 'test' ELSE 'shots' END AS split
            FROM ranked WHERE draw_rank <= {SCORE_N_TEST + SCORE_N_SHOTS}),
  tests AS (SELECT subreddit_id, body, label AS true_label,
              row_number() OVER (PARTITION BY subreddit_id, split
                ORDER BY md5('21:order:' || CAST(comment_id AS VARCHAR)), comment_id) - 1 AS comment_id
            FROM split WHERE split = 'test')
"""


@query("batches", with_fixtures(["comments"], _SPLIT_SQL + f"""
SELECT subreddit_id, CAST(floor(comment_id / {SCORE_BATCH}) AS INT)::BIGINT AS batch_no, count(*) AS n_items,
  min(comment_id) AS first_id, max(comment_id) AS last_id
FROM tests WHERE comment_id < 100 GROUP BY subreddit_id, floor(comment_id / {SCORE_BATCH})"""))
def q_batches(spark, d):
    """Fixed-size request batches per community test set (ids in order)."""
    b = scoring_batches(spark, d)
    return b.select("subreddit_id", "batch_no", "n_items",
                    F.col("items")[0]["comment_id"].alias("first_id"),
                    F.element_at("items", -1)["comment_id"].alias("last_id"))


_PAYLOAD_SQL = _NORMS_SQL.format(src="ec").replace(", pairs AS", ", pairs AS", 1)


@query("request_batches", with_fixtures(["comments"], f"""
, elig AS (SELECT subreddit_id FROM comments GROUP BY subreddit_id HAVING count(*) > {MIN_COUNT}),
  ec AS (SELECT * FROM comments WHERE subreddit_id IN (SELECT subreddit_id FROM elig))
{_PAYLOAD_SQL}
, ranked AS (SELECT *, row_number() OVER (PARTITION BY subreddit_id, label
                 ORDER BY md5('21:' || CAST(comment_id AS VARCHAR)), comment_id) AS draw_rank
             FROM assigned WHERE label IN ('violation', 'non_violation')),
  split AS (SELECT *, CASE WHEN draw_rank <= {SCORE_N_TEST} THEN 'test' ELSE 'shots' END AS split
            FROM ranked WHERE draw_rank <= {SCORE_N_TEST + SCORE_N_SHOTS}),
  tests AS (SELECT subreddit_id, body, norm,
              row_number() OVER (PARTITION BY subreddit_id, split
                ORDER BY md5('21:order:' || CAST(comment_id AS VARCHAR)), comment_id) - 1 AS cid
            FROM split WHERE split = 'test')
SELECT subreddit_id, floor(cid / {SCORE_BATCH})::BIGINT AS batch_no, count(*) AS n_items,
  to_json(list(struct_pack(comment_id := cid, norm := norm, comment := body) ORDER BY cid))::VARCHAR AS payload
FROM tests WHERE cid < 100 GROUP BY subreddit_id, floor(cid / {SCORE_BATCH})"""))
def q_request_batches(spark, d):
    """Each batch as JSON text (NULL norms kept as null, non-ASCII kept)."""
    b = scoring_batches(spark, d)
    return b.select("subreddit_id", "batch_no", "n_items", RQ.payload("items").alias("payload"))


_CONTEXT_SQL = f"""
, elig AS (SELECT subreddit_id FROM comments GROUP BY subreddit_id HAVING count(*) > {MIN_COUNT}),
  ec AS (SELECT * FROM comments WHERE subreddit_id IN (SELECT subreddit_id FROM elig))
{_PAYLOAD_SQL}
, ranked AS (SELECT *, row_number() OVER (PARTITION BY subreddit_id, label
                 ORDER BY md5('21:' || CAST(comment_id AS VARCHAR)), comment_id) AS draw_rank
             FROM assigned WHERE label IN ('violation', 'non_violation')),
  split AS (SELECT *, CASE WHEN draw_rank <= {SCORE_N_TEST} THEN 'test' ELSE 'shots' END AS split
            FROM ranked WHERE draw_rank <= {SCORE_N_TEST + SCORE_N_SHOTS}),
  prepared AS (SELECT subreddit_id, split, body, norm, label AS true_label,
                 row_number() OVER (PARTITION BY subreddit_id, split
                   ORDER BY md5('21:order:' || CAST(comment_id AS VARCHAR)), comment_id) - 1 AS cid
               FROM split),
  shots AS (SELECT subreddit_id, to_json(list(struct_pack(comment_id := cid, body := body, norm := norm,
                                                          true_label := true_label) ORDER BY cid))::VARCHAR AS shots_json
            FROM prepared WHERE split = 'shots' GROUP BY subreddit_id),
  rule_names AS (SELECT DISTINCT subreddit_id, target_reason AS short_name FROM comments WHERE target_reason IS NOT NULL),
  rules AS (SELECT subreddit_id, string_agg(short_name || ': ' || CASE WHEN contains(short_name, 'no') THEN ''
                                              ELSE 'don''t ' || short_name END, chr(10) ORDER BY short_name) AS rules_text
            FROM rule_names GROUP BY subreddit_id)
"""


@query("request_context", with_fixtures(["comments", "communities"], _CONTEXT_SQL + """
SELECT c.name AS subreddit_id, c.display_name_prefixed, c.public_description,
  coalesce(r.rules_text, '') AS rules_text, s.shots_json
FROM communities c LEFT JOIN rules r ON r.subreddit_id = c.name LEFT JOIN shots s ON s.subreddit_id = c.name"""))
def q_request_context(spark, d):
    """Per community: name, description, rule lines and few-shot examples (rendered as text)."""
    ctx = context(spark, d, scoring_split(spark, d))
    return ctx.select("subreddit_id", "display_name_prefixed", "public_description",
                      F.array_join("rules", "\n").alias("rules_text"),
                      RQ.payload("shots").alias("shots_json"))


def _template_sql(template: str, values: dict[str, str]) -> str:
    """SQL concatenation of a ``{name}`` template (literals quoted, newlines as chr(10))."""
    import re as _re
    parts, pos = [], 0

    def lit(t):
        chunks = t.replace("'", "''").split("\n")
        return " || chr(10) || ".join(f"'{c}'" for c in chunks)

    for m in _re.finditer(r"\{(\w+)\}", template):
        if m.start() > pos:
            parts.append(lit(template[pos:m.start()]))
        parts.append(f"coalesce({values[m.group(1)]}, '')")
        pos = m.end()
    if pos < len(template):
        parts.append(lit(template[pos:]))
    return " || ".join(parts)


_VALUES = {"display_name": "c.display_name_prefixed", "description": "c.public_description",
           "rules": "coalesce(r.rules_text, '')", "shots": "s.shots_json", "payload": "b.payload"}
_SYSTEM_SQL = _template_sql(RQ.DEFAULT_SYSTEM_TEMPLATE, _VALUES)
_USER_SQL = _template_sql(RQ.DEFAULT_USER_TEMPLATE, _VALUES)


@query("request_messages", with_fixtures(["comments", "communities"], _CONTEXT_SQL + f"""
, tests AS (SELECT subreddit_id, body, norm, cid FROM prepared WHERE split = 'test'),
  b AS (SELECT subreddit_id, floor(cid / {SCORE_BATCH})::BIGINT AS batch_no,
          to_json(list(struct_pack(comment_id := cid, norm := norm, comment := body) ORDER BY cid))::VARCHAR AS payload
        FROM tests WHERE cid < 100 GROUP BY subreddit_id, floor(cid / {SCORE_BATCH}))
SELECT p.subreddit_id AS prompt_community, b.subreddit_id AS eval_community, b.batch_no,
  {_SYSTEM_SQL} AS system_content, {_USER_SQL} AS user_content
FROM b CROSS JOIN elig p JOIN communities c ON c.name = p.subreddit_id
LEFT JOIN rules r ON r.subreddit_id = p.subreddit_id LEFT JOIN shots s ON s.subreddit_id = p.subreddit_id"""))
def q_request_messages(spark, d):
    """System + user message text for every (prompt community, eval batch) cell."""
    r = cell_requests(spark, d)
    return r.select("prompt_community", "eval_community", "batch_no",
                    F.col("messages")[0]["content"].alias("system_content"),
                    F.col("messages")[1]["content"].alias("user_content"))


@query("score_batches", with_fixtures(["comments"], _SPLIT_SQL + f"""
, elig_names AS (SELECT subreddit_id AS prompt_community FROM elig)
SELECT p.prompt_community, t.subreddit_id AS eval_community,
  CAST(floor(t.comment_id / {SCORE_BATCH}) AS BIGINT) AS batch_no, t.comment_id,
  CASE WHEN contains(lower(t.body), 'no') OR contains(lower(t.body), 'nicht') THEN 'violation'
       ELSE 'non_violation' END AS pred_label,
  CASE WHEN contains(lower(t.body), 'no') THEN 'no' WHEN contains(lower(t.body), 'nicht') THEN 'nicht'
       ELSE '' END AS evidence,
  t.true_label, NULL::VARCHAR AS error
FROM tests t CROSS JOIN elig_names p WHERE t.comment_id < 100"""))
def q_score_batches(spark, d):
    """Score every cell's batches with a deterministic keyword scorer, parse, join truth."""
    split = scoring_split(spark, d)
    reqs = cell_requests(spark, d, split)
    keys = ["prompt_community", "eval_community", "batch_no"]
    scored = SC.score_batches(reqs, SC.keyword_scorer(KEYWORDS), keys)
    preds = PR.predictions(PR.parse_outputs(scored, "content", batch_size=SCORE_BATCH), [*keys, "error"])
    truth = split.filter(F.col("split") == "test").select(
        F.col("subreddit_id").alias("eval_community"), "comment_id", "true_label")
    res = M.join_truth(preds, truth, ["eval_community", "comment_id"])
    return res.select(*keys, "comment_id", "pred_label", "evidence", "true_label", "error")


@query("scan_comments", with_fixtures(["all_comments"], """
SELECT comment_id, subreddit_id, body, label, target_reason, assigned_rule_cluster FROM all_comments"""))
def q_scan_comments(spark, d):
    """Comment CSV round trip (quoted multi-line bodies) with an explicit schema."""
    c = fx.all_comments(spark, d).select(*[f.name for f in RD.COMMENTS_SCHEMA.fields])
    path = RD.write_csv(c, scratch_path(spark, "comments-csv"))
    return RD.read_comments(spark, path)


@query("community_rules", with_fixtures(["comments"], """
, pairs AS (SELECT DISTINCT subreddit_id, target_reason AS short_name FROM comments WHERE target_reason IS NOT NULL)
SELECT subreddit_id, (row_number() OVER (PARTITION BY subreddit_id ORDER BY short_name) - 1)::BIGINT AS rule_no,
  short_name, CASE WHEN contains(short_name, 'no') THEN NULL ELSE 'don''t ' || short_name END AS violation_reason,
  short_name || ': ' || CASE WHEN contains(short_name, 'no') THEN '' ELSE 'don''t ' || short_name END AS rule_text
FROM pairs"""))
def q_community_rules(spark, d):
    """Rules CSV (padded cells, Python-literal lists) -> one formatted row per rule."""
    path = RD.write_rules_csv(fx.rules_literal(spark, d), scratch_path(spark, "rules-csv"))
    return RD.read_rules(spark, path)


def faulty_rules(spark, d):
    """Rule cells of every community, some broken: cut short, a number, empty, or with an element that is no rule."""
    k = F.conv(F.substring(F.md5("subreddit_id"), 1, 1), 16, 10).cast("int") % 5
    text = (F.when(k == 0, F.expr("left(rules, length(rules) - 1)")).when(k == 1, F.lit("42"))
            .when(k == 2, F.lit(None).cast("string"))
            .when(k == 3, F.concat(F.lit("['be kind', "), F.expr("substring(rules, 2)"))).otherwise(F.col("rules")))
    return fx.rules_literal(spark, d).select("subreddit_id", text.alias("rules"))


@query("rule_rejects", with_fixtures(["comments"], """
, names AS (SELECT DISTINCT subreddit_id FROM comments WHERE target_reason IS NOT NULL),
  k AS (SELECT subreddit_id, CAST('0x' || substr(md5(subreddit_id), 1, 1) AS BIGINT) % 5 AS k FROM names)
SELECT subreddit_id, CASE k WHEN 0 THEN 'not_a_literal' WHEN 1 THEN 'not_a_list' WHEN 2 THEN 'missing' ELSE 'not_a_rule' END AS error,
  CASE WHEN k = 3 THEN 0::BIGINT END AS rule_place
FROM k WHERE k < 4"""))
def q_rule_rejects(spark, d):
    """Rule cells and list elements that cannot be read, with their community, from a rules CSV."""
    path = RD.write_rules_csv(faulty_rules(spark, d), scratch_path(spark, "rules-csv"))
    return RD.rule_rejects(RD.parsed_rules(RD.read_rule_cells(spark, path)))


# ---- whole runs at the default sizes: 50 tests a class, batches of 10

CELL = ["prompt_community", "eval_community", "batch_no"]


def reference_requests(spark, d, split):
    """Requests of every (prompt, eval) cell of the language communities, as message chains."""
    c = fx.language_comments(spark, d)
    rules = RD.explode_rules(fx.rule_lists(c.where("label IS NOT NULL")))
    ctx = RQ.request_context(fx.language_communities(spark, d), rules, split.where("split = 'shots'"))
    b = RQ.batches(split.where("split = 'test'"), ["subreddit_id"])
    return RQ.message_chain(RQ.cell_requests(b, ctx, split.select("subreddit_id").distinct()), RQ.DEFAULT_CHAIN)


_LANG_CONTEXT_SQL = REFERENCE_SQL + """
, shots AS (SELECT subreddit_id, to_json(list(struct_pack(comment_id := comment_id, body := body, norm := norm,
                                                          true_label := true_label) ORDER BY comment_id))::VARCHAR AS shots_json
            FROM prepared WHERE split = 'shots' GROUP BY subreddit_id),
  rule_names AS (SELECT DISTINCT subreddit_id, target_reason AS short_name FROM language_comments
                 WHERE target_reason IS NOT NULL AND label IS NOT NULL),
  rules AS (SELECT subreddit_id, string_agg(short_name || ': ' || CASE WHEN contains(short_name, 'no') THEN ''
                                              ELSE 'don''t ' || short_name END, chr(10) ORDER BY short_name) AS rules_text
            FROM rule_names GROUP BY subreddit_id),
  c AS (SELECT DISTINCT subreddit_id, 'r/' || subreddit_id AS display_name_prefixed,
               'Comments in ' || subreddit_id AS public_description FROM prepared),
  b AS (SELECT subreddit_id, comment_id // 10 AS batch_no, min(comment_id) AS first_id, max(comment_id) AS last_id,
          to_json(list(struct_pack(comment_id := comment_id, norm := norm, comment := body) ORDER BY comment_id))::VARCHAR AS payload
        FROM prepared WHERE split = 'test' GROUP BY ALL)
"""
_CHAIN_SQL = ", ".join(f"{_template_sql(text, _VALUES)} AS step_{i}" for i, (_, text) in enumerate(RQ.DEFAULT_CHAIN))


@query("reference_chain", with_fixtures(["language_comments"], _LANG_CONTEXT_SQL + f"""
, msg AS (SELECT c.subreddit_id AS prompt_community, b.subreddit_id AS eval_community, b.batch_no, first_id, last_id, {_CHAIN_SQL}
          FROM b CROSS JOIN c LEFT JOIN rules r ON r.subreddit_id = c.subreddit_id
          LEFT JOIN shots s ON s.subreddit_id = c.subreddit_id)
SELECT prompt_community, eval_community, batch_no, first_id, last_id, 4::BIGINT AS n_messages,
  sha256(step_0) AS system_sha256, sha256(step_1) AS step_1_sha256, sha256(step_2) AS step_2_sha256, sha256(step_3) AS step_3_sha256
FROM msg"""))
def q_reference_chain(spark, d):
    """System message and three user steps of every cell's batches of ten, as digests."""
    r = reference_requests(spark, d, reference_prepared(spark, d))
    sha = lambda i: F.sha2(F.encode(F.col("messages")[i]["content"], "UTF-8"), 256)
    return r.select(*CELL, F.col("items")[0]["comment_id"].alias("first_id"),
                    F.element_at("items", -1)["comment_id"].alias("last_id"), F.size("messages").alias("n_messages"),
                    sha(0).alias("system_sha256"), *[sha(i).alias(f"step_{i}_sha256") for i in (1, 2, 3)])


def refusing_scorer(keywords, modulus: int = 4):
    """Keyword scorer that refuses a batch whose first comment's length is a multiple of ``modulus``."""
    score = SC.keyword_scorer(keywords)

    def run(messages):
        text = messages[-1]["content"]
        first = json.loads(text[text.index("["):text.rindex("]") + 1])[0]["comment"] or ""
        if len(first) % modulus == 0:
            raise ValueError(f"refused a comment of {len(first)} characters")
        return score(messages)
    return run


@query("score_results", with_fixtures(["language_comments"], REFERENCE_SQL + """
, tests AS (SELECT *, comment_id // 10 AS batch_no FROM prepared WHERE split = 'test'),
  firsts AS (SELECT subreddit_id, batch_no, length(coalesce(arg_min(body, comment_id), '')) AS n FROM tests GROUP BY ALL),
  res AS (SELECT p.subreddit_id AS prompt_community, t.subreddit_id AS eval_community, t.batch_no, t.comment_id, t.norm, t.true_label,
            md5(t.body) AS body_md5, f.n % 4 = 0 AS refused, f.n,
            CASE WHEN contains(lower(t.body), 'no') THEN 'no' WHEN contains(lower(t.body), 'nicht') THEN 'nicht' ELSE '' END AS hit
          FROM tests t JOIN firsts f USING (subreddit_id, batch_no) CROSS JOIN (SELECT DISTINCT subreddit_id FROM prepared) p)
SELECT prompt_community, eval_community, batch_no, comment_id, body_md5, norm, true_label,
  CASE WHEN NOT refused THEN CASE WHEN hit = '' THEN 'non_violation' ELSE 'violation' END END AS pred_label,
  CASE WHEN NOT refused THEN hit END AS evidence,
  CASE WHEN refused THEN 'ValueError: refused a comment of ' || n || ' characters' END AS error
FROM res"""))
def q_score_results(spark, d):
    """Runs at the default sizes, scored in two goes (the second resumes), as result rows with norm, evidence and error.

    Result rows are written as JSON per prompt community and read back.
    """
    split = reference_prepared(spark, d)
    reqs = materialize(reference_requests(spark, d, split).select(*CELL, "messages"), "requests")
    folder, scorer = scratch_path(spark, "scored-cells"), refusing_scorer(KEYWORDS)
    SC.score_resumable(reqs.where("batch_no % 2 = 0"), scorer, CELL, folder, commit_every=16)
    scored = SC.score_resumable(reqs, scorer, CELL, folder, commit_every=16)
    tests = split.where("split = 'test'").withColumnRenamed("subreddit_id", "eval_community")
    results, _ = SC.result_rows(scored, tests, CELL, ["eval_community"], BATCH_SIZE)
    path = RF.write_json(results, scratch_path(spark, "result-rows"), ["prompt_community"])
    back = spark.read.schema(results.schema).json(path)
    return back.select(*CELL, "comment_id", F.md5("body").alias("body_md5"), "norm", "true_label", "pred_label", "evidence", "error")
