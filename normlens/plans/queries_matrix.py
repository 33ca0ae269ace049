"""Cross-community grid queries and community dimension queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from normlens.operators import dims as D
from normlens.operators import matrix as X
from normlens.operators import rates as R
from normlens.plans import fixtures as fx
from normlens.plans.oracle_fixtures import with_fixtures
from normlens.plans.registry import query
from normlens.session import materialize
from normlens.sources.tables import read_table

MODEL = "org/model-a:free"

_GRID_SQL = """
, grid AS (SELECT p.name AS prompt_community, e.name AS eval_community, c.accuracy
           FROM communities p CROSS JOIN communities e
           LEFT JOIN cells c ON c.prompt_community = p.name AND c.eval_community = e.name),
  ng AS (SELECT *, CASE WHEN diag > 0 THEN accuracy / diag ELSE accuracy END AS norm_accuracy
         FROM (SELECT *, max(CASE WHEN prompt_community = eval_community THEN accuracy END)
                           OVER (PARTITION BY eval_community) AS diag FROM cells)),
  axis AS (SELECT count(DISTINCT name) AS n FROM communities),
  em AS (SELECT e.name AS community, coalesce(g.n_cells, 0) AS n_cells,
                CASE WHEN g.n_cells = (SELECT n FROM axis) THEN g.m END AS mean_accuracy,
                CASE WHEN g.n_cells = (SELECT n FROM axis) THEN g.nm END AS norm_mean
         FROM communities e LEFT JOIN (SELECT eval_community, count(*) AS n_cells, avg(accuracy) AS m,
                                              avg(norm_accuracy) AS nm FROM ng GROUP BY eval_community) g
           ON g.eval_community = e.name),
  pm AS (SELECT p.name AS community, coalesce(g.n_cells, 0) AS n_cells, g.m AS mean_accuracy, g.nm AS norm_mean
         FROM communities p LEFT JOIN (SELECT prompt_community, count(*) AS n_cells, avg(accuracy) AS m,
                                              avg(norm_accuracy) AS nm FROM ng GROUP BY prompt_community) g
           ON g.prompt_community = p.name),
  counts AS (SELECT subreddit_id, count(*) AS n FROM all_comments GROUP BY subreddit_id)
"""
_GRID_FX = ["cells", "communities", "all_comments"]


def _comm(spark, d):
    return fx.communities(spark, d)


@query("grid_accuracy", with_fixtures(_GRID_FX, _GRID_SQL + "SELECT prompt_community, eval_community, accuracy FROM grid"))
def q_grid_accuracy(spark, d):
    """Full prompt x eval grid; missing cells are NULL."""
    return X.full_grid(fx.cells(spark, d), _comm(spark, d))


@query("pending_cells", with_fixtures(_GRID_FX, _GRID_SQL + f"""
SELECT prompt_community, eval_community, '{MODEL}' AS model FROM grid WHERE accuracy IS NULL"""))
def q_pending_cells(spark, d):
    """Grid cells with no finished run for the model (resume list)."""
    finished = fx.cells(spark, d).withColumn("model", F.lit(MODEL))
    pend = X.pending_cells(_comm(spark, d), finished.filter(F.col("model") == MODEL))
    return pend.withColumn("model", F.lit(MODEL))


@query("normalized_grid", with_fixtures(_GRID_FX, _GRID_SQL + """
SELECT prompt_community, eval_community, accuracy, diag, norm_accuracy FROM ng"""))
def q_normalized_grid(spark, d):
    """Each eval row divided by its own diagonal cell when that is > 0."""
    return X.normalize_by_diagonal(fx.cells(spark, d))


@query("eval_means", with_fixtures(_GRID_FX, _GRID_SQL + """
SELECT community AS eval_community, n_cells, mean_accuracy FROM em"""))
def q_eval_means(spark, d):
    """Mean accuracy per eval community; NULL if any grid cell is missing."""
    return X.eval_means(fx.cells(spark, d), _comm(spark, d))


@query("prompt_means", with_fixtures(_GRID_FX, _GRID_SQL + """
SELECT community AS prompt_community, n_cells, mean_accuracy FROM pm"""))
def q_prompt_means(spark, d):
    """Mean accuracy per prompt community, missing cells skipped."""
    return X.prompt_means(fx.cells(spark, d), _comm(spark, d))


def _norm_means(spark, d):
    comm = _comm(spark, d)
    ng = X.normalize_by_diagonal(fx.cells(spark, d))
    e = X.eval_means(ng, comm, value="norm_accuracy").select(
        F.col("eval_community").alias("community"), F.col("mean_accuracy").alias("eval_norm_mean"))
    p = X.prompt_means(ng, comm, value="norm_accuracy").select(
        F.col("prompt_community").alias("community"), F.col("mean_accuracy").alias("prompt_norm_mean"))
    return e.join(p, "community")


@query("norm_means", with_fixtures(_GRID_FX, _GRID_SQL + """
SELECT em.community, em.norm_mean AS eval_norm_mean, pm.norm_mean AS prompt_norm_mean
FROM em JOIN pm ON em.community = pm.community"""))
def q_norm_means(spark, d):
    """Eval (strict) and prompt (skip-missing) means of the normalised grid."""
    return _norm_means(spark, d)


@query("matrix_order", with_fixtures(_GRID_FX, _GRID_SQL + """
SELECT em.community, em.mean_accuracy AS eval_mean, pm.mean_accuracy AS prompt_mean,
  coalesce(counts.n, 0) AS n_comments,
  row_number() OVER (ORDER BY em.mean_accuracy DESC NULLS LAST, em.community) AS eval_rank,
  row_number() OVER (ORDER BY pm.mean_accuracy DESC NULLS LAST, em.community) AS prompt_rank,
  row_number() OVER (ORDER BY em.norm_mean DESC NULLS LAST, em.community) AS norm_eval_rank,
  row_number() OVER (ORDER BY pm.norm_mean DESC NULLS LAST, em.community) AS norm_prompt_rank,
  row_number() OVER (ORDER BY coalesce(counts.n, 0) DESC, em.community) AS count_rank
FROM em JOIN pm ON em.community = pm.community LEFT JOIN counts ON counts.subreddit_id = em.community"""))
def q_matrix_order(spark, d):
    """Row / column order of the matrix by each mean and by comment count."""
    ranks = dict(zip(_AXIS_KEYS, ("eval_rank", "prompt_rank", "norm_eval_rank", "norm_prompt_rank", "count_rank")))
    t = axis_keys(spark, d)
    return t.join(X.axis_ranks(t, "community", ranks), "community").select(
        "community", "eval_mean", "prompt_mean", "n_comments", *ranks.values())


_AXIS_KEYS = ("eval_mean", "prompt_mean", "eval_norm_mean", "prompt_norm_mean", "n_comments")


def axis_keys(spark, d):
    """Per community all that the axes of the matrix are sorted by; stored, as it is read twice."""
    comm = _comm(spark, d)
    cells = fx.cells(spark, d)
    e = X.eval_means(cells, comm).select(F.col("eval_community").alias("community"),
                                         F.col("mean_accuracy").alias("eval_mean"))
    p = X.prompt_means(cells, comm).select(F.col("prompt_community").alias("community"),
                                           F.col("mean_accuracy").alias("prompt_mean"))
    nm = _norm_means(spark, d)
    cnt = R.count_by(fx.all_comments(spark, d), "subreddit_id", value=None).select(
        F.col("subreddit_id").alias("community"), F.col("n").alias("n_comments"))
    t = (e.join(p, "community").join(nm, "community").join(cnt, "community", "left")
         .withColumn("n_comments", F.coalesce("n_comments", F.lit(0))))
    return materialize(t, "axis-keys")


@query("ordered_grid", with_fixtures(_GRID_FX, _GRID_SQL + """
, k AS (SELECT em.community,
          row_number() OVER (ORDER BY em.mean_accuracy DESC NULLS LAST, em.community) AS eval_rank,
          row_number() OVER (ORDER BY pm.mean_accuracy DESC NULLS LAST, em.community) AS prompt_rank,
          row_number() OVER (ORDER BY em.norm_mean DESC NULLS LAST, em.community) AS norm_eval_rank,
          row_number() OVER (ORDER BY pm.norm_mean DESC NULLS LAST, em.community) AS norm_prompt_rank,
          row_number() OVER (ORDER BY coalesce(counts.n, 0) DESC, em.community) AS count_rank
        FROM em JOIN pm ON em.community = pm.community LEFT JOIN counts ON counts.subreddit_id = em.community)
SELECT g.prompt_community, g.eval_community, g.accuracy, e.eval_rank AS row_rank, p.prompt_rank AS col_rank,
  e.norm_eval_rank AS norm_row_rank, p.norm_prompt_rank AS norm_col_rank,
  e.count_rank AS count_row_rank, p.count_rank AS count_col_rank
FROM grid g JOIN k e ON e.community = g.eval_community JOIN k p ON p.community = g.prompt_community"""))
def q_ordered_grid(spark, d):
    """Every cell of the grid with its row and column, for each of the three orders of the axes."""
    t = axis_keys(spark, d)
    r = X.axis_ranks(t, "community", {"eval_mean": "e", "prompt_mean": "p", "eval_norm_mean": "ne",
                                      "prompt_norm_mean": "np", "n_comments": "n"})
    r = materialize(r, "axis-ranks")
    rows = {"e": "row_rank", "ne": "norm_row_rank", "n": "count_row_rank"}
    cols = {"p": "col_rank", "np": "norm_col_rank", "n": "count_col_rank"}
    grid = X.full_grid(fx.cells(spark, d), _comm(spark, d))
    return X.ordered_grid(grid, r, "community", rows, cols)


_COLUMNS = ", ".join(f"'src{k}'" for k in range(20))


@query("accuracy_matrix", with_fixtures(_GRID_FX, _GRID_SQL + f"""
SELECT * FROM (PIVOT (SELECT prompt_community, eval_community, round(accuracy, 6) AS accuracy FROM grid)
               ON prompt_community IN ({_COLUMNS}) USING max(accuracy) GROUP BY eval_community)"""))
def q_accuracy_matrix(spark, d):
    """Display matrix: rows = eval community, columns = prompt community."""
    comm = _comm(spark, d)
    return X.accuracy_matrix(X.full_grid(fx.cells(spark, d), comm), comm)


@query("community_labels", with_fixtures(_GRID_FX, _GRID_SQL + """
SELECT c.name, coalesce(counts.n, 0) AS n_comments,
  c.display_name_prefixed || ' (' || c.name || ') | n=' || CAST(coalesce(counts.n, 0) AS VARCHAR) AS label
FROM communities c LEFT JOIN counts ON counts.subreddit_id = c.name"""))
def q_community_labels(spark, d):
    """Axis labels '<name> (<id>) | n=<comments>' (0 when a community has none)."""
    cnt = R.count_by(fx.all_comments(spark, d), "subreddit_id", value=None)
    return X.community_labels(_comm(spark, d), cnt)


@query("top_accuracy_pairs", with_fixtures(_GRID_FX, _GRID_SQL + """
SELECT row_number() OVER (ORDER BY accuracy DESC, prompt_community, eval_community) AS rank,
  prompt_community, eval_community,
  'r/' || prompt_community || ' (' || prompt_community || ')' AS prompt_label,
  'r/' || eval_community || ' (' || eval_community || ')' AS eval_label, accuracy
FROM grid WHERE accuracy IS NOT NULL ORDER BY accuracy DESC, prompt_community, eval_community LIMIT 20"""))
def q_top_accuracy_pairs(spark, d):
    """20 best (prompt, eval) cells with display labels for both roles."""
    comm = _comm(spark, d)
    top = X.top_pairs(fx.cells(spark, d), 20)
    return X.label_grid(top, comm).select("rank", "prompt_community", "eval_community",
                                          "prompt_label", "eval_label", "accuracy")


def _doc_communities(spark, d):
    """Community rows as loaded, one per document (first row per name wins)."""
    docs = read_table(spark, d, "documents").select("doc_id", "source", "lang")
    return docs.select(F.col("source").alias("name"),
                       F.concat(F.lit("r/"), F.col("source")).alias("display_name_prefixed"),
                       F.concat(F.lit("About "), F.col("source"), F.lit(" ("), F.col("lang"),
                                F.lit(")")).alias("public_description"),
                       F.col("doc_id").alias("load_order"))


_DIM_SQL = """
, dim AS (SELECT source AS name, arg_min('r/' || source, doc_id) AS display_name_prefixed,
                 arg_min('About ' || source || ' (' || lang || ')', doc_id) AS public_description
          FROM documents GROUP BY source)
"""


@query("community_dim", with_fixtures([], _DIM_SQL + "SELECT * FROM dim"))
def q_community_dim(spark, d):
    """Community metadata with one row per name, the first loaded row winning."""
    rows = _doc_communities(spark, d)
    return D.first_by_key(rows, "name", "load_order",
                          ["display_name_prefixed", "public_description"])


@query("distinct_comments", with_fixtures(["all_comments"], """
SELECT DISTINCT subreddit_id, body, label, target_reason, assigned_rule_cluster FROM all_comments"""))
def q_distinct_comments(spark, d):
    """Full-row distinct comments (exact copies collapse)."""
    return D.distinct_rows(fx.all_comments(spark, d).drop("comment_id"))


@query("community_counts", with_fixtures(["all_comments"], _DIM_SQL + """
, dc AS (SELECT DISTINCT subreddit_id, body, label, target_reason, assigned_rule_cluster FROM all_comments)
SELECT dc.subreddit_id, dim.display_name_prefixed, count(*) AS count
FROM dc LEFT JOIN dim ON dim.name = dc.subreddit_id
GROUP BY dc.subreddit_id, dim.display_name_prefixed ORDER BY count DESC, dc.subreddit_id LIMIT 32"""))
def q_community_counts(spark, d):
    """Distinct comments per community with its display name, top 32."""
    dim = q_community_dim(spark, d).select(F.col("name").alias("subreddit_id"), "display_name_prefixed")
    c = fx.all_comments(spark, d).drop("comment_id")
    counts = D.distinct_counts(c, "subreddit_id")
    out = counts.join(dim, "subreddit_id", "left")
    return out.orderBy(F.col("count").desc(), F.col("subreddit_id")).limit(32)
