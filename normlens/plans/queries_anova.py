"""Two-way ANOVA queries.

The general table (grid accuracy ~ prompt + eval) is held against alternating
sweeps in a recursive CTE, with the F tail by Simpson's rule; with one 2-level
factor every sum of squares is a closed-form aggregate.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from normlens.operators import anova as AN
from normlens.plans import fixtures as fx
from normlens.plans.oracle_fixtures import with_fixtures
from normlens.plans.registry import query
from normlens.sources.tables import read_table


def _two_level_sql(src: str, y: str, a: str, b: str, a1: str) -> str:
    """Type II table when factor ``a`` has two levels (``a1`` is one of them)."""
    return f"""
, base AS (SELECT {a} AS a, {b} AS b, {y}::DOUBLE AS y FROM {src}
           WHERE {y} IS NOT NULL AND {a} IS NOT NULL AND {b} IS NOT NULL),
  mu AS (SELECT avg(y) AS m FROM base),
  c AS (SELECT a, b, count(*) AS n, sum(y - (SELECT m FROM mu)) AS s,
               sum((y - (SELECT m FROM mu)) * (y - (SELECT m FROM mu))) AS ss FROM base GROUP BY a, b),
  bt AS (SELECT b, sum(n) AS nb, sum(s) AS sb,
                coalesce(sum(n) FILTER (WHERE a = {a1}), 0) AS n1, coalesce(sum(s) FILTER (WHERE a = {a1}), 0) AS s1,
                coalesce(sum(n) FILTER (WHERE a <> {a1}), 0) AS n0, coalesce(sum(s) FILTER (WHERE a <> {a1}), 0) AS s0
         FROM c GROUP BY b),
  ta AS (SELECT a, sum(n) AS na, sum(s) AS sa FROM c GROUP BY a),
  w AS (SELECT n0 * n1 / nb AS w, s1 / n1 - s0 / n0 AS d FROM bt WHERE n0 > 0 AND n1 > 0),
  k AS (SELECT (SELECT power(sum(w * d), 2) / sum(w) FROM w) AS ss_a,
               (SELECT sum(ss) FROM c) AS t, (SELECT sum(n) FROM c) AS n,
               (SELECT sum(sb * sb / nb) FROM bt) AS qb, (SELECT sum(sa * sa / na) FROM ta) AS qa,
               (SELECT count(*) FROM bt) AS levels_b),
  r AS (SELECT ss_a, t - qb - ss_a AS rss, (t - qa) - (t - qb - ss_a) AS ss_b,
               1.0::DOUBLE AS df_a, (levels_b - 1)::DOUBLE AS df_b, (n - levels_b - 1)::DOUBLE AS df_r FROM k),
  tbl AS (SELECT '{a}' AS term, ss_a AS sum_sq, df_a AS df, (ss_a / df_a) / (rss / df_r) AS F,
                 ss_a / (ss_a + ss_b + rss) AS eta_sq FROM r
          UNION ALL
          SELECT '{b}', ss_b, df_b, (ss_b / df_b) / (rss / df_r), ss_b / (ss_a + ss_b + rss) FROM r
          UNION ALL
          SELECT 'Residual', rss, df_r, NULL, rss / (ss_a + ss_b + rss) FROM r)
SELECT term, round(sum_sq, 6) AS sum_sq, round(df, 6) AS df, round(F, 6) AS F, round(eta_sq, 6) AS eta_sq FROM tbl"""


def _sweeps_sql(src: str, y: str, a: str, b: str, sweeps: int = 120, points: int = 20_000) -> str:
    """Type II table of a connected grid: effects of ``a`` by ``sweeps`` alternating fits of both factors."""
    # P(F > f) = I_x(d_r / 2, d / 2) at x = d_r / (d_r + d f); with t = 1 - w^2 the integrand is smooth at both ends
    tail = """2 * exp(lgamma((d + d_r) / 2) - lgamma(d / 2) - lgamma(d_r / 2)) * (1 - sqrt(1 - x)) / {n} / 3 * (
      SELECT sum((CASE WHEN k = 0 OR k = {n} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * power(w, d - 1)
                 * power(greatest(1 - w * w, 0), d_r / 2 - 1))
      FROM (SELECT k, sqrt(1 - x) + (1 - sqrt(1 - x)) * k / {n} AS w FROM range({n} + 1) t(k)))""".format(n=points)
    return f"""
, base AS (SELECT {a} AS a, {b} AS b, {y}::DOUBLE AS y FROM {src}
           WHERE {y} IS NOT NULL AND {a} IS NOT NULL AND {b} IS NOT NULL),
  mu AS (SELECT avg(y) AS m FROM base),
  c AS (SELECT a, b, count(*) AS n, sum(y - (SELECT m FROM mu)) AS s,
               sum((y - (SELECT m FROM mu)) * (y - (SELECT m FROM mu))) AS ss FROM base GROUP BY a, b),
  ta AS (SELECT a, sum(n) AS n, sum(s) AS s FROM c GROUP BY a),
  tb AS (SELECT b, sum(n) AS n, sum(s) AS s FROM c GROUP BY b),
  fit AS (
    SELECT 0 AS k, a, 0.0::DOUBLE AS e FROM ta
    UNION ALL
    SELECT any_value(down.k) + 1, c.a, sum(c.s - c.n * down.e) / sum(c.n)
    FROM c JOIN (SELECT any_value(f.k) AS k, c.b, sum(c.s - c.n * f.e) / sum(c.n) AS e
                 FROM c JOIN fit f ON c.a = f.a WHERE f.k < {sweeps} GROUP BY c.b) down ON c.b = down.b
    GROUP BY c.a),
  ea AS (SELECT a, e FROM fit WHERE k = {sweeps}),
  eb AS (SELECT c.b, sum(c.s - c.n * ea.e) / sum(c.n) AS e FROM c JOIN ea ON c.a = ea.a GROUP BY c.b),
  r AS (SELECT (SELECT sum(ss - 2 * s * (ea.e + eb.e) + n * (ea.e + eb.e) * (ea.e + eb.e))
                FROM c JOIN ea ON c.a = ea.a JOIN eb ON c.b = eb.b) AS rss,
               (SELECT sum(ss) FROM c) AS t, (SELECT sum(s * s / n) FROM ta) AS qa, (SELECT sum(s * s / n) FROM tb) AS qb,
               (SELECT count(*) FROM ta)::DOUBLE AS la, (SELECT count(*) FROM tb)::DOUBLE AS lb, (SELECT sum(n) FROM c)::DOUBLE AS n),
  v AS (SELECT t - qb - rss AS ss_a, t - qa - rss AS ss_b, rss, la - 1 AS df_a, lb - 1 AS df_b, n - la - lb + 1 AS d_r FROM r),
  f AS (SELECT '{a}' AS term, ss_a AS ss, df_a AS d, * FROM v UNION ALL SELECT '{b}', ss_b, df_b, * FROM v),
  q AS (SELECT *, (ss / d) / (rss / d_r) AS F, d_r / (d_r + d * ((ss / d) / (rss / d_r))) AS x FROM f)
SELECT term, ss AS sum_sq, d AS df, F, {tail} AS p_value, ss / (ss_a + ss_b + rss) AS eta_sq FROM q
UNION ALL
SELECT 'Residual', rss, d_r, NULL, NULL, rss / (ss_a + ss_b + rss) FROM v"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("anova_two_way", _recursive(with_fixtures(["cells"], _sweeps_sql(
    "cells", "accuracy", "prompt_community", "eval_community"))))
def q_anova_two_way(spark, d):
    """Type II ANOVA of grid accuracy on prompt and eval community, with eta squared and p."""
    return AN.anova_two_way(spark, fx.cells(spark, d), "accuracy", "prompt_community", "eval_community")


@query("anova_source_language", _recursive(with_fixtures([], """
, docs AS (SELECT d.source, d.lang, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
""" + _sweeps_sql("docs", "quality", "source", "lang"))))
def q_anova_source_language(spark, d):
    """Type II ANOVA of the quality label on source and language (many rows a cell, unbalanced)."""
    docs = read_table(spark, d, "documents").select("doc_id", "source", "lang")
    labels = read_table(spark, d, "labels").select("doc_id", "quality")
    return AN.anova_two_way(spark, docs.join(labels, "doc_id"), "quality", "source", "lang")


@query("anova_two_level", with_fixtures([], """
, docs AS (SELECT d.lang, l.toxic, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
""" + _two_level_sql("docs", "quality", "toxic", "lang", "1")))
def q_anova_two_level(spark, d):
    """Type II ANOVA of the quality label on toxic (2 levels) and language."""
    docs = read_table(spark, d, "documents").select("doc_id", "lang")
    labels = read_table(spark, d, "labels").select("doc_id", "toxic", "quality")
    t = AN.anova_two_way(spark, docs.join(labels, "doc_id"), "quality", "toxic", "lang")
    return t.drop("p_value")


@query("anova_lineitem", with_fixtures([], _two_level_sql(
    "lineitem", "l_discount", "l_linestatus", "l_returnflag", "'O'")))
def q_anova_lineitem(spark, d):
    """Type II ANOVA of discount on line status (2 levels) and return flag (whole lineitem)."""
    li = read_table(spark, d, "lineitem")
    t = AN.anova_two_way(spark, li, "l_discount", "l_linestatus", "l_returnflag")
    return t.drop("p_value")
