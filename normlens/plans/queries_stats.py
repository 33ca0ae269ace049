"""Label, rate, length and word statistics over the comment corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from normlens.constants import ALL_STOPWORDS
from normlens.functions.text import clean_text
from normlens.operators import rates as R
from normlens.operators import words as Wd
from normlens.plans import fixtures as fx
from normlens.plans.oracle_fixtures import with_fixtures
from normlens.plans.registry import query
from normlens.session import materialize

_RESTRICT_SQL = "coalesce(regexp_matches(target_reason, '(?i)(?:no|not)'), false)"
_STOP_SQL = ", ".join("'" + w + "'" for w in sorted(ALL_STOPWORDS))
_CLEAN_SQL = ("lower(regexp_replace(replace(replace(replace(body, '&gt;', '>'), '&lt;', '<'), '&amp;', '&'), "
              "'[^\\p{L}\\p{N}_\\s]', '', 'g'))")


def _rate_sql(src: str, group: str, rule: str = "positive") -> str:
    cond = "n_violation > 0" if rule == "positive" else "n_violation > 0 AND n_non_violation > 0"
    return f"""
SELECT {group}, n_violation, n_non_violation, n_violation + n_non_violation AS total,
  round(CASE WHEN {cond} THEN n_violation::DOUBLE / (n_violation + n_non_violation) END, 6) AS rate
FROM (SELECT {group}, count(*) FILTER (WHERE label = 'violation') AS n_violation,
             count(*) FILTER (WHERE label = 'non_violation') AS n_non_violation
      FROM {src} WHERE {group} IS NOT NULL AND label IN ('violation', 'non_violation') GROUP BY {group})"""


def _top_sql(src: str, group: str, n: int) -> str:
    return f"""
SELECT *, row_number() OVER (ORDER BY rate DESC NULLS LAST, {group}) AS rank
FROM ({_rate_sql(src, group)}) ORDER BY rate DESC NULLS LAST, {group} LIMIT {n}"""


def _tail_sql(src: str, group: str, n: int) -> str:
    return f"""
SELECT *, row_number() OVER (ORDER BY rate DESC, {group}) AS rank FROM (
  SELECT * FROM ({_rate_sql(src, group)}) WHERE rate > 0 ORDER BY rate ASC, {group} DESC LIMIT {n})"""


@query("label_counts", with_fixtures(["comments"], """
SELECT label, count(*) AS n FROM comments WHERE label IS NOT NULL GROUP BY label"""))
def q_label_counts(spark, d):
    """How many comments carry each label."""
    return R.label_counts(fx.comments(spark, d))


@query("filter_label", with_fixtures(["comments"], """
SELECT comment_id, subreddit_id, target_reason FROM comments WHERE label = 'violation'"""))
def q_filter_label(spark, d):
    """Violating comments (label equality filter)."""
    return R.filter_label(fx.comments(spark, d)).select("comment_id", "subreddit_id", "target_reason")


@query("cluster_violations", with_fixtures(["comments"], """
SELECT assigned_rule_cluster, count(*) AS n FROM comments
WHERE label = 'violation' AND assigned_rule_cluster IS NOT NULL GROUP BY assigned_rule_cluster"""))
def q_cluster_violations(spark, d):
    """Violations per rule cluster."""
    return R.count_by(fx.comments(spark, d), "assigned_rule_cluster")


@query("cluster_rates", with_fixtures(["comments"], _rate_sql("comments", "assigned_rule_cluster", "both")))
def q_cluster_rates(spark, d):
    """Violation rate per rule cluster; NULL unless both labels occur."""
    return R.rate_by(fx.comments(spark, d), "assigned_rule_cluster", null_rule="both")


@query("reason_rates_top", with_fixtures(["comments"], _top_sql("comments", "target_reason", 20)))
def q_reason_rates_top(spark, d):
    """Top 20 target reasons by violation rate (NULL rates last)."""
    return R.top_rates(R.rate_by(fx.comments(spark, d), "target_reason"), "target_reason", 20)


@query("reason_rates_tail", with_fixtures(["comments"], _tail_sql("comments", "target_reason", 20)))
def q_reason_rates_tail(spark, d):
    """Lowest 20 non-zero target-reason rates."""
    return R.tail_rates(R.rate_by(fx.comments(spark, d), "target_reason"), "target_reason", 20)


@query("question_labels", with_fixtures(["comments"], """
SELECT label, count(*) AS n FROM comments WHERE ends_with(body, '?') AND label IS NOT NULL GROUP BY label"""))
def q_question_labels(spark, d):
    """Label counts among comments that end with a question mark."""
    return R.label_counts(R.questions(fx.comments(spark, d)))


@query("restrictive_norms", with_fixtures(["comments"], f"""
, restricted AS (SELECT * FROM comments WHERE {_RESTRICT_SQL})
{_top_sql("restricted", "target_reason", 10)}"""))
def q_restrictive_norms(spark, d):
    """Top 10 violation rates among restrictive norms (substring no|not)."""
    src = R.restrictive(fx.comments(spark, d))
    return R.top_rates(R.rate_by(src, "target_reason"), "target_reason", 10)


@query("unrestrictive_norms", with_fixtures(["comments"], f"""
, unrestricted AS (SELECT * FROM comments WHERE NOT {_RESTRICT_SQL})
{_top_sql("unrestricted", "target_reason", 10)}"""))
def q_unrestrictive_norms(spark, d):
    """Top 10 violation rates among the other norms."""
    src = R.unrestrictive(fx.comments(spark, d))
    return R.top_rates(R.rate_by(src, "target_reason"), "target_reason", 10)


@query("distinct_reasons", with_fixtures(["comments"], f"""
SELECT DISTINCT 'restrictive' AS kind, target_reason FROM comments WHERE {_RESTRICT_SQL}
UNION ALL
SELECT DISTINCT 'unrestrictive' AS kind, target_reason FROM comments WHERE NOT {_RESTRICT_SQL}"""))
def q_distinct_reasons(spark, d):
    """Distinct restrictive and unrestrictive reasons (NULL is unrestrictive)."""
    c = fx.comments(spark, d)
    a = R.distinct_values(R.restrictive(c), "target_reason").select(F.lit("restrictive").alias("kind"), "target_reason")
    b = R.distinct_values(R.unrestrictive(c), "target_reason").select(F.lit("unrestrictive").alias("kind"), "target_reason")
    return a.unionByName(b)


@query("length_bin_rates", with_fixtures(["comments"], """
, l AS (SELECT length(body) AS len, label FROM comments WHERE body IS NOT NULL),
  s AS (SELECT min(len)::DOUBLE AS mn, max(len)::DOUBLE AS mx FROM l),
  e AS (SELECT CASE WHEN mn = mx THEN mn - (CASE WHEN mn <> 0 THEN abs(mn) * 0.001 ELSE 0.001 END) ELSE mn END AS lo,
               CASE WHEN mn = mx THEN mx + (CASE WHEN mx <> 0 THEN abs(mx) * 0.001 ELSE 0.001 END) ELSE mx END AS hi,
               mn, mx FROM s),
  b AS (SELECT 1 + (SELECT count(*) FROM range(1, 20) r(i) WHERE e.lo + i * ((e.hi - e.lo) / 20.0) < l.len) AS bin, l.label
        FROM l, e),
  agg AS (SELECT bin, count(*) AS n, count(*) FILTER (WHERE label = 'violation') AS nv FROM b GROUP BY bin)
SELECT sp.i::BIGINT AS bin,
  round(CASE WHEN sp.i = 1 THEN (CASE WHEN e.mn = e.mx THEN e.lo ELSE e.lo - (e.mx - e.mn) * 0.001 END)
             ELSE e.lo + (sp.i - 1) * ((e.hi - e.lo) / 20.0) END, 6) AS bin_left,
  round(CASE WHEN sp.i = 20 THEN e.hi ELSE e.lo + sp.i * ((e.hi - e.lo) / 20.0) END, 6) AS bin_right,
  coalesce(agg.n, 0) AS n_comments,
  round(agg.nv::DOUBLE / agg.n, 6) AS rate
FROM range(1, 21) sp(i) CROSS JOIN e LEFT JOIN agg ON agg.bin = sp.i"""))
def q_length_bin_rates(spark, d):
    """Violation rate per 20 equal-width comment-length bins (empty bins kept)."""
    # the texts are read once; the per-length counts are small and reused
    counts = materialize(R.length_counts(fx.comments(spark, d)), "length-counts")
    return R.bin_rates(counts, spark)


_WORDS_SQL = f"""
, w AS (SELECT unnest(regexp_split_to_array({_CLEAN_SQL}, '\\s+')) AS word, label
        FROM comments WHERE label IN ('violation', 'non_violation')),
  wc AS (SELECT word, count(*) FILTER (WHERE label = 'violation') AS n_violation,
                count(*) FILTER (WHERE label = 'non_violation') AS n_non_violation, count(*) AS total
         FROM w WHERE word <> '' GROUP BY word),
  wr AS (SELECT *, n_violation::DOUBLE / total AS rate FROM wc
         WHERE total >= 20 AND word NOT IN ({_STOP_SQL}))
"""


@query("word_counts", with_fixtures(["comments"], _WORDS_SQL + "SELECT * FROM wc"))
def q_word_counts(spark, d):
    """Occurrences of every cleaned word under each label."""
    return Wd.word_counts(fx.comments(spark, d))


@query("word_rates", with_fixtures(["comments"], _WORDS_SQL + """
SELECT word, n_violation, n_non_violation, total, round(rate, 6) AS rate,
  row_number() OVER (ORDER BY rate DESC, word) AS rank
FROM wr ORDER BY rate DESC, word LIMIT 50"""))
def q_word_rates(spark, d):
    """50 common words (>= 20 uses, no stopwords) most associated with violations."""
    return Wd.top_words(Wd.word_rates(Wd.word_counts(fx.comments(spark, d))), 50)


@query("word_rates_low", with_fixtures(["comments"], _WORDS_SQL + """
SELECT word, n_violation, n_non_violation, total, round(rate, 6) AS rate,
  row_number() OVER (ORDER BY rate, word) AS rank
FROM wr WHERE rate > 0 ORDER BY rate, word LIMIT 50"""))
def q_word_rates_low(spark, d):
    """50 common words with the lowest non-zero violation rate."""
    return Wd.low_words(Wd.word_rates(Wd.word_counts(fx.comments(spark, d))), 50)


@query("unique_words", with_fixtures(["comments"], _WORDS_SQL + """
SELECT * FROM (
  SELECT label, word, n, row_number() OVER (PARTITION BY label ORDER BY n DESC, word) AS rank FROM (
    SELECT 'violation' AS label, word, n_violation AS n FROM wc WHERE n_non_violation = 0 AND n_violation > 0
    UNION ALL
    SELECT 'non_violation' AS label, word, n_non_violation AS n FROM wc WHERE n_violation = 0 AND n_non_violation > 0))
WHERE rank <= 10"""))
def q_unique_words(spark, d):
    """Ten most frequent words seen only in violations, and only in non-violations."""
    return Wd.unique_words(Wd.word_counts(fx.comments(spark, d)), n=10)


@query("clean_text", with_fixtures(["all_comments"], f"""
SELECT comment_id, {_CLEAN_SQL} AS clean_body FROM all_comments"""))
def q_clean_text(spark, d):
    """Whole comment texts HTML-decoded, punctuation-stripped and lower-cased."""
    c = fx.all_comments(spark, d)
    return c.select("comment_id", clean_text(F.col("body")).alias("clean_body"))
