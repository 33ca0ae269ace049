"""Score merge, z-scores, correlations and similarity queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from normlens.operators import corr as C
from normlens.plans import fixtures as fx
from normlens.plans.oracle_fixtures import with_fixtures
from normlens.plans.registry import query
from normlens.session import materialize, scratch_path
from normlens.sources import readers as RD

STATS = ["in_cluster_sim_mean", "in_cluster_sim_std", "cross_cluster_sim_mean",
         "cross_cluster_sim_std", "contrastive_score_mean", "contrastive_score_std"]
SIM_METRICS = ["accuracy", "n_items", *STATS]


def merged(spark, d):
    """The merged per-community table, written once: every statistic below
    reuses it several times (scalar subqueries, pair joins)."""
    comm = fx.communities(spark, d)
    return materialize(C.merge_scores(fx.accuracy(spark, d), comm, fx.scores(spark, d), comm),
                       "merged-scores")


def _long_sql(src: str, key: str, metrics: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {key}, '{m}' AS metric, {m}::DOUBLE AS value FROM {src}" for m in metrics)


_MERGED_SQL = f"""
, acc AS (SELECT regexp_replace(subreddit, '\\s*\\(.*\\)', '') AS clean, arg_max(accuracy, subreddit) AS accuracy
          FROM accuracy GROUP BY 1),
  meta AS (SELECT name, min(display_name_prefixed) AS subreddit FROM communities GROUP BY name),
  merged AS (SELECT m.name AS community, m.subreddit, acc.accuracy, sc.n_items, {", ".join("sc." + s for s in STATS)}
             FROM meta m JOIN acc ON acc.clean = m.subreddit JOIN scores sc ON sc.subreddit = m.subreddit),
  long AS ({_long_sql("merged", "community", SIM_METRICS)}),
  st AS (SELECT metric, avg(value) AS mu, stddev_samp(value) AS sd FROM long GROUP BY metric),
  z AS (SELECT l.community, l.metric, l.value, CASE WHEN st.sd <> 0 THEN (l.value - st.mu) / st.sd END AS z
        FROM long l JOIN st ON st.metric = l.metric),
  zm AS (SELECT community, CASE WHEN count(z) = {len(SIM_METRICS)} THEN avg(z) END AS m FROM z GROUP BY community),
  zd AS (SELECT z.community, z.metric, z.z - zm.m AS d FROM z JOIN zm ON zm.community = z.community),
  zn AS (SELECT community, sqrt(sum(d * d)) AS n FROM zd GROUP BY community),
  u AS (SELECT zd.community, zd.metric, CASE WHEN zn.n > 0 THEN zd.d / zn.n END AS u
        FROM zd JOIN zn ON zn.community = zd.community),
  pairs AS (SELECT a.community AS community_A, b.community AS community_B, sum(a.u * b.u) AS correlation
            FROM u a JOIN u b ON a.metric = b.metric AND a.community < b.community
            GROUP BY a.community, b.community),
  cent AS (SELECT m.community, avg(p.correlation) AS mean_correlation FROM merged m
           LEFT JOIN (SELECT community_A AS c, correlation FROM pairs UNION ALL
                      SELECT community_B AS c, correlation FROM pairs) p ON p.c = m.community
           GROUP BY m.community)
"""
_FX = ["accuracy", "communities", "scores"]


@query("merged_scores", with_fixtures(_FX, _MERGED_SQL + "SELECT * FROM merged"))
def q_merged_scores(spark, d):
    """Accuracy, metadata and similarity scores joined on the cleaned community name."""
    return merged(spark, d)


@query("zscores", with_fixtures(_FX, _MERGED_SQL + "SELECT community, metric, value, z FROM z"))
def q_zscores(spark, d):
    """Column z-scores (sample std) of every merged metric, long form."""
    return C.zscores(merged(spark, d), "community", SIM_METRICS)


@query("community_similarity", with_fixtures(_FX, _MERGED_SQL + "SELECT * FROM pairs"))
def q_community_similarity(spark, d):
    """Pearson r between z-scored metric vectors for every community pair."""
    return C.community_similarity(merged(spark, d), "community", SIM_METRICS)


@query("similar_pairs", with_fixtures(_FX, _MERGED_SQL + """
SELECT *, row_number() OVER (ORDER BY correlation DESC NULLS LAST, community_A, community_B) AS rank
FROM pairs ORDER BY correlation DESC NULLS LAST, community_A, community_B LIMIT 10"""))
def q_similar_pairs(spark, d):
    """Ten most similar community pairs."""
    return C.extreme_pairs(merged(spark, d), "community", SIM_METRICS, 10)


@query("different_pairs", with_fixtures(_FX, _MERGED_SQL + """
SELECT *, row_number() OVER (ORDER BY correlation ASC NULLS LAST, community_A, community_B) AS rank
FROM pairs ORDER BY correlation ASC NULLS LAST, community_A, community_B LIMIT 10"""))
def q_different_pairs(spark, d):
    """Ten least similar community pairs."""
    return C.extreme_pairs(merged(spark, d), "community", SIM_METRICS, 10, ascending=True)


@query("community_centrality", with_fixtures(_FX, _MERGED_SQL + "SELECT * FROM cent"))
def q_community_centrality(spark, d):
    """Mean similarity of each community to all others (no pair materialisation)."""
    return C.community_centrality(merged(spark, d), "community", SIM_METRICS)


@query("central_communities", with_fixtures(_FX, _MERGED_SQL + """
SELECT *, row_number() OVER (ORDER BY mean_correlation DESC, community) AS rank FROM cent
WHERE mean_correlation IS NOT NULL ORDER BY mean_correlation DESC, community LIMIT 10"""))
def q_central_communities(spark, d):
    """Ten most central communities."""
    c = C.community_centrality(merged(spark, d), "community", SIM_METRICS)
    # NULLs sort last, so dropping them after the limit keeps the same rows
    # (and keeps the filter from being pushed into the vector expressions)
    top = C.top_pairs(c, 10, value="mean_correlation", keys=["community"])
    return top.filter(F.col("mean_correlation").isNotNull())


@query("outlier_communities", with_fixtures(_FX, _MERGED_SQL + """
SELECT *, row_number() OVER (ORDER BY mean_correlation DESC, community DESC) AS rank FROM (
  SELECT * FROM cent WHERE mean_correlation IS NOT NULL ORDER BY mean_correlation ASC, community ASC LIMIT 10)"""))
def q_outlier_communities(spark, d):
    """Ten least central communities (shown most central first)."""
    c = C.community_centrality(merged(spark, d), "community", SIM_METRICS)
    low = (c.orderBy(F.col("mean_correlation").asc_nulls_last(), F.col("community").asc()).limit(10)
           .filter(F.col("mean_correlation").isNotNull()))
    return low.withColumn("rank", F.row_number().over(
        Window.orderBy(F.col("mean_correlation").desc(), F.col("community").desc())))


@query("score_correlations", with_fixtures(_FX, _MERGED_SQL + """
SELECT l.metric, count(*) AS n,
  CASE WHEN stddev_samp(l.value) * stddev_samp(m.accuracy) > 0
       THEN covar_samp(l.value, m.accuracy) / (stddev_samp(l.value) * stddev_samp(m.accuracy)) END AS r
FROM long l JOIN merged m ON m.community = l.community
WHERE l.metric NOT IN ('accuracy', 'n_items') AND l.value IS NOT NULL AND m.accuracy IS NOT NULL
GROUP BY l.metric"""))
def q_score_correlations(spark, d):
    """Pearson r of each numeric score column (n_items excluded) with accuracy."""
    m = merged(spark, d)
    cols = C.numeric_columns(m, exclude=["accuracy", "n_items"])
    return C.score_correlations(m, "accuracy", cols)


@query("score_rankings", with_fixtures(["scores"], f"""
, long AS ({_long_sql("scores", "subreddit", STATS)})
SELECT subreddit, metric, value,
  row_number() OVER (PARTITION BY metric ORDER BY value DESC NULLS LAST, subreddit) AS rank FROM long"""))
def q_score_rankings(spark, d):
    """Communities ranked by each of the six similarity statistics."""
    return C.rank_within(fx.scores(spark, d), "subreddit", STATS)


@query("scan_scores", with_fixtures(["scores"], "SELECT * FROM scores"))
def q_scan_scores(spark, d):
    """Score CSV round trip: write the scores as CSV, read back with an explicit schema."""
    path = RD.write_csv(fx.scores(spark, d), scratch_path(spark, "scores-csv"))
    return RD.read_scores(spark, path)
