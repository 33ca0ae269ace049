"""Preparation queries: eligibility, norms, balanced draws, split files."""

from __future__ import annotations

from pyspark.sql import functions as F

from normlens.operators import prep as P
from normlens.plans import fixtures as fx
from normlens.plans.oracle_fixtures import with_fixtures
from normlens.plans.registry import query
from normlens.session import materialize, scratch_path
from normlens.sources import splits as S

# parameters sized for the fixture corpus (13-26 labelled rows per community at sf0.01)
MIN_COUNT = 18
N_TEST = 2
N_SHOTS = 1
EXCLUDED = ["src3", "src7", "not_a_community"]


def eligible_comments(spark, d):
    c = fx.comments(spark, d)
    return c.join(eligible(spark, d), "subreddit_id", "left_semi")


def eligible(spark, d):
    return P.eligible_communities(fx.comments(spark, d), min_count=MIN_COUNT).select("subreddit_id")


def eligible_draw(spark, d, n_test=N_TEST, n_shots=N_SHOTS):
    """The balanced draw of every eligible community."""
    return P.balanced_split(fx.comments(spark, d), n_test=n_test, n_shots=n_shots, communities=eligible(spark, d))


def prepared(spark, d):
    """Draw first, then attach norms to the drawn rows only (the hash choice
    depends on the id alone, so the order does not change the result)."""
    return with_norms(spark, d, eligible_draw(spark, d))


def with_norms(spark, d, drawn):
    return P.prepared_examples(P.assign_norms(drawn, P.community_norms(fx.comments(spark, d), communities=eligible(spark, d))))


_NORMS_SQL = """
, pairs AS (SELECT DISTINCT subreddit_id, target_reason AS norm FROM {src}
            WHERE label = 'violation' AND target_reason IS NOT NULL),
  norms AS (SELECT subreddit_id, norm, row_number() OVER (PARTITION BY subreddit_id ORDER BY norm) - 1 AS norm_index,
                   count(*) OVER (PARTITION BY subreddit_id) AS n_norms FROM pairs),
  nn AS (SELECT DISTINCT subreddit_id, n_norms FROM norms),
  assigned AS (
    SELECT c.*, CASE WHEN c.label = 'non_violation' THEN n.norm ELSE c.target_reason END AS norm
    FROM (SELECT c.*, CASE WHEN c.label = 'non_violation' AND nn.n_norms > 0 THEN
                 ('0x' || substr(md5('21:norm:' || CAST(c.comment_id AS VARCHAR)), 1, 8))::BIGINT % nn.n_norms END AS pick
          FROM {src} c LEFT JOIN nn ON c.subreddit_id = nn.subreddit_id) c
    LEFT JOIN norms n ON n.subreddit_id = c.subreddit_id AND n.norm_index = c.pick)
"""

_ELIGIBLE_SQL = f"""
, elig AS (SELECT subreddit_id, count(*) AS n_comments FROM comments GROUP BY subreddit_id HAVING count(*) > {MIN_COUNT}),
  ec AS (SELECT * FROM comments WHERE subreddit_id IN (SELECT subreddit_id FROM elig))
"""

_SPLIT_SQL = _ELIGIBLE_SQL + _NORMS_SQL.format(src="ec") + f"""
, ranked AS (SELECT *, row_number() OVER (PARTITION BY subreddit_id, label
                   ORDER BY md5('21:' || CAST(comment_id AS VARCHAR)), comment_id) AS draw_rank
             FROM assigned WHERE label IN ('violation', 'non_violation')),
  split AS (SELECT *, CASE WHEN draw_rank <= {N_TEST} THEN 'test' ELSE 'shots' END AS split
            FROM ranked WHERE draw_rank <= {N_TEST + N_SHOTS}),
  prepared AS (SELECT subreddit_id, split,
                 row_number() OVER (PARTITION BY subreddit_id, split
                   ORDER BY md5('21:order:' || CAST(comment_id AS VARCHAR)), comment_id) - 1 AS comment_id,
                 body, norm, label AS true_label, comment_id AS source_id FROM split)
"""


@query("eligible_communities", with_fixtures(["all_comments"], f"""
SELECT subreddit_id, count(*) AS n_comments FROM all_comments WHERE subreddit_id IS NOT NULL
GROUP BY subreddit_id HAVING count(*) > {MIN_COUNT}"""))
def q_eligible_communities(spark, d):
    """Communities with more than MIN_COUNT comments."""
    return P.eligible_communities(fx.all_comments(spark, d), min_count=MIN_COUNT)


@query("exclude_communities", with_fixtures(["all_comments"], """
SELECT comment_id, subreddit_id FROM all_comments WHERE subreddit_id NOT IN ('src3', 'src7', 'not_a_community')"""))
def q_exclude_communities(spark, d):
    """Comments outside a list of excluded community ids."""
    return P.exclude_communities(fx.all_comments(spark, d), EXCLUDED).select("comment_id", "subreddit_id")


@query("community_norms", with_fixtures(["comments"], _NORMS_SQL.format(src="comments") + """
SELECT subreddit_id, norm, norm_index, n_norms FROM norms"""))
def q_community_norms(spark, d):
    """Distinct norms of violating comments per community (long form, indexed)."""
    return P.community_norms(fx.comments(spark, d))


@query("assign_norms", with_fixtures(["comments"], _NORMS_SQL.format(src="comments") + """
SELECT comment_id, subreddit_id, label, norm FROM assigned"""))
def q_assign_norms(spark, d):
    """Every comment with a norm: own reason, or a seeded pick for non-violations."""
    c = fx.comments(spark, d)
    return P.assign_norms(c, P.community_norms(c)).select("comment_id", "subreddit_id", "label", "norm")


@query("balanced_split", with_fixtures(["comments"], _SPLIT_SQL + """
SELECT subreddit_id, label, comment_id, draw_rank, split FROM split"""))
def q_balanced_split(spark, d):
    """Seeded balanced test / few-shot draw per eligible community and label."""
    s = eligible_draw(spark, d)
    return s.select("subreddit_id", "label", "comment_id", "draw_rank", "split")


@query("split_shortfall", with_fixtures(["comments"], _SPLIT_SQL + f"""
SELECT c.subreddit_id, l.label, s.split, (CASE WHEN s.split = 'test' THEN {N_TEST} ELSE {N_SHOTS} END)::BIGINT AS requested,
  count(t.comment_id) AS taken, CASE WHEN s.split = 'test' THEN {N_TEST} ELSE {N_SHOTS} END - count(t.comment_id) AS shortfall
FROM (SELECT DISTINCT subreddit_id FROM ec) c CROSS JOIN (VALUES ('violation'), ('non_violation')) l(label)
CROSS JOIN (VALUES ('test'), ('shots')) s(split)
LEFT JOIN split t ON t.subreddit_id = c.subreddit_id AND t.label = l.label AND t.split = s.split
GROUP BY c.subreddit_id, l.label, s.split"""))
def q_split_shortfall(spark, d):
    """Rows requested vs taken per community, label and split."""
    # eligible communities have comments, so the list itself names them all
    return P.split_shortfall(eligible_draw(spark, d), n_test=N_TEST, n_shots=N_SHOTS, communities=eligible(spark, d))


@query("sequence_ids", with_fixtures(["comments"], _SPLIT_SQL + """
SELECT subreddit_id, split, comment_id, source_id, norm, true_label FROM prepared"""))
def q_sequence_ids(spark, d):
    """Prepared examples: 0-based ids per (community, split) in seeded order."""
    return prepared(spark, d).drop("body")


@query("union_samples", with_fixtures(["comments"], _SPLIT_SQL + """
SELECT subreddit_id, comment_id, label FROM split WHERE split = 'test' AND label = 'violation'
UNION ALL
SELECT subreddit_id, comment_id, label FROM split WHERE split = 'test' AND label = 'non_violation'"""))
def q_union_samples(spark, d):
    """Bag union of the per-class test samples."""
    s = eligible_draw(spark, d)
    t = s.filter(F.col("split") == "test").select("subreddit_id", "comment_id", "label")
    return t.filter(F.col("label") == "violation").unionByName(
        t.filter(F.col("label") == "non_violation"))


@query("write_splits", with_fixtures(["comments"], _SPLIT_SQL + """
SELECT subreddit_id, split, comment_id, source_id, norm, true_label, length(body)::BIGINT AS body_chars
FROM prepared"""))
def q_write_splits(spark, d):
    """Write prepared examples partitioned by (community, split); read them back."""
    prep = prepared(spark, d)
    path = S.write_splits(prep, scratch_path(spark, "splits"))
    back = S.read_split(spark, path, schema=prep.schema)
    return back.select("subreddit_id", "split", "comment_id", "source_id", "norm", "true_label",
                       F.length("body").cast("bigint").alias("body_chars"))


@query("community_tests", with_fixtures(["comments"], _SPLIT_SQL + """
SELECT subreddit_id, comment_id, body, norm, true_label FROM prepared WHERE split = 'test'"""))
def q_community_tests(spark, d):
    """Test rows of every community via partition-pruned reads of the split dataset."""
    prep = prepared(spark, d)
    path = S.write_splits(prep, scratch_path(spark, "splits"))
    t = S.read_split(spark, path, split="test", schema=prep.schema)
    return t.select("subreddit_id", "comment_id", "body", "norm", "true_label")


@query("scan_split_csv", with_fixtures(["comments"], _SPLIT_SQL + """
SELECT subreddit_id, split, comment_id, nullif(body, '') AS body, nullif(norm, '') AS norm, true_label FROM prepared"""))
def q_scan_split_csv(spark, d):
    """tests.csv and shots.csv of every community, written as files and scanned with keys from the path."""
    base = S.write_split_csv(prepared(spark, d), scratch_path(spark, "communities"))
    return S.read_split_csv(spark, base)


@query("tests_of_eligible", with_fixtures(["comments"], _NORMS_SQL.format(src="comments") + f"""
, ranked AS (SELECT *, row_number() OVER (PARTITION BY subreddit_id, label
                   ORDER BY md5('21:' || CAST(comment_id AS VARCHAR)), comment_id) AS draw_rank
             FROM assigned WHERE label IN ('violation', 'non_violation')),
  prepared AS (SELECT *, row_number() OVER (PARTITION BY subreddit_id
                   ORDER BY md5('21:order:' || CAST(comment_id AS VARCHAR)), comment_id) - 1 AS seq
               FROM ranked WHERE draw_rank <= {N_TEST})
SELECT subreddit_id, seq AS comment_id, norm, label AS true_label FROM prepared
WHERE subreddit_id IN (SELECT subreddit_id FROM comments GROUP BY subreddit_id HAVING count(*) > {MIN_COUNT})"""))
def q_tests_of_eligible(spark, d):
    """Test rows of the eligible communities out of a split dataset of all, pruned by the joined set."""
    c = fx.comments(spark, d)
    drawn = P.balanced_split(c, n_test=N_TEST, n_shots=N_SHOTS)
    prep = P.prepared_examples(P.assign_norms(drawn, P.community_norms(c)))
    path = S.write_splits(prep, scratch_path(spark, "splits"))
    elig = P.eligible_communities(c, min_count=MIN_COUNT)
    return S.read_split(spark, path, "test", elig, schema=prep.schema).select(
        "subreddit_id", "comment_id", "norm", "true_label")


# ---- the draw at the default sizes, over communities that are large enough for it (languages)

REFERENCE_SQL = _NORMS_SQL.format(src="ec").replace(", pairs AS", """
, elig AS (SELECT subreddit_id, count(*) AS n_comments FROM language_comments WHERE subreddit_id IS NOT NULL
           GROUP BY subreddit_id HAVING count(*) > 106),
  ec AS (SELECT * FROM language_comments WHERE label IS NOT NULL AND subreddit_id IN (SELECT subreddit_id FROM elig)),
  pairs AS""", 1) + """
, ranked AS (SELECT *, row_number() OVER (PARTITION BY subreddit_id, label
                   ORDER BY md5('21:' || CAST(comment_id AS VARCHAR)), comment_id) AS draw_rank FROM assigned),
  split AS (SELECT *, CASE WHEN draw_rank <= 50 THEN 'test' ELSE 'shots' END AS split FROM ranked WHERE draw_rank <= 53),
  prepared AS (SELECT subreddit_id, split,
                 row_number() OVER (PARTITION BY subreddit_id, split
                   ORDER BY md5('21:order:' || CAST(comment_id AS VARCHAR)), comment_id) - 1 AS comment_id,
                 body, norm, label AS true_label, comment_id AS source_id FROM split)
"""


def reference_comments(spark, d):
    """Labelled comments of the language communities, and the communities with more than 106 comments."""
    c = fx.language_comments(spark, d)
    return c.where("label IS NOT NULL"), P.eligible_communities(c).select("subreddit_id")


def reference_prepared(spark, d):
    """50 tests and 3 shots a class, with norms and ids; stored once for all that reads it."""
    c, elig = reference_comments(spark, d)
    drawn = P.balanced_split(c, communities=elig)
    return materialize(P.prepared_examples(P.assign_norms(drawn, P.community_norms(c, communities=elig))), "reference-split")


@query("reference_eligible", with_fixtures(["language_comments"], REFERENCE_SQL + "SELECT * FROM elig"))
def q_reference_eligible(spark, d):
    """Language communities with more than 106 comments."""
    return P.eligible_communities(fx.language_comments(spark, d))


@query("reference_split", with_fixtures(["language_comments"], REFERENCE_SQL + """
SELECT subreddit_id, split, comment_id, source_id, norm, true_label FROM prepared"""))
def q_reference_split(spark, d):
    """Balanced draw at the default sizes: 50 tests and 3 shots per class and community."""
    return reference_prepared(spark, d).drop("body")


@query("reference_shortfall", with_fixtures(["language_comments"], REFERENCE_SQL + """
SELECT c.subreddit_id, l.label, s.split, CASE WHEN s.split = 'test' THEN 50::BIGINT ELSE 3::BIGINT END AS requested,
  count(t.comment_id) AS taken, CASE WHEN s.split = 'test' THEN 50 ELSE 3 END - count(t.comment_id) AS shortfall
FROM (SELECT DISTINCT subreddit_id FROM ec) c CROSS JOIN (VALUES ('violation'), ('non_violation')) l(label)
CROSS JOIN (VALUES ('test'), ('shots')) s(split)
LEFT JOIN split t ON t.subreddit_id = c.subreddit_id AND t.label = l.label AND t.split = s.split
GROUP BY c.subreddit_id, l.label, s.split"""))
def q_reference_shortfall(spark, d):
    """Rows that the draw at the default sizes asked for and got."""
    c, elig = reference_comments(spark, d)
    return P.split_shortfall(P.balanced_split(c, communities=elig),
                             communities=P.in_communities(c.select("subreddit_id").distinct(), elig))
