"""Dataset preparation: eligibility, norm lists, norm assignment, balanced draws.

One plan covers every community: eligibility is a HAVING aggregate,
norms are assigned with an equi-join on (community, hashed index), and the
per-(community, label) draw is a ``row_number() <= k`` filter, which Spark
runs as a partial per-group limit before the shuffle — a community holding
a third of all rows still ships only ``k`` rows per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from normlens.constants import MIN_COMMUNITY_COMMENTS, NEGATIVE, NUM_SHOTS, NUM_TESTS, POSITIVE, SEED
from normlens.functions.keys import draw_key, hash_bucket


def eligible_communities(df: DataFrame, community_col: str = "subreddit_id",
                         min_count: int = MIN_COMMUNITY_COMMENTS) -> DataFrame:
    """Communities with strictly more than ``min_count`` comments, with their count."""
    return (df.filter(F.col(community_col).isNotNull()).groupBy(community_col)
            .agg(F.count(F.lit(1)).alias("n_comments"))
            .filter(F.col("n_comments") > min_count))


def exclude_communities(df: DataFrame, ids: list[str],
                        community_col: str = "subreddit_id", strict: bool = False) -> DataFrame:
    """Drop the listed community ids.

    Ids that are absent are a no-op; ``strict=True`` raises for them instead
    (one small check job over the distinct listed ids).
    """
    if not ids:
        return df
    if strict:
        present = {r[0] for r in df.filter(F.col(community_col).isin(list(ids)))
                   .select(community_col).distinct().collect()}
        missing = sorted(set(ids) - present)
        if missing:
            raise ValueError(f"community ids not present: {missing}")
    return df.filter(~F.col(community_col).isin(list(ids)))


def in_communities(df: DataFrame, communities: DataFrame, community_col: str = "subreddit_id") -> DataFrame:
    """Rows of the listed communities.

    An inner join with the distinct list, not a semi join: Spark moves a semi join
    below windows, where it deals all rows by community and a large community
    falls to one task.  For frames that are reduced already.
    """
    return df.join(communities.select(community_col).distinct(), community_col)


def community_norms(df: DataFrame, community_col: str = "subreddit_id",
                    reason_col: str = "target_reason", label_col: str = "label",
                    positive: str = POSITIVE, communities: DataFrame | None = None) -> DataFrame:
    """Distinct non-NULL norms of positive rows per community, long form.

    Output ``community, norm, norm_index (0-based, by norm), n_norms``.
    The window runs over distinct (community, norm) pairs only, of the given
    ``communities`` if any.
    """
    pairs = (df.filter((F.col(label_col) == positive) & F.col(reason_col).isNotNull())
             .select(community_col, F.col(reason_col).alias("norm")).distinct())
    if communities is not None:
        pairs = in_communities(pairs, communities, community_col)
    w = Window.partitionBy(community_col).orderBy("norm")
    return pairs.select(
        community_col, "norm",
        (F.row_number().over(w) - 1).alias("norm_index"),
        F.count(F.lit(1)).over(Window.partitionBy(community_col)).alias("n_norms"))


def assign_norms(df: DataFrame, norms: DataFrame, id_col: str = "comment_id",
                 community_col: str = "subreddit_id", reason_col: str = "target_reason",
                 label_col: str = "label", negative: str = NEGATIVE,
                 seed: int = SEED) -> DataFrame:
    """Attach a ``norm`` to every row.

    Negative rows get one of their community's norms, chosen by
    ``md5('<seed>:<id>')`` modulo the number of norms (NULL when the
    community has none); other rows keep their own reason.  Two equi-joins
    on small per-community tables, no arrays and no per-row Python.
    """
    counts = norms.select(community_col, "n_norms").distinct()
    pick = hash_bucket(draw_key(id_col, seed, "norm:"), F.col("n_norms"))
    base = (df.join(counts, community_col, "left")
            .withColumn("_pick", F.when(F.col(label_col) == negative, pick)))
    chosen = norms.select(community_col, F.col("norm_index").alias("_pick"),
                          F.col("norm").alias("_norm"))
    out = base.join(chosen, [community_col, "_pick"], "left")
    return (out.withColumn("norm", F.when(F.col(label_col) == negative, F.col("_norm"))
                           .otherwise(F.col(reason_col)))
            .drop("_pick", "_norm", "n_norms"))


def balanced_split(df: DataFrame, id_col: str = "comment_id",
                   community_col: str = "subreddit_id", label_col: str = "label",
                   labels: tuple[str, str] = (POSITIVE, NEGATIVE),
                   n_test: int = NUM_TESTS // 2, n_shots: int = NUM_SHOTS,
                   seed: int = SEED, strict: bool = False, communities: DataFrame | None = None) -> DataFrame:
    """Seeded balanced draw per (community, label).

    Rows are ordered by ``md5('<seed>:<id>')`` (id breaks ties); the first
    ``n_test`` per class are ``test`` and the next ``n_shots`` are ``shots``,
    so the two sets are disjoint.  A class with too few rows gives what it
    has (see :func:`split_shortfall`); ``strict=True`` raises instead.
    Output adds ``split`` and ``draw_rank``.  ``communities`` (one column of
    them, such as the eligible ones) keeps the draws of those; the list is joined
    to the drawn rows, as a draw depends on its own community alone.
    """
    k = n_test + n_shots
    w = Window.partitionBy(community_col, label_col).orderBy(draw_key(id_col, seed), F.col(id_col))
    ranked = (df.filter(F.col(label_col).isin(*labels))
              .withColumn("draw_rank", F.row_number().over(w))
              .filter(F.col("draw_rank") <= k))
    out = ranked.withColumn("split", F.when(F.col("draw_rank") <= n_test, F.lit("test"))
                            .otherwise(F.lit("shots")))
    if communities is not None:
        out = in_communities(out, communities, community_col)
    if strict:
        known = df if communities is None else in_communities(df.select(community_col).distinct(), communities, community_col)
        short = split_shortfall(out, community_col, label_col, n_test, n_shots, known, labels)
        if not short.filter(F.col("shortfall") > 0).isEmpty():
            raise ValueError("a (community, label) class has fewer rows than requested")
    return out


def split_shortfall(split: DataFrame, community_col: str = "subreddit_id",
                    label_col: str = "label", n_test: int = NUM_TESTS // 2,
                    n_shots: int = NUM_SHOTS, communities: DataFrame | None = None,
                    labels: tuple[str, str] = (POSITIVE, NEGATIVE)) -> DataFrame:
    """Per (community, label, split): rows requested, taken and missing.

    Every community of ``communities`` (of ``split`` when omitted) has a row for
    each label and split, with ``taken`` 0 where nothing was drawn.
    """
    wanted = F.array(*[F.struct(F.lit(v).alias(label_col), F.lit(s).alias("split"))
                       for v in labels for s in ("test", "shots")])
    spine = ((split if communities is None else communities).select(community_col).where(F.col(community_col).isNotNull())
             .distinct().select(community_col, F.inline(wanted)))
    g = split.groupBy(community_col, label_col, "split").agg(F.count(F.lit(1)).alias("taken"))
    req = F.when(F.col("split") == "test", F.lit(n_test)).otherwise(F.lit(n_shots))
    taken = F.coalesce("taken", F.lit(0))
    return spine.join(g, [community_col, label_col, "split"], "left").select(
        community_col, label_col, "split", req.alias("requested"), taken.alias("taken"), (req - taken).alias("shortfall"))


def sequence_ids(split: DataFrame, id_col: str = "comment_id",
                 community_col: str = "subreddit_id", seed: int = SEED,
                 out_col: str = "seq_id") -> DataFrame:
    """0-based id per (community, split) in a seeded shuffled order.

    The window is partitioned by (community, split), whose size is bounded
    by the draw size.
    """
    w = Window.partitionBy(community_col, "split").orderBy(
        draw_key(id_col, seed, "order:"), F.col(id_col))
    return split.withColumn(out_col, F.row_number().over(w) - 1)


def prepared_examples(split: DataFrame, id_col: str = "comment_id",
                      community_col: str = "subreddit_id", body_col: str = "body",
                      label_col: str = "label", seed: int = SEED) -> DataFrame:
    """Prepared example rows ``(community, split, comment_id, body, norm, true_label, source_id)``.

    ``comment_id`` restarts at 0 in every (community, split); ``source_id``
    keeps the original id.
    """
    s = sequence_ids(split, id_col, community_col, seed, "_seq")
    return s.select(community_col, "split", F.col("_seq").cast("bigint").alias("comment_id"),
                    F.col(body_col).alias("body"), "norm", F.col(label_col).alias("true_label"),
                    F.col(id_col).alias("source_id"))
