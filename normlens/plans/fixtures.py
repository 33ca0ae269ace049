"""Stand-in inputs derived from the driver tables.

The driver tables hold documents, labels and embeddings but no comments,
communities or model replies, so these views derive them (documents are
comments, ``source`` is the community, ``labels.toxic`` the truth).  The
same derivations are written as SQL in ``oracle_sql`` for DuckDB.

Nothing here pairs rows without a key: the prompt-community axis is added by
an equi-join on block numbers (``operators.matrix.paired``).
"""

from __future__ import annotations

import functools
import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normlens.constants import NEGATIVE, POSITIVE
from normlens.functions.index import global_row_index
from normlens.operators.matrix import paired
from normlens.session import application_id, scratch_path
from normlens.sources.tables import read_table

# ---- fixed values: stand-in norms by doc_id % 8 (NULL when doc_id % 11 == 0)
FIXTURE_NORMS = ["no spam", "be nice", "do not troll", "stay on topic",
                 "NO self promotion", "know the rules", "be civil", "respect others"]


_STORE: dict[tuple, str] = {}
_LOCK = threading.Lock()                  # guards the lock table only
_KEY_LOCKS: dict[tuple, threading.RLock] = {}


def _key_lock(key: tuple) -> threading.RLock:
    with _LOCK:
        return _KEY_LOCKS.setdefault(key, threading.RLock())


def stored(name: str):
    """Derive an input once per (application, sf dir) and keep it as Parquet.

    These views stand in for the input files of the reference workflow
    (comment corpus, community list, model replies), so each is written
    once to the shared checkpoint folder and every query reads the files.
    """
    def deco(fn):
        @functools.wraps(fn)
        def wrapper(spark: SparkSession, d: str, *args, **kwargs) -> DataFrame:
            if args or kwargs:
                return fn(spark, d, *args, **kwargs)
            key = (application_id(spark), d.rstrip("/"), name)
            # one lock per input: independent inputs derive concurrently and an
            # input that needs another (acyclic) waits only for that one
            with _key_lock(key):
                path = _STORE.get(key)
                if path is None:
                    path = scratch_path(spark, f"input-{name}")
                    fn(spark, d).write.mode("overwrite").parquet(path)
                    _STORE[key] = path
            return spark.read.parquet(path)
        wrapper.derive = fn
        return wrapper
    return deco


def materialize_inputs(spark: SparkSession, d: str, parallel: int = 4) -> None:
    """Write every stored input for ``d`` (the bench times this separately).

    Independent inputs are derived as concurrent Spark jobs.
    """
    from concurrent.futures import ThreadPoolExecutor
    waves = [(all_comments, communities, scores, raw_outputs, reply_truth), (comments,),
             (predictions, rules_literal), (cells,), (accuracy,)]
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        for wave in waves:
            list(pool.map(lambda fn: fn(spark, d), wave))


def _reason(doc_id: Column) -> Column:
    expr = F.when(doc_id % 11 == 0, F.lit(None).cast("string"))
    for k, norm in enumerate(FIXTURE_NORMS):
        expr = expr.when(doc_id % 8 == k, F.lit(norm))
    return expr


def _body(doc_id: Column, text: Column) -> Column:
    """Comment text: the document's, some with HTML entities, some as questions."""
    return (F.when(doc_id % 9 == 0, F.concat(text, F.lit("?")))
            .when(doc_id % 10 == 1, F.concat(F.lit("&lt;b&gt; &amp;amp; "), text)).otherwise(text))


@stored("all_comments")
def all_comments(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a comment; the label is NULL where ``labels`` has none."""
    docs = read_table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    labels = read_table(spark, d, "labels").select("doc_id", "toxic")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("comment_id"),
        _body(F.col("doc_id"), F.col("text")).alias("body"),
        F.col("source").alias("subreddit_id"),
        F.col("lang").alias("assigned_rule_cluster"),
        _reason(F.col("doc_id")).alias("target_reason"),
        F.when(F.col("toxic") == 1, F.lit(POSITIVE)).when(F.col("toxic").isNotNull(), F.lit(NEGATIVE)).alias("label"),
    )


@stored("comments")
def comments(spark: SparkSession, d: str) -> DataFrame:
    """The labelled comments."""
    return all_comments(spark, d).where("label IS NOT NULL")


def language_comments(spark: SparkSession, d: str) -> DataFrame:
    """All comments with the language as community: few, large communities."""
    return all_comments(spark, d).withColumn("subreddit_id", F.col("assigned_rule_cluster"))


@stored("communities")
def communities(spark: SparkSession, d: str) -> DataFrame:
    src = read_table(spark, d, "documents").select(F.col("source").alias("name")).distinct()
    return src.select(
        "name",
        F.concat(F.lit("r/"), F.col("name")).alias("display_name_prefixed"),
        F.concat(F.lit("About "), F.col("name")).alias("public_description"),
    )


def _flip(label: Column) -> Column:
    return F.when(label == POSITIVE, F.lit(NEGATIVE)).otherwise(F.lit(POSITIVE))


@stored("predictions")
def predictions(spark: SparkSession, d: str) -> DataFrame:
    """One simulated reply per (prompt community, comment)."""
    c = comments(spark, d)
    names = communities(spark, d).select(F.col("name").alias("prompt_community")).where("prompt_community IS NOT NULL")
    p = paired(names, c.select(F.col("subreddit_id").alias("eval_community"), "comment_id",
                               F.col("label").alias("true_label")), "comment_id")
    key = F.md5(F.concat(F.col("prompt_community"), F.lit(":"), F.col("comment_id").cast("string")))
    flip = F.substring(key, 1, 1) < F.substring(F.md5(F.col("prompt_community")), 1, 1)
    return p.withColumn("pred_label", F.when(flip, _flip(F.col("true_label")))
                        .otherwise(F.col("true_label")))


@stored("cells")
def cells(spark: SparkSession, d: str) -> DataFrame:
    """Unbalanced (prompt, eval) accuracy grid: some cells are missing."""
    p = predictions(spark, d)
    present = F.substring(F.md5(F.concat(F.col("prompt_community"), F.lit("/"),
                                         F.col("eval_community"))), 1, 1) != "0"
    hit = F.when(F.col("true_label") == F.col("pred_label"), 1.0).otherwise(0.0)
    return (p.filter(present).groupBy("prompt_community", "eval_community")
            .agg(F.avg(hit).alias("accuracy")))


@stored("accuracy")
def accuracy(spark: SparkSession, d: str) -> DataFrame:
    e = cells(spark, d)
    c = communities(spark, d)
    j = e.join(c, c["name"] == e["eval_community"])
    return (j.groupBy("display_name_prefixed", "eval_community")
            .agg(F.avg("accuracy").alias("accuracy"))
            .select(F.concat(F.col("display_name_prefixed"), F.lit(" ("),
                             F.col("eval_community"), F.lit(")")).alias("subreddit"),
                    "accuracy"))


@stored("scores")
def scores(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in similarity scores per community from ``embeddings``."""
    e = read_table(spark, d, "embeddings").select(
        "label",
        F.col("embedding")[0].cast("double").alias("x"),
        F.col("embedding")[1].cast("double").alias("y"),
        F.col("embedding")[2].cast("double").alias("z"))
    return e.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.avg("x").alias("in_cluster_sim_mean"), F.stddev_samp("x").alias("in_cluster_sim_std"),
        F.avg("y").alias("cross_cluster_sim_mean"), F.stddev_samp("y").alias("cross_cluster_sim_std"),
        F.avg("z").alias("contrastive_score_mean"), F.stddev_samp("z").alias("contrastive_score_std"),
    ).select(F.concat(F.lit("r/src"), F.col("label").cast("string")).alias("subreddit"),
             *[c for c in ["n_items", "in_cluster_sim_mean", "in_cluster_sim_std",
                           "cross_cluster_sim_mean", "cross_cluster_sim_std",
                           "contrastive_score_mean", "contrastive_score_std"]])


@stored("raw_outputs")
def raw_outputs(spark: SparkSession, d: str, batch_size: int = 10) -> DataFrame:
    """Simulated reply text per batch of ``batch_size`` labelled documents.

    Shapes by batch number: clean arrays, arrays cut before ``]``, arrays
    wrapped in prose, arrays one element short, empty replies, replies without
    JSON, bare objects with one bad fragment, and batches whose ids are
    decimals, strings or missing.  Some items carry a third label or evidence.
    """
    labels = read_table(spark, d, "labels").select("doc_id", "quality")
    ranked = global_row_index(labels, "doc_id", "rn").withColumn("b", F.floor(F.col("rn") / batch_size).cast("int"))
    doc, b = F.col("doc_id"), F.col("b")
    number = doc.cast("string")
    odd = b % 11 == 6
    ident = (F.when(odd & (doc % 7 == 1), F.concat(F.lit('"'), number, F.lit('"')))
             .when(odd & (doc % 7 == 2), F.concat(number, F.lit(".5")))
             .when((b % 11 == 8) | odd, F.concat(number, F.lit(".0")))
             .otherwise(number))
    label = (F.when(doc % 23 == 5, F.lit("unclear")).when(F.col("quality") == 0, F.lit(POSITIVE))
             .otherwise(F.lit(NEGATIVE)))
    item = F.concat(F.lit("{"), F.when(odd & (doc % 7 == 3), F.lit("")).otherwise(
                        F.concat(F.lit('"comment_id":'), ident, F.lit(","))),
                    F.lit('"label":"'), label, F.lit('","evidence":"'),
                    F.when(doc % 3 == 0, F.concat(F.lit('see \\"word '), number, F.lit('\\"'))).otherwise(F.lit("")),
                    F.lit('"}'))
    items = ranked.select(F.col("b").alias("batch_no"), "rn", item.alias("j"))
    g = items.groupBy("batch_no").agg(F.array_sort(F.collect_list(F.struct("rn", "j"))).alias("l"))
    texts = F.transform("l", lambda s: s["j"])
    b = F.col("batch_no")
    body = F.array_join(F.when(b % 9 == 5, F.slice(texts, 1, batch_size - 1)).otherwise(texts), ",")
    content = (F.when(b % 13 == 9, F.lit("I cannot judge these comments."))
               .when(b % 5 == 1, F.concat(F.lit("["), body))
               .when(b % 5 == 2, F.concat(F.lit("Sure: ["), body, F.lit("] ok")))
               .when(b % 7 == 3, F.lit(""))
               .when(b % 5 == 4, F.concat(body, F.lit(",{bad}")))
               .otherwise(F.concat(F.lit("["), body, F.lit("]"))))
    return g.select("batch_no", content.alias("content"))


@stored("reply_truth")
def reply_truth(spark: SparkSession, d: str) -> DataFrame:
    """Truth for ``raw_outputs`` replies: ``labels.toxic``."""
    labels = read_table(spark, d, "labels").select("doc_id", "toxic")
    return labels.select(F.col("doc_id").alias("comment_id"),
                         F.when(F.col("toxic") == 1, F.lit(POSITIVE))
                         .otherwise(F.lit(NEGATIVE)).alias("true_label"))


def language_communities(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of the language communities."""
    names = all_comments(spark, d).select(F.col("assigned_rule_cluster").alias("name")).distinct()
    return names.select("name", F.concat(F.lit("r/"), F.col("name")).alias("display_name_prefixed"),
                        F.concat(F.lit("Comments in "), F.col("name")).alias("public_description"))


def _py_str_literal(s: Column) -> Column:
    """Python repr of a string without backslashes: '...' or "..." if it holds '."""
    return F.when(F.instr(s, "'") > 0, F.concat(F.lit('"'), s, F.lit('"'))) \
        .otherwise(F.concat(F.lit("'"), s, F.lit("'")))


@stored("rules_literal")
def rules_literal(spark: SparkSession, d: str) -> DataFrame:
    """Rule lists of the source communities."""
    return rule_lists(comments(spark, d))


def rule_lists(c: DataFrame) -> DataFrame:
    """Per community a Python-literal rule list built from its norms.

    ``short_name`` is the norm, ``violation_reason`` is None for norms
    containing "no" and ``don't <norm>`` otherwise.
    """
    c = c.filter(F.col("target_reason").isNotNull())
    per = c.select("subreddit_id", "target_reason").distinct()
    reason = F.when(F.col("target_reason").contains("no"), F.lit("None")).otherwise(
        _py_str_literal(F.concat(F.lit("don't "), F.col("target_reason"))))
    entry = F.concat(F.lit("{'short_name': "), _py_str_literal(F.col("target_reason")),
                     F.lit(", 'violation_reason': "), reason, F.lit("}"))
    per = per.select("subreddit_id", "target_reason", entry.alias("entry"))
    g = per.groupBy("subreddit_id").agg(
        F.array_sort(F.collect_list(F.struct("target_reason", "entry"))).alias("es"))
    return g.select("subreddit_id", F.concat(
        F.lit("["), F.array_join(F.transform("es", lambda s: s["entry"]), ", "), F.lit("]")
    ).alias("rules"))
