"""Plans that must hold on larger tables: no table copied for its small files, no body dealt by community, no sort of texts."""

import glob

from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from normlens.operators import metrics as M
from normlens.operators import prep as P
from normlens.session import scratch_path
from normlens.sources import run_files as RF


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_join_truth_copies_no_predictions(spark):
    # 40,000 predictions of one value lie in a few hundred bytes
    path = scratch_path(spark, "few-values")
    spark.range(40_000).select(F.lit("a").alias("run"), (F.col("id") % 4).alias("comment_id"), F.lit("violation").alias("pred_label")) \
        .write.parquet(path)
    truth = spark.range(3).select(F.col("id").alias("comment_id"), F.lit("violation").alias("true_label"))
    joined = M.join_truth(spark.read.parquet(path), truth, ["comment_id"])
    assert "SortMergeJoin" in _plan(joined) and "BroadcastHashJoin" not in _plan(joined)
    assert joined.count() == 30_000


def _corpus(spark):
    rows = [("a", "violation", i, f"text {i}", "be nice") for i in range(30)]
    rows += [("a", "non_violation", 100 + i, f"text {i}", None) for i in range(30)]
    rows += [("small", "violation", 300, "alone", "no spam"), (None, "violation", 301, "nowhere", None)]
    return spark.createDataFrame(rows, "subreddit_id string, label string, comment_id long, body string, target_reason string")


def test_draw_of_listed_communities_limits_before_the_shuffle(spark):
    df = _corpus(spark)
    path = scratch_path(spark, "corpus")
    df.write.parquet(path)
    df = spark.read.parquet(path)
    elig = P.eligible_communities(df, min_count=10).select("subreddit_id")
    drawn = P.balanced_split(df, n_test=3, n_shots=2, communities=elig)
    before = P.balanced_split(df.join(elig, "subreddit_id", "left_semi"), n_test=3, n_shots=2)
    assert sorted(map(str, drawn.select(before.columns).collect())) == sorted(map(str, before.collect()))
    lines = _plan(drawn).splitlines()
    # bodies are limited in each map task before anything deals or joins them
    limit = next(i for i, line in enumerate(lines) if "WindowGroupLimit" in line and "Partial" in line)
    scan = next(i for i, line in enumerate(lines) if i > limit and "FileScan" in line)
    assert "Exchange" in lines[limit - 1] or "Exchange" in lines[limit - 2]
    assert not any("Join" in line or "Exchange" in line for line in lines[limit:scan])
    norms = P.community_norms(df, communities=elig).select("subreddit_id", "norm").collect()
    assert [tuple(r) for r in norms] == [("a", "be nice")]


def test_strict_draw_of_listed_communities(spark):
    df = _corpus(spark)
    elig = P.eligible_communities(df, min_count=10).select("subreddit_id")
    assert P.balanced_split(df, n_test=3, n_shots=2, strict=True, communities=elig).count() == 10


def test_write_json_opens_files_side_by_side(spark, monkeypatch):
    key, seen, write = "spark.sql.maxConcurrentOutputFileWriters", [], DataFrameWriter.json

    def json(self, *a, **k):
        seen.append(int(spark.conf.get(key)))
        return write(self, *a, **k)
    monkeypatch.setattr(DataFrameWriter, "json", json)
    # more values than files held open, one of them NULL
    n = RF.OPEN_FILES + 10
    df = spark.range(4 * n, numPartitions=2).select(
        F.nullif(F.col("id") % n, F.lit(7)).alias("k"), F.concat(F.lit("text\n"), F.col("id").cast("string")).alias("body"))
    before = spark.conf.get(key)
    path = RF.write_json(df, scratch_path(spark, "side-by-side"), ["k"], "snappy")
    assert seen == [RF.OPEN_FILES] and spark.conf.get(key) == before
    assert glob.glob(f"{path}/k=3/*.json.snappy")
    back = spark.read.schema("body string, k long").json(path).select("k", "body")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
