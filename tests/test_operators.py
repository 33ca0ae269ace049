import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from normlens.operators import anova as AN
from normlens.operators import corr as C
from normlens.operators import matrix as X
from normlens.operators import metrics as M
from normlens.operators import prep as P
from normlens.operators import rates as R

V, N = "violation", "non_violation"


def test_rate_null_rules(spark):
    rows = [("only_neg", N), ("only_neg", N), ("only_neg", N),
            ("only_pos", V), ("only_pos", V), ("only_pos", V),
            ("mixed", V), ("mixed", N), (None, V), ("other", "maybe")]
    df = spark.createDataFrame(rows, "g string, label string")
    pos = {r.g: r.rate for r in R.rate_by(df, "g", null_rule="positive").collect()}
    both = {r.g: r.rate for r in R.rate_by(df, "g", null_rule="both").collect()}
    assert pos == {"only_neg": None, "only_pos": 1.0, "mixed": 0.5}
    assert both == {"only_neg": None, "only_pos": None, "mixed": 0.5}
    tail = [r.g for r in R.tail_rates(R.rate_by(df, "g"), "g", 5).collect()]
    assert "only_neg" not in tail


def test_metrics_edge_cases(spark):
    rows = [("r", 1, N, N), ("r", 2, V, N), ("r", 3, N, "maybe"), ("r", 4, V, V)]
    df = spark.createDataFrame(rows, "run string, comment_id int, true_label string, pred_label string")
    m = M.run_metrics(df, ["run"]).collect()[0]
    assert m.accuracy == 0.5
    assert m.n_unknown_label == 1
    assert (m.cm_nn, m.cm_np, m.cm_pn, m.cm_pp) == (1, 0, 1, 1)
    assert m.violation_precision == 1.0 and m.violation_recall == 0.5
    none_pred = spark.createDataFrame([("r", 1, V, N)], df.schema)
    m2 = M.run_metrics(none_pred, ["run"]).collect()[0]
    assert m2.violation_precision == 0.0 and m2.violation_recall == 0.0


def test_unknown_id_goes_to_rejects(spark):
    pred = spark.createDataFrame([(1, V), (999, N), (None, V)], "comment_id long, pred_label string")
    truth = spark.createDataFrame([(1, V)], "comment_id long, true_label string")
    assert M.join_truth(pred, truth, ["comment_id"]).count() == 1
    rej = sorted((r.comment_id or -1) for r in M.unmatched_predictions(pred, truth, ["comment_id"]).collect())
    assert rej == [-1, 999]


def test_grid_missing_cell_and_zero_diagonal(spark):
    comm = spark.createDataFrame([("a",), ("b",)], "name string")
    cells = spark.createDataFrame([("a", "a", 0.0), ("b", "a", 0.5), ("a", "b", 0.4)],
                                  "prompt_community string, eval_community string, accuracy double")
    em = {r.eval_community: r.mean_accuracy for r in X.eval_means(cells, comm).collect()}
    pm = {r.prompt_community: r.mean_accuracy for r in X.prompt_means(cells, comm).collect()}
    assert em == {"a": 0.25, "b": None}
    assert pm == {"a": 0.2, "b": 0.5}
    ng = {(r.prompt_community, r.eval_community): r.norm_accuracy
          for r in X.normalize_by_diagonal(cells).collect()}
    assert ng[("b", "a")] == 0.5          # diagonal 0: row left as is
    grid = X.full_grid(cells, comm).collect()
    assert len(grid) == 4 and sum(r.accuracy is None for r in grid) == 1
    pend = [(r.prompt_community, r.eval_community) for r in X.pending_cells(comm, cells).collect()]
    assert pend == [("b", "b")]


def _corpus(spark, n=60):
    rows = [(i, f"c{i % 3}", V if i % 4 == 0 else N, f"norm{i % 5}" if i % 4 == 0 else None)
            for i in range(n)]
    return spark.createDataFrame(rows, "comment_id long, subreddit_id string, label string, target_reason string")


def test_split_invariants(spark):
    df = _corpus(spark)
    s1 = P.balanced_split(df, n_test=3, n_shots=2)
    s2 = P.balanced_split(df.repartition(7), n_test=3, n_shots=2)
    a = sorted((r.subreddit_id, r.comment_id, r.split) for r in s1.collect())
    b = sorted((r.subreddit_id, r.comment_id, r.split) for r in s2.collect())
    assert a == b                                     # stable under repartitioning
    tests = {(c, i) for c, i, s in a if s == "test"}
    shots = {(c, i) for c, i, s in a if s == "shots"}
    assert not tests & shots
    per = pd.DataFrame(s1.collect(), columns=s1.columns).groupby(["subreddit_id", "label", "split"]).size()
    assert (per.xs("test", level="split") == 3).all()
    short = P.split_shortfall(P.balanced_split(df, n_test=30, n_shots=1), n_test=30, n_shots=1)
    assert short.filter(F.col("shortfall") > 0).count() > 0


def test_norm_assignment(spark):
    df = _corpus(spark)
    out = P.assign_norms(df, P.community_norms(df)).collect()
    norms = {}
    for r in df.collect():
        if r.label == V and r.target_reason:
            norms.setdefault(r.subreddit_id, set()).add(r.target_reason)
    for r in out:
        if r.label == N:
            assert r.norm in norms.get(r.subreddit_id, {None})
        else:
            assert r.norm == r.target_reason


def test_similarity_and_centrality_vs_numpy(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(size=(7, 4)), columns=["m1", "m2", "m3", "m4"])
    pdf["community"] = [f"c{i}" for i in range(7)]
    pdf.loc[3, "m2"] = np.nan                         # one incomplete vector -> NULL pairs
    df = spark.createDataFrame(pdf)
    df = df.select("community", *[F.nanvl(c, F.lit(None)).alias(c) for c in ["m1", "m2", "m3", "m4"]])
    metrics = ["m1", "m2", "m3", "m4"]
    z = (pdf[metrics] - pdf[metrics].mean()) / pdf[metrics].std()
    got = {(r.community_A, r.community_B): r.correlation
           for r in C.community_similarity(df, "community", metrics).collect()}
    exp_pairs = {}
    for i, j in itertools.combinations(range(7), 2):
        r = np.corrcoef(z.iloc[i].values, z.iloc[j].values)[0, 1]
        exp_pairs[(f"c{i}", f"c{j}")] = r
        if np.isnan(r):
            assert got[(f"c{i}", f"c{j}")] is None
        else:
            assert got[(f"c{i}", f"c{j}")] == pytest.approx(r, abs=1e-9)
    cent = {r.community: r.mean_correlation for r in C.community_centrality(df, "community", metrics).collect()}
    for k in range(7):
        vals = [v for (a, b), v in exp_pairs.items() if k in (int(a[1:]), int(b[1:])) and not np.isnan(v)]
        if vals:
            assert cent[f"c{k}"] == pytest.approx(np.mean(vals), abs=1e-9)
        else:
            assert cent[f"c{k}"] is None


def test_constant_score_column_gives_null(spark):
    df = spark.createDataFrame([(0.1, 1.0, 0.5), (0.4, 1.0, 0.7), (0.9, 1.0, 0.2)], "acc double, flat double, s double")
    r = {x.metric: x.r for x in C.score_correlations(df, "acc", ["flat", "s"]).collect()}
    assert r["flat"] is None
    assert r["s"] == pytest.approx(np.corrcoef([0.1, 0.4, 0.9], [0.5, 0.7, 0.2])[0, 1], abs=1e-12)


def _least_squares(a, b, y):
    """(SS of a, SS of b, RSS, df of a, df of b, residual df) from dense fits."""
    def fit(*cols):
        X_ = np.column_stack([np.ones(len(y))] + [(c == v).astype(float) for c in cols for v in np.unique(c)])
        beta, _, rank, _ = np.linalg.lstsq(X_, y, rcond=None)
        return float(((y - X_ @ beta) ** 2).sum()), int(rank)
    (full, r), (only_a, ra), (only_b, rb) = fit(a, b), fit(a), fit(b)
    return only_b - full, only_a - full, full, r - rb, r - ra, len(y) - r


def _anova(spark, a, b, y):
    df = spark.createDataFrame(pd.DataFrame({"a": a.astype(str), "b": b.astype(str), "y": y}))
    return {r.term: r for r in AN.anova_two_way(spark, df, "y", "a", "b").collect()}


@pytest.mark.parametrize("shape", ["unbalanced", "disconnected", "chain", "wide"])
def test_anova_matches_least_squares(spark, shape):
    rng = np.random.default_rng(11)
    n, la, lb = {"unbalanced": (120, 4, 3), "disconnected": (200, 8, 6), "chain": (90, 15, 15), "wide": (600, 40, 3)}[shape]
    a, b = rng.integers(0, la, n), rng.integers(0, lb, n)
    if shape == "unbalanced":
        keep = ~((a == 1) & (b == 2))
    elif shape == "disconnected":
        keep = (a % 3) == (b % 3)
    elif shape == "chain":  # level a meets b = a and b = a + 1 only
        b = np.minimum(a + rng.integers(0, 2, n), lb - 1)
        keep = np.ones(n, bool)
    else:
        keep = np.ones(n, bool)
    a, b = a[keep], b[keep]
    y = 0.5 * a + rng.normal(size=a.size) + 1e3
    t = _anova(spark, a, b, y)
    ss_a, ss_b, rss, df_a, df_b, df_r = _least_squares(a, b, y)
    assert t["a"].sum_sq == pytest.approx(ss_a, rel=1e-7)
    assert t["b"].sum_sq == pytest.approx(ss_b, rel=1e-7)
    assert t["Residual"].sum_sq == pytest.approx(rss, rel=1e-7)
    assert (t["a"].df, t["b"].df, t["Residual"].df) == (df_a, df_b, df_r)
    total = sum(r.sum_sq for r in t.values())
    assert t["a"].eta_sq == pytest.approx(t["a"].sum_sq / total)
    assert 0.0 <= t["a"].p_value <= 1.0 and t["Residual"].p_value is None


def test_anova_of_many_levels(spark):
    """50,000 x 3 levels: more than any dense table of the driver; closed form from level means."""
    rng = np.random.default_rng(2)
    n = 50_000
    a = np.repeat(np.arange(n), 3)
    b = np.tile(np.arange(3), n)
    y = (a % 7) * 0.25 + b + rng.normal(size=3 * n)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "y": y}))
    t = {r.term: r for r in AN.anova_two_way(spark, df, "y", "a", "b").collect()}
    ma, mb, m = y.reshape(n, 3).mean(1), y.reshape(n, 3).mean(0), y.mean()
    assert t["a"].sum_sq == pytest.approx(3 * ((ma - m) ** 2).sum(), rel=1e-9)
    assert t["b"].sum_sq == pytest.approx(n * ((mb - m) ** 2).sum(), rel=1e-9)
    assert t["Residual"].sum_sq == pytest.approx(((y.reshape(n, 3) - ma[:, None] - mb + m) ** 2).sum(), rel=1e-9)
    assert (t["a"].df, t["b"].df, t["Residual"].df) == (n - 1, 2, 2 * (n - 1))


def test_anova_of_perfect_fits_one_level_and_no_rows(spark):
    t = _anova(spark, np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1]), np.array([1.0, 2.0, 3.0, 4.0]))
    assert t["a"].sum_sq == pytest.approx(4.0) and t["b"].sum_sq == pytest.approx(1.0)
    assert (t["Residual"].sum_sq, t["a"].F, t["a"].p_value) == (0.0, None, None)
    t = _anova(spark, np.array([0, 0, 0]), np.array([0, 1, 1]), np.array([1.0, 2.0, 4.0]))
    assert (t["a"].df, t["a"].F) == (0.0, None) and t["b"].sum_sq == pytest.approx(8 / 3)
    empty = spark.createDataFrame([], "a string, b string, y double")
    assert {(r.term, r.sum_sq, r.eta_sq) for r in AN.anova_two_way(spark, empty, "y", "a", "b").collect()} == {
        ("a", 0.0, None), ("b", 0.0, None), ("Residual", 0.0, None)}


def test_parts_of_a_long_chain(spark):
    from normlens.operators.components import bipartite_labels, bipartite_parts
    links = [(i, i) for i in range(60)] + [(i, i + 1) for i in range(59) if i != 30] + [(100, 200)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.a: r.part for r in bipartite_labels(df, "a", "b").collect()}
    assert len({got[i] for i in range(31)}) == 1 and len({got[i] for i in range(31, 60)}) == 1
    assert len(set(got.values())) == 3 == bipartite_parts(df, "a", "b", 61, 61)


def test_strict_modes_raise(spark):
    pred = spark.createDataFrame([(999, V)], "comment_id long, pred_label string")
    truth = spark.createDataFrame([(1, V)], "comment_id long, true_label string")
    with pytest.raises(ValueError):
        M.join_truth(pred, truth, ["comment_id"], strict=True)
    with pytest.raises(ValueError):
        P.balanced_split(_corpus(spark, 12), n_test=50, n_shots=1, strict=True)
    acc = spark.createDataFrame([("r/x (x)", 0.5)], "subreddit string, accuracy double")
    meta = spark.createDataFrame([("y", "r/y")], "name string, display_name_prefixed string")
    scores = spark.createDataFrame([("r/y", 3)], "subreddit string, n_items long")
    with pytest.raises(ValueError):
        C.merge_scores(acc, meta, scores, meta, strict=True)


def test_payload_keeps_null_norm_and_non_ascii(spark):
    import json as _json
    from normlens.operators import requests as RQ
    df = spark.createDataFrame([("c", 0, None, "héllo «x»"), ("c", 1, "be nice", "b")],
                               "subreddit_id string, comment_id long, norm string, body string")
    b = RQ.batches(df, ["subreddit_id"], batch_size=10)
    text = b.select(RQ.payload("items").alias("p")).collect()[0].p
    assert '"norm":null' in text and "héllo «x»" in text
    assert _json.loads(text) == [{"comment_id": 0, "norm": None, "comment": "héllo «x»"},
                                 {"comment_id": 1, "norm": "be nice", "comment": "b"}]


def test_null_body_has_no_length_bin(spark):
    rows = [("a" * 10, V), ("a" * 30, N), (None, V), ("a" * 20, V)]
    df = spark.createDataFrame(rows, "body string, label string")
    out = {r.bin: r for r in R.length_bin_rates(df, spark, n_bins=2).collect()}
    # right-closed bins over [10, 30]: (9.98, 20] holds lengths 10 and 20, (20, 30] holds 30
    assert (out[1].n_comments, out[2].n_comments) == (2, 1)
    assert out[1].rate == 1.0 and out[2].rate == 0.0


def test_global_row_index_is_dense_and_ordered(spark):
    from normlens.functions.index import global_row_index
    rng = np.random.default_rng(2)
    ids = rng.choice(10_000_000, size=5000, replace=False)
    ids[:50] = np.arange(50) * 3 + 9_000_000          # a dense cluster of keys
    df = spark.createDataFrame(pd.DataFrame({"k": ids, "v": ids % 7})).repartition(5)
    # a narrower projection for one branch must not change the numbering
    out = global_row_index(df, "k", "rn").select("k", "rn").toPandas()
    expect = pd.Series(np.argsort(np.argsort(ids)), index=ids)
    assert (out.set_index("k")["rn"].sort_index() == expect.sort_index()).all()


def test_exclude_communities_strict(spark):
    df = _corpus(spark, 12)
    assert P.exclude_communities(df, ["c0", "nope"]).filter(F.col("subreddit_id") == "c0").count() == 0
    with pytest.raises(ValueError):
        P.exclude_communities(df, ["c0", "nope"], strict=True)
    assert P.exclude_communities(df, ["c0"], strict=True).count() == 8


def test_repeated_truth_raises_when_strict(spark):
    pred = spark.createDataFrame([(1, V)], "comment_id long, pred_label string")
    truth = spark.createDataFrame([(1, V), (1, N)], "comment_id long, true_label string")
    with pytest.raises(ValueError):
        M.join_truth(pred, truth, ["comment_id"], strict=True)


def test_shortfall_lists_classes_without_rows(spark):
    df = spark.createDataFrame([(i, "c", N) for i in range(9)], "comment_id long, subreddit_id string, label string")
    s = P.balanced_split(df, n_test=2, n_shots=1)
    out = {(r.label, r.split): (r.taken, r.shortfall) for r in P.split_shortfall(s, n_test=2, n_shots=1, communities=df).collect()}
    assert out == {(N, "test"): (2, 0), (N, "shots"): (1, 0), (V, "test"): (0, 2), (V, "shots"): (0, 1)}
    with pytest.raises(ValueError):
        P.balanced_split(df, n_test=2, n_shots=1, strict=True)


def test_all_tests_are_batched_by_default(spark):
    from normlens.operators import requests as RQ
    df = spark.range(150).select(F.lit("c").alias("g"), F.col("id").alias("comment_id"), F.lit(None).cast("string").alias("norm"),
                                 F.lit("x").alias("body"))
    assert RQ.batches(df, ["g"], batch_size=10).agg(F.sum("n_items")).first()[0] == 150
    assert RQ.batches(df, ["g"], batch_size=10, num_tests=100).agg(F.sum("n_items")).first()[0] == 100


@pytest.mark.parametrize("parts", [1, 5])
def test_merge_duplicate_rule(spark, parts):
    acc = spark.createDataFrame([("r/x (b)", 0.1, 0), ("r/x (a)", 0.9, 1)], "subreddit string, accuracy double, o int").repartition(parts)
    meta = spark.createDataFrame([("x", "r/x", 0), ("x", "r/a", 1)], "name string, display_name_prefixed string, o int")
    sc = spark.createDataFrame([("r/x", 10.0 - k, k) for k in range(5)], "subreddit string, s double, o int").repartition(parts)
    r = C.merge_scores(acc, meta, sc, meta, acc_order="o", meta_order="o", score_order="o").collect()
    assert [(x.community, x.subreddit, x.accuracy, x.s) for x in r] == [("x", "r/x", 0.9, 10.0)]


def test_every_score_column_gets_its_correlation(spark):
    df = spark.createDataFrame([(0.1, *map(float, range(8))), (0.5, *map(float, range(1, 9)))],
                               "acc double, " + ", ".join(f"m{k} double" for k in range(8)))
    cols = C.numeric_columns(df, exclude=["acc"])
    assert {r.metric for r in C.score_correlations(df, "acc", cols).collect()} == {f"m{k}" for k in range(8)}


def test_row_ranks_number_rows_of_any_order_inside_groups(spark):
    import random
    from pyspark.sql import functions as F
    from normlens.functions.index import row_ranks
    rng = random.Random(4)
    rows = [(g, rng.choice([None, 1.0, 2.0, 3.5, float(i)]), f"t{i:04d}") for i in range(900)
            for g in [rng.choice(["hot", "hot", "a", "b", None])]]
    df = spark.createDataFrame(rows, "g string, v double, t string").repartition(5)
    got = row_ranks(df, ["g"], [F.col("v").desc_nulls_last(), "t"], "r").collect()
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        assert [(x.v, x.t) for x in sorted((x for x in got if x.g == g), key=lambda x: x.r)] == [r[1:] for r in mine]
    whole = sorted(row_ranks(df, [], ["t"], "r").collect(), key=lambda x: x.r)
    assert [x.r for x in whole] == list(range(900)) and [x.t for x in whole] == sorted(r[2] for r in rows)
    ties = row_ranks(df.select(F.lit(1).alias("k")), [], ["k"], "r").collect()
    assert sorted(x.r for x in ties) == list(range(900))
    assert row_ranks(df.limit(0), [], ["t"], "r").collect() == []


@pytest.mark.parametrize("ascending", [False, True])
def test_extreme_pairs_equal_a_sort_of_all_pairs(spark, ascending):
    rng = np.random.default_rng(8)
    m = ["m1", "m2", "m3", "m4"]
    base = rng.normal(size=(90, 4)) + rng.integers(0, 3, 90)[:, None] * 4.0
    base[30:42] = base[30]  # copies: ties of r = 1
    rows = [(f"c{k:03d}", *map(float, v)) for k, v in enumerate(base)] + [("c0001", None, 1.0, 2.0, 3.0), ("zz", 1.0, None, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "community string, " + ", ".join(f"{c} double" for c in m))
    want = C.top_pairs(C.community_similarity(df, "community", m), 25, ascending, keys=["community_A", "community_B"])
    want = sorted(map(tuple, want.select("community_A", "community_B", "correlation", "rank").collect()), key=lambda r: r[3])
    for block in (7, 2048):
        got = C.extreme_pairs(df, "community", m, 25, ascending, block_rows=block)
        got = sorted(map(tuple, got.select("community_A", "community_B", "correlation", "rank").collect()), key=lambda r: r[3])
        assert got == want


def test_extreme_pairs_fall_back_to_pairs_without_r(spark):
    m = ["m1", "m2", "m3"]
    rows = [("a", 1.0, 2.0, 4.0), ("b", None, 1.0, 1.0), ("c", 3.0, 1.0, 2.0), ("d", 2.0, 9.0, 1.0), ("e", None, None, None)]
    df = spark.createDataFrame(rows, "k string, m1 double, m2 double, m3 double")
    for n in (2, 5, 9, 50):
        want = C.top_pairs(C.community_similarity(df, "k", m), n, keys=["k_A", "k_B"]).collect()
        got = C.extreme_pairs(df, "k", m, n).collect()
        assert sorted((r.rank, r.k_A, r.k_B, r.correlation) for r in got) == sorted((r.rank, r.k_A, r.k_B, r.correlation) for r in want)
    assert C.extreme_pairs(df.limit(0), "k", m, 3).collect() == []


def test_distinct_rows_keep_nulls_apart(spark):
    from normlens.operators import dims as D
    df = spark.createDataFrame([(1, None), (1, None), (1, ""), (None, "")], "a int, b string")
    assert sorted(map(str, D.distinct_rows(df).collect())) == sorted(map(str, df.distinct().collect()))


def test_axis_ranks_and_ordered_grid(spark):
    from normlens.operators import matrix as X
    t = spark.createDataFrame([("a", 0.5, None), ("b", None, 2.0), ("c", 0.5, 3.0)], "k string, v double, w double")
    r = X.axis_ranks(t, "k", {"v": "rv", "w": "rw"})
    assert sorted(map(tuple, r.collect())) == [("a", 1, 3), ("b", 3, 2), ("c", 2, 1)]
    grid = spark.createDataFrame([("a", "b", 0.1), ("b", "c", None)], "prompt_community string, eval_community string, accuracy double")
    got = X.ordered_grid(grid, r, "k", {"rv": "row_rank"}, {"rw": "col_rank"})
    assert sorted((x.prompt_community, x.eval_community, x.row_rank, x.col_rank) for x in got.collect()) == [("a", "b", 3, 3), ("b", "c", 2, 2)]
