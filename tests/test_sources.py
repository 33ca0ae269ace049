import json
import os

from pyspark.sql import functions as F

from normlens.session import scratch_path
from normlens.sources import readers as RD
from normlens.sources import run_files as RF


def test_scan_nested_metrics_layout(spark):
    base = scratch_path(spark, "results")
    runs = [("cross_community/t5_a/t5_b", "org_model-a_free", 0.75),
            ("cross_community/t5_b/t5_a", "org_model-a_free", 0.5),
            ("ZeroShot", "qwen3_14b", 0.9)]
    for directory, model, acc in runs:
        d = os.path.join(base, directory, model)
        os.makedirs(d, exist_ok=True)
        with open(os.path.join(d, "metrics.json"), "w") as f:
            json.dump({"model": model, "directory": directory, "num_tests": 100, "num_successes": 100,
                       "batch_size": 10, "accuracy": acc, "violation_precision": 0.0,
                       "non_violation_precision": 0.0, "violation_recall": 0.0, "non_violation_recall": 0.0,
                       "confusion_matrix": [[1, 2], [3, 4]]}, f, indent=2)
        with open(os.path.join(d, "results.json"), "w") as f:
            json.dump([], f)
    got = sorted((r.directory_path, r.model_folder, r.accuracy, r.confusion_matrix[1][0])
                 for r in RF.scan_run_metrics(spark, base, layout="nested").collect())
    assert got == sorted((d, m, a, 3) for d, m, a in runs)


def test_rules_csv_with_padding_and_literals(spark):
    path = scratch_path(spark, "rules")
    os.makedirs(path)
    with open(os.path.join(path, "rules.csv"), "w") as f:
        f.write(' subreddit_id , rules\n')
        f.write(' t5_a, "[{\'short_name\': \' be nice \', \'violation_reason\': None}, '
                '{\'short_name\': ""don\'t spam"", \'violation_reason\': \'ads\'}]"\n')
    rows = RD.read_rules(spark, path).orderBy("rule_no").collect()
    assert [r.subreddit_id for r in rows] == ["t5_a", "t5_a"]
    assert [r.rule_text for r in rows] == ["be nice: ", "don't spam: ads"]


def test_comment_csv_round_trip_keeps_multiline_quotes(spark):
    rows = [(1, "c1", 'line one\nline "two", three', "violation", None, "x"),
            (2, "c1", "  padded  ", "non_violation", "no spam", "y")]
    df = spark.createDataFrame(rows, RD.COMMENTS_SCHEMA)
    path = RD.write_csv(df, scratch_path(spark, "comments"))
    back = sorted(tuple(r) for r in RD.read_comments(spark, path).collect())
    assert back == sorted(rows)


def test_nan_scores_become_null(spark):
    path = scratch_path(spark, "scores")
    os.makedirs(path)
    with open(os.path.join(path, "s.csv"), "w") as f:
        f.write("subreddit,n_items,in_cluster_sim_mean,in_cluster_sim_std,cross_cluster_sim_mean,"
                "cross_cluster_sim_std,contrastive_score_mean,contrastive_score_std\n")
        f.write("r/a,3,0.1,NaN,0.2,0.3,0.4,0.5\n")
    r = RD.read_scores(spark, path).collect()[0]
    assert r.in_cluster_sim_std is None and r.in_cluster_sim_mean == 0.1
    assert RD.read_scores(spark, path).filter(F.isnan("in_cluster_sim_std")).count() == 0


def _csv(spark, text):
    path = scratch_path(spark, "csv")
    os.makedirs(path)
    with open(os.path.join(path, "c.csv"), "w") as f:
        f.write(text)
    return path


def test_csv_binds_by_header_name(spark):
    import pytest
    path = _csv(spark, "public_description,name,display_name_prefixed,more\nabout a,a,r/a,1\n")
    assert [tuple(r) for r in RD.read_communities(spark, path).collect()] == [("a", "r/a", "about a")]
    with pytest.raises(ValueError):
        RD.read_communities(spark, _csv(spark, "name,public_description\na,b\n"))


def test_five_column_comments_get_ids(spark):
    path = _csv(spark, "body,subreddit_id,label,target_reason,assigned_rule_cluster\nhi,c1,violation,n,x\nho,c2,violation,,y\n")
    rows = RD.read_comments(spark, path).collect()
    assert len({r.comment_id for r in rows}) == 2
    assert [(r.subreddit_id, r.body, r.target_reason) for r in rows] == [("c1", "hi", "n"), ("c2", "ho", None)]


def test_nested_keys_when_a_parent_repeats_the_base_name(spark):
    base = os.path.join(scratch_path(spark, "r"), "results", "x+(1)", "results")
    os.makedirs(os.path.join(base, "e", "m"))
    with open(os.path.join(base, "e", "m", "metrics.json"), "w") as f:
        json.dump({"model": "m", "accuracy": 0.5}, f)
    r = RF.scan_run_metrics(spark, base, layout="nested").collect()
    assert [(x.directory_path, x.model_folder) for x in r] == [("e", "m")]


def test_a_batch_with_a_bare_number_keeps_its_items(spark):
    from normlens.operators import parse as PR
    items = ",".join('{"comment_id":%d,"label":"violation","evidence":""}' % k for k in range(9))
    df = spark.createDataFrame([(0, f"[{items},5]"), (1, f"[{items}]")], "b int, content string")
    out = PR.parse_outputs(df).collect()
    assert [r.outcome for r in sorted(out)] == ["wrong_size", "wrong_size"]
    assert PR.predictions(PR.parse_outputs(df), ["b"]).count() == 18


def test_stream_rejects_and_scoped_keys(spark):
    from normlens.streaming import run_metrics_stream as ST
    landing, out = scratch_path(spark, "l"), scratch_path(spark, "o")
    reply = '[{"comment_id":0,"label":"violation","evidence":""},{"comment_id":7,"label":"violation","evidence":""}]'
    spark.createDataFrame([("a", 0, reply)], "run string, batch_no int, content string").write.json(landing)
    truth = spark.createDataFrame([("a", 0, "violation"), ("b", 0, "non_violation")], "run string, comment_id long, true_label string")
    for rejects, want in ((False, [0]), (True, [7])):
        df = ST.stream_results(spark, landing, truth, batch_size=2, keys=["run", "comment_id"], rejects=rejects)
        q = (df.writeStream.format("parquet").option("path", f"{out}-{rejects}").option("checkpointLocation", f"{out}-c{rejects}")
             .trigger(availableNow=True).start())
        q.awaitTermination()
        assert [r.comment_id for r in spark.read.parquet(f"{out}-{rejects}").collect()] == want


def test_row_ids_do_not_change_with_other_files_or_splits(spark):
    head = "body,subreddit_id,label,target_reason,assigned_rule_cluster\n"
    base = scratch_path(spark, "unnumbered")
    os.makedirs(os.path.join(base, "x"))

    def put(name, lines):
        with open(os.path.join(base, name), "w") as f:
            f.write(head + "".join(lines))

    put("x/a.csv", [f"a{i} {'w' * 40},c,violation,,x\n" for i in range(300)])
    put("b.csv", ['"two\nlines",c,violation,,x\n', "b,c,violation,,x\n"])
    rest = RD.T.StructType([f for f in RD.COMMENTS_SCHEMA.fields if f.name != "comment_id"])
    opts = {"recursiveFileLookup": "true"}

    def ids(path=base, **more):
        rows = RD.with_row_ids(spark, path, rest, **opts, **more).collect()
        assert len({r.comment_id for r in rows}) == len(rows)
        return {(r.source_file, r.source_row, r.body): r.comment_id for r in rows}

    first = ids()
    assert sorted(k[:2] for k in first) == [("b.csv", 0), ("b.csv", 1)] + [("x/a.csv", i) for i in range(300)]
    assert first[("b.csv", 0, "two\nlines")] + 1 == first[("b.csv", 1, "b")]
    put("aa.csv", ["new,c,violation,,x\n"])  # sorts before the others
    assert first.items() <= ids().items()
    # one line a row: files may be split; smaller pieces, same ids
    os.remove(os.path.join(base, "b.csv"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        split = ids(multiLine=False)
        assert RD.read_csv(spark, base, rest, multiLine=False, **opts).rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {k: v for k, v in first.items() if k[0] == "x/a.csv"}.items() <= split.items()
    assert len({r.comment_id for r in RD.read_comments(spark, os.path.join(base, "x")).collect()}) == 300


def test_named_files_of_splits_round_trip(spark):
    from normlens.sources import splits as S
    rows = [("t5_a", "test", 0, 'say "hi",\nthen go', "n", "violation"), ("t5_a", "test", 1, "", None, "non_violation"),
            ("t5_a", "shots", 0, None, "", "violation"), ("t5 b+c", "test", 0, "  x ", "n", "violation")]
    df = spark.createDataFrame(rows, "subreddit_id string, split string, comment_id long, body string, norm string, true_label string")
    base = S.write_split_csv(df, scratch_path(spark, "communities"))
    assert sorted(os.listdir(os.path.join(base, "t5_a"))) == ["shots.csv", "tests.csv"]
    back = S.read_split_csv(spark, base).collect()
    want = [tuple(v if v != "" else None for v in r) for r in rows]  # CSV does not tell '' from NULL
    assert sorted(map(tuple, back), key=str) == sorted(want, key=str)
    assert {r.split for r in S.read_split_csv(spark, base, "shots").collect()} == {"shots"}
    empty = S.write_split_csv(df.limit(0), scratch_path(spark, "none"))
    assert S.read_split_csv(spark, empty).collect() == [] and S.read_split_csv(spark, empty).columns == df.columns
    S.write_split_csv(df, base)  # again over the same files
    assert S.read_split_csv(spark, base).count() == 4


def test_named_files_refuse_hidden_and_outside_names(spark):
    import pytest
    from normlens.sources.named_files import write_named
    for name in ("../x", "_x/y", "a//b"):
        with pytest.raises(Exception, match="not a path"):
            write_named(spark.createDataFrame([(name, "c")], "file string, content string"), scratch_path(spark, "named"))


def test_run_records_are_pretty_files_with_keys_in_the_path(spark):
    rows = [("org/m:a", "x/t5_a/t5_b", 100, 90, 10, 0.5, 0.1, 0.2, 0.3, None, [[1, 2], [3, 4]], "org_m_a")]
    df = spark.createDataFrame(rows, RF.RUN_METRICS_SCHEMA.add("model_folder", "string"))
    base = RF.write_run_records(df, scratch_path(spark, "runs"))
    text = open(os.path.join(base, "x/t5_a/t5_b/org_m_a/metrics.json")).read()
    assert json.loads(text)["confusion_matrix"] == [[1, 2], [3, 4]] and text.startswith('{\n  "model": "org/m:a",\n')
    got = RF.scan_run_metrics(spark, base, layout="nested").collect()
    assert [(r.directory_path, r.model_folder, r.num_successes, r.non_violation_recall) for r in got] == [
        ("x/t5_a/t5_b", "org_m_a", 90, None)]


def test_split_reads_for_a_joined_set_prune_directories(spark):
    from normlens.sources import splits as S
    df = spark.createDataFrame([(f"c{i}", "test", i, "b", "n", "violation") for i in range(20)],
                               "subreddit_id string, split string, comment_id long, body string, norm string, true_label string")
    path = S.write_splits(df, scratch_path(spark, "splits"))
    wanted = spark.createDataFrame([("c3",), ("c7",), ("zz",)], "subreddit_id string").where("subreddit_id like 'c%'")
    got = S.read_split(spark, path, "test", wanted)
    assert sorted(r.subreddit_id for r in got.collect()) == ["c3", "c7"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_rule_rejects_keep_their_community(spark):
    cells = [("a", "[{'short_name': 'x', 'violation_reason': None}, 5, {'short_name': 'y'}]"), ("b", "[{'short_name': 'x'"),
             ("c", "42"), ("d", None), (" e ", "  "), ("f", "{'short_name': 'only'}"), ("g", "[]"), ("h", "__import__('os')")]
    parsed = RD.parsed_rules(spark.createDataFrame(cells, "subreddit_id string, rules string"))
    assert sorted(map(tuple, RD.rule_rejects(parsed).collect())) == [
        ("a", "not_a_rule", 1), ("b", "not_a_literal", None), ("c", "not_a_list", None), ("d", "missing", None),
        ("e", "missing", None), ("h", "not_a_literal", None)]
    assert sorted((r.subreddit_id, r.rule_no, r.rule_text) for r in RD.rule_rows(parsed).collect()) == [
        ("a", 0, "x: "), ("a", 1, "y: "), ("f", 0, "only: ")]
    path = RD.write_rules_csv(spark.createDataFrame(cells[:4], "subreddit_id string, rules string"), scratch_path(spark, "r"))
    back = RD.parsed_rules(RD.read_rule_cells(spark, path))
    assert RD.rule_rejects(back).count() == 4 and RD.rule_rows(back).count() == 2
