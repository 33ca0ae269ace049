"""Resumable scoring, result rows with errors, message chains."""

import json
import os

import pytest
from pyspark.sql import functions as F

from normlens.operators import requests as RQ
from normlens.operators import scoring as SC
from normlens.session import scratch_path

KEYS = ["run", "batch_no"]


def _requests(spark, n=8):
    rows = [("r", b, [{"role": "user", "content": json.dumps([{"comment_id": 2 * b + i, "comment": f"c{b}{i}", "norm": "n"}
                                                             for i in range(2)])}]) for b in range(n)]
    return spark.createDataFrame(rows, "run string, batch_no int, messages array<struct<role: string, content: string>>")


def _logged(path, fail=(), die=None):
    """A keyword scorer that notes every call in a file, fails on some batches and dies on one."""
    plain = SC.keyword_scorer(["c1"])

    def score(messages):
        first = json.loads(messages[-1]["content"])[0]["comment_id"] // 2
        with open(path, "a") as f:
            f.write(f"{first}\n")
        if first == die:
            raise KeyboardInterrupt("killed")
        if first in fail:
            raise ValueError(f"refused {first}")
        return plain(messages)
    return score


def _calls(path):
    return [int(x) for x in open(path)] if os.path.exists(path) else []


def test_a_run_that_dies_half_way_scores_only_the_rest(spark, tmp_path):
    folder, log, reqs = scratch_path(spark, "scores"), str(tmp_path / "calls"), _requests(spark)
    with pytest.raises(Exception):
        SC.score_resumable(reqs, _logged(log, die=5), KEYS, folder, num_partitions=1)
    first = _calls(log)
    assert 5 in first and len(first) < 8
    os.remove(log)
    out = {r.batch_no: r for r in SC.score_resumable(reqs, _logged(log), KEYS, folder, num_partitions=1).collect()}
    assert sorted(_calls(log)) == sorted(set(range(8)) - set(first) | {5})
    assert sorted(out) == list(range(8)) and all(json.loads(r.content) and r.error is None for r in out.values())
    os.remove(log)
    assert SC.score_resumable(reqs, _logged(log), KEYS, folder).count() == 8 and _calls(log) == []


def test_errors_are_kept_and_tried_again(spark, tmp_path):
    folder, log, reqs = scratch_path(spark, "scores"), str(tmp_path / "calls"), _requests(spark, 4)
    out = {r.batch_no: r for r in SC.score_resumable(reqs, _logged(log, fail=(1, 2)), KEYS, folder, commit_every=3).collect()}
    assert [out[b].error for b in range(4)] == [None, "ValueError: refused 1", "ValueError: refused 2", None]
    os.remove(log)
    out = {r.batch_no: r for r in SC.score_resumable(reqs, _logged(log, fail=(2,)), KEYS, folder).collect()}
    assert sorted(_calls(log)) == [1, 2] and out[1].error is None and out[2].error == "ValueError: refused 2"
    history = SC.scored_attempts(spark, folder, SC._reply_schema(reqs, KEYS))
    assert history.where("error IS NOT NULL").groupBy("batch_no").count().orderBy("batch_no").collect() == [(1, 1), (2, 2)]


def test_repeated_rows_of_a_request_count_once(spark):
    rows = [("r", 0, None, "E: x", 1), ("r", 0, "late", None, 3), ("r", 0, "early", None, 2), ("r", 0, "early", None, 2),
            ("r", 1, None, "E: old", 1), ("r", 1, None, "E: new", 2)]
    df = spark.createDataFrame(rows, "run string, batch_no int, content string, error string, attempt long")
    assert sorted(map(tuple, SC.latest_replies(df, KEYS).collect())) == [("r", 0, "early", None), ("r", 1, None, "E: new")]


def test_result_rows_carry_norm_evidence_and_error(spark):
    reply = json.dumps([{"comment_id": 0, "label": "violation", "evidence": "bad"}, {"comment_id": 9, "label": "x", "evidence": ""}])
    scored = spark.createDataFrame([("p", "e", 0, reply, None), ("p", "e", 1, None, "E: down")],
                                   "prompt string, eval string, batch_no int, content string, error string")
    tests = spark.createDataFrame([("e", i, f"b{i}", None if i == 3 else "n", "violation") for i in range(4)],
                                  "eval string, comment_id long, body string, norm string, true_label string")
    out, rejects = SC.result_rows(scored, tests, ["prompt", "eval", "batch_no"], ["eval"], 2)
    assert sorted(map(tuple, out.collect())) == [
        ("p", "e", 0, 0, "b0", "n", "violation", "violation", "bad", None),
        ("p", "e", 1, 2, "b2", "n", "violation", None, None, "E: down"),
        ("p", "e", 1, 3, "b3", None, "violation", None, None, "E: down")]
    assert [r.comment_id for r in rejects.collect()] == [9]


def test_a_chain_has_one_message_per_template(spark):
    df = spark.createDataFrame([("r/x", "about", ["a: b"], [(0, "t")], [(1, None, "hé")])],
                               "display_name_prefixed string, public_description string, rules array<string>, "
                               "shots array<struct<comment_id: long, body: string>>, "
                               "items array<struct<comment_id: long, norm: string, comment: string>>")
    chain = [("system", "You watch {display_name}."), ("user", "1 {payload}"), ("user", "2 {payload} {extra}"), ("user", "3")]
    got = RQ.message_chain(df, chain, {"extra": F.lit("!")}).first().messages
    text = '[{"comment_id":1,"norm":null,"comment":"hé"}]'
    assert [(m.role, m.content) for m in got] == [("system", "You watch r/x."), ("user", "1 " + text),
                                                  ("user", f"2 {text} !"), ("user", "3")]
    assert [m.role for m in RQ.message_chain(df, RQ.DEFAULT_CHAIN).first().messages] == ["system", "user", "user", "user"]
