import os

import pytest
from pyspark.sql import functions as F

from normlens.operators import metrics as M
from normlens.plans import fixtures as fx
from normlens.plans.queries_parse import reply_results
from normlens.session import scratch_path
from normlens.streaming import epoch_table as ET
from normlens.streaming import run_metrics_stream as ST
from tests.conftest import SF01


def test_stream_final_state_equals_batch(spark):
    from normlens.plans.queries_parse import replies
    landing = scratch_path(spark, "t-landing")
    replies(spark, SF01).select("run", "batch_no", "content").repartitionByRange(3, "batch_no") \
        .write.json(landing)
    out = scratch_path(spark, "t-metrics")
    q = ST.start_run_metrics_stream(spark, landing, fx.reply_truth(spark, SF01), out,
                                    scratch_path(spark, "t-ckpt"), max_files_per_trigger=1)
    q.awaitTermination()
    cols = ["run", "num_successes", "accuracy", "cm_nn", "cm_np", "cm_pn", "cm_pp"]
    got = sorted(tuple(r) for r in ST.read_run_metrics(spark, out).select(*cols).collect())
    exp = sorted(tuple(r) for r in M.run_metrics(reply_results(spark, SF01), ["run"]).select(*cols).collect())
    assert got == exp
    # appended result rows: exactly one row per recovered prediction
    res_path = scratch_path(spark, "t-results")
    q2 = ST.start_results_stream(spark, landing, fx.reply_truth(spark, SF01), res_path,
                                 scratch_path(spark, "t-ckpt2"))
    q2.awaitTermination()
    assert spark.read.parquet(res_path).count() == reply_results(spark, SF01).count()
    assert spark.read.parquet(res_path).filter(F.col("comment_id").isNull()).count() == 0


def _reply(run, batch_no, ids, label="violation"):
    items = ",".join('{"comment_id":%d,"label":"%s","evidence":""}' % (i, label) for i in ids)
    return (run, batch_no, f"[{items}]")


@pytest.mark.parametrize("stage", ["before data", "after data", "after pointer"])
def test_a_kill_inside_an_epoch_loses_nothing(spark, stage):
    """The job dies around the write of its second epoch; readers keep the first, a restart completes the second."""
    landing, out, ckpt = (scratch_path(spark, n) for n in ("k-landing", "k-out", "k-ckpt"))
    schema = "run string, batch_no int, content string"
    truth = spark.createDataFrame([("a", i, "violation") for i in range(4)] + [("b", i, "non_violation") for i in range(4)],
                                  "run string, comment_id long, true_label string")

    def land(name, *rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.json(f"{landing}/{name}")

    def start(writer=None):
        return ST.start_run_metrics_stream(spark, f"{landing}/*", truth, out, ckpt, batch_size=2, writer=writer)

    def state():
        return sorted((r.run, r.num_successes, r.accuracy) for r in ST.read_run_metrics(spark, out).collect())

    land("one", _reply("a", 0, [0, 1]))
    start().awaitTermination()
    first = state()
    assert first == [("a", 2, 1.0)]
    land("two", _reply("a", 1, [2, 3]), _reply("b", 0, [0, 1]))

    def dying(batch, epoch):
        if stage != "before data":
            ET.write_version(batch, out, epoch)
        if stage == "after pointer":
            ET.write_pointer(batch.sparkSession, out, epoch)
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        q = start(dying)
        q.awaitTermination()
    want = [("a", 4, 1.0), ("b", 2, 0.0)]
    assert state() == (want if stage == "after pointer" else first)
    start().awaitTermination()
    assert state() == want


def test_old_versions_go_and_readers_need_a_pointer(spark):
    path = scratch_path(spark, "epochs")
    with pytest.raises(FileNotFoundError):
        ET.read_current(spark, path)
    write = ET.epoch_writer(path, keep=2)
    for epoch in range(4):
        write(spark.range(epoch + 1), epoch)
    assert ET.read_current(spark, path).count() == 4
    assert sorted(os.listdir(f"{path}/epochs")) == sorted(os.listdir(f"{path}/pointers")) == ["epoch=2", "epoch=3"]
    ET.write_version(spark.range(50), path, 4)  # no pointer: not there yet
    assert ET.current_epoch(spark, path) == 3 and ET.read_current(spark, path).count() == 4


def test_default_keys_hold_the_scope_of_the_run(spark):
    landing, out = scratch_path(spark, "s-landing"), scratch_path(spark, "s-out")
    spark.createDataFrame([_reply("a", 0, [0, 1]), _reply("b", 0, [0, 1])], "run string, batch_no int, content string").write.json(landing)
    truth = spark.createDataFrame([(r, i, "violation" if r == "a" else "non_violation") for r in "ab" for i in range(2)],
                                  "run string, comment_id long, true_label string")
    ST.start_run_metrics_stream(spark, landing, truth, out, scratch_path(spark, "s-ckpt"), batch_size=2).awaitTermination()
    assert sorted((r.run, r.num_successes, r.accuracy) for r in ST.read_run_metrics(spark, out).collect()) == [
        ("a", 2, 1.0), ("b", 2, 0.0)]
