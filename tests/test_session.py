"""Shared folder of a session."""

import pytest

from normlens.session import ensure_checkpoint_dir


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value


class _Session:
    def __init__(self, **values):
        self.conf = _Conf({k.replace("_", "."): v for k, v in values.items()})


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", ""])
def test_cluster_without_shared_folder_raises(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(_Session(spark_master=master))


def test_given_folder_is_used_as_it_is():
    s = _Session(spark_master="yarn", spark_checkpoint_dir="hdfs://x/y")
    assert ensure_checkpoint_dir(s) == "hdfs://x/y"


@pytest.mark.parametrize("master", ["local", "local[8]"])
def test_local_mode_makes_a_folder(master):
    s = _Session(spark_master=master)
    made = ensure_checkpoint_dir(s)
    assert made and s.conf.get("spark.checkpoint.dir") == made


def test_shuffle_files_of_a_stored_frame_go_with_its_write(spark):
    import os
    import time

    from normlens.session import SHUFFLE_CLEANUP, materialize
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def shuffles():
        return {f for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    set_before = spark.conf.get(SHUFFLE_CLEANUP, None)
    old = shuffles()
    dealt = spark.range(10_000).repartition(7, "id")
    stored = materialize(dealt, "dealt")
    ends = time.time() + 10
    while shuffles() - old and time.time() < ends:  # they go without a wait
        time.sleep(0.1)
    assert not shuffles() - old and stored.count() == 10_000
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == set_before
    assert dealt.count() == dealt.count() == 10_000
