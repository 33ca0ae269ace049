import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from normlens.functions import text as TX


def py_clean(s):
    s = s.replace("&gt;", ">").replace("&lt;", "<").replace("&amp;", "&")
    return re.sub(r"[^\w\s]", "", s).lower()


def test_clean_text_and_words_match_python(spark):
    samples = ["Héllo, Wörld! &amp; &gt;x&lt;", "naïve café — déjà-vu?", "a_b 12,5 % ÜBER",
               "  spaced\tout\nlines  ", "", "日本語のテキスト。句読点！"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    got = df.select(TX.clean_text("t").alias("c"), TX.words(TX.clean_text("t")).alias("w")).collect()
    for s, r in zip(samples, got):
        assert r.c == py_clean(s)
        assert list(r.w) == py_clean(s).split()


def test_null_text_has_no_words(spark):
    df = spark.createDataFrame([(None,)], "t string")
    r = df.select(F.size(TX.words(TX.clean_text("t"))).alias("n")).collect()[0]
    assert r.n in (None, -1)


def test_equal_width_bins_match_pandas_cut(spark):
    rng = np.random.default_rng(3)
    for n_bins in (5, 20):
        x = rng.integers(0, 1000, 500).astype(float)
        x[:3] = [x.min(), x.max(), (x.min() + x.max()) / 2]
        expect = pd.cut(x, bins=n_bins, labels=False) + 1
        df = spark.createDataFrame(pd.DataFrame({"x": x}))
        p = TX.equal_width_params(F.lit(float(x.min())), F.lit(float(x.max())), n_bins)
        got = df.select(TX.equal_width_bin("x", p, n_bins).alias("b")).toPandas()["b"].to_numpy()
        assert (got == expect).all()


def test_equal_width_bins_zero_range(spark):
    x = np.array([7.0, 7.0, 7.0])
    expect = pd.cut(x, bins=4, labels=False) + 1
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    p = TX.equal_width_params(F.lit(7.0), F.lit(7.0), 4)
    got = df.select(TX.equal_width_bin("x", p, 4).alias("b")).toPandas()["b"].to_numpy()
    assert (got == expect).all()


def test_restrictive_is_substring_and_null_false(spark):
    df = spark.createDataFrame([("know the rules",), ("NO spam",), ("be nice",), (None,)], "r string")
    got = [r.f for r in df.select(TX.is_restrictive("r").alias("f")).collect()]
    assert got == [True, True, False, False]
    wb = [r.f for r in df.select(TX.is_restrictive("r", word_boundary=True).alias("f")).collect()]
    assert wb == [False, True, False, False]


def test_name_helpers(spark):
    df = spark.createDataFrame([("r/foo (t5_1)", 'org/m:1<x>"|?*\\')], "a string, m string")
    r = df.select(TX.strip_paren_suffix("a").alias("a"), TX.safe_name("m").alias("m")).collect()[0]
    assert r.a == "r/foo"
    assert r.m == re.sub(r'[<>:"/\\|?*]', "_", 'org/m:1<x>"|?*\\')


def test_question_flag(spark):
    df = spark.createDataFrame([("why?",), ("why? ",), (None,)], "b string")
    assert [r.q for r in df.select(TX.ends_with_question("b").alias("q")).collect()] == [True, False, False]
