import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from normlens.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string, spans int, h string"


def brute(texts, window):
    raw = {k: (t or "").encode() for k, t in texts}
    seen = Counter(b[i:i + window] for b in raw.values() for i in range(len(b) - window + 1))
    out = {}
    for k, b in raw.items():
        mark = np.zeros(len(b), bool)
        for i in range(len(b) - window + 1):
            if seen[b[i:i + window]] > 1:
                mark[i:i + window] = True
        runs = int((np.diff(np.concatenate(([0], mark.astype(int), [0]))) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~mark])
        out[k] = (len(b), int(mark.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randrange(1, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(r.randrange(8, 40)) for _ in range(6)]
    texts = []
    for i in range(n):
        t = text(r.randrange(0, 60))
        for _ in range(r.randrange(0, 4)):
            at = r.randrange(0, len(t) + 1)
            t = t[:at] + r.choice(passages) + t[at:]
        texts.append(t)
    texts += texts[:5]
    near = list(texts[7] + passages[0])
    for _ in range(10):
        near[r.randrange(len(near))] = "Z"
        texts.append("".join(near))
    texts += [None, "", "x", "ab" * 150, "q" * 300, passages[1], passages[1][3:]]
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,window,gram,hot", [(1, 60, 20, 4096), (2, 60, 20, 2), (3, 40, 13, 3), (4, 50, 50, 4096)])
def test_matches_brute_force(spark, seed, window, gram, hot):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(5)
    out = S.remove_repeats(df, "doc_id", "text", window, gram, hot).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out}
    assert got == brute(rows, window)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in out)


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], SCHEMA), "doc_id", "text").count() == 0


def test_sorted_suffixes_are_in_order():
    r = np.random.default_rng(5)
    data = r.integers(0, 2, 3000).astype(np.uint8)
    start = r.integers(0, 2900, 500)
    length = np.minimum(r.integers(0, 100, 500), 3000 - start)
    group = r.integers(0, 7, 500)
    order = S._Suffixes(data, start, length, group).sort()
    keys = [(group[i], data[start[i]:start[i] + length[i]].tobytes()) for i in order]
    assert keys == sorted(keys)


def test_query_schema(spark):
    from normlens.llm.queries import QUERIES
    df = QUERIES["op1_suffix_array_dedup"](spark, "/root/testdata/sf0.001")
    assert dict(df.dtypes)["n_removed"] == "bigint" and dict(df.dtypes)["kept_sha256"] == "string"
    assert isinstance(df.schema["doc_id"].dataType, T.LongType)
