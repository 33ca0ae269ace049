"""Periodic runs: against brute force, planted repeats, odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from normlens.llm import queries
from normlens.llm.periodic_runs import find_runs, periodic_runs

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """All runs by every lag; the smallest period of equal ends."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    words = SPACE.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def expected(doc_id, text):
    words = planted(doc_id, text)
    runs = brute(words)
    drop = {i for s, e, q in runs for i in range(s + q, e)}
    best = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def _random_words(rng):
    n, letters = rng.choice([0, 1, 5, 30, 150, 500]), rng.choice([1, 2, 3, 60])
    w = [f"w{rng.randrange(letters)}" for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n > 8:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // rng.randint(2, 10)))
            for i in range(a, rng.randint(a, n)):
                w[i] = w[a + (i - a) % p]
    return w


def test_runs_of_blocks_equal_brute_force():
    rng = random.Random(7)
    for _ in range(300):
        texts, ids, off = [_random_words(rng) for _ in range(rng.randint(1, 3))], [], [0]
        for w in texts:
            first = {}
            ids += [first.setdefault(x, off[-1] + i) for i, x in enumerate(w)]
            off.append(len(ids))
        s, e, q = find_runs(np.array(ids, np.int64), np.array(off))
        want = [(a + o, b + o, c) for w, o in zip(texts, off) for a, b, c in brute(w)]
        assert list(zip(s.tolist(), e.tolist(), q.tolist())) == want


def test_fibonacci_and_parity_words_have_the_runs_of_brute_force():
    a, b = "ab", "a"
    while len(a) < 3000:
        a, b = a + b, a
    parity = [str(bin(i).count("1") % 2) for i in range(4096)]
    for w in (list(a), parity, parity + parity * 4):
        ids = [w.index(x) for x in w]
        got = find_runs(np.array(ids, np.int64), np.array([0, len(ids)]))
        assert list(zip(*(x.tolist() for x in got))) == brute(w)


def test_shorter_runs_are_refused():
    with pytest.raises(ValueError):
        find_runs(np.zeros(4, np.int64), np.array([0, 4]), times=3)


def test_query_equals_brute_force_on_whole_table(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " \n".join(_random_words(rng)) + rng.choice(["", "\t"])) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, " \n "), (2**55, "a b c " * 2000), (2**55, "a b c " * 2000),
             (5, "é x é x"), (7, "one word " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.selectExpr("doc_id", "text", "'x' AS runs", "1 AS w", "2 AS g", "3 AS id").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns[:6] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((expected(*r) for r in rows), key=str)
    assert any(zlib.crc32(str(d).encode()) % 10 == 0 and t and t.strip() for d, t in rows)


def test_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "x " * 9, 1)], "doc_id long, text string, n_words int")
    r = periodic_runs(df, "doc_id", "text").first()
    assert (r.id, r.n_words, r.collapsed) == (None, 9, "x") and [tuple(x) for x in r.runs] == [(0, 9, 1)]
    assert periodic_runs(df.limit(0), "doc_id", "text").collect() == []
