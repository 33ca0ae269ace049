import random

import numpy as np
import pytest

from normlens.llm import minhash_dedup as M
from normlens.llm.common import star_components

SCHEMA = "doc_id long, text string, n int, key string"


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    out, cur = [], ""
    for c in low:
        if c in " \t\n\x0b\x0c\r":
            out += [cur] if cur else []
            cur = ""
        else:
            cur += c
    return out + ([cur] if cur else [])


def set_of(text, k):
    w = words_of(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k):
    sets = {i: set_of(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    ra, rb = find(a), find(b)
                    parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)] + ["Ünï", "the", "The", " x", "a\x1cb", " y"]
    rows = []
    for _ in range(12):
        base = [r.choice(vocab) for _ in range(r.randrange(20, 120))]
        for _ in range(r.randrange(1, 15)):
            t = list(base)
            for _ in range(r.randrange(0, max(2, len(t) // 12))):
                t[r.randrange(len(t))] = r.choice(vocab)
            rows.append(r.choice([" ", "\n", "\t ", "\x0b"]).join(t) if r.random() < .3 else " ".join(t))
    rows += [None, "", " \n", "one", "One", "two words", "two  words", "a b c", "a b c d", "a b c d e", "d c b a"]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,k", [(1, 4), (2, 4), (3, 5)])
def test_matches_brute_force(spark, seed, k):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 0, "k") for i, t in rows], SCHEMA).repartition(4)
    got = {r.id: (r.n_shingles, r.component_id) for r in M.near_duplicates(df, "doc_id", "text", words=k).collect()}
    assert got == brute(rows, k)


def test_kept_marks_the_smallest_id(spark):
    rows = corpus(4)
    df = spark.createDataFrame([(i, t, 0, "k") for i, t in rows], SCHEMA)
    assert all(r.kept == (r.id == r.component_id) for r in M.near_duplicates(df, "doc_id", "text").collect())


def test_empty_table(spark):
    assert M.near_duplicates(spark.createDataFrame([], SCHEMA), "doc_id", "text").count() == 0


def test_components_of_paths_and_hubs(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + k) for k in range(1, 300)] + [(9, 9), (7, 8), (8, 7)]
    perm = list(range(1000))
    r.shuffle(perm)
    pairs = [(perm[a], perm[b]) for a, b in edges]
    got = {x.node: x.component_id for x in star_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    parent = list(range(1000))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}


def test_minima_estimate_similarity():
    r = np.random.default_rng(1)
    base = np.unique(r.integers(0, 1 << 62, 1000).astype(np.uint64))
    flat = np.concatenate([base, base[:800], np.unique(r.integers(0, 1 << 62, 900).astype(np.uint64))])
    keys = M.band_keys(flat, np.array([0, 1000, 1800]), 200, 1, 3)
    assert 0.7 < (keys[0] == keys[1]).mean() < 0.9 and (keys[0] == keys[2]).mean() < 0.02
