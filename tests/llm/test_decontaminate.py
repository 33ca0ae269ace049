import random

import pytest

from normlens.llm import decontaminate as D

SCHEMA = "doc_id long, text string, item_id int, coverage string"


def tokens(text):
    out, cur = [], ""
    for c in text or "":
        if c.isascii() and not (c.isalnum() or c == "_"):
            out += [cur] if cur else []
            cur = ""
        else:
            cur += c.lower() if c.isascii() else c
    return out + ([cur] if cur else [])


def tiling(a, b, least):
    """Greedy string tiling as stated: the longest common run of unmarked tokens, first by position, again and again."""
    fa, fb, covered = [True] * len(a), [True] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and fa[i + k] and fb[j + k] and a[i + k] == b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return covered
        fa[i:i + k] = [False] * k
        fb[j:j + k] = [False] * k
        covered += k


def fixture(seed):
    r = random.Random(seed)
    vocab = ["w%d" % k for k in range(60)] + ["Ünï"]
    items = [[r.choice(vocab) for _ in range(r.randrange(1, 30))] for _ in range(12)] + [[], ["a"]]
    docs = []
    for k in range(40):
        w = [r.choice(vocab) for _ in range(r.randrange(0, 40))]
        if k % 2:
            t = list(r.choice(items))
            if k % 4 == 1 and len(t) > 12:  # parts in another order
                t = t[len(t) // 2:] + ["x"] + t[:len(t) // 2]
            if k % 8 == 3 and t:
                t[r.randrange(len(t))] = "changed"
            at = r.randrange(len(w) + 1)
            w = w[:at] + t + w[at:]
        sep = r.choice([" ", ", ", "\n"])
        docs.append(sep.join(x.upper() if r.random() < .1 and x.isascii() else x for x in w))
    docs += [None, "", docs[1]]
    return list(enumerate(docs)), list(enumerate(" ".join(t) for t in items)) + [(90, None)]


@pytest.mark.parametrize("seed,block", [(1, 2_000_000), (2, 25), (3, 2_000_000)])
def test_matches_brute_force(spark, seed, block):
    docs, items = fixture(seed)
    d = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], SCHEMA).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.covered, r.item_tokens) for r in
           D.matches(d, "doc_id", "text", b, "item_id", "text", block_tokens=block).collect()}
    want = {}
    for i, t in docs:
        for j, u in items:
            a, c = tokens(t), tokens(u)
            if c and (n := tiling(a, c, min(5, len(c)))):
                want[i, j] = (n, len(c))
    assert got == want


def test_reordered_passage_is_caught_and_clean_text_is_not(spark):
    r = random.Random(8)
    words = ["t%d" % k for k in range(4000)]
    item = [r.choice(words) for _ in range(40)]
    docs = [(1, " ".join(r.choice(words) for _ in range(300)) + " " + " ".join(item[20:] + item[:20])),
            (2, " ".join(item)), (3, " ".join(r.choice(words) for _ in range(500)))]
    out = D.contaminated(D.matches(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text",
                                   spark.createDataFrame([(7, " ".join(item))], "item_id long, text string"),
                                   "item_id", "text")).collect()
    assert {r.doc_id: r.items for r in out} == {1: [7], 2: [7]}


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a b c", 0, "")], SCHEMA)
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert D.matches(none, "doc_id", "text", items, "item_id", "text").count() == 0
    assert D.matches(some, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0
