import hashlib
import random

import numpy as np

from normlens.llm import chunk_dedup as C

SCHEMA = "doc_id long, text string, pos int, len string"


def words(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(n))


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(3)
    return {r.doc_id: r for r in C.remove_repeated_chunks(df, "doc_id", "text", **kw).collect()}


def brute(rows, bits=4, least=8, most=256, min_run=100):
    """The rules again, text by text, with a dictionary of whole chunks."""
    cut = {}
    for i, t in rows:
        b = (t or "").encode()
        ends, last = [], 0
        for x in range(1, len(b) + 1):
            h = sum(int(C.GEAR[b[x - 1 - j]]) << j for j in range(min(32, x))) & 0xFFFFFFFF
            if x - last == most and x < len(b) and not (h >> (32 - bits) == 0) or h >> (32 - bits) == 0 and x - last >= least:
                ends.append(x)
                last = x
        if last < len(b):
            ends.append(len(b))
        cut[i] = (b, [(s, b[s:e]) for s, e in zip([0, *ends], ends)])
    where = {}
    for i in sorted(cut):
        for s, c in cut[i][1]:
            where.setdefault(c, []).append((i, s))
    out = {}
    for i, (b, chunks) in cut.items():
        runs, cur = [], []
        for s, c in chunks + [(None, None)]:
            if c is not None and len(where[c]) > 1:
                cur.append((s, c))
            elif cur:
                runs.append(cur)
                cur = []
        drop = np.zeros(len(b), bool)
        repeated = 0
        for g in runs:
            if sum(len(c) for _, c in g) >= min_run:
                repeated += sum(len(c) for _, c in g)
                for s, c in g:
                    if where[c][0] != (i, s):
                        drop[s:s + len(c)] = True
        out[i] = (len(b), repeated, int(drop.sum()), bytes(np.frombuffer(b, np.uint8)[~drop]))
    return out


def corpus(seed):
    r = random.Random(seed)
    shared = [words(r, 55), words(r, 80), words(r, 8)]
    rows = []
    for i in range(40):
        t = words(r, r.randrange(0, 90))
        if i % 3 == 0:
            t = t + " " + r.choice(shared) + " " + words(r, 20)
        rows.append(t)
    rows += [rows[0], rows[0], None, "", "a", "z" * 2000, "z" * 2000 + "y", "é" * 300]
    return list(enumerate(rows))


def test_matches_brute_force(spark):
    rows = corpus(1)
    got = {k: (r.n_bytes, r.n_repeated, r.n_removed, bytes(r.kept)) for k, r in run(spark, rows).items()}
    assert got == brute(rows)


def test_digest_and_first_copy(spark):
    rows = corpus(2)
    out = run(spark, rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in out.values())
    assert out[0].n_removed <= out[40].n_removed == out[40].n_bytes


def test_long_passages_are_caught_and_clean_texts_left(spark):
    r = random.Random(9)
    passage = [words(r, 51) for _ in range(30)]
    rows = []
    for i in range(120):
        t = words(r, r.randrange(30, 200))
        if i < 60:
            at = t.index(" ", len(t) // 2)
            t = t[:at] + " " + passage[i % 30] + t[at:]
        rows.append((i, t))
    out = run(spark, rows)
    assert all(out[i].n_removed > 0.5 * len(passage[i % 30]) for i in range(30, 60))
    assert all(out[i].n_repeated > 0 for i in range(60))
    assert all(out[i].n_removed == out[i].n_repeated == 0 for i in range(60, 120))


def test_stock_phrases_in_a_row_are_no_passage(spark):
    """Chunks of 25 bytes: p0..p4 occur one by one elsewhere, q0..q4 as a whole."""
    r = random.Random(3)
    block = lambda: "".join(r.choice("abcdefghij ") for _ in range(24)) + "."
    p, q = [block() for _ in range(5)], [block() for _ in range(5)]
    rows = [block() + x + block() for x in p] + ["".join(p), "".join(q), "".join(q), block() + "".join(q[:4]) + p[0] + p[2]]
    out = run(spark, list(enumerate(rows)), least=25, most=25)
    assert [(out[i].n_removed, out[i].n_repeated, out[i].n_passages) for i in range(9)] == [
        *[(0, 0, 0)] * 6, (0, 125, 1), (125, 125, 1), (100, 100, 1)]
    assert bytes(out[8].kept).decode() == rows[8][:25] + p[0] + p[2]


def test_empty_table(spark):
    assert run(spark, []) == {}
