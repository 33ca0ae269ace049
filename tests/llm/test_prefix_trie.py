"""Prefix trie: against a plain trie built in Python, hot and odd conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from normlens.llm import prefix_trie, queries


def rebuilt(rows):
    """conv_id -> list of (role, text), openings borrowed."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    for c in by:
        by[c] = [(r, t) for *_, r, t in sorted(by[c])]
    out = {}
    for c, turns in by.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = by.get(c - c % 100, [])[:h] + turns[h:]
    return out


def brute(rows):
    members, ends = defaultdict(list), defaultdict(list)
    convs = rebuilt(rows)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
                  for p, m in members.items())


def run(spark, tmp_path, rows, schema="conv_id long, turn long, role string, text string"):
    df = spark.createDataFrame(rows, schema).selectExpr("*", "'x' AS node", "1 AS depth", "2 AS sym", "3 AS h").repartition(3)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    return sorted(map(tuple, queries.op11_prefix_trie(spark, str(tmp_path)).collect()))


def test_trie_equals_plain_trie(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 260), 400, 401, 405, 999, 2**40 + 5]:
        n = rng.choice([1, 1, 2, 3, 5, 8, 13])
        for t in range(n):
            rows.append((c, t if rng.random() < .95 else None, "user" if t % 2 == 0 else "assistant",
                         rng.choice(["hi", "é😀", "", f"x{rng.randrange(3)}"])))
    rows += [(7, 20, None, None), (8, 3, "user", "long " * 20_000), (None, 1, "user", "no conversation")]
    rows += [(500, t, "user", f"deep {t % 4}") for t in range(150)] + [(501, t, "user", f"deep {t % 4}") for t in range(150)]
    # turns of one number stand by role, then by digest: make them tell apart by role only
    seen, clean = set(), []
    for c, t, r, x in rows:
        while (c, t, r) in seen:
            r = (r or "") + "+"
        seen.add((c, t, r))
        clean.append((c, t, r, x))
    assert run(spark, tmp_path, clean) == brute(clean)


def test_hot_opening_copies_and_turnless(spark, tmp_path):
    rows = [(c, t, "user", "same") for c in range(1, 400) for t in range(3)]
    got = run(spark, tmp_path, rows)
    assert got == brute(rows)
    assert any(r[1] == 0 and r[3] == 399 for r in got)


def test_single_turns_and_empty_table(spark, tmp_path):
    assert run(spark, tmp_path / "a", [(1, 0, "u", "x")]) == brute([(1, 0, "u", "x")])
    assert run(spark, tmp_path / "b", [(1, 0, "u", "x")][:0]) == []


def test_repeated_rows_are_turns_of_their_own(spark):
    df = spark.createDataFrame([(1, 0, "u", "x"), (1, 0, "u", "x"), (1, None, None, None)],
                               "conv_id int, turn int, role string, text string")
    got = prefix_trie.ranked_turns(df, "conv_id", "turn", "role", "text").orderBy("pos").collect()
    assert [(r.pos, r.chars) for r in got] == [(1, 0), (2, 1), (3, 1)]


def test_role_and_text_do_not_run_together(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("", "abc")], "r string, t string")
    assert df.select(prefix_trie.symbol(df.r, df.t)).distinct().count() == 3


@pytest.mark.parametrize("size", [1, 3])
def test_members_are_hashed_over_pieces(spark, monkeypatch, size):
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", size)
    import pyarrow as pa
    rows = pa.record_batch([pa.array([4] * 5 + [9]), pa.array([2] * 5 + [2]), pa.array([4, 10, 11, 200, 3000, 9])],
                           names=["conv_id", "depth", "member"])
    pieces = [p for p in prefix_trie._pieces(iter([rows]))]
    assert sum(p.num_rows for p in pieces) == (6 if size == 1 else 3)
    out = [r for b in prefix_trie._hashed(iter(pieces)) for r in b.to_pylist()]
    assert [r["ends_sha256"] for r in out] == [hashlib.sha256(x).hexdigest() for x in (b"4,10,11,200,3000", b"9")]
