import random

import numpy as np
import pyarrow as pa
import pytest

from normlens.llm import line_dedup as L
from normlens.llm import linking
from normlens.llm.common import BLOCK_BYTES

SCHEMA = "doc_id long, text string, id int, n_removed string"


def normal(line):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
    for c in "\t\x0b\x0c\r":
        low = low.replace(c, " ")
    return " ".join(x for x in low.split(" ") if x)


def brute(rows, min_chars=20, k=8):
    lines = [(i, n, normal(x)) for i, t in sorted(rows) for n, x in enumerate((t or "").split("\n"))]
    lines = [(i, n, x) for i, n, x in lines if len(x) >= min_chars]
    sets = [{x[j:j + k] for j in range(max(1, len(x) - k + 1))} for _, _, x in lines]
    parent = list(range(len(lines)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(lines)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * len(sets[a] | sets[b]):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    gone = {(i, n) for k_, (i, n, _) in enumerate(lines) if find(k_) != k_}
    return {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in rows}


def corpus(seed):
    r = random.Random(seed)
    line = lambda: " ".join("".join(r.choice("abcdefghé") for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(1, 14)))
    pool = [line() for _ in range(15)]
    rows = []
    for _ in range(50):
        t = []
        for _ in range(r.randrange(0, 7)):
            x = r.choice(pool) if r.random() < .4 else line()
            if r.random() < .3 and x:
                at = r.randrange(len(x))
                x = x[:at] + r.choice("XYZ ") + x[at + 1:]
            t.append(r.choice(["", "  ", "\t"]) + (x.upper() if r.random() < .1 and "é" not in x else x) + r.choice(["", " ", "\r"]))
        rows.append("\n".join(t))
    rows += [rows[3], None, "", "\n\n", "short", "short", "Ünïcödé line with enough text\nÜnïcödé line with enough text!"]
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], SCHEMA).repartition(4)
    out = L.cleaned(df, "doc_id", "text").collect()
    assert {r.doc_id: r.text for r in out} == brute(rows)
    assert all(r.id == 5 and r.n_removed == "x" for r in out)
    want = brute(rows)
    assert all(r["__removed"] == len((dict(rows)[r.doc_id] or "").split("\n")) - len((want[r.doc_id] or "").split("\n"))
               for r in out if want[r.doc_id])


def test_registered_queries_compare_short_lines(spark):
    """Menu entries repeat exactly (case and white space aside); near ones and blank lines stay."""
    import hashlib

    import corpus_pipeline
    from normlens.llm.queries import QUERIES
    from normlens.session import scratch_path
    rows = [(1, "Read more\n\nthe first document has a line\nShare"), (2, "  READ  more\n\nthe second one has another\nShares"),
            (3, "Share\r\nx\n \nx"), (4, "x"), (5, ""), (6, None)]
    want = {1: (0, rows[0][1]), 2: (1, "\nthe second one has another\nShares"), 3: (2, "x\n "), 4: (1, ""), 5: (0, ""), 6: (0, None)}
    out = scratch_path(spark, "short-lines")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in QUERIES["op5_line_dedup"](spark, out).collect()}
    assert got == {i: (n, hashlib.sha256((t or "").encode()).hexdigest()) for i, (n, t) in want.items()}
    left = corpus_pipeline.line_stage(spark, spark.read.parquet(f"{out}/documents.parquet"), out).collect()
    assert {r.doc_id: r.text for r in left} == {i: t for i, (_, t) in want.items() if i != 4}


def test_empty_table(spark):
    assert L.cleaned(spark.createDataFrame([], SCHEMA), "doc_id", "text").count() == 0


def test_large_ids_and_clashing_columns(spark):
    same = "a line that stands in both of the texts\nanother line that stands in both texts"
    rows = [(2**43, same), (2**43 + 2**44, same + "\nand one of its own, long enough"), (-5, "nothing in common with the others here"),
            (None, same), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "doc_id", "text", "1 AS _id", "'t' AS _text", "9L AS __removed", "2 AS id", "3 AS row", "4 AS n_removed", "5 AS `a.b`")
    out = L.cleaned(df, "doc_id", "text")
    assert out.columns == [*df.columns, "___removed"]
    got = {r.doc_id: (r.text, r["___removed"], r["__removed"], r.row, r["a.b"]) for r in out.collect()}
    assert got == {2**43: (same, 0, 9, 3, 5), 2**43 + 2**44: ("and one of its own, long enough", 2, 9, 3, 5),
                   -5: (rows[2][1], 0, 9, 3, 5), None: (same, 0, 9, 3, 5), 7: (None, 0, 9, 3, 5)}


def test_many_lines_of_one_text(spark):
    text = "\n".join(f"line number {k % 5} of a long text" for k in range(40))
    r = L.duplicate_lines(spark.createDataFrame([(2**62, text)], "doc_id long, text string"), "doc_id", "text").collect()
    assert sorted(x.line for x in r if x.kept) == [0, 1, 2, 3, 4] and all(x.first_line == x.line % 5 for x in r) and {x.first_id for x in r} == {2**62} and len(r) == 40


def test_kept_lines_are_decoded_in_bounded_runs():
    rng = np.random.default_rng(3)
    a = [bytes(rng.integers(97, 123, int(n), dtype=np.uint8)) for n in [*rng.integers(20, 40_000, 120), 900_000, 5]]
    b = [x[:-3] + b"xyz" for x in a]
    batch = pa.record_batch([pa.array(range(len(a)), pa.int64()), pa.array(range(len(a)), pa.int64()),
                             pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b", "sa", "sb"])
    decode, sizes = L._line_sets(8), []

    def seen(column):
        sizes.append([len(x) for x in column.to_pylist()])
        return decode(column)
    out = list(linking._verify_task(seen)(iter([batch.slice(0, 0), batch])))
    assert len(sizes) > 2 and all(sum(x[1:]) <= BLOCK_BYTES for x in sizes)
    rows = [r for o in out for r in o.to_pylist()]
    assert [r["a"] for r in rows] == list(range(len(a)))
    for r, x, y in zip(rows, a, b):
        p, q = ({z[i:i + 8] for i in range(max(1, len(z) - 7))} for z in (x, y))
        assert (r["inter"], r["total"]) == (len(p & q), len(p | q))


def test_stored_sets_of_a_later_run_keep_their_places():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 62, 40_000)) for _ in range(6)]
    lists = pa.array([s.tolist() for s in sets], pa.list_(pa.int64()))
    batch = pa.record_batch([pa.array(range(6), pa.int64()), pa.array(range(6), pa.int64()), lists, lists], names=["a", "b", "sa", "sb"])
    out = list(linking._verify_task(linking.stored_sets)(iter([batch])))
    assert len(out) > 1
    assert [(r["inter"], r["total"]) for o in out for r in o.to_pylist()] == [(len(s), len(s)) for s in sets]
    sketches = [r for o in linking._parity_task(linking.stored_sets)(iter([batch.select(["a", "sa"]).rename_columns(["id", "items"])]))
                for r in o.to_pylist()]
    assert [r["id"] for r in sketches] == list(range(6)) and all(len(r["par"]) == linking.PARITY_BITS // 64 for r in sketches)


@pytest.mark.parametrize("few,joins", [(10**6, 0), (0, 1)])
def test_texts_are_dealt_only_for_many_sought_lines(spark, monkeypatch, few, joins):
    rows = corpus(3)
    plans, kept = {}, L.materialize

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return kept(df, name)
    monkeypatch.setattr(L, "materialize", seen)
    monkeypatch.setattr(L, "FEW_LINES", few)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = L.cleaned(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(3), "doc_id", "text").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert {r.doc_id: r.text for r in out} == brute(rows)
    assert plans["ln-sets"].count("SortMergeJoin") == joins


@pytest.mark.parametrize("few,joins", [(10**6, 1), (0, 2)])
def test_cut_texts_are_dealt_once(spark, monkeypatch, few, joins):
    """Texts with repeated lines are dealt for the cut only where many lines go, and never beside the cut text."""
    rows = corpus(2)
    monkeypatch.setattr(L, "FEW_LINES", few)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = L.cleaned(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(3), "doc_id", "text")
        plan = out._jdf.queryExecution().sparkPlan().toString()
        got = {r.doc_id: r.text for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == brute(rows)
    assert plan.count("SortMergeJoin") == joins


def test_band_keys_do_not_depend_on_runs(monkeypatch):
    from normlens.llm import minhash_dedup as M
    rng = np.random.default_rng(6)
    n = rng.integers(1, 60, 200)
    start, flat = np.cumsum(n) - n, rng.integers(0, 1 << 63, int(n.sum()), dtype=np.uint64)
    whole = M.band_keys(flat, start, 4, 3, 1)
    for run in (1, 50, 333):
        monkeypatch.setattr(M, "BAND_RUN", run)
        assert (M.band_keys(flat, start, 4, 3, 1) == whole).all()
    assert M.band_keys(flat[:0], start[:0], 4, 3, 1).shape == (0, 4)


def test_buckets_are_found_in_blocks_of_pairs(monkeypatch):
    """Keys of two or more ids come with all their ids, whatever the order, repeats and folds."""
    r = random.Random(7)
    keys = {i: [r.randrange(-2**63, 2**63) if r.random() < .4 else r.randrange(-90, 90) for _ in range(4)] for i in range(-40, 40)}
    rows = [(i, keys[i]) for i in (r.randrange(-40, 40) for _ in range(300))] + [(2**62, [5, 5, 6, 7]), (-2**63, [2**63 - 1, -2**63, 9, 9])]
    ids = {}
    for i, own in rows:
        for k in own:
            ids.setdefault(k, set()).add(i)
    want = {(k, i) for k, x in ids.items() if len(x) > 1 for i in x}
    monkeypatch.setattr(linking, "DEALT", 7)
    batches = [pa.record_batch([pa.array([i for i, _ in part], pa.int64()),
                                pa.array([np.array(k, np.int64).tobytes() for _, k in part], pa.binary())], names=["id", "keys"])
               for part in (rows[:1], rows[1:1], rows[1:150], rows[150:])]
    for slots, fold in ((1, 10), (5, 100), (3, 10**6)):
        monkeypatch.setattr(linking, "FOLD_PAIRS", fold)
        dealt = pa.Table.from_batches(list(linking._deal_task(slots)(iter(batches))))
        assert max(len(x) for x in dealt.column("pairs").to_pylist()) <= 7 * 16
        got = set()
        for slot in range(slots):
            at = dealt.filter(pa.array([x == slot for x in dealt.column("slot").to_pylist()]))
            for out in linking._shared_task(iter(at.select(["pairs"]).to_batches())):
                got |= set(zip(out.column("key").to_pylist(), out.column("id").to_pylist()))
        assert got == want


def test_texts_are_read_once_and_keys_are_not_dealt_row_by_row(spark, monkeypatch):
    plans, kept = {}, linking.materialize

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return kept(df, name)
    monkeypatch.setattr(L, "materialize", seen)
    monkeypatch.setattr(linking, "materialize", seen)
    text = "the one line that stands in this text twice\n"
    rows = L.duplicate_lines(spark.createDataFrame([(1, text + text.upper())], "doc_id long, text string"), "doc_id", "text").collect()
    assert sorted((r.line, r.kept) for r in rows) == [(0, True), (1, False)]
    assert "ln-bands" not in plans and "Generate" not in plans["ln-shared"]


@pytest.mark.parametrize("chars", [1, 3, 8])
def test_shingle_sets_are_those_of_single_lines(chars):
    r = random.Random(chars)
    for _ in range(60):
        texts = ["".join(r.choice("aB \t\n\x0b\ré日") for _ in range(r.choice([0, 1, 9, 60]))) for _ in range(r.randrange(1, 7))]
        data, off = L.byte_blocks.__globals__["binary_column"](pa.record_batch([pa.array(texts)], names=["text"]), "text")
        norm, s, e, text, number = L.normal_block(data, off)
        lines = [norm[x:y].tobytes().decode() for x, y in zip(s, e)]
        assert lines == [normal(x) for t in texts for x in t.split("\n")]
        assert list(zip(text, number)) == [(i, k) for i, t in enumerate(texts) for k in range(t.count("\n") + 1)]
        full = np.array([k for k, x in enumerate(lines) if x], np.int64)
        flat, at = L.shingle_sets(norm, s[full], e[full], chars)
        for k, i, j in zip(full, at[:-1], at[1:]):
            assert j - i == len({lines[k][x:x + chars] for x in range(max(1, len(lines[k]) - chars + 1))})
            alone = np.frombuffer(lines[k].encode(), np.uint8)
            assert (L.shingle_sets(alone, np.array([0]), np.array([len(alone)]), chars)[0] == flat[i:j]).all()
