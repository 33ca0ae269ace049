import numpy as np
import pyarrow as pa
import pytest

from normlens.llm import embedding_dedup as D

SCHEMA = "vec_id long, embedding array<float>, id int, label string"


def brute(rows, cosine):
    ok = {i: np.array(v, dtype=np.float64) for i, v in rows
          if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    parent = {i: i for i, _ in rows}
    links = dict.fromkeys(parent, 0)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(ok)
    for a in ids:
        for b in ids:
            if a < b and len(ok[a]) == len(ok[b]):
                if ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= cosine:
                    links[a] += 1
                    links[b] += 1
                    ra, rb = find(a), find(b)
                    parent[max(ra, rb)] = min(ra, rb)
    return {i: (links[i], find(i)) for i in parent}


def vectors(seed, n=500, dim=24):
    r = np.random.default_rng(seed)
    rows = [r.normal(size=dim) for _ in range(n)]
    for size, noise in ((60, .05), (25, .25), (8, .3)):
        c = r.normal(size=dim)
        rows += [c + noise * r.normal(size=dim) for _ in range(size)]
    rows += [rows[0], rows[0], rows[1] * 3, rows[2][:5], rows[2][:5] * 2]
    rows = [np.asarray(x, np.float32).tolist() for x in rows]
    rows += [None, [], [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [float("inf")] * dim]
    order = r.permutation(len(rows))
    return [(int(k), rows[j]) for k, j in enumerate(order)]


@pytest.mark.parametrize("seed,shards", [(1, 1), (2, 3)])
def test_matches_brute_force(spark, seed, shards):
    rows = vectors(seed)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(3)
    out = D.near_vectors(df, "vec_id", "embedding", shards=shards).collect()
    assert {r.id: (r.n_links, r.component_id) for r in out} == brute(rows, 0.9)
    assert all(r.kept == (r.id == r.component_id) for r in out)


def test_empty_table(spark):
    assert D.near_vectors(spark.createDataFrame([], SCHEMA), "vec_id", "embedding").count() == 0


def test_links_are_merged_query_block_by_query_block(monkeypatch):
    """A tight group of 1,500 vectors queried by 3,000: no more links at hand than one block of queries has."""
    r = np.random.default_rng(7)
    x = r.normal(size=32) + .05 * r.normal(size=(3000, 32))
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x[:1500])] + [(k, v.tolist(), 1) for k, v in enumerate(x)]
    table = pa.table({"id": [k for k, _, _ in rows], "copies": [1] * len(rows), "vec": [v for _, v, _ in rows],
                      "dim": [32] * len(rows), "shard": [0] * len(rows), "block": [0] * len(rows), "query": [q for _, _, q in rows]})
    at_once, asked = [], []
    forest, search = D._forest, D.search
    monkeypatch.setattr(D, "_forest", lambda u, v: (at_once.append(len(u)), forest(u, v))[1])
    monkeypatch.setattr(D, "search", lambda q, *a: (asked.append(len(q)), search(q, *a))[1])
    out = list(D._link_task(0.9, 16, 32, 200, 700)(iter(table.to_batches(max_chunksize=1100))))
    assert max(at_once) <= 3000 and max(asked) <= 512  # 4.5 million links in all
    assert max(sum(i is not None for i in b.column("id").to_pylist()) for b in out) <= 700
    got = [row for b in out for row in b.to_pylist()]
    assert {g["id"]: g["n_links"] for g in got if g["id"] is not None} == {k: 1500 - (k < 1500) for k in range(3000)}
    edges = [(g["u"], g["v"]) for g in got if g["u"] is not None]
    assert len(edges) < 4500
    u, _ = forest(*np.array(edges).T)
    assert len(u) == 2999


def test_graph_search_recall():
    r = np.random.default_rng(4)
    c = r.normal(size=(40, 32))
    x = np.concatenate([c[k % 40] + .25 * r.normal(size=(1, 32)) for k in range(3000)])
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    layers = D.build_graph(x, np.arange(3000), 16)
    ef, slack = D.tuned(x, layers, 0.9, 32, 1000)
    a, b = D.search(x[:800], x, layers, 0.9, ef, slack)
    truth = {(i, j) for i, j in np.argwhere(x[:800] @ x.T >= 0.9).tolist()}
    got = set(zip(a.tolist(), b.tolist()))
    assert len(truth & got) >= 0.99 * len(truth)


def test_recall_on_sf001(spark):
    path = "/root/testdata/sf0.01"
    from normlens.llm.queries import QUERIES
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    out = {r.vec_id: (r.n_links, r.component_id) for r in QUERIES["op2_embedding_near_dedup"](spark, path).collect()}
    assert out == brute(rows, 0.9)


def test_walk_starts_at_a_layer_looked_through_whole(monkeypatch):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(5000, 24))
    x[2500:] = x[:2500] + 0.05 * rng.normal(size=(2500, 24))
    x[4900:] = x[0] + 0.02 * rng.normal(size=(100, 24))  # one tight group
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    layers = D.build_graph(x, rng.integers(0, 1 << 62, len(x)), 16)
    assert len(layers) > 2
    beams, beam = [], D._beam

    def counted(*a):
        beams.append(a[2])
        return beam(*a)
    monkeypatch.setattr(D, "_beam", counted)
    ef, slack = D.tuned(x, layers, 0.9, 32, 500)
    assert ef < len(x)
    beams.clear()
    r, v = D.search(x[:512], x, layers, 0.9, ef, slack)
    assert len(beams) == 1 and beams[0] is layers[0][1]
    got = list(zip(r.tolist(), v.tolist()))
    assert len(got) == len(set(got))  # every pair once
    sim = x[:512].astype(np.float64) @ x.T.astype(np.float64)
    want = set(zip(*(c.tolist() for c in np.nonzero(sim >= 0.9))))
    assert len(want & set(got)) >= 0.999 * len(want)


def test_vector_that_no_neighbour_leads_to_is_found_without_a_wider_beam():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x = x.astype(np.float32)
    layers = D.build_graph(x, np.arange(3000), 16)
    rows, table = layers[0]
    lost = int(np.setdiff1d(rows, layers[1][0])[100])
    table[table == lost] = -1
    assert lost not in D.search(x[lost:lost + 1], x, layers, 0.9, 32, 0.05)[1]
    mended = D.reachable(x, layers, 0.9, 32)
    assert lost in D.search(x[lost:lost + 1], x, mended, 0.9, 32, 0.05)[1]
    assert D.tuned(x, layers, 0.9, 32, 3000)[0] > 32 and D.tuned(x, mended, 0.9, 32, 3000)[0] == 32
    assert len(mended[1][0]) < 600
