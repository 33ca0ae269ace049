import random

from normlens.llm import quality as Q

DOCS = "doc_id long, text string, host string, path string, p_doc int"
LABELS = "doc_id long, quality int"


def corpus(n, seed):
    """Prose and junk by turns; hosts h0 and h1 hold mostly one kind each."""
    r = random.Random(seed)
    rows, truth = [], {}
    for i in range(n):
        good = i % 2 == 0
        if good:
            t = ". ".join(" ".join(r.choice(["the", "river", "house", "morning", "quiet", "walked", "under", "light"])
                                   for _ in range(r.randrange(6, 12))).capitalize() for _ in range(r.randrange(2, 6))) + "."
        else:
            t = " ".join(r.choice(["CLICK", "$$$", "|", "#1", "buy", "!!!", "00", "FREE"]) for _ in range(r.randrange(8, 40)))
        rows.append((i, t, f"h{int(good) if r.random() < .8 else 2}", r.choice(["a", "b", None]), 0))
        truth[i] = good
    return rows, truth


def scored(spark, rows, labels):
    out = Q.quality_scores(spark.createDataFrame(rows, DOCS).repartition(3), "doc_id", "text", "host", "path",
                           spark.createDataFrame(labels, LABELS), "doc_id", "quality")
    return {r.id: r for r in out.collect()}


def test_held_out_accuracy(spark):
    rows, truth = corpus(400, 3)
    train = [(i, int(truth[i])) for i in range(200)]
    out = scored(spark, rows, train)
    assert len(out) == 400
    assert sum(out[i].keep == truth[i] for i in range(200, 400)) >= 195


def test_posteriors_leave_a_document_out_of_its_own_site(spark):
    rows, truth = corpus(60, 4)
    out = scored(spark, [*rows, (900, rows[0][1], "alone", "x", 0)], [(i, int(truth[i])) for i in range(60)])
    mean = sum(r.p_doc for r in out.values()) / len(out)
    assert abs(out[900].host_posterior - mean) < 1e-9  # no other document on its host: the global mean
    assert abs(out[900].path_posterior - mean) < 1e-9


def test_nulls_empty_texts_and_empty_tables(spark):
    rows, truth = corpus(40, 5)
    odd = [(100, None, None, None, 0), (101, "", "h0", None, 0), (102, rows[0][1], rows[0][2], rows[0][3], 0)]
    out = scored(spark, rows + odd, [(i, int(truth[i])) for i in range(40)] + [(5, None)])
    assert len(out) == 43 and all(0 <= r.p_quality <= 1 for r in out.values())
    assert out[102].keep == out[0].keep and abs(out[102].p_doc - out[0].p_doc) < 1e-12
    assert all(r.keep for r in scored(spark, rows, []).values())          # no labels: kept
    assert scored(spark, [], [(1, 1)]) == {}
