"""Every registered corpus query on empty tables, and on tables with extra columns of clashing names."""

import pytest

import corpus_pipeline
from normlens.llm.queries import QUERIES
from normlens.session import scratch_path

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}
# names that the operators use for columns of their own
EXTRA = ["id", "key", "n", "u", "v", "h", "g", "p", "a", "d1", "d2", "keys", "items", "rep", "node", "component_id", "kept",
         "spans", "want", "host", "path", "slot", "own", "payload", "digest", "depth", "sym", "chars", "runs", "w", "part", "seq",
         "start", "ids", "rows", "row", "drop", "n_removed", "line", "score", "x", "y", "vec", "copies", "shard", "block", "_id",
         "_text", "__removed", "n_items", "coverage", "site", "keep"]
LINE = "a line that stands in several of the documents given here"
BENCH = "which of the following words is the odd one out among all these many other common words here"


def _tables():
    texts = [LINE + f"\n{k} own words of number {k} " + " ".join(f"w{k}x{j}" for j in range(40)) for k in range(12)]
    texts += [texts[0], texts[1] + " more", None, "", BENCH + " " + BENCH, "z " * 300]
    docs = [(k, t, "en" if k % 2 else None, f"s{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)]
    return {
        "documents": docs,
        "embeddings": [(k, [float(k % 4), 1.0, float(k % 3)], 0) for k in range(20)] + [(90, None, None), (91, [0.0] * 3, 1)],
        "pages": [(k, f"https://h/{k}", f"<article><p>words {k}</p></article>") for k in range(6)] + [(7, None, None)],
        "benchmark": [(0, BENCH), (1, None), (2, "")],
        "labels": [(k, k % 2, 0) for k in range(12)] + [(99, None, None)],
        "conversations": [(c, t, "user", f"turn {t}") for c in (0, 1, 100) for t in range(3)] + [(1, None, None, None)],
    }


def _write(spark, rows, extra):
    out = scratch_path(spark, "odd")
    for name, schema in SCHEMAS.items():
        df = spark.createDataFrame(rows.get(name, []), schema)
        more = [f"'{c}' AS `{c}`" for c in EXTRA if c not in df.columns] if extra else []
        df.selectExpr("*", *more).write.parquet(f"{out}/{name}.parquet")
    return out


RUN = {**QUERIES, "pipeline": corpus_pipeline.run}


@pytest.mark.parametrize("name", sorted(RUN))
def test_empty_tables_give_no_rows(spark, name):
    assert RUN[name](spark, _write(spark, {}, False)).collect() == []


@pytest.fixture(scope="module")
def folders(spark):
    return _write(spark, _tables(), False), _write(spark, _tables(), True)


@pytest.mark.parametrize("name", sorted(RUN))
def test_extra_columns_change_nothing(spark, folders, name):
    plain, wide = (RUN[name](spark, d) for d in folders)
    assert set(plain.columns) <= set(wide.columns)
    rows = [sorted(map(str, f.select(*plain.columns).collect())) for f in (plain, wide)]
    assert rows[0] == rows[1] and rows[0]
