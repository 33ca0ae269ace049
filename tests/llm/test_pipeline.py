import hashlib
import random

import corpus_pipeline as C
import public_tokenizers
import pytest

from normlens.session import scratch_path


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark):
    r = random.Random(2)
    line = prose(r, 14)
    item = prose(r, 30)
    docs = [(i, "\n".join(prose(r, 25) for _ in range(4)), "en", f"src{i % 3}") for i in range(40)]
    base = [prose(r, 30) for _ in range(6)]
    docs += [(50, f"{line}\n{docs[0][1]} x", "en", "src0"),   # doc 0's lines repeat, the new line stays
             (51, docs[1][1], "en", "src1"),                  # exact copy: all its lines go
             (52, base[0] + "\n" + item, "en", "src2"),       # benchmark passage
             (53, None, "en", None), (54, "", None, "src1"),
             (55, "$$$ ||| BUY 00 !!! " * 30, "en", "src2")]  # rejected by the classifier
    labels = [(i, 1, 0) for i in range(0, 40, 2)]
    junk = [(200 + k, "$$$ ||| BUY 00 !!! " * (20 + k), "en", f"junk{k % 2}") for k in range(15)]
    docs += junk
    labels += [(i, 0, 0) for i, *_ in junk]
    out = scratch_path(spark, "pipeline-fixture")
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, {d[0]: d[1] for d in docs}


def test_stages_keep_the_columns_and_take_effect(spark, folder):
    out, texts = folder
    docs = spark.read.parquet(f"{out}/documents.parquet")
    cur, left = docs, [set(texts)]
    for name, stage in C.STAGES[:-1]:
        cur = C.materialize(stage(spark, cur, out), f"t-{name}")
        assert cur.dtypes == docs.dtypes
        left.append({r.doc_id for r in cur.select("doc_id").collect()})
    assert all(b <= a for a, b in zip(left, left[1:]))
    quality, lines, near, clean = left[1:]
    assert 55 not in quality and not quality & set(range(200, 215)) and set(range(40)) <= quality
    assert 51 not in lines and set(range(40)) <= lines
    assert set(range(40)) <= near
    assert 52 in near and 52 not in clean and set(range(40)) <= clean
    kept = {r.doc_id: r.text for r in cur.select("doc_id", "text").collect()}
    assert all(kept[i] == texts[i] for i in range(40))        # clean documents are untouched


def test_run_gives_the_tokens_of_what_is_left(spark, folder):
    out, texts = folder
    rows = {r.doc_id: r for r in C.run(spark, out).collect()}
    assert set(range(40)) <= set(rows) and not {51, 52, 55} & set(rows)
    import base64

    import tiktoken
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i in range(40):
        assert list(rows[i].ids) == enc.encode_ordinary(texts[i])
        assert rows[i].decoded_sha256 == hashlib.sha256(texts[i].encode()).hexdigest()


def test_empty_documents(spark, folder):
    out, _ = folder
    cur = spark.read.parquet(f"{out}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        cur = stage(spark, cur, out)
    assert cur.count() == 0
