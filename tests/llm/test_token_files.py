"""Packed token files: round trips, library ids, odd rows, broken files."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from normlens.llm import simple8b, token_files
from normlens.llm.word_tokens import Encoder
from normlens.session import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " \n\t", "x<|endoftext|>y <|startoftext|>", "İstanbul ÇA é 'S'RE don't DON'T they'll 12,5½ ×÷ æØÅ",
       "ﬁ x y 中文 ñ̃ 😀 Ǆ ß ẞ\x1cz \x85", "a\x00b ).,(", "Word, word. WORD", "naïve　cóop"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=400))
def test_simple8b_round_trip(values):
    v = np.array(values, np.uint64)
    words, escapes = simple8b.encode(v)
    assert (simple8b.decode(words, escapes, len(v)) == v).all()
    assert len(escapes) <= sum(x >= 1 << 60 for x in values)


def test_simple8b_packs_small_values_and_rejects_short_words():
    words, _ = simple8b.encode(np.zeros(1200, np.uint64))
    assert len(words) == 10
    with pytest.raises(ValueError):
        simple8b.decode(words, np.zeros(0, np.uint64), 1201)


def test_words_give_the_ids_of_the_whole_library():
    texts = ODD + [" ".join(ODD), "The quick brown fox's den; naïve façade — 3.14 ok..."]
    encoder, library = Encoder(PATH), Tokenizer.from_file(PATH)
    assert encoder.by_words
    ids, off = encoder.encode(pa.array(texts))
    for k, want in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[off[k]:off[k + 1]].tolist() == want.ids


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = Encoder(path)
    assert not encoder.by_words
    ids, off = encoder.encode(pa.array(["a b  c", ""]))
    assert ids.tolist() == Tokenizer.from_file(path).encode("a b  c").ids and off.tolist() == [0, len(ids), len(ids)]


def _brute(rows):
    lib, at, out = Tokenizer.from_file(PATH), 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def _read(spark, folder):
    out = token_files.read_token_files(spark, folder).selectExpr("doc_id", "start", "n_tokens", "crc32(ids) c")
    return sorted((tuple(r) for r in out.collect()), key=lambda r: r[1])


@pytest.mark.parametrize("roll", [40, 1 << 20])
def test_files_hold_the_stream_in_id_order(spark, roll):
    rows = [(k * 7 % 101 - 3, t) for k, t in enumerate(ODD * 3)] + [(None, "no id"), (2**60, None), (5000, "long " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "doc_id", "text", "1 AS ids", "'x' AS part", "2 AS start").repartition(3)
    folder = scratch_path(spark, "tok")
    manifest = token_files.write_token_files(df, folder, "doc_id", "text", PATH, 1, roll_ids=roll)
    assert manifest.count() > (10 if roll == 40 else 0)
    assert _read(spark, folder) == _brute(rows)


def test_equal_ids_stand_together_and_empty_tables_give_nothing(spark):
    folder = scratch_path(spark, "tok")
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (0, "z")], "doc_id long, text string")
    token_files.write_token_files(df, folder, "doc_id", "text", PATH, 1)
    got = _read(spark, folder)
    assert [r[0] for r in got] == [0, 1, 1, 1] and [r[1] for r in got] == [0, 2, 4, 6]
    folder = scratch_path(spark, "tok")
    token_files.write_token_files(df.limit(0), folder, "doc_id", "text", PATH, 1)
    assert _read(spark, folder) == []


def test_blocks_decode_alone_and_broken_files_are_noticed():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 1 << 40, 3 * token_files.BLOCK + 17).astype(np.uint64)
    data = token_files.pack_file([4, None], ids, np.array([0, 70_000, len(ids)]))
    f = token_files.TokenFile(data)
    assert (f.ids(70_000, 150_000) == ids[70_000:150_000]).all() and (f.ids(0, len(ids)) == ids).all()
    assert f.null.tolist() == [False, True]
    with pytest.raises(ValueError):
        token_files.TokenFile(data[:100] + b"\x00" + data[101:])


def test_a_repeated_commit_leaves_one_file(spark):
    import pyarrow.fs as pafs
    fs, root = pafs.FileSystem.from_uri("file://" + scratch_path(spark, "tok").removeprefix("file:"))
    for _ in range(2):
        token_files._commit(fs, root, "tokens-0", b"abc")
    names = [f.base_name for f in fs.get_file_info(pafs.FileSelector(root)) if f.is_file]
    assert names == ["tokens-0"]
