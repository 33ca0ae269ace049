"""Token-id files: one stream of ids in document order, Simple-8b packed, with offsets.

Writer: rows are range-sorted by id (one shuffle of the texts); each task
encodes its texts, closes every document with ``end_id``, and rolls a file when
``roll_ids`` ids are gathered.  A file is written under a temporary name and
renamed to one made of its place and its checksum, so a repeated task meets an equal file
and leaves it.  The manifest, written last by Spark's committer, is what makes files
visible, and gives every file its place in the stream.

A file: magic, counts, the document table (ids, null marks, first id of each
document), the block table (first word and first escape of each block of
``BLOCK`` ids), words, escapes, and the CRC-32 of all that.  Any block can be
decoded without those before it.  Readers take files by name from the manifest
and check checksum and counts.

Defined cases: null text is empty, so its document is the end id alone; a null
id sorts first and is read back as null; rows with equal ids stand by their
text; an empty table gives an empty manifest and no rows; a text longer than a
file makes a file of its own; only the two named columns are read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from normlens.llm import simple8b

MAGIC = b"NLTOK\x00\x01\n"
COUNTS = struct.Struct("<8sQQQQQ")  # magic, documents, ids, blocks, words, escapes
BLOCK = 1 << 16
TEXT_BYTES = 8 << 20
MANIFEST = "part int, seq int, file string, n_docs long, n_ids long, n_bytes long, crc long"
ROWS = "part int, seq int, pos int, doc_id long, at long, n_tokens long, ids binary"


def pack_file(doc_ids: list, ids: np.ndarray, off: np.ndarray) -> bytes:
    """The bytes of a file holding documents with ids[off[i]:off[i + 1]]."""
    words, escapes = [], []
    for i in range(0, len(ids), BLOCK):
        w, e = simple8b.encode(ids[i:i + BLOCK])
        words.append(w)
        escapes.append(e)
    at = lambda parts: np.cumsum([0] + [len(p) for p in parts]).astype("<u8")
    body = [COUNTS.pack(MAGIC, len(doc_ids), len(ids), len(words), sum(map(len, words)), sum(map(len, escapes))),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], "u1").tobytes(), off.astype("<u8").tobytes(),
            at(words).tobytes(), at(escapes).tobytes(), *(w.astype("<u8").tobytes() for w in words),
            *(e.astype("<u8").tobytes() for e in escapes)]
    data = b"".join(body)
    return data + struct.pack("<I", zlib.crc32(data))


class TokenFile:
    """A file's tables, and its ids block by block."""

    def __init__(self, content: bytes):
        view = memoryview(content)
        if len(view) < COUNTS.size + 4 or zlib.crc32(view[:-4]) != struct.unpack("<I", view[-4:])[0]:
            raise ValueError("broken token file")
        magic, docs, self.n_ids, self.n_blocks, words, escapes = COUNTS.unpack_from(view)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = COUNTS.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(view, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids, self.null = take("<i8", docs), take("u1", docs).astype(bool)
        self.off = take("<u8", docs + 1).astype(np.int64)
        self.word_at, self.escape_at = take("<u8", self.n_blocks + 1), take("<u8", self.n_blocks + 1)
        self.words, self.escapes = take("<u8", words), take("<u8", escapes)

    def block(self, k: int) -> np.ndarray:
        w, e = self.word_at, self.escape_at
        return simple8b.decode(self.words[w[k]:w[k + 1]], self.escapes[e[k]:e[k + 1]],
                               min(BLOCK, self.n_ids - k * BLOCK))

    def ids(self, first: int, end: int) -> np.ndarray:
        """Ids first..end-1 of the file, decoding only the blocks that hold them."""
        if first >= end:
            return np.zeros(0, np.uint64)
        a, b = first // BLOCK, (end - 1) // BLOCK
        return np.concatenate([self.block(k) for k in range(a, b + 1)])[first - a * BLOCK:end - a * BLOCK]


def _commit(fs, folder: str, name: str, data: bytes) -> None:
    """Write under a temporary name, then rename; an equal file of an earlier attempt stays."""
    tmp = f"{folder}/_temporary/{uuid.uuid4().hex}"
    fs.create_dir(f"{folder}/_temporary", recursive=True)
    with fs.open_output_stream(tmp, compression=None) as out:
        out.write(data)
    if fs.get_file_info(f"{folder}/{name}").type == pafs.FileType.NotFound:
        fs.move(tmp, f"{folder}/{name}")
    else:
        fs.delete_file(tmp)


def _writer(folder: str, tokenizer: str, end_id: int, roll_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from normlens.llm.word_tokens import Encoder
        encoder = Encoder(tokenizer)
        fs, root = pafs.FileSystem.from_uri(folder)
        part, docs, ids, size, done = TaskContext.get().partitionId(), [], [], 0, []

        def close():
            nonlocal docs, ids, size
            if not docs:
                return
            off = np.cumsum([0] + [len(x) for x in ids])
            data = pack_file(docs, np.concatenate(ids), off)
            crc = zlib.crc32(data)
            name = f"tokens-{part:06d}-{len(done):06d}-{crc:08x}-{len(data)}"
            _commit(fs, root, name, data)
            done.append((part, len(done), name, len(docs), int(off[-1]), len(data), crc))
            docs, ids, size = [], [], 0

        for b in batches:
            keys, texts = b.column("doc_id").to_pylist(), b.column("text").fill_null("")
            at, i = np.concatenate(([0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)))), 0
            while i < len(keys):
                j = max(i + 1, int(np.searchsorted(at, at[i] + TEXT_BYTES, side="right")) - 1)
                got, off = encoder.encode(texts[i:j])
                for k in range(i, j):
                    docs.append(keys[k])
                    ids.append(np.append(got[off[k - i]:off[k - i + 1]], np.uint32(end_id)))
                    size += len(ids[-1])
                    if size >= roll_ids:
                        close()
                i = j
        close()
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        cols = list(zip(*done)) or [()] * len(types)
        yield pa.record_batch([pa.array(list(c), t) for c, t in zip(cols, types)],
                              names=["part", "seq", "file", "n_docs", "n_ids", "n_bytes", "crc"])
    return write


def write_token_files(df: DataFrame, folder: str, id_col: str, text_col: str, tokenizer: str,
                      end_id: int, roll_ids: int = 4 << 20) -> DataFrame:
    """Write the ids of every text under ``folder``; returns the committed manifest."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (rows.repartitionByRange(shards, "doc_id", F.xxhash64("text"))
               .sortWithinPartitions("doc_id", F.xxhash64("text"), "text"))
    manifest = ordered.mapInArrow(_writer(f"{folder}/data", tokenizer, end_id, roll_ids), MANIFEST)
    manifest.write.mode("errorifexists").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for m in b.to_pylist():
                with fs.open_input_stream(f"{root}/{m['file']}", compression=None) as src:
                    data = src.read()
                if len(data) != m["n_bytes"] or zlib.crc32(data) != m["crc"]:
                    raise ValueError(f"{m['file']} is not the file of the manifest")
                f = TokenFile(data)
                if (len(f.doc_ids), f.n_ids) != (m["n_docs"], m["n_ids"]):
                    raise ValueError(f"{m['file']} has other counts than the manifest")
                i, n = 0, len(f.doc_ids)
                while i < n:  # some 16 blocks of ids at a time, whole documents
                    j = max(i + 1, int(np.searchsorted(f.off, f.off[i] + 16 * BLOCK, side="right")) - 1)
                    raw = f.ids(f.off[i], f.off[j]).astype("<u4").tobytes()
                    off = (f.off[i:j + 1] - f.off[i]) * 4
                    yield pa.record_batch(
                        [pa.array(np.full(j - i, m["part"], np.int32)), pa.array(np.full(j - i, m["seq"], np.int32)),
                         pa.array(np.arange(i, j, dtype=np.int32)), pa.array(f.doc_ids[i:j], mask=f.null[i:j]),
                         pa.array(f.off[i:j]), pa.array(np.diff(f.off[i:j + 1])),
                         pa.array([raw[a:z] for a, z in zip(off[:-1].tolist(), off[1:].tolist())], pa.binary())],
                        names=["part", "seq", "pos", "doc_id", "at", "n_tokens", "ids"])
                    i = j
    return read


def file_starts(manifest: DataFrame) -> DataFrame:
    """``manifest`` with ``base``, the number of ids in all files before each.

    Files are summed inside their part; the window over parts has one row per
    writing task.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    parts = parts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("_in", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    return files.join(parts, "part").withColumn("base", F.col("_before") + F.col("_in")).drop("_before", "_in")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document; ids are little-endian unsigned 32-bit integers."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    tasks = max(1, manifest.count())
    files = manifest.repartition(min(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file")
    rows = files.mapInArrow(_reader(f"{folder}/data"), ROWS)
    starts = file_starts(manifest).select("part", "seq", "base")
    return rows.join(F.broadcast(starts) if tasks <= 100_000 else starts, ["part", "seq"]).select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")
