"""WARC archives written by sorted, sharded tasks and read back.

Writer: rows are range-sorted by id (one shuffle of the payloads), each task
appends gzip members to a temporary file, rolls it once its compressed size
reaches ``roll_bytes``, and renames it to a name made of its first id and its
content digest.  The tasks return one manifest row per file; the manifest is
written last by Spark's own committer, and readers take only files it lists,
so a lost or repeated task leaves no visible trace.  Headers, lengths and
digests are rebuilt from the payload.

Defined cases: a null payload is empty; a null id sorts first and is written
without an id header; rows that repeat an id and payload give one response
and revisits to the same id; an empty table gives an empty manifest; only the
three named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "file string, first_id long, last_id long, n_records long, n_bytes long, sha256 string"
RECORDS = ("id long, url string, record_type string, payload_bytes long, payload_digest string, "
           "refers_to long, payload binary")
CRLF = b"\r\n"


def _record_id(rid: int | None, digest: str) -> str:
    h = hashlib.sha256(f"{rid}:{digest}".encode()).digest()[:16]
    return f"<urn:uuid:{uuid.UUID(bytes=h, version=5)}>"


def _record(rid, url, payload: bytes, digest: str, refers, date: str) -> bytes:
    """One gzip member holding a response, or a revisit of the record ``refers``."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}",
             f"WARC-Record-ID: {_record_id(rid, digest)}", f"WARC-Date: {date}",
             "Content-Type: application/http; msgtype=response",
             f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
             f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + " ".join(url.split()))
    if rid is not None:
        lines.append(f"X-Source-Id: {rid}")
    if refers is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {_record_id(refers, digest)}", f"X-Refers-To-Id: {refers}"]
    lines.append(f"Content-Length: {len(block)}")
    raw = "\r\n".join(lines).encode() + CRLF * 2 + block + CRLF * 2
    return gzip.compress(raw, compresslevel=6, mtime=0)


class _Roller:
    """Appends members to temporary files and renames each when it is full."""

    def __init__(self, folder: str, roll_bytes: int):
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.roll, self.out, self.done = roll_bytes, None, []

    def add(self, rid, member: bytes) -> None:
        if self.out is None:
            self.tmp = f"{self.root}/_temporary/{uuid.uuid4().hex}.warc.gz"
            self.fs.create_dir(f"{self.root}/_temporary", recursive=True)
            self.out, self.sha = self.fs.open_output_stream(self.tmp, compression=None), hashlib.sha256()
            self.first, self.n, self.size = rid, 0, 0
        self.out.write(member)
        self.sha.update(member)
        self.last, self.n, self.size = rid, self.n + 1, self.size + len(member)
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        self.out = None
        digest = self.sha.hexdigest()
        name = f"part-{'null' if self.first is None else format(self.first, '020d')}-{digest[:24]}.warc.gz"
        if self.fs.get_file_info(f"{self.root}/{name}").type == pafs.FileType.NotFound:
            self.fs.move(self.tmp, f"{self.root}/{name}")
        else:  # an earlier attempt wrote the same bytes
            self.fs.delete_file(self.tmp)
        self.done.append((name, self.first, self.last, self.n, self.size, digest))


def _writer(folder: str, roll_bytes: int, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = _Roller(folder, roll_bytes)
        mark_key, mark_first, last_key = None, None, None
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("id", "digest", "first_id", "url", "payload")]
            for rid, digest, first, url, payload in zip(*cols):
                key = (rid, digest)
                if payload is None:  # a marker row precedes the payloads of its key
                    mark_key, mark_first = key, first
                    continue
                refers = None
                if key == mark_key and (mark_first != rid or key == last_key):
                    refers = mark_first
                roller.add(rid, _record(rid, url, payload, digest, refers, date))
                last_key = key
        roller.close()
        cols = list(zip(*roller.done)) or [[]] * 6
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        names = ["file", "first_id", "last_id", "n_records", "n_bytes", "sha256"]
        yield pa.record_batch([pa.array(list(c), t) for c, t in zip(cols, types)], names=names)
    return write


def write_warc(df: DataFrame, folder: str, id_col: str, url_col: str, payload_col: str,
               min_revisit_bytes: int = 100, roll_bytes: int = 64 << 20,
               date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write ``df`` as WARC files under ``folder``; returns the committed manifest."""
    spark = df.sparkSession
    rows = df.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"),
        F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    keys = rows.where(F.octet_length("payload") >= min_revisit_bytes).select("id", "digest").where("id IS NOT NULL")
    first = keys.groupBy("digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    marks = keys.join(first, "digest").groupBy("id", "digest").agg(F.min("first_id").alias("first_id"))
    both = (rows.select("id", "digest", F.lit(None).cast("long").alias("first_id"), "url", "payload")
            .unionByName(marks.select("id", "digest", "first_id", F.lit(None).cast("string").alias("url"),
                                      F.lit(None).cast("binary").alias("payload"))))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (both.repartitionByRange(shards, "id", "digest")
               .sortWithinPartitions("id", "digest", F.col("payload").isNotNull(), "url"))
    manifest = ordered.mapInArrow(_writer(f"{folder}/data", roll_bytes, date), MANIFEST)
    manifest.write.mode("errorifexists").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def _members(content: bytes, step: int = 8 << 10) -> Iterator[bytes]:
    """Decompressed gzip members, one at a time; what follows a member is looked at ``step`` bytes ahead at most."""
    view, at = memoryview(content), 0
    while at < len(view):
        d, parts = zlib.decompressobj(wbits=31), []
        while not d.eof:
            piece = view[at:at + step]
            if not len(piece):
                raise ValueError("broken gzip member")
            parts.append(d.decompress(piece))
            at += len(piece)
        at -= len(d.unused_data)
        yield parts[0] if len(parts) == 1 else b"".join(parts)


def parse_record(raw: bytes) -> dict:
    """Headers and payload (a view of ``raw``) of one record; raises when a digest or length is wrong."""
    view, cut = memoryview(raw), raw.find(CRLF * 2)
    fields = dict(x.split(": ", 1) for x in raw[:cut].decode().split("\r\n")[1:])
    first = cut + 4
    end = first + int(fields["Content-Length"])
    if cut < 0 or len(raw) != end + 4 or raw[end:] != CRLF * 2:
        raise ValueError("broken WARC record")
    if "sha256:" + hashlib.sha256(view[first:end]).hexdigest() != fields["WARC-Block-Digest"]:
        raise ValueError("block digest differs")
    kind = fields["WARC-Type"]
    payload = view[raw.index(CRLF * 2, first) + 4:end] if kind == "response" else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("payload digest differs")
    num = lambda k: int(fields[k]) if k in fields else None
    return {"id": num("X-Source-Id"), "url": fields.get("WARC-Target-URI"), "record_type": kind,
            "payload_bytes": None if payload is None else len(payload), "payload_digest": digest,
            "refers_to": num("X-Refers-To-Id"), "payload": payload}


def _reader(folder: str, with_payload: bool):
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("refers_to", pa.int64()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for m in b.to_pylist():
                with fs.open_input_stream(f"{root}/{m['file']}", compression=None) as src:
                    content = src.read()
                if len(content) != m["n_bytes"] or hashlib.sha256(content).hexdigest() != m["sha256"]:
                    raise ValueError(f"{m['file']} is not the file of the manifest")
                rows, size, n = [], 0, 0
                for raw in _members(content):
                    rows.append(parse_record(raw))
                    size += len(raw)
                    n += 1
                    rows[-1]["payload"] = bytes(rows[-1]["payload"]) if with_payload and rows[-1]["payload"] is not None else None
                    if len(rows) >= 2000 or with_payload and size > 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if n != m["n_records"]:
                    raise ValueError(f"{m['file']} has other records than the manifest")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)
    return read


def read_warc(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """Records of the committed files under ``folder`` (a revisit has no length of its own).

    Tasks take file names from the manifest and open the files themselves; size,
    digest and record count must be those of the manifest.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    n = manifest.count()
    if not n:
        return spark.createDataFrame([], RECORDS)
    files = manifest.repartition(min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file")
    return files.mapInArrow(_reader(f"{folder}/data", with_payload), RECORDS)


def resolve_revisits(recs: DataFrame) -> DataFrame:
    """Give every revisit the payload length of the response that it refers to."""
    sizes = (recs.where("record_type = 'response' AND id IS NOT NULL").groupBy("id", "payload_digest")
             .agg(F.min("payload_bytes").alias("_n")))
    revisits = recs.where("record_type = 'revisit'").alias("r").join(
        sizes.alias("s"), (F.col("r.refers_to") == F.col("s.id"))
        & (F.col("r.payload_digest") == F.col("s.payload_digest")))
    revisits = revisits.select("r.id", "r.url", "r.record_type", F.col("s._n").alias("payload_bytes"),
                               "r.payload_digest", "r.refers_to", "r.payload")
    return recs.where("record_type = 'response'").unionByName(revisits)
