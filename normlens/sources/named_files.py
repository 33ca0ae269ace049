"""Files whose names and folders carry meaning, one per row, written by tasks.

Spark's own writers choose file names; the layouts of the workflow
(``<community>/tests.csv``, ``<run>/<model>/metrics.json``) fix them.  Every
task writes its rows under temporary names and renames each to its place, so a
reader never meets half a file and a repeated task replaces a file by an equal
one.  The list of written files is committed last, by Spark's committer.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normlens.session import materialize

WRITTEN = "file string, n_bytes long"


def commit_bytes(fs, target: str, data: bytes) -> None:
    """Write ``data`` beside ``target`` under a temporary name, then rename it."""
    folder = target.rsplit("/", 1)[0]
    fs.create_dir(folder, recursive=True)
    tmp = f"{folder}/._{uuid.uuid4().hex}"
    with fs.open_output_stream(tmp, compression=None) as out:
        out.write(data)
    if fs.get_file_info(target).type != pafs.FileType.NotFound:
        fs.delete_file(target)  # left by an earlier attempt; some stores refuse to rename onto a file
    fs.move(tmp, target)


def _safe(path: str) -> str:
    parts = path.split("/")
    if not all(parts) or any(p in (".", "..") or p.startswith(("_", ".")) for p in parts):
        raise ValueError(f"not a path that readers see: {path!r}")
    return path


def write_named(df: DataFrame, base: str, path_col: str = "file", content_col: str = "content") -> DataFrame:
    """Write ``content`` of every row to ``<base>/<file>``; returns the committed (file, n_bytes) list.

    ``file`` must differ from row to row; names that Spark's readers skip raise.
    """
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(base)
        for pdf in batches:
            sizes = []
            for name, content in zip(pdf["file"], pdf["content"]):
                data = (content or "").encode()
                commit_bytes(fs, f"{root}/{_safe(name)}", data)
                sizes.append(len(data))
            yield pd.DataFrame({"file": pdf["file"], "n_bytes": sizes})

    rows = df.select(F.col(path_col).alias("file"), F.col(content_col).alias("content"))
    return materialize(rows.mapInPandas(write, WRITTEN), "written-files")


def file_path() -> Column:
    """Decoded path of the file a row was read from (``+`` is no space in a path)."""
    return F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def relative_path(path: Column, base: str) -> Column:
    """``path`` below ``base`` (its last part where it does not lie below), whatever scheme either is written with."""
    root = re.sub(r"^[A-Za-z][\w+.-]*:(//[^/]*)?", "", base)
    lead = r"^[A-Za-z][\w+.-]*:(?://[^/]*)?/*" if root.startswith("/") else r"^.*?/"
    below = F.regexp_extract(path, lead + r"\Q" + root.strip("/") + r"\E/(.*)$", 1)
    return F.when(below != "", below).otherwise(F.element_at(F.split(path, "/"), -1))
