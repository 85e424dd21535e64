"""Files, directories and changes of a checkout as corpora.

A directory is listed with every name in it (Spark's own file sources pass over names that begin with `_` or `.`), the
names are filtered, and only the files that are left are opened, by the executors. Listing goes down level by level on the
driver until there are directories enough to share out, and from there in tasks.

Defined results: a root without files gives no rows; files that vanish or cannot be read before they are opened have an
`error` and null content; links to directories are not followed twice; names are compared as they are.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import paths
from corpusmill.operators.corpus import in_order
from corpusmill.session import cut, ship

#: Directories that the driver finds before it leaves the rest to tasks, and files that one task opens at least.
FAN_OUT, FILES_A_TASK = 64, 256
_LISTED = "path string, length long, modified_at timestamp, url string"


def _entries(fs: pafs.FileSystem, folder: str, recursive: bool) -> list[pafs.FileInfo]:
    return fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True, recursive=recursive))


def _row(info: pafs.FileInfo, base: str, prefix: str) -> tuple:
    return info.path[len(base) :].lstrip("/"), info.size, info.mtime, prefix + info.path


def _located(root: str) -> tuple[pafs.FileSystem, str, str]:
    """(file system, path in it, what makes a URL of a path) of a local path or a URL."""
    if root.startswith("file:"):
        root = "/" + root[5:].lstrip("/")
    if "://" not in root:
        return pafs.LocalFileSystem(), os.path.abspath(root), "file://"
    fs, path = pafs.FileSystem.from_uri(root)
    scheme, _, rest = root.partition("://")
    return fs, path.rstrip("/"), f"{scheme}://" + (rest.split("/", 1)[0] if fs.type_name == "hdfs" else "")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modified_at, url) of all files under `root`, whatever their names; contents are not read."""
    ship(spark)
    fs, base, prefix = _located(root)
    found: list[tuple] = []
    level = [base]
    while level and len(level) < FAN_OUT:
        below = []
        for folder in level:
            for info in _entries(fs, folder, False):
                if info.type == pafs.FileType.Directory:
                    below.append(info.path)
                elif info.type == pafs.FileType.File:
                    found.append(_row(info, base, prefix))
        level = below
    rows = spark.createDataFrame(found, _LISTED)
    if not level:
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _located(root)[0]
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                part = [_row(i, base, prefix) for i in _entries(own, folder, True) if i.type == pafs.FileType.File]
                kinds = (pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.string())
                cols = list(zip(*part)) if part else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["path", "length", "modified_at", "url"])

    folders = spark.createDataFrame([(f,) for f in level], "folder string").repartition(len(level))
    return rows.unionByName(folders.mapInArrow(run, _LISTED))


def kept(
    rows: DataFrame, depth: int | None = None, include: list[str] | None = None, exclude: list[str] | None = None, only: DataFrame | None = None, hidden: bool = False
) -> DataFrame:
    """The rows whose `path` the filters leave; secret files never are. `only` is a table of paths."""
    p = F.col("path")
    rows = rows.filter(~paths.is_secret_file(p))
    if not hidden:
        rows = rows.filter(~p.rlike(r"(?:^|/)\.[^/]"))
    if depth is not None:
        rows = rows.filter(paths.depth(p) <= depth)
    if include:
        rows = rows.filter(paths.included(p, include))
    if exclude:
        rows = rows.filter(~paths.excluded(p, exclude))
    if only is not None:
        rows = rows.join(only.select("path").distinct(), "path", "left_semi")
    return rows


def opened(listed: DataFrame) -> DataFrame:
    """(ord, path, content BINARY, error) of (ord, path, url): each file read whole by the task that has its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for o, path, url in zip(*(c.to_pylist() for c in batch.columns)):
                content = error = None
                try:
                    fs, name, _ = _located(url)
                    with fs.open_input_stream(name) as f:
                        content = f.read()
                except OSError as e:
                    error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o], pa.int64()), pa.array([path], pa.string()), pa.array([content], pa.binary()), pa.array([error], pa.string())], names=["ord", "path", "content", "error"]
                )

    return listed.select("ord", "path", "url").mapInArrow(run, "ord long, path string, content binary, error string")


def directory(spark: SparkSession, root: str, depth: int | None = None, include: list[str] | None = None, exclude: list[str] | None = None, only: DataFrame | None = None, hidden: bool = False) -> DataFrame:
    """(ord, path, content BINARY, error) of the files under `root` that the filters leave, `ord` by sorted path."""
    rows = cut(in_order(kept(listing(spark, root), depth, include, exclude, only, hidden), "path", "ord"))
    tasks = max(1, -(-rows.count() // FILES_A_TASK))
    return opened(rows.repartition(tasks, "ord"))


def single(spark: SparkSession, path: str) -> DataFrame:
    """(ord, path, content, error): one file under the name it was asked for; a folder is an error."""
    ship(spark)
    return opened(spark.createDataFrame([(0, path, path)], "ord long, path string, url string"))


def page(spark: SparkSession, url: str) -> DataFrame:
    """(ord, path, content, error): a URL is never fetched here; the row says so."""
    return spark.createDataFrame([(0, url, None, "Unavailable: pages are not fetched; give them as a table of (url, html)")], "ord long, path string, content binary, error string")


def target(spark: SparkSession, name: str, whole: bool = False, **filters) -> DataFrame:
    """A target as a run names it: a URL, a folder (with `whole`) or a single file."""
    if name.startswith(("http://", "https://")):
        return page(spark, name)
    return directory(spark, name, **filters) if whole else single(spark, name)


def text(spark: SparkSession, name: str, content: str | None) -> DataFrame:
    """One row for the text of a stream or clipboard; none if it is empty."""
    return spark.createDataFrame([(0, name, content)] if content else [], "ord long, path string, content string")


def changed_files(spark: SparkSession, checkout: str, ref: str) -> DataFrame | None:
    """The paths that differ from `ref`; None if git cannot tell, in which case nothing is filtered."""
    done = subprocess.run(["git", "-C", checkout, "diff", "--name-only", ref], capture_output=True, text=True)
    if done.returncode:
        return None
    return spark.createDataFrame([(p,) for p in done.stdout.split("\n") if p], "path string")


def diffs(spark: SparkSession, checkout: str, ref: str) -> DataFrame:
    """(ord, path, content): the unified diff of each changed file, blank ones left out."""
    done = subprocess.run(["git", "-C", checkout, "diff", ref], capture_output=True, text=True, check=True)
    rows = []
    for part in done.stdout.split("diff --git ")[1:]:
        name = part.split("\n", 1)[0].split(" b/", 1)[-1]
        if part.strip():
            rows.append((len(rows), name, "diff --git " + part))
    return spark.createDataFrame(rows, "ord long, path string, content string")
