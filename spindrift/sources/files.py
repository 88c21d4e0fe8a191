"""Source trees as DataFrames."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.text import basename, extension
from spindrift.session import shared_folder, ship
from spindrift.sources import ignore

MAX_BYTES = 5 * 1024 * 1024
#: Entries of folders, and bytes of files, that a task hands on at once.
ENTRIES, CONTENT = 10_000, 32 << 20
#: Fixed values.
SPECIAL = ("Dockerfile", "Makefile")
EXTENSIONS = (".go", ".py", ".js", ".ts", ".tsx", ".jsx", ".java", ".rs", ".c", ".cpp", ".h", ".rb", ".cs", ".md", ".yaml", ".yml", ".toml")


def scan(spark: SparkSession, root: str, extensions: list[str] | None = None, user_patterns: list[str] | None = None) -> DataFrame:
    """(path, content) of the files that are indexed. The tree is listed first, without going into folders that are
    ignored; size, name and rules are tested on the list, and only what stays is read. Files that can't be read are left out."""
    rules = ignore.load(spark, root, user_patterns)
    listed = listing(spark, root, rules)
    return contents(listed.where(is_indexed(extensions) & ~ignore.ignored(F.col("path"), F.lit(False), rules)), root)


def is_indexed(extensions: list[str] | None = None) -> Column:
    """Whether a listed file is small enough and of a wanted kind."""
    wanted = [(e if e.startswith(".") else "." + e).lower() for e in (extensions or EXTENSIONS)]
    name = basename(F.col("path")).isin(*SPECIAL) | F.lower(extension(F.col("path"))).isin(*wanted)
    return (F.col("length") <= MAX_BYTES) & name


def listing(spark: SparkSession, root: str, rules: list[ignore.Rule]) -> DataFrame:
    """(path below the root, length) of every file that isn't in an ignored folder.

    The tree is expanded level by level: the folders of a level are a DataFrame, pruned by the rules, and listed by as many tasks
    as there are; each level is checkpointed, so that none is listed twice, and the driver only learns
    whether there is another. Folders that can't be listed are passed over; links to folders aren't followed.
    """
    out = spark.createDataFrame([], "path string, length long")
    for found in _levels(spark, root, rules):
        out = out.union(found.where("NOT is_dir").select("path", "length"))
    return out


_FOUND = ("path", "is_dir", "length", "written")


def _levels(spark: SparkSession, root: str, rules: list[ignore.Rule]) -> Iterator[DataFrame]:
    """What is in the folders of each level of a tree that aren't ignored, as _FOUND; checkpointed."""
    ship(spark)
    shared_folder(spark)
    base = _qualified(spark, root)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder in b.column(0).to_pylist():
                held = []
                for entry in _entries(base, folder):
                    held.append(entry)
                    if len(held) >= ENTRIES:
                        yield _batch(held, *_FOUND)
                        held = []
                if held:
                    yield _batch(held, *_FOUND)

    level = spark.createDataFrame([("",)], "path string")
    while True:
        found = level.mapInArrow(entries, "path string, is_dir boolean, length long, written long").checkpoint()
        yield found
        level = found.where("is_dir").where(~ignore.ignored(F.col("path"), F.lit(True), rules)).select("path")
        if level.isEmpty():
            return
        level = level.repartition(n)


def contents(listed: DataFrame, root: str) -> DataFrame:
    """(path, content) of listed files, read where the list is: hidden ones too, which Spark's readers pass over."""
    ship(listed.sparkSession)
    base = _qualified(listed.sparkSession, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for path in b.column(0).to_pylist():
                try:
                    content = _read(base, path)
                except OSError:
                    continue
                held.append((path, content))
                size += len(content)
                if size >= CONTENT:
                    yield _batch(held, "path", "content")
                    held, size = [], 0
        if held:
            yield _batch(held, "path", "content")

    n = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return listed.select("path").repartition(n).mapInArrow(run, "path string, content binary")


def write_files(files: DataFrame, root: str) -> int:
    """Write files (path below the root, content) from where the rows are, with the folders they need; returns how many. One that a
    lost task is asked for again is written again."""
    ship(files.sparkSession)
    base = _qualified(files.sparkSession, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = []
            for path, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                _write(base, path, content or b"")
                done.append((path,))
            if done:
                yield _batch(done, "path")

    return files.select("path", F.col("content").cast("binary")).mapInArrow(run, "path string").count()


def delete_tree(spark: SparkSession, root: str) -> None:
    """Delete a folder and all that is in it; links aren't followed. On a local disk tasks delete the files, in the order in which they
    were written, so that each task frees places that lie together, then the folders, the deepest first. What they leave the driver deletes."""
    base = _qualified(spark, root)
    if base.startswith("file:"):
        levels = list(_levels(spark, root, []))
        _each(reduce(DataFrame.union, levels).where("NOT is_dir"), base, os.unlink)
        for level in reversed(levels):
            _each(level.where("is_dir"), base, os.rmdir)
    _delete(spark, root)


def _each(found: DataFrame, base: str, remove: Callable[[str], None]) -> None:
    """remove() every path below base by tasks, in the order of writing. One that can't be, or was before, is passed over."""
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                with suppress(OSError):
                    remove(f"/{base[5:].lstrip('/')}/{path}")
        yield from ()

    found.repartitionByRange(n, "written").sortWithinPartitions("written").select("path").mapInArrow(run, "path string").count()


def _delete(spark: SparkSession, root: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_TYPES = {"path": pa.string(), "is_dir": pa.bool_(), "length": pa.int64(), "written": pa.int64(), "content": pa.binary()}


def _batch(rows: list[tuple], *names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[k]) for c, k in zip(zip(*rows, strict=True), names, strict=True)], names=list(names))


def _qualified(spark: SparkSession, root: str) -> str:
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    return top.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(top).toString()


def _entries(base: str, folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """(path, whether it is a folder, length, when it was written in ns) of what is in a folder below base."""
    at = f"{folder}/" if folder else ""
    try:
        if base.startswith("file:"):
            with os.scandir(f"/{base[5:].lstrip('/')}/{folder}") as found:
                for e in found:
                    try:
                        known = e.stat(follow_symlinks=False)
                        yield at + e.name, e.is_dir(follow_symlinks=False), known.st_size, known.st_mtime_ns
                    except OSError:
                        continue
        else:
            from pyarrow import fs

            system, top = fs.FileSystem.from_uri(f"{base}/{folder}")
            for e in system.get_file_info(fs.FileSelector(top)):
                yield at + e.base_name, e.type == fs.FileType.Directory, e.size or 0, e.mtime_ns or 0
    except OSError:
        return


def _read(base: str, path: str) -> bytes:
    if base.startswith("file:"):
        with open(f"/{base[5:].lstrip('/')}/{path}", "rb") as f:
            return f.read()
    from pyarrow import fs

    system, top = fs.FileSystem.from_uri(base)
    with system.open_input_stream(f"{top}/{path}") as f:
        return f.read()


def _write(base: str, path: str, content: bytes) -> None:
    from pyarrow import fs

    system, top = (fs.LocalFileSystem(), "/" + base[5:].lstrip("/")) if base.startswith("file:") else fs.FileSystem.from_uri(base)
    system.create_dir(f"{top}/{path}".rpartition("/")[0], recursive=True)
    with system.open_output_stream(f"{top}/{path}") as f:
        f.write(content)


def read_file(spark: SparkSession, path: str) -> str:
    row = spark.read.format("binaryFile").load(path).select(F.expr("make_valid_utf8(cast(content as string))").alias("t")).first()
    return row.t
