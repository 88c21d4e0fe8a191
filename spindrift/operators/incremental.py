"""An index that follows its files: only those that are new or changed are chunked and embedded.

`segments` has the items of every refresh, with its generation; it is only appended to. `files` has a row for each file that
there is: its digest, and the generation that its items are of. An item counts if `files` names its generation for its
file. So writing `files` is the commit: items of a refresh that broke off, of files changed since and of
files gone are there, but don't count; compact() drops them.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from spindrift.operators.store import Store
from spindrift.session import shared_folder, ship

#: Seconds between two calls of a progress function.
EVERY = 0.5


@dataclass(frozen=True)
class Refreshed:
    """What a refresh found and did."""

    files: int
    changed: int
    removed: int
    chunks: int


def digests(contents: DataFrame) -> DataFrame:
    """(path, digest) of files (path, content). Contents are read and let go of where they are."""
    return contents.select("path", F.sha2(F.coalesce(F.col("content").cast("binary"), F.lit(b"")), 256).alias("digest"))


def refresh(store: Store, now: DataFrame, read: Callable[[DataFrame], DataFrame], items_of: Callable[[DataFrame], DataFrame], progress: Callable[[int, int], None] | None = None) -> Refreshed:
    """Bring an index up to date with files.

    now: (path, digest) of all files, each path once; read(paths) gives (path, content) of some of them, items_of(files) the
    columns of items. progress(done, total) hears, while it lasts, how many of the changed files have been read.
    Numbers come with the writing (observed metrics); no table is counted.
    """
    spark = store.spark
    shared_folder(spark)
    seen = Observation()
    now = now.observe(seen, F.count("*").alias("files")).checkpoint()
    old = store.read("files")
    # a file's row, its generation where nothing changed
    state = now.join(old.withColumnRenamed("digest", "before"), "path", "full")
    state = state.select("path", "digest", F.when(F.col("digest") == F.col("before"), F.col("generation")).alias("generation")).checkpoint()
    counts = state.agg(F.count(F.when(F.col("digest").isNotNull() & F.col("generation").isNull(), 1)).alias("changed"), F.count(F.when(F.col("digest").isNull(), 1)).alias("removed")).first()
    generation, chunks = uuid.uuid4().hex, 0
    if counts.changed:
        written = Observation()
        changed = state.where("digest IS NOT NULL AND generation IS NULL").select("path")
        with _Progress(spark, counts.changed, progress) as p:
            items = items_of(p.counted(read(changed))).withColumn("generation", F.lit(generation))
            store.append("segments", items.observe(written, F.count("*").alias("chunks")))
        chunks = written.get["chunks"]
    if counts.changed or counts.removed:
        store.replace("files", state.where("digest IS NOT NULL").withColumn("generation", F.coalesce("generation", F.lit(generation))))
    return Refreshed(seen.get["files"], counts.changed, counts.removed, chunks)


def items(store: Store) -> DataFrame:
    """The items that count, in the columns of items."""
    segments = store.read("segments")
    live = store.read("files").select(F.col("path").alias("file_path"), "generation")
    return segments.join(live, ["file_path", "generation"], "left_semi").select(*(c for c in segments.columns if c != "generation"))


def compact(store: Store) -> None:
    """Write the items that count anew, without the others. Not while a refresh runs."""
    segments = store.read("segments")
    live = store.read("files").select(F.col("path").alias("file_path"), "generation")
    store.replace("segments", segments.join(live, ["file_path", "generation"], "left_semi").select(*segments.columns))


class _Progress:
    """Tells a function how many files have gone through counted(). A task that is run again counts again, up to the total."""

    def __init__(self, spark, total: int, tell: Callable[[int, int], None] | None):
        self.done, self.total, self.tell, self.ended = spark.sparkContext.accumulator(0), total, tell, threading.Event()

    def counted(self, files: DataFrame) -> DataFrame:
        if self.tell is None:
            return files
        ship(files.sparkSession)
        done = self.done

        def run(batches):
            for b in batches:
                done.add(b.num_rows)
                yield pa.RecordBatch.from_arrays(b.columns, names=b.schema.names)

        return files.mapInArrow(run, files.schema)

    def _say(self) -> None:
        said = -1
        while True:
            over = self.ended.wait(EVERY)
            n = min(self.done.value, self.total)
            if n != said:
                self.tell(said := n, self.total)
            if over:
                return

    def __enter__(self) -> _Progress:
        if self.tell is not None:
            self.thread = threading.Thread(target=self._say, daemon=True)
            self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.ended.set()
        if self.tell is not None:
            self.thread.join()
