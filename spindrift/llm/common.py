"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.session import ship


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where the session has none, a temporary
    folder on one machine (tests) and an error on a cluster, which has no folder we could know of."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spindrift-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the reliable checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def save(df: DataFrame) -> DataFrame:
    """Like cut(), as a compressed columnar table: for what is large or read in part."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/spindrift-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._saved_at = path
    return table


def drop(*tables: DataFrame) -> None:
    """Delete tables of save() that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(t._saved_at)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def where_computed(df: DataFrame, condition: Column) -> DataFrame:
    """df.where(condition) for a condition on costly computed columns. A plain filter is pushed below
    the projection, with the expressions of all columns it names written out again and again."""
    d = df.withColumn("_guard", F.monotonically_increasing_id())
    return d.where(condition & (F.col("_guard") >= 0)).drop("_guard")


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished phases now, not when the driver next
    happens to collect its garbage: on large inputs they are most of the disk in use."""
    sc = spark.sparkContext
    for _ in range(2):
        gc.collect()
        # what Python lets go of is told to the JVM by a thread that wakes once a second
        waiting, until = getattr(sc._gateway._gateway_client, "finalizer_deque", None), time.monotonic() + 15
        time.sleep(0.2 if waiting is not None else 1.5)
        while waiting and time.monotonic() < until:
            time.sleep(0.1)
        time.sleep(0.2)
        sc._jvm.System.gc()


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any spelling."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def doc_bytes(docs: DataFrame) -> DataFrame:
    """(doc_id, text as UTF-8 bytes, null as empty): all that most operators read."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def map_rows(df: DataFrame, schema: str, fn: Callable[[Iterable[tuple]], Iterator[tuple]], size: int = 2000) -> DataFrame:
    """mapInArrow over a stream of row tuples; results are written in batches of `size` rows."""
    ship(df.sparkSession)
    target = df.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)

        def rows():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        def pack(out):
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        out = []
        for row in fn(rows()):
            out.append(row)
            if len(out) >= size:
                yield pack(out)
                out = []
        if out:
            yield pack(out)

    return df.mapInArrow(run, target)
