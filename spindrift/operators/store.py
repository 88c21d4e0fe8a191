"""Index storage: Parquet tables in one folder per project, replaced as a whole."""

from __future__ import annotations

import struct
import uuid
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift import schemas


def upsert(old: DataFrame, new: DataFrame, *keys: str, order: str) -> DataFrame:
    """The last row by order for each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return old.unionByName(new).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def insert_or_ignore(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    return old.unionByName(new.join(old, list(keys), "left_anti").select(*old.columns))


def delete_in(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_anti").select(*table.columns)


def encode_vector(v: list[float]) -> bytes:
    return struct.pack(f"<{len(v)}d", *v)


def decode_vector(b: bytes) -> list[float]:
    return list(struct.unpack(f"<{len(b) // 8}d", b))


class Storage(Protocol):
    """What the engine asks of a store. Another one needs these, and no more."""

    def save(self, items: DataFrame, root: str, config_hash: str, summary: str = "") -> None: ...
    def reset(self) -> None: ...
    def status(self, config_hash: str) -> schemas.IndexStatus: ...
    def items(self) -> DataFrame: ...
    def summary(self, root: str) -> str: ...
    def memory(self) -> dict: ...
    def queue(self) -> DataFrame: ...
    def enqueue(self, payload: str) -> str: ...
    def commit_memory(self, memory: dict, done: list[str]) -> None: ...


#: How tables are written that are looked up by a column: sorted by it, in ranges, so that a filter on it skips files and row groups.
SORTED = {"items": ("symbol", "file_path", "start_line")}


class Store:
    """Tables under a folder that Spark can write. A table's folder holds versions; a commit writes the
    new version, then the pointer to it, so a reader sees the old table or the new one."""

    TABLES = {"items": schemas.ITEMS, "meta": schemas.META, "summary": schemas.SUMMARY, "memory": schemas.MEMORY, "queue": schemas.QUEUE, "done": schemas.DONE, "segments": schemas.SEGMENTS, "files": schemas.FILES}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def open(self) -> Store:
        """Make every table that isn't there, empty, and the one row of memory; nothing that is there changes."""
        for name, schema in self.TABLES.items():
            if self._current(name) is None:
                self.replace(name, self.spark.createDataFrame([], schema))
        blank = self.spark.createDataFrame([(1, "", [], [], [])], "id int, project_summary string, topics array<string>, preferences array<string>, folded array<string>")
        if not self._memory_rows():
            self.replace("memory", insert_or_ignore(self.read("memory"), blank.withColumn("updated_at", F.current_timestamp()), "id"))
        return self

    def columns(self, name: str) -> dict[str, str]:
        """Names and types of a table's columns as they are stored, whatever this version of the library would write; none if it isn't there."""
        version = self._current(name)
        return dict(self.spark.read.parquet(f"{self.folder}/{name}/{version}").dtypes) if version else {}

    def has_column(self, name: str, column: str) -> bool:
        return column in self.columns(name)

    def _pointer(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/CURRENT")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _current(self, name: str) -> str | None:
        path, fs = self._pointer(name)
        if not fs.exists(path):
            return None
        return self.spark.read.text(path.toString()).first().value

    def read(self, name: str) -> DataFrame:
        version = self._current(name)
        if version is None:
            return self.spark.createDataFrame([], self.TABLES[name])
        return self.spark.read.schema(self.TABLES[name]).parquet(f"{self.folder}/{name}/{version}")

    def replace(self, name: str, df: DataFrame) -> None:
        version = f"v-{uuid.uuid4().hex}"
        typed = self.spark.createDataFrame([], self.TABLES[name]).unionByName(df)
        by = SORTED.get(name)
        if by:
            n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            typed = typed.repartitionByRange(n, *by).sortWithinPartitions(*by)
        out = typed.write.option(f"parquet.bloom.filter.enabled#{by[0]}", "true") if by else typed.write
        out.parquet(f"{self.folder}/{name}/{version}")
        path, fs = self._pointer(name)
        out = fs.create(path, True)
        out.write(bytearray(version.encode()))
        out.close()

    def append(self, name: str, df: DataFrame) -> None:
        """Add rows, and write nothing but these: writers needn't know of each other. A table that is
        appended to is never replaced."""
        if self._current(name) is None:
            self.replace(name, self.spark.createDataFrame([], self.TABLES[name]))
        typed = self.spark.createDataFrame([], self.TABLES[name]).unionByName(df)
        typed.write.mode("append").parquet(f"{self.folder}/{name}/{self._current(name)}")

    def reset(self) -> None:
        for name in ("items", "summary", "meta"):
            self.replace(name, self.spark.createDataFrame([], self.TABLES[name]))

    def save(self, items: DataFrame, root: str, config_hash: str, summary: str = "") -> None:
        """Replace the index; the metadata goes last, so an index half written doesn't count as there."""
        now = F.current_timestamp()
        self.replace("items", items)
        if summary:
            row = self.spark.createDataFrame([(root, summary)], "project_root string, content string").withColumn("updated_at", now)
            self.replace("summary", upsert(self.read("summary"), row, "project_root", order="updated_at"))
        meta = self.spark.createDataFrame([(1, root, config_hash, schemas.META_VERSION)], "id int, project_root string, config_hash string, version string")
        self.replace("meta", upsert(self.read("meta"), meta.withColumn("created_at", now), "id", order="created_at"))

    def status(self, config_hash: str) -> schemas.IndexStatus:
        rows = self.read("meta").where("id = 1").limit(1).collect()
        if not rows:
            return schemas.IndexStatus.MISSING
        fresh = rows[0].version == schemas.META_VERSION and rows[0].config_hash == config_hash
        return schemas.IndexStatus.OK if fresh else schemas.IndexStatus.STALE

    def items(self) -> DataFrame:
        if self._current("items") is None or self.read("items").isEmpty():
            raise LookupError("the index is empty")
        return self.read("items")

    def summary(self, root: str) -> str:
        rows = self.read("summary").where(F.col("project_root") == root).select("content").limit(1).collect()
        return rows[0].content if rows else ""

    def memory(self) -> dict:
        rows = self._memory_rows()
        r = rows[0].asDict() if rows else {"project_summary": "", "topics": [], "preferences": []}
        return {"project_summary": r["project_summary"] or "", "topics": r["topics"] or [], "preferences": r["preferences"] or []}

    def _memory_rows(self) -> list:
        return self.read("memory").where("id = 1").limit(1).collect()

    def pending(self, queue: DataFrame) -> DataFrame:
        """The rows of a queue whose ids aren't done: neither among those told to be, nor folded by the state."""
        folded = self.read("memory").where("id = 1").select(F.explode("folded").alias("id"))
        return delete_in(queue, self.read("done").union(folded))

    def queue(self) -> DataFrame:
        return self.pending(self.read("queue")).orderBy("created_at", "id")

    def enqueue(self, payload: str) -> str:
        key = str(uuid.uuid4())
        row = self.spark.createDataFrame([(key, payload)], "id string, payload string").withColumn("created_at", F.current_timestamp())
        self.append("queue", row)
        return key

    def commit_memory(self, memory: dict, done: list[str]) -> None:
        """The new state, which holds the ids folded into it, is one commit; the ids are listed as done after
        it, and before the next one again if a crash came between. So each is folded once."""
        for r in self._memory_rows():
            self._list_done(r.folded or [])
        row = (1, memory["project_summary"], memory["topics"], memory["preferences"], done)
        row = self.spark.createDataFrame([row], "id int, project_summary string, topics array<string>, preferences array<string>, folded array<string>")
        self.replace("memory", row.withColumn("updated_at", F.current_timestamp()))
        self._list_done(done)

    def _list_done(self, ids: list[str]) -> None:
        if ids:
            new = delete_in(self.spark.createDataFrame([(x,) for x in ids], "id string"), self.read("done"))
            if not new.isEmpty():
                self.append("done", new)
