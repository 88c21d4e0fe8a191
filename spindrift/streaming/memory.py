"""Interaction memory: a durable queue folded, in order, into one state."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery

from spindrift import schemas
from spindrift.session import ship

TOPICS, PREFERENCES = 20, 10
EMPTY = {"project_summary": "", "topics": [], "preferences": []}


def to_payload(user: str, assistant: str) -> str:
    return json.dumps({"user_input": user, "assistant_output": assistant})


def merge_list(existing: list[str], add: list[str], limit: int) -> list[str]:
    """Old items first, lower-cased, trimmed, once each; new ones until there are limit. The limit is
    looked at after an item is added, so a full list still grows by one."""
    if not add:
        return existing
    out = list(dict.fromkeys(x for v in existing if (x := v.strip().lower())))
    for v in add:
        x = v.strip().lower()
        if x and x not in out:
            out.append(x)
            if len(out) >= limit:
                break
    return out


def merge(memory: dict, extraction: dict) -> dict:
    update = (extraction.get("summary_update") or "").strip()
    return {
        "project_summary": update or memory["project_summary"],
        "topics": merge_list(memory["topics"], extraction.get("topics_add") or [], TOPICS),
        "preferences": merge_list(memory["preferences"], extraction.get("preferences_add") or [], PREFERENCES),
    }


def parse_extraction(reply: str) -> dict | None:
    """None: nothing to extract. Bad JSON raises ValueError."""
    a, z = reply.find("{"), reply.rfind("}")
    if a < 0 or z < a:
        return None
    out = json.loads(reply[a : z + 1])
    if not isinstance(out, dict):
        raise ValueError("not an object")
    return out


def fold(items: list[tuple[str, str]], memory: dict, extract: Callable[[dict, dict], str]) -> tuple[dict, list[str], int]:
    """(new state, ids that are done, number processed) of (id, payload) in order. An item that can't be
    read or whose reply is bad JSON stays; one whose reply holds none is done but not counted."""
    done, n = [], 0
    for key, payload in items:
        try:
            got = parse_extraction(extract(json.loads(payload), memory))
        except ValueError:
            continue
        done.append(key)
        if got is not None:
            memory, n = merge(memory, got), n + 1
    return memory, done, n


def flush(store, extract: Callable[[dict, dict], str]) -> int:
    """Fold a store's queue. Items are read one after another, never all at once: the state depends on
    their order, and the model is asked with the state so far."""
    rows = ((r.id, r.payload) for r in store.queue().toLocalIterator())
    memory, done, n = fold(rows, store.memory(), extract)
    if done:
        store.commit_memory(memory, done)
    return n


def memory_text(m: dict) -> str:
    if not (m["project_summary"] or m["topics"] or m["preferences"]):
        return ""
    out = f"PROJECT SUMMARY:\n{m['project_summary']}\n\nTOPICS:\n" + "".join(f"- {t}\n" for t in m["topics"])
    return (out + "\nPREFERENCES:\n" + "".join(f"- {p}\n" for p in m["preferences"])).strip()


def stream_flush(queue_folder: str, store, extract: Callable[[dict, dict], str], checkpoint: str):
    """The same fold as a stream over a folder of queue files: each batch is folded in order, row by row. A batch
    that is replayed after a crash finds its ids done, and adds nothing."""

    def batch(df: DataFrame, batch_id: int) -> None:
        rows = ((r.id, r.payload) for r in store.pending(df).orderBy("created_at", "id").toLocalIterator())
        memory, done, _ = fold(rows, store.memory(), extract)
        if done:
            store.commit_memory(memory, done)

    stream = store.spark.readStream.schema(schemas.QUEUE).parquet(queue_folder)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What folds read, besides keys and order, and the state that they make.
READ = ("summary_update", "topics_add", "preferences_add")
STATE = "project_summary string, topics array<string>, preferences array<string>"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _prepared(extractions: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """keys, order and READ; a column that is missing is null."""
    cast = {"summary_update": "string", "topics_add": "array<string>", "preferences_add": "array<string>"}
    have = set(extractions.columns)
    return extractions.select(*keys, order, *((F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in cast.items()))


def _without_nulls(extraction: dict) -> dict:
    return {k: [x for x in v if x is not None] if isinstance(v, list) else v for k, v in extraction.items()}


def fold_frames(extractions: DataFrame, *keys: str, order: str) -> DataFrame:
    """The fold of many projects at once, a row for each: keys and STATE.

    extractions: keys, order and those of READ that there are. Each project's rows are merged one after another, by order (ties by
    what they hold), exactly as merge() does. Rows are dealt by key, sorted where they are and read as a
    stream: a task holds the state of one project, however many rows that has. Null keys are a project too.
    """
    ship(extractions.sparkSession)
    rows = _prepared(extractions, keys, order)
    n, out = len(keys), T.StructType([*(rows.schema[k] for k in keys), *T.StructType.fromDDL(STATE).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, now, state, done = to_arrow_schema(out), None, EMPTY, []

        def finished() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), arrow, strict=True)], schema=arrow)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:n] != now:
                    if now is not None:
                        done.append((*now, *state.values()))
                    now, state = row[:n], EMPTY
                state = merge(state, _without_nulls(dict(zip(READ, row[n + 1 :], strict=True))))
            if len(done) >= 1_000:
                yield finished()
                done = []
        if now is not None:
            done.append((*now, *state.values()))
        if done:
            yield finished()

    return rows.repartition(*keys).sortWithinPartitions(*keys, order, *READ).mapInArrow(run, out)


class MemoryFold(StatefulProcessor):
    """merge() as state of a stream: what one project has, in a value that Spark keeps and restores."""

    def __init__(self, order: str):
        self.order = order

    def init(self, handle) -> None:
        self.state = handle.getValueState("memory", STATE)

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:  # noqa: N802  Spark's name
        old = self.state.get() if self.state.exists() else None
        memory = {"project_summary": old[0], "topics": list(old[1]), "preferences": list(old[2])} if old else EMPTY
        told = [x for r in rows for x in r[[self.order, *READ]].itertuples(index=False, name=None)]
        as_list = lambda v: [] if v is None else [x for x in v if x is not None]
        clean = [(o, s if isinstance(s, str) else None, as_list(t), as_list(p)) for o, s, t, p in told]
        for _, s, t, p in sorted(clean, key=lambda x: (x[0], x[1] is not None, x[1] or "", x[2], x[3])):
            memory = merge(memory, {"summary_update": s, "topics_add": t, "preferences_add": p})
        self.state.update(tuple(memory.values()))
        yield pd.DataFrame({**{k: [v] for k, v in zip(self.keys, key, strict=True)}, **{k: [v] for k, v in memory.items()}})

    def close(self) -> None:
        pass


def stream_fold(extractions: DataFrame, *keys: str, order: str) -> DataFrame:
    """fold_frames() of a stream: after each batch the new state of every project that had rows in it. Within a batch rows are merged
    by order; those that come in a later batch are merged later, as a queue would be. The session's state store must be ROCKSDB."""
    ship(extractions.sparkSession)
    rows = _prepared(extractions, keys, order)
    fold = MemoryFold(order)
    fold.keys = keys
    out = T.StructType([*(rows.schema[k] for k in keys), *T.StructType.fromDDL(STATE).fields])
    return rows.groupBy(*keys).transformWithStateInPandas(statefulProcessor=fold, outputStructType=out, outputMode="Update", timeMode="None")


def start_fold(extractions: DataFrame, *keys: str, order: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Fold what there is of a stream and stop. Each batch's states are a folder of their own, named by the batch: one that is run
    again after a crash replaces what it wrote. Another start on the same checkpoint goes on where this one ended."""

    def write(states: DataFrame, batch: int) -> None:
        states.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    spark = extractions.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)  # a query keeps the setting that it starts with
    try:
        query = stream_fold(extractions, *keys, order=order).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return query
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def latest_states(spark: SparkSession, folder: str, *keys: str) -> DataFrame:
    """The last state of every project that start_fold() wrote: keys and STATE."""
    rows = spark.read.parquet(folder)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct("project_summary", "topics", "preferences"), "batch").alias("s"))
    return last.select(*keys, "s.*")


def chat_history(turns: DataFrame) -> DataFrame:
    """Each turn with the texts of the turns before it in its conversation."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("history", F.collect_list(F.struct("role", "text")).over(w))
