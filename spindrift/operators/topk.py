"""Exact similarity search over stored vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import vector as vec
from spindrift.session import ship

OVERSAMPLE, LAMBDA = 4, 0.85


def scored(items: DataFrame, query: list[float], embedding: str = "embedding") -> DataFrame:
    """items with score: the dot product of normalised vectors."""
    n = float(np.linalg.norm(query)) or 1.0
    q = F.array(*(F.lit(float(x) / n) for x in query))
    return items.withColumn("score", vec.dot(vec.normalize(vec.as_double(F.col(embedding))), q))


def top_k(scored_rows: DataFrame, k: int, *order: str) -> DataFrame:
    """The k rows of highest score; ties in the order of the given columns. Takes k rows from
    each partition and merges them: no full sort."""
    if k < 1:
        return scored_rows.limit(0)
    return scored_rows.orderBy(F.desc("score"), *order).limit(k)


#: Bytes of query vectors, and of what is kept for each, that a task may hold; bytes of scores that it works on at once.
MAX_QUERY_BYTES, TILE_BYTES = 64 << 20, 16 << 20


def knn_join(items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, item_id, score, rank): the k items of highest score for every query.

    items (item_id, embedding), queries (query_id, embedding). Items stay where they are: each task
    multiplies tiles of items with tiles of queries and keeps k per query, so the shuffle carries k rows for each query and task,
    whatever the number of items, and a task's memory doesn't grow with queries, items or dimensions. The queries are broadcast
    in blocks of at most MAX_QUERY_BYTES, so any number of them can be asked. Ties go to the smaller item_id.
    """
    ship(items.sparkSession)
    sc = items.sparkSession.sparkContext
    out = None
    for ids, matrix in _query_blocks(queries, k):
        shared = sc.broadcast((ids, matrix))

        def run(batches, shared=shared):
            ids, q = shared.value
            best = Best(len(ids), k)
            for b in batches:
                if len(b):
                    best.see(q, np.stack(b["embedding"].to_numpy()).astype(np.float64), b["item_id"].to_numpy())
            rows, item, score = best.rows()
            if len(rows):
                yield pd.DataFrame({"query_id": ids[rows], "item_id": item, "score": score})

        part = items.select("item_id", vec.as_double(F.col("embedding")).alias("embedding")).mapInPandas(run, "query_id long, item_id long, score double")
        out = part if out is None else out.union(part)
    if out is None:
        out = items.sparkSession.createDataFrame([], "query_id long, item_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class Best:
    """The k best items so far of each of n queries."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.item = k, np.full((n, k), -np.inf), np.zeros((n, k), np.int64)
        self.most = 0  # numbers of the largest tile of scores

    def see(self, queries: np.ndarray, items: np.ndarray, ids: np.ndarray) -> None:
        """Score items (rows of vectors) against all queries, a tile of TILE_BYTES at a time."""
        size = TILE_BYTES // 8
        wide = max(1, min(len(ids), int(size**0.5)))
        high = max(1, size // (wide + self.k))
        for a in range(0, len(ids), wide):
            x = items[a : a + wide]
            norms = np.linalg.norm(x, axis=1, keepdims=True)
            x = x / np.where(norms > 0, norms, 1)
            for b in range(0, len(queries), high):
                self._keep(slice(b, b + high), queries[b : b + high] @ x.T, ids[a : a + wide])

    def _keep(self, at: slice, scores: np.ndarray, ids: np.ndarray) -> None:
        s = np.hstack([self.score[at], scores])
        i = np.hstack([self.item[at], np.broadcast_to(ids, scores.shape)])
        self.most = max(self.most, s.size)
        bound = np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
        row, col = np.nonzero(s >= bound[:, None])  # k of each row, and what ties with the last
        s, i = s[row, col], i[row, col]
        order = np.lexsort((i, -s, row))
        place = np.arange(len(order)) - np.searchsorted(row, row)
        first = order[place < self.k]
        self.score[at], self.item[at] = s[first].reshape(-1, self.k), i[first].reshape(-1, self.k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the query, item, score) of all that was kept."""
        row, col = np.nonzero(np.isfinite(self.score))
        return row, self.item[row, col], self.score[row, col]


def _query_blocks(queries: DataFrame, k: int):
    ids, rows, size = [], [], 0
    for r in queries.select("query_id", vec.normalize(vec.as_double(F.col("embedding"))).alias("e")).toLocalIterator():
        ids.append(r.query_id)
        rows.append(r.e)
        size += 8 * len(r.e) + 16 * k
        if size >= MAX_QUERY_BYTES:
            yield np.array(ids), np.array(rows)
            ids, rows, size = [], [], 0
    if ids:
        yield np.array(ids), np.array(rows)


def mmr(candidates: list[dict], k: int, lam: float, similarity: Callable[[dict, dict], float]) -> list[dict]:
    """Up to k greedy picks of the most lam * score + (1 - lam) * (1 - similarity to the picks); the
    similarity counts as 0 at least; the first of equals wins. candidates: dicts with score, in order."""
    rest, out = list(candidates), []
    nearest = [0.0] * len(rest)
    while rest and len(out) < k:
        values = [lam * c["score"] + (1 - lam) * (1 - m) for c, m in zip(rest, nearest, strict=True)]
        i = values.index(max(values))
        pick = rest.pop(i)
        nearest.pop(i)
        out.append(pick)
        nearest = [max(m, similarity(c, pick)) for c, m in zip(rest, nearest, strict=True)]
    return out


def search(items: DataFrame, query: list[float], k: int, use_mmr: bool = False, order: tuple = ("file_path", "start_line"), lam: float = LAMBDA) -> DataFrame:
    """The k best items; with use_mmr, picked for variety among OVERSAMPLE * k of them."""
    if k < 1:
        raise ValueError("k must be positive")
    rows = scored(items, query)
    if not use_mmr:
        return top_k(rows, k, *order)
    top = top_k(rows, k * OVERSAMPLE, *order)
    got = [r.asDict() for r in top.collect()]  # OVERSAMPLE * k rows at most
    for r in got:
        v = np.array(r["embedding"], float)
        r["_v"] = v / (np.linalg.norm(v) or 1.0)
    picks = mmr(got, k, lam, lambda a, b: float(a["_v"] @ b["_v"]))
    rows = [tuple(p[c] for c in top.columns) for p in picks]
    return items.sparkSession.createDataFrame(rows, top.schema)


def join_chunks(rows: DataFrame, text: str, *order: str) -> DataFrame:
    """One row, output: the results in order as text. For a result list of k rows."""
    ranked = rows.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("score"), *order)))
    line = F.concat(F.lit("\n["), F.col("_r").cast("string"), F.lit("] (score: "), F.format_string("%.3f", F.col("score").cast("double")), F.lit(")\n"), F.col(text), F.lit("\n\n---\n"))
    parts = ranked.agg(F.array_sort(F.collect_list(F.struct("_r", line.alias("l")))).alias("p"))
    return parts.select(F.array_join(F.transform("p", lambda s: s["l"]), "").alias("output"))
