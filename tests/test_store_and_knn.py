"""Lookups that skip files, tables as they are stored, and the tiled kNN join."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift import schemas
from spindrift.operators import hybrid, topk
from spindrift.operators.store import Store
from spindrift.schemas import IndexStatus


def items(spark, n):
    ids = spark.range(n)
    return ids.select(
        F.format_string("f%05d", "id").alias("file_path"), F.concat(F.lit("S"), (F.col("id") * 7919 % n).cast("string")).alias("symbol"), F.lit("function").alias("kind"),
        F.lit(1).alias("start_line"), F.lit(3).alias("end_line"), F.repeat(F.lit("x"), 50).alias("content"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"),
    )


def test_a_symbol_lookup_skips_files(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.save(items(spark, 20_000).repartition(4), "r", "h")
    found = hybrid.find_by_symbols(store.items(), ["pkg.S17", "S99", "absent"], 5)
    assert [r.symbol for r in found.collect()] == ["S17", "S99"]
    plan = found._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[[^\]]*In\(symbol, \[S17,S99,absent\]\)", plan)
    # each file holds a range of symbols of its own
    ranges = store.items().groupBy(F.input_file_name()).agg(F.min("symbol").alias("a"), F.max("symbol").alias("z")).orderBy("a").collect()
    assert len(ranges) > 1 and all(x.z < y.a for x, y in zip(ranges, ranges[1:], strict=False))


def test_open_and_look(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.columns("items") == {} and not store.has_column("meta", "version")
    for _ in range(2):
        store.open()
    assert store.read("memory").count() == 1 and store.memory() == {"project_summary": "", "topics": [], "preferences": []}
    assert store.status("h") == IndexStatus.MISSING
    with pytest.raises(LookupError):
        store.items()
    assert set(store.TABLES) == {p.name for p in (tmp_path / "s").iterdir()}
    for name, ddl in store.TABLES.items():
        assert list(store.columns(name)) == [c.split()[0] for c in re.split(r", (?![^<]*>)", ddl)]
    assert store.has_column("meta", "version") and not store.has_column("meta", "odd")
    store.commit_memory({"project_summary": "s", "topics": ["t"], "preferences": []}, ["1"])
    store.open()
    assert store.memory()["topics"] == ["t"] and schemas.ITEMS


@pytest.mark.parametrize(("n", "q", "dims", "k", "tile"), [(500, 40, 8, 5, 4_000), (300, 7, 700, 3, 10_000), (90, 90, 2, 100, 2_000), (1, 1, 3, 4, 8)])
def test_best_in_tiles(monkeypatch, n, q, dims, k, tile):
    monkeypatch.setattr(topk, "TILE_BYTES", tile)
    rng = np.random.default_rng(n)
    x = rng.integers(-2, 3, (n, dims)).astype(float)  # many ties
    queries = rng.normal(size=(q, dims))
    queries[0] = 0
    ids = rng.permutation(n) * 3
    best = topk.Best(q, k)
    for a in range(0, n, 64):
        best.see(queries, x[a : a + 64], ids[a : a + 64])
    unit = x / np.where((norm := np.linalg.norm(x, axis=1, keepdims=True)) > 0, norm, 1)
    row, item, score = best.rows()
    for i in range(q):
        s = queries[i] @ unit.T
        got = dict(zip(item[row == i].tolist(), score[row == i].tolist(), strict=True))
        assert len(got) == min(k, n)
        want = np.sort(s)[::-1][: min(k, n)]
        assert np.allclose(sorted(got.values(), reverse=True), want)
    first = sorted(item[row == 0].tolist())
    assert first == sorted(ids.tolist())[: min(k, n)]  # all tie: the smallest ids
    assert best.most <= max(tile // 8 + tile // 8, 2 * k + 2)  # whatever the dimensions


def test_blocks_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(120)]
    frame = spark.createDataFrame(rows, "item_id long, embedding array<double>").repartition(3)
    queries = frame.where("item_id % 4 = 0").withColumnRenamed("item_id", "query_id")
    ask = lambda: sorted((r.query_id, r.rank, r.item_id) for r in topk.knn_join(frame, queries, 4).collect())
    whole = ask()
    monkeypatch.setattr(topk, "MAX_QUERY_BYTES", 500)
    assert ask() == whole and len(whole) == 30 * 4
    assert all(q == i for q, rank, i in whole if rank == 1)
