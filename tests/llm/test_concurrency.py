"""The sweep against a plain count of what is open, and awkward rows."""

import datetime as dt
import random

import pytest

from spindrift.llm import concurrency
from spindrift.llm.concurrency import sweep

DDL = "g int, start_s long, end_s long, amount long, r string, piece int"


def plain(rows, total=None):
    out, changes = [], {}
    for g, start, end, amount, *_ in rows:
        if start is None or (end is not None and end <= start):
            continue
        for k in [-1 if g is None else g] + ([total] if total is not None else []):
            for t, sign in [(start, 1)] + ([(end, -1)] if end is not None else []):
                n, c = changes.setdefault(k, {}).get(t, (0, 0))
                changes[k][t] = (n + sign, c + sign * (amount or 0))
    for g, at in changes.items():
        n = c = high = 0
        rows = []
        moments = sorted(t for t, change in at.items() if change != (0, 0))
        for t, after in zip(moments, moments[1:] + [None], strict=True):
            n, c = n + at[t][0], c + at[t][1]
            high = n if not rows else max(high, n)
            rows.append((g, t, after, n, c, high))
        peak = max((r[4] for r in rows), default=0)
        out += [(*r, r[4] == peak) for r in rows]
    return sorted(out)


def made(seed, n, moments=2_000, groups=3):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        start = rnd.choice([None, *[rnd.randrange(-moments, moments) for _ in range(20)]])
        end = rnd.choice([None, 0 if start is None else start, (start or 0) - 5, *[(start or 0) + rnd.randrange(1, moments) for _ in range(8)]])
        g = rnd.choice([None, 0, 0, 0, *range(groups)])
        rows.append((g, start, end, rnd.choice([None, 0, -7, 250, 10**12]), "x", None))
    return rows + rows[: n // 10]


@pytest.mark.parametrize(("parts", "fan", "range_s"), [(1, 64, 86_400), (7, 2, 100), (16, 3, 17)])
def test_against_plain(spark, parts, fan, range_s):
    rows = made(parts, 400)
    got = sweep(spark.createDataFrame(rows, DDL).repartition(parts), total=-2, fan=fan, range_s=range_s)
    assert sorted(map(tuple, got.collect())) == plain(rows, -2)


def test_lets_go_of_what_it_holds(spark, monkeypatch):
    monkeypatch.setattr(concurrency, "GATHER", 50)
    monkeypatch.setattr(concurrency, "KEEP", 20)
    rows = made(5, 600)
    assert sorted(map(tuple, sweep(spark.createDataFrame(rows, DDL).repartition(3), fan=2, range_s=400).collect())) == plain(rows)


def test_what_cancels_out_leaves_no_row(spark):
    rows = [(0, 0, 60, 5, "", 0), (0, 60, 120, 5, "", 0)]
    assert [tuple(r) for r in sweep(spark.createDataFrame(rows, DDL)).orderBy("from_s").collect()] == [(0, 0, 120, 1, 5, 1, True), (0, 120, None, 0, 0, 1, False)]


def test_no_rows(spark):
    for rows in ([], [(1, None, 5, 1, "", 0)], [(1, 5, 5, 1, "", 0)]):
        assert sweep(spark.createDataFrame(rows, DDL), total=-2).collect() == []


def test_one_group_has_nearly_all(spark):
    rows = [(7, i % 1_440, i % 1_440 + 100, 1, "", 0) for i in range(20_000)] + [(1, 0, None, 3, "", 0)]
    assert sorted(map(tuple, sweep(spark.createDataFrame(rows, DDL).repartition(8), fan=2, range_s=60).collect())) == plain(rows)


def test_sales(spark):
    day = dt.datetime(2024, 1, 1)
    at = lambda m: day + dt.timedelta(minutes=m, seconds=59)
    sales = spark.createDataFrame(
        [(1, 1, 1.005, at(0), "a"), (1, 1, None, at(0), "b"), (2, 9, float("nan"), at(1), "c"), (3, None, 2.0, at(2), "d"), (None, 2, 3.0, at(3), "e"), (4, 2, 4.0, None, "f"), (5, 2, 5.0, at(20_000), "g")],
        "sale_id long, client_id long, total double, sold_at timestamp_ntz, g string",
    )
    lines = spark.createDataFrame([(1, at(10)), (1, at(5)), (1, None), (5, at(0)), (None, at(1))], "sale_id long, shipped_at timestamp_ntz")
    clients = spark.createDataFrame([(1, 4), (1, 3), (2, None), (None, 8)], "client_id long, nation_id int")
    zero = 1_704_067_200
    week = 7 * 86_400 + 300
    want = [(3, 0, week, 100), (3, 0, week, 0), (-1, 60, None, 0), (-1, 120, None, 200), (-1, 180, None, 300)]
    want = plain([(g, zero + a, b and zero + b, c) for g, a, b, c in want], -2)
    got = concurrency.sales_concurrency(sales, lines, clients, total=-2)
    assert sorted(map(tuple, got.collect())) == want
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert sorted(map(tuple, concurrency.sales_concurrency(sales, lines, clients, total=-2).collect())) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert concurrency.sales_concurrency(sales.limit(0), lines.limit(0), clients.limit(0)).collect() == []
