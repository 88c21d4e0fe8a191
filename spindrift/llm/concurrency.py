"""How many things are open at once, by adding step functions.

Every task turns whatever intervals it reads into a compact step function: what changes at each
moment, as sums. The function is cut by group and range of time, so a piece has no more points
than its range has moments, however many intervals it stands for. Pieces of one group and range
are added pairwise, as a tree, `fan` of them in one task at most about, in as many rounds as that
takes. What ranges hand on to each other (how much is open, the highest so far) is then scanned
over one short row for each range, and the ranges are stitched together.

No task holds a group's intervals, whatever the group's share: what it holds are points.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import drop, save
from spindrift.session import ship

RANGE_S = 86_400
FAN = 64
#: Events that a task gathers before it adds them up, and points from which it lets go of what it has.
GATHER, KEEP = 1 << 20, 1 << 19
PIECE = pa.schema([
    ("g", pa.int32()), ("r", pa.int64()), ("piece", pa.int64()), ("at", pa.list_(pa.int32())), ("dn", pa.list_(pa.int64())), ("dc", pa.list_(pa.int64())),
    ("first", pa.int64()), ("sum_n", pa.int64()), ("sum_c", pa.int64()), ("top_n", pa.int64()), ("top_c", pa.int64()),
])
PIECE_DDL = "g int, r long, piece long, at array<int>, dn array<long>, dc array<long>, first long, sum_n long, sum_c long, top_n long, top_c long"
STEPS_DDL = "g int, from_s long, to_s long, n_open long, open_sum long, high_open long, is_peak boolean"
#: Moments (group, second) and what changes there: in number and in amount.
Steps = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def utc_minutes(df: DataFrame, column: str) -> Column:
    """A timestamp column as UTC seconds since 1970, rounded down to whole minutes. One without a zone is read as UTC,
    whatever the session's zone."""
    c = F.col(column)
    if dict(df.dtypes)[column] == "timestamp_ntz":
        return F.unix_date(c.cast("date")).cast("long") * 86_400 + F.hour(c) * 3_600 + F.minute(c) * 60
    seconds = F.unix_seconds(c.cast("timestamp"))
    return seconds - F.pmod(seconds, F.lit(60))


def added(parts: Iterable[Steps]) -> Steps:
    """The sum of step functions; moments at which nothing changes fall out."""
    g, t, n, c = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((t, g))
    g, t, n, c = g[order], t[order], n[order], c[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (t[1:] != t[:-1])][: len(g)]
    at = np.flatnonzero(new)
    n, c = (np.add.reduceat(x, at) if len(at) else x for x in (n, c))
    live = (n != 0) | (c != 0)
    return g[at][live], t[at][live], n[live], c[live]


def tree(parts: list[Steps]) -> Steps:
    """Sum by pairs, pairs of pairs and so on."""
    while len(parts) > 1:
        parts = [added(parts[i : i + 2]) for i in range(0, len(parts), 2)]
    return parts[0]


def packed(f: Steps, range_s: int, piece: int) -> pa.RecordBatch:
    """One row for each group and range."""
    g, t, n, c = f
    if not len(g):
        return pa.RecordBatch.from_pylist([], schema=PIECE)
    r = t // range_s
    cut = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (r[1:] != r[:-1])])
    ends = np.r_[cut[1:], len(g)].astype(np.int64)
    offsets = pa.array(np.r_[cut, len(g)].astype(np.int32), pa.int32())
    run_n, run_c = np.cumsum(n), np.cumsum(c)
    before_n, before_c = run_n[cut] - n[cut], run_c[cut] - c[cut]
    top = [np.maximum.reduceat(x, cut) - b for x, b in ((run_n, before_n), (run_c, before_c))]
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in ((t - r * range_s).astype(np.int32), n, c)]
    numbers = [t[cut], run_n[ends - 1] - before_n, run_c[ends - 1] - before_c, *top]
    return pa.RecordBatch.from_arrays([pa.array(g[cut].astype(np.int32)), pa.array(r[cut]), pa.array(np.full(len(cut), piece)), *lists, *map(pa.array, numbers)], schema=PIECE)


def unpacked(rows: pa.Table | pa.RecordBatch, range_s: int) -> list[Steps]:
    """The step function of each row."""
    out = []
    for g, r, at, n, c in zip(*(rows[k] for k in ("g", "r", "at", "dn", "dc")), strict=True):
        t = at.values.to_numpy(zero_copy_only=False).astype(np.int64) + r.as_py() * range_s
        out.append((np.full(len(t), g.as_py(), np.int64), t, *(x.values.to_numpy(zero_copy_only=False).astype(np.int64) for x in (n, c))))
    return out


def pieces(intervals: DataFrame, range_s: int, total: int | None) -> DataFrame:
    """Compact step functions of whatever each task reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId(), [], 0
        for b in batches:
            g, start, end, amount = (x.to_numpy(zero_copy_only=False) for x in (b["g"], b["start_s"], b["end_s"].fill_null(0), b["amount"]))
            closes = b["end_s"].is_valid().to_numpy(zero_copy_only=False)
            one = np.ones(len(g), np.int64)
            f = (np.r_[g, g[closes]].astype(np.int64), np.r_[start, end[closes]].astype(np.int64), np.r_[one, -one[closes]], np.r_[amount, -amount[closes]].astype(np.int64))
            held.append(f)
            if total is not None:
                held.append((np.full(len(f[0]), total, np.int64), *f[1:]))
            size += sum(len(x[0]) for x in held[-2:])
            if size >= GATHER:
                held = [added(held)]
                size = len(held[0][0])
                if size >= KEEP:
                    yield packed(held[0], range_s, number)
                    held, size, number = [], 0, number + 1_000_003
        if held and len((f := added(held))[0]):
            yield packed(f, range_s, number)

    return intervals.mapInArrow(run, PIECE_DDL)


def merged(functions: DataFrame, range_s: int, fan: int) -> DataFrame:
    """One piece for each group and range: the sum of all. functions is a table of save(), read once for the number of rounds."""

    def add(rows: pa.Table) -> pa.Table:
        return pa.Table.from_batches([packed(tree(unpacked(rows, range_s)), range_s, rows["slot"][0].as_py())], schema=PIECE)

    most = functions.groupBy("g", "r").count().agg(F.max("count")).first()[0] or 1
    while most > 1:
        most = -(-most // fan)
        slots = functions.withColumn("slot", F.pmod("piece", F.lit(most)).cast("long"))
        functions = slots.groupBy("g", "r", "slot").applyInArrow(add, PIECE_DDL)
    return functions


def carries(functions: DataFrame) -> DataFrame:
    """For each group and range: what is open and the highest number before it, the highest amount of all, the next moment after it."""
    whole = Window.partitionBy("g")
    w = whole.orderBy("r")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    short = functions.select("g", "r", "first", "sum_n", "sum_c", "top_n", "top_c")
    opened = short.withColumns({f"carry_{k}": F.coalesce(F.sum(f"sum_{k}").over(before), F.lit(0)) for k in "nc"})
    return opened.select(
        "g", "r", "carry_n", "carry_c", F.lead("first").over(w).alias("next_first"),
        F.max(F.col("carry_n") + F.col("top_n")).over(before).alias("carry_high"),
        F.max(F.col("carry_c") + F.col("top_c")).over(whole.orderBy("r").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("peak"),
    )


def stitched(functions: DataFrame, range_s: int) -> DataFrame:
    """Rows of the step function of each group, in columns of STEPS_DDL."""
    names = ("g", "from_s", "to_s", "n_open", "open_sum", "high_open", "is_peak")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, (g, t, n, c) in enumerate(unpacked(b, range_s)):
                carry_n, carry_c, high, peak, after = (b[x][k].as_py() for x in ("carry_n", "carry_c", "carry_high", "peak", "next_first"))
                n_open, amount = carry_n + np.cumsum(n), carry_c + np.cumsum(c)
                highest = np.maximum.accumulate(n_open if high is None else np.maximum(n_open, high))
                to = pa.array([*t[1:].tolist(), after], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(t), to, pa.array(n_open), pa.array(amount), pa.array(highest), pa.array(amount == peak)], names=names)

    known = functions.select("g", "r", "at", "dn", "dc").join(carries(functions), ["g", "r"])
    return known.mapInArrow(run, STEPS_DDL)


def sweep(intervals: DataFrame, *, total: int | None = None, unknown: int = -1, range_s: int = RANGE_S, fan: int = FAN) -> DataFrame:
    """The step function of open intervals, for each group.

    intervals: columns g (int; null: `unknown`), start_s, end_s (seconds; the end is excluded, null is open for ever) and
    amount (long; null: 0); others are ignored. Rows without a start, or with an end not after it, take no part; repeated
    rows count each time. total: a further group that every row counts for too (added to rows that have it as their own).
    Result: g, from_s, to_s (null: for ever), n_open, open_sum, high_open (highest n_open so far), is_peak (open_sum is the
    group's highest); a row for each moment at which n_open or open_sum changes. No rows in, none out.
    """
    ship(intervals.sparkSession)
    clean = intervals.select(
        F.coalesce(F.col("g"), F.lit(unknown)).cast("int").alias("g"), F.col("start_s").cast("long"), F.col("end_s").cast("long"), F.coalesce(F.col("amount"), F.lit(0)).cast("long").alias("amount"),
    ).where("start_s IS NOT NULL AND (end_s IS NULL OR end_s > start_s)")
    first = save(pieces(clean, range_s, total))
    functions = save(merged(first, range_s, fan))
    drop(first)
    return stitched(functions, range_s)


def sales_concurrency(sales: DataFrame, sale_lines: DataFrame, clients: DataFrame, days: int = 7, **how) -> DataFrame:
    """sweep() of sales, open from sold_at to the earliest shipped_at of the sale's lines plus `days`, by the client's nation.

    A row of sales is a sale, also where it repeats a sale_id. Of clients that repeat an id the smallest nation counts; null
    ids match nothing. total is counted in cents, rounded half up; null, NaN and infinite ones count 0. Both look-ups are
    written as tables: a join of two plain scans is one that Spark can split where a third of the rows has one key.
    """
    cents = F.floor(F.lit(100) * F.col("total") + F.lit(0.5))
    finite = F.col("total").isNotNull() & ~F.isnan("total") & (F.abs("total") < 1e15)
    sold = sales.where("sold_at IS NOT NULL").select("sale_id", "client_id", utc_minutes(sales, "sold_at").alias("start_s"), F.when(finite, cents).otherwise(0).cast("long").alias("amount"))
    shipped = sale_lines.where("shipped_at IS NOT NULL AND sale_id IS NOT NULL").select("sale_id", (utc_minutes(sale_lines, "shipped_at") + days * 86_400).alias("end_s"))
    ends = save(shipped.groupBy("sale_id").agg(F.min("end_s").alias("end_s")))
    nations = save(clients.where("client_id IS NOT NULL AND nation_id IS NOT NULL").groupBy("client_id").agg(F.min("nation_id").alias("g")))
    out = sweep(sold.join(ends, "sale_id", "left").join(nations, "client_id", "left").select("g", "start_s", "end_s", "amount"), **how)
    drop(ends, nations)
    return out
