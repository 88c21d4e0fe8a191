"""Runs of repetition among a text's words, by Crochemore's partition refinement.

Positions of a text are in one class for a length if the stretches of that many words that start
there are equal. Classes of length 1 are those of equal words; from one length to the next a class
splits by the class of the position behind. Only positions before the smaller parts of what was
split last can split now, so a position is looked at again only when its class has halved: n log n
in all. Two neighbours in a class whose distance is the length make a square, and of neighbours the
root is never itself a repetition. Squares of one period at consecutive positions are one run.

Many texts are refined at once, each over classes of its own; numpy does a step for all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.session import ship

LEAST = 12
#: Words that are refined together; a longer text is refined by itself.
TOGETHER = 1 << 20
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS_DDL = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
RUNS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where the keys of sorted rows change."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for size[0] numbers, then those of first[1], and so on."""
    return np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())


class Refinement:
    """Classes of equal stretches and the neighbours in them, refined from length 1 upwards.

    The members of class c are members[first[c] : first[c] + size[c]], in no order; left and right are
    a member's neighbours by position, and since[i] the length from which i has its right neighbour.
    A position whose stretch would pass its text's end stays in its last class: it is behind all the
    others there, so it parts no neighbours, and what it seems to be neighbour to is not reported.
    """

    def __init__(self, word: np.ndarray, begin: np.ndarray, end: np.ndarray):
        n = len(word)
        self.begin, self.end = begin, end
        self.members = np.argsort(word, kind="stable").astype(np.int32)
        w = word[self.members]
        head = _starts(w)
        self.n_classes = len(head)
        self.first, self.size = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.first[: len(head)], self.size[: len(head)] = head, np.diff(np.r_[head, n])
        self.of, self.place = np.empty(n, np.int32), np.empty(n, np.int32)
        self.of[self.members] = np.repeat(np.arange(len(head)), self.size[: len(head)])
        self.place[self.members] = np.arange(n)
        self.left, self.right = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        same = w[1:] == w[:-1]
        a, b = self.members[:-1][same], self.members[1:][same]
        self.right[a], self.left[b] = b, a
        self.since, self.moving = np.ones(n, np.int32), np.zeros(n, bool)
        self.squares: list[tuple[np.ndarray, np.ndarray]] = []

    def part(self, x: np.ndarray, k: int) -> None:
        """x and their right neighbours are neighbours up to length k: those whose distance is one of the lengths are squares."""
        y = self.right[x].astype(np.int64)
        d = y - x
        ok = (self.since[x] <= d) & (d <= k) & (y + d <= self.end[x])
        self.squares.append((x[ok].astype(np.int64), d[ok]))

    def step(self, small: np.ndarray, k: int) -> np.ndarray:
        """From length k to k + 1. small: the positions of all parts but the largest of each class that the last step split.
        Returns the like for the next step."""
        at, of, size = small - 1, self.of, self.size
        live = (small > self.begin[small]) & (size[of[at]] > 1) & (small + k <= self.end[small]) & (2 * (k + 1) <= self.end[small] - self.begin[small])
        at = np.sort(at[live])
        if not len(at):
            return at
        a, b = of[at], of[at + 1]
        by_class, by_part = np.argsort(a, kind="stable"), np.lexsort((b, a))
        a, b = a[by_part], b[by_part]
        part = _starts(a, b)
        n_part = np.diff(np.r_[part, len(at)])
        owner = a[part]
        one = _starts(owner)
        split = owner[one]
        nth = np.repeat(np.arange(len(one)), np.diff(np.r_[one, len(part)]))
        rest, most = size[split] - np.add.reduceat(n_part, one), np.maximum.reduceat(n_part, one)
        largest = np.zeros(len(part), bool)  # the first of the largest parts of each class
        top = np.flatnonzero(n_part == most[nth])
        largest[top[_starts(nth[top])]] = True
        stays = largest & (rest == 0)[nth]  # nothing else is left in its class
        if stays.all():
            return at[:0]
        moved = at[by_part][np.repeat(~stays, n_part)]
        n_moved = n_part[~stays]
        self.moving[moved] = True
        in_order = at[by_class]
        in_order = in_order[self.moving[in_order]]
        self._relink(moved, n_moved, in_order, k)
        # members that stay take the places of those that go; the class's last places are the new classes
        out = np.add.reduceat(np.where(stays, 0, n_part), one)
        tail_at = self.first[split] + size[split] - out
        tail = _ranges(tail_at, out)
        kept = self.members[tail]
        kept = kept[~self.moving[kept]]
        holes = self.place[in_order]
        holes = holes[holes < np.repeat(tail_at, out)]
        self.members[holes], self.place[kept] = kept, holes
        self.members[tail], self.place[moved] = moved, tail
        size[split] -= out
        new = np.arange(self.n_classes, self.n_classes + len(n_moved))
        self.first[new], size[new] = tail[np.r_[0, np.cumsum(n_moved)[:-1]]], n_moved
        of[moved] = np.repeat(new, n_moved)
        self.n_classes += len(new)
        self.moving[moved] = False
        beaten = (rest > 0) & (most > rest)  # what is left of the class is not its largest part
        again = np.repeat(~(largest & beaten[nth])[~stays], n_moved)
        left = split[beaten]
        return np.r_[moved[again], self.members[_ranges(self.first[left], size[left])]]

    def _relink(self, moved: np.ndarray, n_moved: np.ndarray, in_order: np.ndarray, k: int) -> None:
        """moved, part by part, leave the lists of their classes for lists of their own. in_order: the same, by class and position."""
        linked = self.right[in_order[:-1]] == in_order[1:]
        before, after = self.left[in_order[np.r_[True, ~linked]]], self.right[in_order[np.r_[~linked, True]]]
        inner = np.ones(len(moved), bool)
        inner[np.cumsum(n_moved) - 1] = False
        right = np.where(inner, np.r_[moved[1:], -1], -1)
        left = np.r_[-1, np.where(inner, moved, -1)[:-1]]
        other = self.right[moved] != right
        has = before >= 0
        self.part(moved[other & (self.right[moved] >= 0)], k)
        self.part(before[has], k)
        self.right[moved], self.left[moved] = right, left
        self.since[moved[other]] = k + 1
        self.right[before[has]], self.since[before[has]] = after[has], k + 1
        has = after >= 0
        self.left[after[has]] = before[has]

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """All squares with a root that is no repetition: position and period."""
        small, k = np.arange(len(self.of)), 1
        while len(small):
            small = self.step(small, k)
            k += 1
        self.part(np.flatnonzero(self.right >= 0), len(self.of))
        return tuple(np.concatenate(x) for x in zip(*self.squares, strict=True))


def runs(word: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(start, length, period) of the runs of at least `least` words, by start, then period.

    word: a number for each word, equal for equal words of one text and for no others; begin and end: of each position's text.
    """
    none = (np.zeros(0, np.int64),) * 3
    at, period = Refinement(word, begin, end).run() if len(word) else none[:2]
    if not len(at):
        return none
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    first = _starts(period, at - np.arange(len(at)))
    last = np.r_[first[1:], len(at)].astype(np.int64) - 1
    start, length, period = at[first], at[last] - at[first] + 2 * period[first], period[first]
    order = np.lexsort((period, start))
    order = order[length[order] >= least]
    return start[order], length[order], period[order]


def _batch(ids: list, texts: list[list[bytes]], least: int) -> pa.RecordBatch:
    n = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(n)
    word = []
    for text in texts:
        seen: dict[bytes, int] = {}
        word += [seen.setdefault(w, len(seen)) for w in text]
    begin, end = (np.repeat(x, n).astype(np.int32) for x in (ends - n, ends))
    start, length, period = runs(np.array(word, np.int64) + begin, begin, end, least)
    change = np.zeros(len(word) + 1, np.int32)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    gone = np.cumsum(change)[:-1] > 0
    collapsed = []
    for text, a, b in zip(texts, (ends - n).tolist(), ends.tolist(), strict=True):
        g = gone[a:b]
        collapsed.append(b" ".join([w for w, x in zip(text, g.tolist(), strict=True) if not x] if g.any() else text).decode())
    offsets = np.searchsorted(start, np.r_[ends - n, ends[-1:]]).astype(np.int32)
    own = np.repeat(ends - n, np.diff(offsets))
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(start - own), pa.array(length), pa.array(period)], fields=list(RUN)))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), lists, pa.array(collapsed, pa.string())], schema=RUNS)


def find_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row of docs; other columns are not read.

    runs: (start, length, period) in words, by start, then period; collapsed: the words joined by a space, without those that
    any run has after its first period. Words are what stands between spaces, tabs, line ends, form feeds and vertical tabs.
    Null and blank texts have no words and no runs; rows that repeat give results that repeat, null doc_ids stay null.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for b in batches:
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
                ids.append(doc_id)
                texts.append(text.as_buffer().to_pybytes().split() if text.is_valid else [])
                size += len(texts[-1])
                if size >= TOGETHER or len(ids) >= TOGETHER:
                    yield _batch(ids, texts, least)
                    ids, texts, size = [], [], 0
        if ids:
            yield _batch(ids, texts, least)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, RUNS_DDL)


def stuttered(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of every document with h % 10 = 0, for h the CRC32 of its doc_id as text and g = h div 10, the n words
    from a = g % n on repeat the first 1 + (n - a) div (3 + g % 8) of them. Other texts, and those of null ids, stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, text = F.floor(h / 10), F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, "[ \\t\\n\\u000B\\f\\r]+"), lambda w: w != "")

    def tail(w):
        n = F.size(w)
        a = F.pmod(g, n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        again = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.concat_ws(" ", F.slice(w, F.lit(1), a), F.slice(again, F.lit(1), n - a)))

    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(F.transform(F.array(words), tail)[0], text)).otherwise(text).alias("text"))


def run_digests(docs: DataFrame) -> DataFrame:
    """Of each document: the number of runs, the longest one, and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("at"), (-r["period"]).alias("p"))))
    told = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    found = find_runs(docs).select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), told.alias("told"), "collapsed")
    length, period = F.col("best.length"), -F.col("best.p")
    return found.select(
        "doc_id", "n_runs", (-F.col("best.at")).alias("start"), length.alias("length"), period.alias("period"),
        F.expr("best.length * 1000 div -best.p").alias("exponent_milli"), F.sha2(F.col("told").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
