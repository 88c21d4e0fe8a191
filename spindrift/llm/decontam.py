"""Benchmark decontamination: prefix-filtered set join with exact verification.

Every benchmark item becomes windows of WINDOW words. A document contains a window
only if it contains the window's rarest word, so that word alone is the necessary
prefix of the join (the overlap asked for is the whole window). Words are ordered by
how often they occur in the corpus. Positions and lengths bound where a window can
lie, and the words at that place are then compared exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import doc_bytes, drop, map_rows, save

WINDOW = 10
#: Bytes of benchmark text that one broadcast may hold; a larger benchmark is cut into
#: parts of this size, and each part meets the documents in turn.
PART_BYTES = 16 << 20
_DELIMITERS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_FOLD = bytes.maketrans(
    bytes(range(0x41, 0x5B)) + _DELIMITERS, bytes(range(0x61, 0x7B)) + b" " * len(_DELIMITERS)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def windows_of(text: bytes, width: int = WINDOW) -> list[tuple]:
    w = words_of(text)
    if len(w) <= width:
        return [tuple(w)] if w else []
    return [tuple(w[i : i + width]) for i in range(len(w) - width + 1)]


def _clean(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("item_id is not null and text is not null").select("item_id", F.col("text").cast("binary").alias("text")).distinct()


def _parts(benchmark: DataFrame, part_bytes: int) -> Iterator[list[tuple[int, bytes]]]:
    """Parts of the benchmark as lists of (item_id, text), each of at most part_bytes, or one item; one part at a time is held."""
    part, size = [], 0
    for r in _clean(benchmark).toLocalIterator():
        if part and size + len(r.text) > part_bytes:
            yield part
            part, size = [], 0
        part.append((r.item_id, bytes(r.text)))
        size += len(r.text)
    yield part


def indexes(docs: DataFrame, benchmark: DataFrame, part_bytes: int) -> Iterator[Index]:
    """An index for each part of the benchmark. The corpus is counted once, for all parts."""
    size = _clean(benchmark).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counts = _count_table(docs, benchmark) if size > part_bytes else None
    for part in _parts(benchmark, part_bytes):
        vocabulary = {w for _, text in part for w in words_of(text)}
        yield Index(part, _counts_of(counts, vocabulary) if counts is not None else word_counts(docs, vocabulary) if part else {})
    if counts is not None:
        drop(counts)


def _count_table(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(word, n): occurrences in all documents of the words of a benchmark of any size, as a table."""

    def distinct(rows):
        for _, text in rows:
            yield from ((w,) for w in set(words_of(text)))

    def count(rows):
        found: Counter = Counter()
        for _, text in rows:
            found.update(words_of(text))
            if len(found) > 1 << 18:
                yield from found.items()
                found.clear()
        yield from found.items()

    words = map_rows(_clean(benchmark), "word binary", distinct).distinct()
    counted = map_rows(doc_bytes(docs), "word binary, n long", count).groupBy("word").agg(F.sum("n").alias("n"))
    return save(counted.join(words, "word"))


def _counts_of(table: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """The rows of a part's words: no more than the part has."""
    words = table.sparkSession.createDataFrame(((w,) for w in vocabulary), "word binary")
    return {bytes(r.word): r.n for r in table.join(words, "word", "left_semi").collect()}


def word_counts(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Occurrences in all documents of the words of a (bounded) vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(rows):
        known, found = shared.value, Counter()
        for _, text in rows:
            found.update(filter(known.__contains__, words_of(text)))
        yield from found.items()

    counted = map_rows(doc_bytes(docs), "word binary, n long", run).groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in counted.collect()}  # at most one row for each word of the vocabulary


class Index:
    """Windows of a part of the benchmark by their rarest words, in arrays.

    words: all the part's words as numbers; a window is `size` words from `start`. Prefix word w has the windows
    from first[w] to first[w + 1]: in each it is at `offset`. The items of window k are item[owner[k] : owner[k + 1]].
    """

    def __init__(self, part: list[tuple[int, bytes]], counts: dict[bytes, int], width: int = WINDOW):
        """width: at most 255."""
        number: dict[bytes, int] = {}
        lens, ids = [], []
        for _, text in part:
            w = words_of(text)
            lens.append(len(w))
            ids.append(np.array([number.setdefault(x, len(number)) for x in w], np.int32))
        words = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        lens = np.array(lens, np.int64)
        n = np.where(lens > width, lens - width + 1, np.minimum(lens, 1))  # windows of each item
        begin = np.cumsum(lens) - lens
        start = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        size = np.repeat(np.minimum(lens, width), n)
        item = np.repeat(np.array([i for i, _ in part], np.int64), n)
        # equal windows are one, whatever items they are of
        order, new = self._same(words, start, size, item, width)
        start, size, item = start[order], size[order], item[order]
        window = np.cumsum(new) - 1
        once = np.r_[True, (window[1:] != window[:-1]) | (item[1:] != item[:-1])][: len(item)]
        self.item, window = item[once], window[once]
        start, size = start[new], size[new]
        self.owner = np.r_[np.searchsorted(window, np.arange(len(start))), len(window)].astype(np.int32)
        # words by rarity in the corpus, then by themselves
        rank = np.empty(len(number), np.int64)
        rank[[number[w] for w in sorted(number, key=lambda w: (counts.get(w, 0), w))]] = np.arange(len(number))
        best, offset = np.full(len(start), len(number), np.int64), np.zeros(len(start), np.int64)
        for k in range(width):
            has = np.flatnonzero(size > k)
            r = rank[words[start[has] + k]]
            less = r < best[has]
            best[has[less]], offset[has[less]] = r[less], k
        prefix = words[start + offset] if len(start) else np.zeros(0, np.int32)
        # a word that the corpus lacks leads to no document
        seen = np.array([counts.get(w, 0) > 0 for w in number], bool)
        by = np.argsort(prefix, kind="stable")
        by = by[seen[prefix[by]]]
        self.words, self.number = words.tobytes(), number
        self.start, self.window = start[by].astype(np.int32), by.astype(np.int32)
        self.size, self.offset = size[by].astype(np.uint8), offset[by].astype(np.uint8)
        self.first = np.searchsorted(prefix[by], np.arange(len(number) + 1)).astype(np.int32)

    @staticmethod
    def _same(words: np.ndarray, start: np.ndarray, size: np.ndarray, item: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """An order in which equal windows follow each other, by item, and whether each is another than the one before."""
        mixed = size.astype(np.uint64)
        for k in range(width):
            has = size > k
            mixed[has] = (mixed[has] ^ words[start[has] + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        order = np.lexsort((item, mixed))
        s, z = start[order], size[order]
        new = np.ones(len(order), bool)
        new[1:] = (mixed[order][1:] != mixed[order][:-1]) | (z[1:] != z[:-1])
        for k in range(width):  # windows with one hash are compared word by word
            at = np.flatnonzero(~new)
            at = at[z[at] > k]
            new[at[words[s[at] + k] != words[s[at - 1] + k]]] = True
        return order, new


def find_hits(words: list[bytes], index: Index) -> tuple[bytearray, set]:
    """Which words lie in an occurrence of a window, and the items with one."""
    hit, found = bytearray(len(words)), set()
    get = index.number.get
    own = np.array([get(w, -1) for w in words], np.int32)
    if len(own) and own.max() >= 0:
        at = np.flatnonzero(own >= 0)
        at = at[index.first[own[at]] < index.first[own[at] + 1]]
        text = own.tobytes()
        for i, first, last in zip(at.tolist(), index.first[own[at]].tolist(), index.first[own[at] + 1].tolist(), strict=True):
            for start, size, offset, window in zip(*(x[first:last].tolist() for x in (index.start, index.size, index.offset, index.window)), strict=True):
                a = i - offset
                z = 4 * (a + size)
                if a >= 0 and z <= len(text) and text[4 * a : z] == index.words[4 * start : 4 * (start + size)]:
                    hit[a : a + size] = b"\x01" * size
                    found.update(index.item[index.owner[window] : index.owner[window + 1]].tolist())
    return hit, found


SCHEMA = "row long, doc_id long, n_words long, n_hit long, hit binary, items array<long>"


def hits(docs: DataFrame, benchmark: DataFrame, part_bytes: int = PART_BYTES) -> list[DataFrame]:
    """For each part of the benchmark, a row per row of docs: row (its number, the same in all parts), doc_id, n_words, n_hit, hit (a byte
    for each word, 1 if hit; empty if none is or if there is but one part), items (ids with an
    occurring window)."""
    out = []
    rows = doc_bytes(docs).withColumn("row", F.monotonically_increasing_id())
    several = (_clean(benchmark).agg(F.sum(F.octet_length("text"))).first()[0] or 0) > part_bytes
    if several:  # written once: read again, rows could come in another order and be numbered anew
        rows = save(rows)
    for index in indexes(docs, benchmark, part_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(rows, shared=shared):
            index = shared.value
            for row, doc_id, text in rows:
                words = words_of(text)
                hit, found = find_hits(words, index)
                yield row, doc_id, len(words), sum(hit), bytes(hit) if found and several else b"", sorted(found)

        out.append(map_rows(rows.select("row", "doc_id", "text"), SCHEMA, run))
    return out


def decontamination_report(docs: DataFrame, benchmark: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null or empty text has no words. Benchmark rows with null text or item_id are passed
    over, repeated ones count once. Rows that share a doc_id are judged each for itself.
    """
    found = hits(docs, benchmark, part_bytes)
    flat = found[0] if len(found) == 1 else _merge(found)
    listed = F.sort_array(F.transform(F.col("items"), lambda x: x.cast("string")))
    return flat.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def _merge(found: list[DataFrame]) -> DataFrame:
    """Hits of several parts, row by row and word by word; only rows with hits send more than their counts."""
    union = found[0]
    for f in found[1:]:
        union = union.union(f)
    counts = union.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"))
    word = union.where("length(hit) > 0").select("row", F.posexplode(F.split(F.decode("hit", "ISO-8859-1"), "")))
    n_hit = word.where(F.col("col") == "\x01").distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    items = union.where("size(items) > 0").select("row", F.explode("items").alias("item")).groupBy("row").agg(F.collect_set("item").alias("items"))
    return counts.join(n_hit, "row", "left").join(items, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<long>")).alias("items")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """docs without those that contain a window of any benchmark item. Columns and other
    rows are untouched; rows with a null doc_id or text stay, repeated rows stay or go together. Without items all rows stay."""
    at, out = docs.columns.index("text"), docs
    for index in indexes(docs, benchmark, part_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            index = shared.value
            for b in batches:
                clean = [t is None or not find_hits(words_of(t.encode()), index)[1] for t in b.column(at).to_pylist()]
                yield b.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
