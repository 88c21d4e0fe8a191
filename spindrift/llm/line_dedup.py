"""Fuzzy line deduplication by MinHash.

Equal lines are one by their digest. Signatures are minima of multiplicatively permuted
hashes of all SHINGLE-character shingles, BANDS bands of ROWS minima each, and two bits of every
minimum beside them. Lines that share a band are candidates if at least BANDS * ROWS - MOST of the
minima agree in those bits (two lines at SIMILARITY fail that about once in 700 times).
Band rows are packed in blobs by ranges of the band's hash. A band of at most SMALL lines is
compared pair by pair there. The lines of a larger one are only linked to leaders, in the task that
reads them already, so that no band is one task's work; and it stays open: once the links are verified and joined, what is not one
component in an open band is compared in full, in cells of two blocks of lines. So any two lines that
share a band and agree as above are linked in the end if they are near. What is verified is the exact Jaccard
similarity of all SHINGLE-character shingles (as sets of 64-bit hashes). Links go through distributed
union-find, and of every component the first line (by doc_id and place) stays.

Signatures, bands and verification are Arrow batches with numpy: the form of DataFrame
functions alone cost more CPU than is allowed (see README). Joins and union-find are
DataFrame operations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import drop, map_rows, release, save
from spindrift.llm.components import connected_components
from spindrift.session import ship

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 8, 4
#: Characters hashed at a time; longer lines are cut into overlapping pieces.
BLOCK = 1 << 16
#: Of the BANDS * ROWS minima, as many may differ in the bits that are compared.
MOST = 10
#: Lines that a task looks at together for their bands, and bytes of band rows in a bucket.
BLOCK_LINES, BUCKET_BYTES = 1 << 17, 16 << 20
#: The largest band that is compared pair by pair at once, and how often others look for leaders.
SMALL, LEADERS = 32, 8
#: Lines in a block of a band that is compared in full; a line counts once more for every WEIGHT characters.
CELL, WEIGHT = 1024, 4096
_TEXT = re.compile(r"\S", re.ASCII)


def _odd(n: int, seed: int, kind: type) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, np.iinfo(kind).max, n, dtype=kind) | kind(1)


_POWERS, _PERMUTE, _MIX = _odd(SHINGLE, 1, np.uint64), _odd(BANDS * ROWS, 2, np.uint32), _odd(ROWS + 1, 3, np.uint64)


def _hashes(text: str) -> np.ndarray:
    """64-bit hashes of the shingles at all places of a text of SHINGLE or more characters."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(c) - SHINGLE + 1
    if n < 1024:  # fewer calls
        h = np.correlate(c, _POWERS, "valid")
    else:
        h = c[:n] * _POWERS[0]
        for j in range(1, SHINGLE):
            h += c[j : j + n] * _POWERS[j]
    h ^= h >> np.uint64(29)
    h *= _MIX[0]
    return h


def _minima(pieces: list[str]) -> np.ndarray:
    """One row of BANDS * ROWS minima for each piece, of SHINGLE or more characters each."""
    h = (_hashes("".join(pieces)) >> np.uint64(32)).astype(np.uint32)
    n = len(h)
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    end = np.cumsum(size)
    within = np.ones(n + SHINGLE, bool)
    for j in range(1, SHINGLE):  # shingles that would run over the end of a piece
        within[end - j] = False
    h = h[within[:n]]
    starts = np.concatenate(([0], np.cumsum(size - SHINGLE + 1)[:-1]))
    return np.stack([np.minimum.reduceat(h * a, starts) for a in _PERMUTE], axis=1)


def minima_of(lines: list[str]) -> np.ndarray:
    """len(lines) x (BANDS * ROWS) minima. Lines of fewer than SHINGLE characters must not be among them."""
    out, pieces, first, held = [], [], [], 0

    def flush() -> None:
        if pieces:
            out.append(np.minimum.reduceat(_minima(pieces), np.array(first), axis=0))

    step = BLOCK - SHINGLE + 1
    for line in lines:
        if len(line) > BLOCK:
            flush()
            pieces, first, held = [], [], 0
            at = None  # the minima over the pieces
            for i in range(0, len(line) - SHINGLE + 1, step):
                m = _minima([line[i : i + BLOCK]])
                at = m if at is None else np.minimum(at, m)
            out.append(at)
            continue
        first.append(len(pieces))
        pieces.append(line)
        held += len(line)
        if held >= BLOCK:
            flush()
            pieces, first, held = [], [], 0
    flush()
    return np.concatenate(out) if out else np.zeros((0, BANDS * ROWS), np.uint32)


def _banded(minima: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each row of minima and band."""
    m = minima.astype(np.uint64).reshape(-1, BANDS, ROWS)
    x = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX[0], m.shape[:2]).copy()
    for r in range(ROWS):
        x = (x ^ m[:, :, r]) * _MIX[r + 1]
        x ^= x >> np.uint64(31)
    return x


def band_hashes(lines: list[str]) -> np.ndarray:
    """len(lines) x BANDS hashes. Lines of fewer than SHINGLE characters must not be among them."""
    return _banded(minima_of(lines)).view(np.int64)


def _bits(minima: np.ndarray) -> np.ndarray:
    """Two bits of each minimum, in 64."""
    two = ((minima * np.uint32(0x9E3779B1)) >> np.uint32(30)).astype(np.uint64)
    return (two << np.arange(0, 2 * BANDS * ROWS, 2, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of _bits() differ for at most MOST minima."""
    x = a ^ b
    return np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)) <= MOST


SIGNED = "key binary, doc_id long, row long, idx int, bands binary, bits long"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of SIGNED from (doc_id, row, text): one for every line with a character other than white space. Of
    equal lines here the first has bands; lines too short for a shingle have none, since no other line is near them."""

    def pack(ids, rows, places, lines):
        number: dict[str, int] = {}
        own = [number.setdefault(x, len(number)) for x in lines]
        digests = [hashlib.md5(x.encode()).digest() for x in number]
        long = [x for x in number if len(x) >= SHINGLE]
        minima = minima_of(long)
        bands, bits = _banded(minima).tobytes(), _bits(minima).view(np.int64).tolist()
        size = 8 * BANDS
        at = iter(range(len(long)))
        signed = [(bands[i * size : (i + 1) * size], bits[i]) if len(x) >= SHINGLE and (i := next(at)) >= 0 else (None, None) for x in number]
        new, known = [], set()
        for i in own:
            new.append((None, None) if i in known else signed[i])
            known.add(i)
        cols = [
            pa.array([digests[i] for i in own], pa.binary()), pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(places, pa.int32()),
            pa.array([x for x, _ in new], pa.binary()), pa.array([x for _, x in new], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(cols, names=["key", "doc_id", "row", "idx", "bands", "bits"])

    for b in batches:
        ids, rows, places, lines, held = [], [], [], [], 0
        for doc_id, row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            for i, line in enumerate(text.as_py().split("\n")):
                if _TEXT.search(line):
                    ids.append(doc_id)
                    rows.append(row)
                    places.append(i)
                    lines.append(line)
                    held += len(line)
                if held >= 16 * BLOCK:
                    yield pack(ids, rows, places, lines)
                    ids, rows, places, lines, held = [], [], [], [], 0
        if lines:
            yield pack(ids, rows, places, lines)


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text) of rows with both; row, a hash of the text, tells rows apart that share a doc_id."""
    d = docs.where("doc_id is not null and text is not null")
    return d.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")


def signatures(docs: DataFrame) -> DataFrame:
    """SIGNED of every line of docs."""
    ship(docs.sparkSession)
    return _texts(docs).mapInArrow(_sign, SIGNED)


def _id(key: str = "key"):
    """The number of a line where pairs are looked for; lines that share one, if any do, all take part."""
    return F.xxhash64(key)


def _groups(band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's run of equal bands, and the size of that run; band is sorted."""
    new = np.concatenate(([True], band[1:] != band[:-1])) if len(band) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(band)))
    return np.repeat(np.arange(len(at)), size), np.repeat(size, size)


def _led(band: np.ndarray, ids: np.ndarray, bits: np.ndarray) -> list[tuple]:
    """Links (a, b) of lines to leaders: the first of a band leads all that are alike, and so on among the others."""
    out = []
    for _ in range(LEADERS):
        if not len(band):
            break
        group, _ = _groups(band)
        head = np.searchsorted(group, group)  # the first row of each group
        rest = np.arange(len(band)) != head
        like = rest & _alike(bits, bits[head])
        out.append((ids[like], ids[head][like]))
        rest &= ~like
        band, ids, bits = band[rest], ids[rest], bits[rest]
    return out


def _ordered(band, ids, bits, *more):
    """Sorted by band and id; a line comes once in a band."""
    order = np.lexsort((ids, band))
    cols = [x[order] for x in (band, ids, bits, *more)]
    if len(order):
        new = np.concatenate(([True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])))
        cols = [x[new] for x in cols]
    return cols


_DEALT = "bucket long, band binary, ids binary, bits binary, open binary"


def _dealer(buckets: int):
    """Packed band rows, by bucket, from (id, bands, bits). Of a band with more than SMALL lines here only the first goes
    on; its links and lines pass through, as buckets below zero: links have no band."""

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= BLOCK_LINES:
                yield from deal(held)
                held, n = [], 0
        if n:
            yield from deal(held)

    def deal(batches):
        table = pa.Table.from_batches(batches).combine_chunks()
        ids = table["id"].to_numpy()
        _, one = np.unique(ids, return_index=True)
        ids, bits = ids[one], table["bits"].to_numpy()[one].view(np.uint64)
        bands = np.frombuffer(b"".join(table["bands"].to_pylist()), np.uint64).reshape(-1, BANDS)[one]
        band, ids, bits = _ordered(bands.ravel(), np.repeat(ids, BANDS), np.repeat(bits, BANDS))
        _, size = _groups(band)
        large = size > SMALL
        head = np.concatenate(([True], band[1:] != band[:-1]))
        rows = []

        def put(bucket, *cols):
            rows.append((bucket, *(None if c is None else c.tobytes() for c in cols)))

        if large.any():
            spread = -1 - int(ids[0]) % buckets
            for a, b in _led(band[large], ids[large], bits[large]):
                put(spread, None, a, b.view(np.uint64), None)
            put(spread, band[large], ids[large], bits[large], None)
        go = ~large | head
        band, ids, bits, open_ = band[go], ids[go], bits[go], large[go].astype(np.uint8)
        bucket = ((band >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        for i, j in zip(cut, [*cut[1:], len(bucket)], strict=True):
            put(int(bucket[i]), band[i:j], ids[i:j], bits[i:j], open_[i:j])
        cols = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(next(cols), pa.int64()), *(pa.array(c, pa.binary()) for c in cols)], names=["bucket", "band", "ids", "bits", "open"])

    return run


_MET = pa.schema([("band", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _met(links: list[tuple], band=None, ids=None, bits=None) -> pa.Table:
    """Links as rows (null, a, b), lines of open bands as rows (band, id, bits)."""
    a = np.concatenate([np.zeros(0, np.int64), *(x for x, _ in links)])
    b = np.concatenate([np.zeros(0, np.int64), *(x for _, x in links)])
    parts = [pa.table([pa.nulls(len(a), pa.int64()), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=_MET)]
    if band is not None:
        parts.append(pa.table([pa.array(band.view(np.int64)), pa.array(ids), pa.array(bits.view(np.int64))], schema=_MET))
    return pa.concat_tables(parts)


def _meet(table: pa.Table) -> pa.Table:
    """Candidate pairs of one bucket, and the lines of its open bands."""
    read = lambda name, kind: np.frombuffer(b"".join(x or b"" for x in table[name].to_pylist()), kind)
    if table["bucket"][0].as_py() < 0:
        parts = []
        for band, ids, bits in zip(*(table[c].to_pylist() for c in ("band", "ids", "bits")), strict=True):
            ids = np.frombuffer(ids, np.int64)
            parts.append(_met([(ids, np.frombuffer(bits, np.int64))]) if band is None else _met([], np.frombuffer(band, np.uint64), ids, np.frombuffer(bits, np.uint64)))
        return pa.concat_tables(parts)
    band, ids, bits, open_ = _ordered(read("band", np.uint64), read("ids", np.int64), read("bits", np.uint64), read("open", np.uint8))
    group, size = _groups(band)
    large = (size > SMALL) | (np.bincount(group, open_)[group] > 0 if len(group) else False)
    links = _led(band[large], ids[large], bits[large])
    few = ~large & (size > 1)
    b, i, x = band[few], ids[few], bits[few]
    for d in range(1, SMALL):
        same = np.flatnonzero(b[d:] == b[:-d])
        if not len(same):
            break
        same = same[_alike(x[same], x[same + d])]
        links.append((i[same], i[same + d]))
    return _met(links, band[large], ids[large], bits[large])


def candidates(signed: DataFrame) -> DataFrame:
    """Rows of _MET over ids of lines: pairs to verify, and the lines of open bands. signed must be a table."""
    ship(signed.sparkSession)
    d = signed.where("bands is not null").select(_id().alias("id"), "bands", "bits")
    buckets = max(1, -(-d.count() * BANDS * 24 // BUCKET_BYTES))
    dealt = d.mapInArrow(_dealer(buckets), _DEALT)
    return dealt.groupBy("bucket").applyInArrow(_meet, "band long, a long, b long")


def _shingles(line: str) -> np.ndarray:
    """The set of hashes of all shingles, sorted."""
    h = _hashes(line)
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def _near(rows) -> Iterator[tuple]:
    """The (a, b) among (a, b, line_a, line_b) with a Jaccard similarity of SIMILARITY or more."""
    held, other = None, None
    for a, b, line_a, line_b in rows:
        if b != held:  # the first of a batch comes many times in a row
            held, other = b, _shingles(line_b)
        if (len(line_a) - SHINGLE + 1) / len(other) < SIMILARITY:
            continue
        own = _shingles(line_a)
        both = np.sort(np.concatenate((own, other)))
        common = np.count_nonzero(both[1:] == both[:-1])
        if common / (len(both) - common) >= SIMILARITY:
            yield a, b


def wanted_lines(docs: DataFrame, signed: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, id, key, line) of all lines whose id is in ids; node, their number, holds once the table is written."""
    places = signed.where("bands is not null").withColumn("id", _id()).join(ids.distinct(), "id", "left_semi")
    places = places.groupBy("key").agg(F.min(F.struct("doc_id", "row", "idx")).alias("at")).select("key", "at.*")
    by_row = places.groupBy("doc_id", "row").agg(F.collect_list(F.struct("idx", "key")).alias("wanted"))
    d = _texts(docs).join(by_row.hint("shuffle_hash"), ["doc_id", "row"])
    # the text is split once: inside a lambda it would be split again for every line
    d = d.select("wanted", F.explode(F.array(F.split("text", "\n", -1))).alias("lines"))
    d = d.select(F.explode(F.transform("wanted", lambda w: F.struct(w["key"].alias("key"), F.get("lines", w["idx"]).alias("line")))).alias("w"))
    # rows that repeat one another repeat their lines
    d = d.select("w.*").dropDuplicates(["key"])
    return d.select(F.monotonically_increasing_id().alias("node"), _id().alias("id"), "key", "line")


def verified(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs with a Jaccard similarity of SIMILARITY or more, as nodes."""
    of = lambda x: lines.select(F.col("id").alias(x), F.col("node").alias(f"node_{x}"), F.col("line").alias(f"line_{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return map_rows(both.select("node_a", "node_b", "line_a", "line_b"), "a long, b long", _near)


def _compare(rows: list[tuple], across: bool) -> Iterator[tuple]:
    """Links between the roots of (root, line, bits, side) rows: of every near pair that is alike, also by way of others. across:
    only pairs of different sides."""
    names = sorted({r[0] for r in rows})
    number = {x: i for i, x in enumerate(names)}
    root = np.array([number[r[0]] for r in rows])
    bits = np.array([r[2] for r in rows], np.int64).view(np.uint64)
    sets: dict[int, np.ndarray] = {}

    def shingles(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = _shingles(rows[i][1])
        return sets[i]

    if across:
        cut = sum(1 for r in rows if r[3] == rows[0][3])
    for i in range(cut if across else len(rows) - 1):
        at = cut if across else i + 1
        for j in at + np.flatnonzero((root[at:] != root[i]) & _alike(bits[at:], bits[i])):
            if root[j] == root[i]:
                continue
            a, b = shingles(i), shingles(j)
            if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
                continue
            both = np.sort(np.concatenate((a, b)))
            common = np.count_nonzero(both[1:] == both[:-1])
            if common / (len(both) - common) >= SIMILARITY:
                yield names[root[i]], names[root[j]]
                root[root == root[j]] = root[i]


def _cells(rows) -> Iterator[tuple]:
    """_compare for every cell of (band, low, high, block, root, line, bits), sorted by the first four."""
    for (_, low, high), cell in groupby(rows, lambda r: r[:3]):
        yield from _compare([(r[4], r[5], r[6], r[3]) for r in cell], low != high)


def rest(open_: DataFrame, lines: DataFrame, roots: DataFrame) -> DataFrame:
    """Links (a, b) between roots: those of all near lines that share an open band and have not the same root. The lines of a band's
    largest component make blocks of their own, since they needn't meet each other; a band of m lines with u
    outside that component makes some m * u / CELL rows."""
    known = lines.join(roots, "node", "left").select("id", "node", F.coalesce("root", "node").alias("root"), F.length("line").alias("n"))
    at = save(open_.join(known, "id").select("node", "root", "band", "bits", (1 + F.col("n") / WEIGHT).alias("w")).distinct())
    by_root = at.groupBy("band", "root").agg(F.sum("w").alias("w"))
    bands = by_root.groupBy("band").agg(F.sum("w").alias("w"), F.count("*").alias("roots"), F.max(F.struct("w", "root")).alias("top"))
    bands = bands.where("roots > 1").select(
        "band", F.col("top.root").alias("top"), F.ceil((F.col("w") - F.col("top.w")) / CELL).cast("int").alias("outside"), F.ceil(F.col("top.w") / CELL).cast("int").alias("inside")
    )
    at = at.drop("w").join(bands, "band")
    some = lambda n: F.pmod(F.xxhash64("node"), F.greatest(F.col(n), F.lit(1))).cast("int")
    block = F.when(F.col("root") == F.col("top"), F.col("outside") + some("inside")).otherwise(some("outside"))
    at = save(at.withColumn("block", block).select("node", "root", "band", "bits", "block", "outside", "inside"))
    other = F.when(F.col("block") < F.col("outside"), F.sequence(F.lit(0), F.col("outside") + F.col("inside") - 1)).otherwise(F.sequence(F.lit(0), F.col("outside") - 1))
    d = lines.select("node", "line").join(at, "node").withColumn("other", F.explode(other))
    d = d.select("band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "root", "line", "bits")
    d = d.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high", "block")
    return map_rows(d, "a long, b long", _cells)


def rejoined(roots: DataFrame, above: DataFrame) -> DataFrame:
    """(node, root) of the components of roots, whose roots, or lines that have none, are joined by above, (node, root) likewise."""
    up = above.select(F.col("node").alias("root"), F.col("root").alias("top"))
    joined = roots.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    # lines without a root of their own: above alone knows them
    return joined.union(above.join(roots, "node", "left_anti").select("node", "root"))


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, row, gone array<int>): places of the lines that go, for every text that has any; row is the text's xxhash64."""
    spark = docs.sparkSession
    signed = save(signatures(docs))
    met = save(candidates(signed))
    release(spark)
    pairs = save(met.where("band is null").select("a", "b").distinct())
    open_ = met.where("band is not null").select("band", F.col("a").alias("id"), F.col("b").alias("bits"))
    lines = save(wanted_lines(docs, signed, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(open_.select("id"))))
    release(spark)
    links = save(verified(lines, pairs))
    release(spark)
    roots = connected_components(links)
    if not open_.isEmpty():
        more = save(rest(open_, lines, roots))
        release(spark)
        roots = rejoined(roots, connected_components(more))
    roots = lines.select("node", "key").join(roots, "node").select("key", F.unhex(F.lpad(F.hex("root"), 16, "0")).alias("root"))
    drop(met, pairs, links)
    by_key = signed.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    # of 8 bytes where lines are near, of 16 where they are only equal
    several = by_key.join(roots, "key", "left").where("n > 1 or root is not null").withColumn("root", F.coalesce("root", "key"))
    stays = several.groupBy("root").agg(F.min("first").alias("stay"))
    decided = several.join(stays, "root").select("key", "root", "stay")
    at = signed.select("key", "doc_id", "row", "idx").join(decided, "key")
    # in the document that keeps one, the first of all places stays
    own = at.repartition("doc_id").groupBy("doc_id", "root").agg(F.min("stay").alias("stay"), F.collect_set(F.struct("row", "idx")).alias("at"))
    gone = F.when(F.col("doc_id") == F.col("stay"), F.array_except("at", F.array(F.array_min("at")))).otherwise(F.col("at"))
    gone = own.select("doc_id", F.explode(gone).alias("p")).groupBy("doc_id", "p.row").agg(F.collect_set("p.idx").alias("gone"))
    gone = save(gone)
    drop(signed, lines)
    release(spark)
    return gone


def _kept(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs with _gone, how many lines go (null: none), and _kept, the text without them (null, where _gone is)."""
    names = docs.columns
    d = docs.toDF(*(f"_doc_{i}" for i in range(len(names))))  # no clash with names of our own
    doc_id, text = (f"_doc_{names.index(c)}" for c in ("doc_id", "text"))
    whole = d.where(F.col(doc_id).isNull() | F.col(text).isNull())  # these meet nothing, and would all meet it in one task
    keys = gone.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "gone")
    d = d.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).withColumn("_text_row", F.xxhash64(text))
    d = d.join(keys.hint("shuffle_hash"), (F.col(doc_id).cast("long") == F.col("_id")) & (F.col("_text_row") == F.col("_row")), "left")
    # the text is split once: inside a lambda it would be split again for every line
    d = d.select(*whole.columns, "gone", F.explode(F.array(F.when(F.col("gone").isNotNull(), F.split(text, "\n", -1)))).alias("_lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "gone")
    kept = F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n")
    d = d.select(*whole.columns, F.size("gone").alias("_gone"), F.when(F.col("gone").isNotNull(), kept).alias("_kept"))
    whole = whole.select("*", F.lit(None).cast("int").alias("_gone"), F.lit(None).cast("string").alias("_kept"))
    return d.withColumn("_gone", F.when(F.col("_kept").isNotNull(), F.col("_gone"))).unionByName(whole).toDF(*names, "_gone", "_kept")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the lines that repeat an earlier line, exactly or nearly, taken out of text.

    Lines are parts between newlines; lines of white space alone stay. n_chars, where it is a
    column, follows the text. Rows with a null doc_id or text are left as they are. Rows that share a
    doc_id are one document in the order of lines (by row, the hash of the text, then place), and rows equal in both stay or lose the
    same lines. Other columns are passed on, whatever their names.
    """
    names = docs.columns
    d = _kept(docs, removals(docs))
    own = [f"_doc_{i}" for i in range(len(names))]
    d = d.toDF(*own, "_gone", "_kept")
    out = []
    for c, name in zip(own, names, strict=True):
        if name == "text":
            out.append(F.coalesce("_kept", c).alias(name))
        elif name == "n_chars":
            out.append(F.when(F.col("_kept").isNull(), F.col(c)).otherwise(F.length("_kept").cast(docs.schema[name].dataType)).alias(name))
        else:
            out.append(F.col(c).alias(name))
    return d.select(*out)


def report(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_removed, kept_sha256 (of the text that stays; null text counts as empty)."""
    d = _kept(docs.select("doc_id", "text"), removals(docs))
    text = F.coalesce("text", F.lit(""))
    n_lines = 1 + F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    return d.select("doc_id", n_lines.cast("long").alias("n_lines"), F.coalesce("_gone", F.lit(0)).cast("long").alias("n_removed"), F.sha2(F.coalesce("_kept", text), 256).alias("kept_sha256"))
