"""SimHash near-duplicate detection by meet-in-the-middle ball hashing.

Two fingerprints within 4 bits of each other have a common point within 2 bits of
both, so it would do for every fingerprint to emit the 2,081 points of its ball of
radius 2. That many rows for every document are not needed to find who meets whom:
of the two 32-bit halves one differs by at most 2 bits, so the fingerprint first
emits the 33 points within radius 1 of either half (66 rows), and members of a
bucket are verified at full width. Buckets of more than BUCKET members, as large
groups of near copies make, are not paired: their members go on to the full ball,
where all that share a point are within 4 bits and are linked to one of them, so
the work is linear in the size of the group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import cut, doc_bytes, map_rows, unused
from spindrift.llm.components import connected_components

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
BUCKET = 256
PACK = 4096


def fingerprint(text: bytes) -> int:
    """64-bit SimHash of lower-cased (A-Z) 4-word shingles, repeats included; no words: 0."""
    import xxhash

    h64 = xxhash.xxh64_intdigest
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n < SHINGLE_WORDS:
        return h64(joined, SEED)
    lens = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[: n - SHINGLE_WORDS + 1]
    ends = ends[SHINGLE_WORDS - 1 :]
    total = np.zeros(64, np.int64)
    for i in range(0, len(starts), 1 << 16):
        hashes = [h64(joined[a:z], SEED) for a, z in zip(starts[i : i + (1 << 16)].tolist(), ends[i : i + (1 << 16)].tolist(), strict=True)]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed 64-bit integer."""

    def run(rows):
        for doc_id, text in rows:
            fp = fingerprint(text)
            yield doc_id, fp - (1 << 64) if fp >> 63 else fp

    return map_rows(doc_bytes(docs), "doc_id long, fp long", run)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most one link per node, with the same components as the links a-b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        new = np.minimum(new, new[label])
        if (new == label).all():
            break
        label = new
    while not (label[label] == label).all():
        label = label[label]
    keep = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[keep], nodes[label[keep]]


def _masks(width: int, radius: int) -> np.ndarray:
    one = np.array([1 << i for i in range(width)], np.uint64)
    out = [np.zeros(1, np.uint64), one]
    if radius == 2:
        i, j = np.triu_indices(width, 1)
        out.append(one[i] | one[j])
    return np.concatenate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _pack(keys, fps, buckets, n):
    """Rows (bucket, keys, fps) with one row for each bucket that has any."""
    order = np.argsort(buckets, kind="stable")
    keys, fps, buckets = keys[order], fps[order], buckets[order]
    at = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]]) if len(buckets) else []
    for i, j in zip(at, [*at[1:], len(buckets)], strict=True):
        yield int(buckets[i]), keys[i:j].tobytes(), fps[i:j].tobytes()


def _batches(rows, size):
    batch = []
    for (fp,) in rows:
        batch.append(fp)
        if len(batch) == size:
            yield np.array(batch, np.int64).view(np.uint64)
            batch = []
    if batch:
        yield np.array(batch, np.int64).view(np.uint64)


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("hot", pa.bool_())])


def _links_table(parts) -> pa.Table:
    a = np.concatenate([p[0] for p in parts] or [np.zeros(0, np.uint64)]).view(np.int64)
    b = np.concatenate([p[1] for p in parts] or [np.zeros(0, np.uint64)]).view(np.int64)
    hot = np.concatenate([np.full(len(p[0]), p[2]) for p in parts] or [np.zeros(0, bool)]).astype(bool)
    return pa.table([pa.array(a), pa.array(b), pa.array(hot)], schema=LINKS)


def _half_buckets(n_buckets: int, half_masks: np.ndarray):
    def run(rows):
        for fps in _batches(rows, PACK * 4):
            for half in (0, 1):
                part = (fps >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
                keys = (part[:, None] ^ half_masks[None, :]).ravel()
                own = np.repeat(fps, len(half_masks))
                buckets = (_mix(keys) % np.uint64(n_buckets)).astype(np.int64) * 2 + half
                yield from _pack(keys.astype(np.uint32), own, buckets, n_buckets)

    return run


def _meet_halves(table: pa.Table) -> pa.Table:
    keys = np.concatenate([np.frombuffer(x, np.uint32) for x in table["k"].to_pylist()])
    fps = np.concatenate([np.frombuffer(x, np.uint64) for x in table["f"].to_pylist()])
    order = np.argsort(keys, kind="stable")
    keys, fps = keys[order], fps[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    count = np.diff(np.r_[first, len(keys)])
    size = np.repeat(count, count)
    out = []
    large = fps[size > BUCKET]
    if len(large):
        large = np.unique(large)
        out.append((large, large, True))
    some = (size > 1) & (size <= BUCKET)
    keys, fps = keys[some], fps[some]
    link_a, link_b, d = [], [], 1
    while d < len(keys):
        same = np.flatnonzero(keys[d:] == keys[:-d])
        if not len(same):
            break
        x, y = fps[same], fps[same + d]
        near = np.bitwise_count(x ^ y) <= RADIUS
        link_a.append(x[near])
        link_b.append(y[near])
        d += 1
        if sum(map(len, link_a)) > 1 << 20:
            a, b = forest(np.concatenate(link_a), np.concatenate(link_b))
            link_a, link_b = [a], [b]
    if link_a:
        a, b = forest(np.concatenate(link_a), np.concatenate(link_b))
        out.append((a, b, False))
    return _links_table(out)


def _full_ball(n_buckets: int, masks: np.ndarray):
    def run(rows):
        for fps in _batches(rows, PACK // 4):
            keys = (fps[:, None] ^ masks[None, :]).ravel()
            own = np.repeat(fps, len(masks))
            order = np.argsort(keys, kind="stable")
            keys, own = keys[order], own[order]
            new = np.r_[True, keys[1:] != keys[:-1]]
            head = own[np.flatnonzero(new)][np.cumsum(new) - 1]
            a, b = forest(own[~new], head[~new])  # these meet here already: one of them stands for all
            if len(a):
                yield -1 - int(a[0] % np.uint64(n_buckets)), a.tobytes(), b.tobytes()
            keys, own = keys[new], own[new]
            yield from _pack(keys, own, (_mix(keys) % np.uint64(n_buckets)).astype(np.int64), n_buckets)

    return run


def _meet_ball(table: pa.Table) -> pa.Table:
    keys = np.concatenate([np.frombuffer(x, np.uint64) for x in table["k"].to_pylist()])
    fps = np.concatenate([np.frombuffer(x, np.uint64) for x in table["f"].to_pylist()])
    if table["bucket"][0].as_py() < 0:
        return _links_table([(keys, fps, False)])
    order = np.argsort(keys, kind="stable")
    keys, fps = keys[order], fps[order]
    new = np.r_[True, keys[1:] != keys[:-1]]
    head = fps[np.flatnonzero(new)][np.cumsum(new) - 1]
    return _links_table([(*forest(fps[~new], head[~new]), False)])


PACKED = "bucket long, k binary, f binary"


def links(fps: DataFrame, buckets: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) at RADIUS or fewer bits: for
    each set of mutually reachable fingerprints enough of them to connect it."""
    halves, ball = _masks(32, 1), _masks(64, 2)
    packed = map_rows(fps, PACKED, _half_buckets(buckets, halves), 64)
    met = cut(packed.groupBy("bucket").applyInArrow(_meet_halves, "a long, b long, hot boolean"))
    near = met.where(~F.col("hot")).select("a", "b")
    hot = met.where("hot").select(F.col("a").alias("fp")).distinct()
    if hot.isEmpty():
        return near
    packed = map_rows(hot, PACKED, _full_ball(buckets, ball), 64)
    return near.union(packed.groupBy("bucket").applyInArrow(_meet_ball, "a long, b long, hot boolean").select("a", "b"))


def simhash_components(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id
    (smallest doc_id reachable by links of at most RADIUS bits, itself included).

    Null text counts as empty: fingerprint zero, linked like any other. Rows with a
    null doc_id take part; component_id is the smallest doc_id that isn't null.
    Repeated rows each get their row. Other columns of docs aren't read.
    """
    own, grouped = _grouped(docs)
    least = grouped.groupBy("grp").agg(F.min("rep").alias("component_id"))
    by_fp = grouped.join(least, "grp").select("fp", "component_id")
    return own.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, and (fp, rep, grp) of every fingerprint: its smallest doc_id and its component."""
    spark = docs.sparkSession
    own = cut(fingerprints(docs))
    classes = cut(own.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    roots = connected_components(links(classes.select("fp"), parts))
    return own, classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("grp"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component of docs: that of the smallest doc_id, then fingerprint, then text. Rows that
    share a doc_id are judged each for itself. Rows with a null doc_id stay. Other columns may have any names."""
    own, grouped = _grouped(docs)
    stay_, fp_ = unused(docs, "_stay"), unused(docs, "_fp")
    stay = grouped.where("rep is not null").groupBy("grp").agg(F.min(F.struct("rep", "fp")).alias("stay"))
    by_fp = grouped.join(stay, "grp").select("fp", "stay")
    stays = F.when((F.col("doc_id") == F.col("stay.rep")) & (F.col("fp") == F.col("stay.fp")), F.col("fp"))
    by_doc = own.where("doc_id is not null").join(by_fp, "fp").groupBy("doc_id").agg(F.count("*").alias("n"), F.collect_set(stays).alias("stay"))
    by_doc = cut(by_doc.where("n > 1 or size(stay) = 0"))
    once = docs.join(by_doc.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    # only rows that repeat a doc_id need their fingerprints again
    again = by_doc.where("size(stay) > 0").select("doc_id", F.col("stay").alias(stay_))
    several = docs.join(again, "doc_id").select(*docs.columns, stay_)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            fps = [fingerprint(b"" if t is None else t.encode()) for t in b.column(at).to_pylist()]
            fps = pa.array([fp - (1 << 64) if fp >> 63 else fp for fp in fps], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, fps], names=[*b.schema.names, fp_])

    several = several.mapInArrow(run, several.withColumn(fp_, F.lit(0).cast("long")).schema).where(F.array_contains(stay_, F.col(fp_)))
    one = F.min_by(F.struct(*docs.columns), F.coalesce("text", F.lit(""))).alias("row")
    return once.unionByName(several.groupBy("doc_id", fp_).agg(one).select("row.*"))
