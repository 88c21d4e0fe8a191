"""Removal of repeated passages by a sparse, distributed suffix array.

Every string of LENGTH bytes that also starts in a document with a smaller doc_id is
removed. Not all suffixes are needed to find them: in any LENGTH bytes one GRAM-byte
string is least by a fixed hash (the leftmost, if equal), and equal strings have it at
the same place. Only suffixes that start there (about one in twenty) are kept, each with
the bytes around it that the windows which chose it cover. Sampled splitters deal the
suffixes out by leading bytes; within a bucket they are sorted by multikey quicksort on
tokens of eight bytes, and runs of equal strings are compared by document. Splitters are
whole leading tokens, so a run of equal windows never crosses from one bucket into the next.

A task sends each distinct string once, for its smallest document: the larger ones among
its own are known to repeat it. So a passage that a third of all documents share sends
one string per task. All comparisons are of bytes; hashes only choose where to look.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import map_rows, release, save

LENGTH = 50
GRAM = 12
SPAN = LENGTH - GRAM + 1  # window starts that can choose the same suffix
#: Bytes of text that a task looks at together (under 2**24), that it hashes in one go, and that
#: make one bucket.
BLOCK = 12 << 20
STRETCH = 256 << 10
BUCKET_BYTES = 4 << 20
#: Bytes of text sampled for the splitters, for each bucket and at most.
SAMPLE_BYTES, SAMPLE_MOST = 20_000, 8 << 20
LEFT, WIDTH = 40, 96  # a string lies in a row of WIDTH bytes with its suffix at LEFT
_LOW = np.uint64((1 << 24) - 1)


def anchors(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, first window, last window, suffix start, hash of the string) of every run of
    windows that choose the same suffix; the string goes from the first window to the end of the
    last. buf: the documents' bytes on end, fewer than 2**24; ends: where each ends."""
    n = len(buf)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none, none.view(np.uint64)
    words = np.ndarray((n - 7,), "<u8", buf, strides=(1,))
    with np.errstate(over="ignore"):
        h = words[: n - GRAM + 1] * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        h += words[GRAM - 8 : n - 7] * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    gram = h
    h = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while step * 2 <= SPAN:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    h = np.minimum(h[: n - LENGTH + 1], h[SPAN - step : SPAN - step + n - LENGTH + 1])
    at = (h & _LOW).astype(np.int64)
    starts = np.r_[0, ends[:-1]]
    long = ends - starts >= LENGTH
    inside = np.zeros(n - LENGTH + 2, np.int8)
    inside[starts[long]] += 1
    inside[ends[long] - LENGTH + 1] -= 1
    where = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
    if not len(where):
        return none, none, none, none, none.view(np.uint64)
    at = at[where]
    new = np.flatnonzero(_heads(at))
    first, last = where[new], where[np.append(new[1:], len(at)) - 1]
    end = last + LENGTH - GRAM
    known = (end - first).astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, SPAN + LENGTH - GRAM, GRAM):  # grams that cover the string
            known = (known ^ gram[np.minimum(first + k, end)]) * np.uint64(0x9E3779B97F4A7C15)
            known ^= known >> np.uint64(32)
    return np.searchsorted(ends, first, "right"), first, last, at[new], known


def _heads(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _blocks(rows, size):
    """Lists of (doc_id, key, offset, text), smallest doc_id first, of about size bytes and always
    under 2**24. A very long text is in pieces that share LENGTH - 1 bytes: every window is in one."""
    block, total, most = [], 0, size // 2
    for doc_id, key, text in rows:
        for i in range(0, max(1, len(text) - LENGTH + 1), most - LENGTH + 1):
            piece = text[i : i + most]
            if block and total + len(piece) > size:
                yield sorted(block, key=lambda r: r[:3])
                block, total = [], 0
            block.append((doc_id, key, i, piece))
            total += len(piece)
    if block:
        yield sorted(block, key=lambda r: r[:3])


def _suffixes(data: bytes, ends: np.ndarray) -> list[np.ndarray]:
    """anchors() of the whole block, found in stretches that fit the processor's cache."""
    found, i = [], 0
    while i < len(ends):
        base = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + STRETCH, "right")))
        doc, first, last, at, known = anchors(np.frombuffer(data, np.uint8, int(ends[j - 1]) - base, base), ends[i:j] - base)
        found.append((doc + i, first + base, last + base, at + base, known))
        i = j
    return [np.concatenate(c) for c in zip(*found, strict=True)]


def _leads(data: bytes, at: np.ndarray) -> np.ndarray:
    return np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))[at].astype(np.uint64)


def _dealt(splitters: np.ndarray):
    """Rows (bucket, packed suffixes) and, with bucket -1, the (doc, key, starts, ends) that a task knows already."""

    def run(rows):
        for block in _blocks(rows, BLOCK):
            yield from _deal(block, splitters)

    return run


def _deal(block, splitters):
    data = b"".join(t for *_, t in block)
    ends = np.cumsum([len(t) for *_, t in block])
    doc, first, last, at, known = _suffixes(data, ends)
    if not len(doc):
        return
    ids, keys = (np.array([r[i] for r in block], np.int64) for i in (0, 1))
    shift = np.concatenate([[0], ends[:-1]]) - np.array([r[2] for r in block])
    # equal strings stand together, the smallest document's first
    order = np.lexsort((np.arange(len(known)), last - first, known))
    doc, first, last, at, known = (x[order] for x in (doc, first, last, at, known))
    size = last - first + LENGTH
    new = _heads(known, size)
    dup = np.flatnonzero(~new)
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    for i in range(0, len(dup), 1 << 15):  # hashes only point at equal strings
        d = dup[i : i + (1 << 15)]
        h = head[d]
        k = size[d]
        step = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        flat = np.frombuffer(data, np.uint8)
        differ = flat[np.repeat(first[d], k) + step] != flat[np.repeat(first[h], k) + step]
        odd = head[d[np.add.reduceat(differ, np.cumsum(k) - k) > 0]]
        for h in np.unique(odd).tolist():  # unlike strings of one hash: told apart by their bytes, in order
            z = int(np.searchsorted(head, h, "right"))
            own = sorted(range(h, z), key=lambda r: data[first[r] : last[r] + LENGTH])
            doc[h:z], first[h:z], last[h:z], at[h:z] = doc[own], first[own], last[own], at[own]
            strings = [data[a : b + LENGTH] for a, b in zip(first[h:z].tolist(), last[h:z].tolist(), strict=True)]
            new[h:z] = [True, *(a != b for a, b in zip(strings, strings[1:], strict=False))]
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    again = ids[doc] > ids[doc[head]]
    if again.any():
        d, a, z = doc[again], first[again] - shift[doc[again]], last[again] + LENGTH - shift[doc[again]]
        order = np.argsort(d, kind="stable")
        d, a, z = d[order], a[order], z[order]
        cut = np.flatnonzero(_heads(d))
        for i, j in zip(cut, [*cut[1:], len(d)], strict=True):
            yield -1, None, int(ids[d[i]]), int(keys[d[i]]), a[i:j].tobytes(), z[i:j].tobytes()
        doc, first, last, at, new = doc[~again], first[~again], last[~again], at[~again], new[~again]
    # by bucket, and by place within it: neighbours then differ by little
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    bucket = np.searchsorted(splitters, _leads(data, at), "right")
    order = np.lexsort((first[head], bucket))
    doc, first, last, at, bucket, head, new = (x[order] for x in (doc, first, last, at, bucket, head, new))
    new = _heads(head)
    cut = np.flatnonzero(_heads(bucket))
    for i, j in zip(cut, [*cut[1:], len(doc)], strict=True):
        n = np.flatnonzero(new[i:j]) + i
        count = np.diff(np.append(n, j))
        strings = [data[p:q] for p, q in zip(first[n].tolist(), (last[n] + LENGTH).tolist(), strict=True)]
        own = doc[i:j]
        yield int(bucket[i]), _packed(ids[own], keys[own], first[i:j] - shift[own], at[n] - first[n], last[n] - first[n] + LENGTH, count, strings), None, None, None, None


_TYPES = (np.int64, np.int64, np.int64, np.uint8, np.uint8, np.uint32)


def _packed(ids, keys, places, left, lens, count, strings) -> bytes:
    """The places of each string on end, and the strings: columns of numbers, then bytes, compressed."""
    import zstandard

    cols = [*(np.diff(c, prepend=0) for c in (ids, keys, places)), left.astype(np.uint8), lens.astype(np.uint8), count.astype(np.uint32)]
    head = np.array([len(strings), len(ids)], np.int64).tobytes()
    flat = b"".join(c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in cols)
    return zstandard.ZstdCompressor(level=3).compress(b"".join([head, flat, *strings]))


def _unpacked(blob: bytes):
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, m = np.frombuffer(raw, np.int64, 2)
    at, cols = 16, []
    for dtype, k in zip(_TYPES, (m, m, m, n, n, n), strict=True):
        width = np.dtype(dtype).itemsize
        cols.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, k * width, at).reshape(width, k).T).reshape(-1).view(dtype))
        at += k * width
    for i in range(3):
        cols[i] = np.cumsum(cols[i])
    return cols, raw[at:]


def equal_rows(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of rows of tokens, as far as it is needed to find equal rows: sort by a
    token, set apart what has no equal, and go on with the next token within runs of equals.
    Returns the rows that have an equal, and for each the number of its run."""
    rows = np.arange(len(tokens))
    run = np.zeros(len(tokens), np.int64)
    for k in range(tokens.shape[1]):
        if not len(rows):
            break
        key = tokens[rows, k]
        order = np.lexsort((key, run)) if k else np.argsort(key)
        rows, key, run = rows[order], key[order], run[order]
        run = np.cumsum(_heads(key, run)) - 1
        keep = np.bincount(run)[run] > 1
        rows, run = rows[keep], run[keep]
    return rows, run


def _tokens(m: np.ndarray) -> np.ndarray:
    """Bytes of each row as big-endian numbers of eight bytes, zeros at the end."""
    if m.shape[1] % 8:
        m = np.concatenate([m, np.zeros((len(m), -m.shape[1] % 8), np.uint8)], axis=1)
    return np.ascontiguousarray(m).view(">u8").astype(np.uint64)


def _matrix(strings: bytes, lens: np.ndarray, left: np.ndarray) -> np.ndarray:
    n, flat = len(lens), np.frombuffer(strings, np.uint8)
    m = np.zeros(n * WIDTH, np.uint8)
    start = np.cumsum(lens) - lens
    for i in range(0, n, 1 << 15):
        z = min(n, i + (1 << 15))
        k = lens[i:z]
        to = np.repeat(np.arange(i, z) * WIDTH + LEFT - left[i:z] - start[i:z], k)
        a, b = start[i], start[z - 1] + lens[z - 1]
        m[to + np.arange(a, b)] = flat[a:b]
    return m.reshape(n, WIDTH)


def _least(run: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each row the smallest doc of its run; run is sorted."""
    at = np.flatnonzero(_heads(run))
    return np.repeat(np.minimum.reduceat(doc, at), np.diff(np.append(at, len(run)))) if len(run) else doc


def _compare(blobs: list[bytes]) -> list[tuple]:
    """(doc, key, starts, ends) of what the suffixes of one bucket show to be repeated."""
    parts = [_unpacked(b) for b in blobs]
    doc, key, pos, left, lens, count = (np.concatenate([p[0][i] for p in parts]) for i in range(6))
    m = _matrix(b"".join(p[1] for p in parts), lens.astype(np.int64), left.astype(np.int64))
    left, lens = left.astype(np.int64), lens.astype(np.int64)
    right = lens - left
    own = np.repeat(np.arange(len(lens)), count)  # place -> string
    s_doc = doc[np.cumsum(count) - count]
    # 1. equal strings: the smallest document of each, in the order suffix, what precedes it, lengths
    t = _tokens(m)
    some, _ = equal_rows(np.stack([t[:, LEFT // 8], t[:, LEFT // 8 + 1] >> np.uint64(32)], axis=1))  # the suffix's first GRAM bytes
    t = t[some]
    rows, run = equal_rows(np.concatenate([t[:, LEFT // 8 :], t[:, : LEFT // 8], (left * 256 + right)[some].astype(np.uint64)[:, None]], axis=1))
    rows = some[rows]
    least = s_doc.copy()
    least[rows] = _least(run, s_doc[rows])
    first = np.zeros(len(lens), bool)  # one string of each run stands for it
    first[some] = True
    first[rows] = _heads(run)
    alike = np.arange(len(lens))
    alike[rows] = rows[np.flatnonzero(first[rows])][run]
    # 2. unlike strings that share some window share LENGTH - 19 bytes from the suffix on, or 20 before it
    u = np.flatnonzero(first)
    some = np.zeros(len(lens), bool)
    for lo, hi, ok in ((LEFT, LEFT + LENGTH - 19, right[u] >= LENGTH - 19), (LEFT - 20, LEFT + GRAM, left[u] >= 20)):
        c = u[ok]
        some[c[equal_rows(_tokens(m[c, lo:hi]))[0]]] = True
    u = np.flatnonzero(some)
    again = np.zeros((len(u), SPAN + 1), bool)  # string, bytes before the suffix: that window starts in a smaller document
    for o in range(SPAN):
        ok = np.flatnonzero((left[u] >= o) & (right[u] >= LENGTH - o))
        if len(ok) < 2:
            continue
        c = u[ok]
        rows, run = equal_rows(_tokens(m[c, LEFT - o : LEFT - o + LENGTH]))
        again[ok[rows], o] = _least(run, least[c[rows]]) < least[c[rows]]
    # 3. places: all windows of a larger document, or those found in 2.
    whole = doc > least[own]
    out = [(doc[whole], key[whole], pos[whole], pos[whole] + lens[own[whole]])]
    if again.any():
        edge = np.diff(np.concatenate([np.zeros((len(u), 1), bool), again], axis=1).astype(np.int8), axis=1)
        r, lo = np.nonzero(edge == 1)  # runs of windows, by bytes before the suffix
        hi = np.nonzero(edge == -1)[1] - 1
        by = {}
        for x, a, z in zip(u[r].tolist(), lo.tolist(), hi.tolist(), strict=True):
            by.setdefault(x, []).append((a, z))
        places = np.flatnonzero(~whole & np.isin(alike[own], u))
        add = [(doc[i], key[i], pos[i] + left[s] - z, pos[i] + left[s] - a + LENGTH) for i in places.tolist() for s in (alike[own[i]],) for a, z in by.get(s, ())]
        if add:
            out.append(tuple(np.array(c, np.int64) for c in zip(*add, strict=True)))
    d, k, a, z = (np.concatenate(c) for c in zip(*out, strict=True))
    if not len(d):
        return []
    order = np.lexsort((a, k, d))
    d, k, a, z = d[order], k[order], a[order], z[order]
    at = np.flatnonzero(_heads(d, k))
    return [(int(d[i]), int(k[i]), a[i:j].tobytes(), z[i:j].tobytes()) for i, j in zip(at, [*at[1:], len(d)], strict=True)]


FOUND = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("starts", pa.binary()), ("ends", pa.binary())])


def _reduce(table: pa.Table) -> pa.Table:
    if table["bucket"][0].as_py() < 0:
        return table.select(["doc_id", "key", "starts", "ends"]).cast(FOUND)
    found = _compare(table["packed"].to_pylist())
    return pa.table([pa.array(c, t.type) for c, t in zip(zip(*found, strict=True), FOUND, strict=True)] if found else [pa.array([], t.type) for t in FOUND], schema=FOUND)


def splitters_of(docs: DataFrame, buckets: int, total: int) -> np.ndarray:
    """Leading tokens that cut a sample of the suffixes into about equal parts."""
    if buckets < 2:
        return np.zeros(0, np.uint64)
    share = min(1.0, min(SAMPLE_MOST, SAMPLE_BYTES * buckets) / max(1, total))

    def run(rows):
        for block in _blocks(rows, BLOCK):
            data = b"".join(t for *_, t in block)
            at = _suffixes(data, np.cumsum([len(t) for *_, t in block]))[3]
            if len(at):
                yield (_leads(data, at).tobytes(),)

    sample = map_rows(docs.sample(share, seed=7), "leads binary", run, 1).collect()
    leads = np.sort(np.concatenate([np.frombuffer(r.leads, np.uint64) for r in sample] or [np.zeros(0, np.uint64)]))
    return np.unique(leads[np.linspace(0, len(leads), buckets + 1, dtype=np.int64)[1:-1]]) if len(leads) else leads


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("key"), text.cast("binary").alias("text"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, key, starts, ends): byte spans, packed as 64-bit numbers, that are covered by strings
    which also start in a document with a smaller doc_id; spans may overlap and a document may
    have several rows. key is the hash of the text: rows of one doc_id may hold other texts."""
    rows = _rows(docs).where(F.col("doc_id").isNotNull())
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    deal = _dealt(splitters_of(rows, buckets, total))
    sent = map_rows(rows, "bucket long, packed binary, doc_id long, key long, starts binary, ends binary", deal, 32)
    # what a task knows already goes through in many small groups
    sent = sent.withColumn("grp", F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(-1 - F.pmod(F.xxhash64("doc_id"), F.lit(buckets))))
    return sent.groupBy("grp").applyInArrow(_reduce, "doc_id long, key long, starts binary, ends binary")


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the spans cover."""
    out = []
    for a, z in sorted(zip(starts.tolist(), ends.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], z))
        else:
            out.append((a, z))
    return out


_BOTH = "doc_id long, key long, starts binary, ends binary, kind int, text binary"


def _squeezed(rows):
    import zstandard

    zstd = zstandard.ZstdCompressor(level=3)
    for *rest, text in rows:
        yield *rest, zstd.compress(text)


def cut_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, text (bytes that stay), n_bytes, n_removed, n_spans.

    Null text counts as empty. Texts under LENGTH bytes keep all. Rows with a null doc_id lose
    nothing and make no other lose anything; rows that share a doc_id don't take from each
    other. Matches never cross documents; what stays need not be valid UTF-8. Result rows
    meet their spans by doc_id and stream through: one text is in memory at a time.
    """
    spark = docs.sparkSession
    texts = _rows(docs).select("doc_id", "key", F.lit(None).cast("binary").alias("starts"), F.lit(None).cast("binary").alias("ends"), F.lit(1).alias("kind"), "text")
    texts = map_rows(texts, _BOTH, _squeezed, 200)
    spans = save(repeated_spans(docs))
    release(spark)  # the suffixes, before the texts are shuffled
    spans = spans.select("doc_id", "key", "starts", "ends", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(rows):
        import zstandard

        zstd, at, starts, ends = zstandard.ZstdDecompressor(), None, [], []
        for doc_id, key, a, z, kind, text in rows:
            if (doc_id, key) != at:
                at, starts, ends = (doc_id, key), [], []
            if kind == 0:
                starts.append(np.frombuffer(a, np.int64))
                ends.append(np.frombuffer(z, np.int64))
                continue
            gone = merged(np.concatenate(starts), np.concatenate(ends)) if starts else []
            text = zstd.decompress(text)
            kept, p = [], 0
            for a, z in gone:
                kept.append(text[p:a])
                p = z
            kept.append(text[p:])
            yield doc_id, b"".join(kept), len(text), sum(z - a for a, z in gone), len(gone)

    # rows with a null doc_id meet nothing: they are spread by key
    both = spans.union(texts).repartition(parts, F.coalesce("doc_id", "key")).sortWithinPartitions("doc_id", "key", "kind")
    return map_rows(both, "doc_id long, text binary, n_bytes long, n_removed long, n_spans long", run, 200)


def repeat_digests(docs: DataFrame) -> DataFrame:
    """cut_repeats() with kept_sha256 in place of the text."""
    return cut_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))
