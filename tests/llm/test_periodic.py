"""Runs against a search of all periods, and awkward rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from spindrift.llm import periodic

DDL = "doc_id long, text string, runs string, n_words int"


def plain(words, least=12):
    out, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            part = words[i : i + size]
            if j > i and size >= max(least, 2 * q) and not any(part[r:] == part[: size - r] for r in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def made(rnd):
    words = [rnd.randrange(rnd.choice([1, 2, 3, 9])) for _ in range(rnd.choice([0, 1, 2, 5, 20, 60]))]
    for _ in range(rnd.randrange(4)):
        if words:
            a = rnd.randrange(len(words))
            b = rnd.randrange(a, len(words)) + 1
            words[b:b] = (words[a:b] * rnd.randrange(1, 6))[: rnd.randrange(1, 90)]
    return words


@pytest.mark.parametrize("seed", range(60))
def test_against_all_periods(seed):
    rnd = random.Random(seed)
    texts = [made(rnd) for _ in range(rnd.randrange(1, 14))]
    least = rnd.choice([2, 5, 12])
    n = np.array([len(t) for t in texts])
    ends = np.cumsum(n)
    word = np.array([1_000 * i + w for i, t in enumerate(texts) for w in t], np.int64)
    got = periodic.runs(word, *(np.repeat(x, n).astype(np.int32) for x in (ends - n, ends)), least)
    want = [(s + a, length, q) for t, a in zip(texts, (ends - n).tolist(), strict=True) for s, length, q in plain(t, least)]
    assert list(zip(*(x.tolist() for x in got), strict=True)) == want


def digest(words):
    found = plain(words)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    told = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), *(hashlib.sha256(x.encode()).hexdigest() for x in (told, kept)))


def stutter(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_query_on_a_small_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in periodic.run_digests(periodic.stuttered(docs)).collect()}
    for d in docs.collect():
        words = stutter(d.doc_id, [w.decode() for w in (d.text or "").encode().split()])
        if len(words) < 2_500:
            assert got[d.doc_id] == digest(words), d.doc_id


def test_awkward_rows(spark):
    rows = [(None, "a " * 12, "x", 1), (1, None, "x", 1), (2, "", None, 1), (3, " \t\n\v\f\r", "", 1), (3, "a b a b " * 7, "", 1), (3, "a b a b " * 7, "", 1), (4, "\x00   " * 8, "", None)]
    rows += [(i, "only", "", 0) for i in range(10, 60)]
    got = periodic.find_runs(spark.createDataFrame(rows, DDL).coalesce(1)).collect()
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    assert [(r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got[:7]] == [
        (12, [(0, 12, 1)], "a"), (0, [], ""), (0, [], ""), (0, [], ""),
        (21, [(0, 21, 3)], "a b a b"), (21, [(0, 21, 3)], "a b a b"), (16, [(0, 16, 2)], "\x00  "),
    ]
    assert periodic.run_digests(periodic.stuttered(spark.createDataFrame([], DDL))).collect() == []


def test_long_texts(spark, monkeypatch):
    monkeypatch.setattr(periodic, "TOGETHER", 1_000)
    rnd = random.Random(0)
    block = [str(rnd.randrange(50)) for _ in range(3_000)]
    text = " ".join(block * 3 + ["end"] + ["w"] * 100_000)
    got = periodic.find_runs(spark.createDataFrame([(1, text, "", 0), (2, "b " * 50, "", 0)], DDL)).orderBy("doc_id").collect()
    assert (0, 9_000, 3_000) in [tuple(x) for x in got[0].runs] and (9_001, 100_000, 1) in [tuple(x) for x in got[0].runs]
    assert [tuple(x) for x in got[1].runs] == [(0, 50, 1)]


def test_stuttered_changes_only_the_tenth(spark):
    rows = [(i, "one two  three\nfour five six seven eight nine ten", "", 0) for i in range(80)] + [(None, "a  b", "", 0), (3, None, "", 0), (4, "  ", "", 0)]
    for r in periodic.stuttered(spark.createDataFrame(rows, DDL)).collect():
        if r.doc_id is not None and r.text.startswith("one"):
            assert r.text.split() == stutter(r.doc_id, rows[0][1].split())
    assert [r.text for r in periodic.stuttered(spark.createDataFrame(rows[-3:], DDL)).collect()] == ["a  b", "", "  "]
