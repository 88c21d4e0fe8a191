"""The model against a plain one, and awkward rows."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import lm

DDL = "doc_id long, text string, block long, role string"


def remainder():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def plain(docs, order):
    """doc_id -> (n_tokens, n_known, base, score) of (doc_id, text), whose ids are distinct."""
    texts = {i: tokens(t) for i, t in docs}
    rest = {i: zlib.crc32(str(i).encode()) % 7 for i in texts}

    def grams(x):
        padded = [b" "] * (order - 1) + x
        for t in range(len(x)):
            yield [tuple(padded[t + order - n : t + order]) for n in range(1, order + 1)]

    def counts(x):
        c, k = ([collections.Counter() for _ in range(order)] for _ in range(2))
        for g in grams(x):
            for n in range(order):
                c[n][g[n]] += 1
                k[n][g[n][:-1]] += 1
        return c, k

    own = {i: counts(x) for i, x in texts.items() if rest[i] != 2}
    c, k = ([sum((o[j][n] for o in own.values()), collections.Counter()) for n in range(order)] for j in range(2))
    n_all, v = sum(c[0].values()), len(c[0])

    def estimates(x, mine=None):
        for g in grams(x):
            of, f = 0, [1 / (v + 1)]
            for n in range(order):
                have, seen = (a[n][b] - (mine[j][n][b] if mine else 0) for j, (a, b) in enumerate(((c, g[n]), (k, g[n][:-1]))))
                f.append(have / seen if seen > 0 else 0.0)
                if n and seen > 0:
                    of = n * lm.CLASSES + min(seen.bit_length(), lm.CLASSES - 1)
            yield of, np.array(f)

    knows = lambda of: np.arange(order + 1) <= of // lm.CLASSES + 1
    weights = collections.defaultdict(lambda: None)
    w = lambda of: weights[of] if weights[of] is not None else knows(of) / knows(of).sum()
    aside = [e for i, x in texts.items() if rest[i] == 5 for e in estimates(x, own[i])]
    last = -math.inf
    for _ in range(lm.ROUNDS if aside else 0):
        sums, log = {}, 0.0
        for of, f in aside:
            p = f * w(of)
            log += math.log(p.sum())
            sums[of] = sums.get(of, 0) + p / p.sum()
        for of, s in sums.items():
            s = s + lm.PRIOR * knows(of)
            weights[of] = s / s.sum()
        if log / len(aside) - last < lm.GAIN:
            break
        last = log / len(aside)
    return {
        i: (len(x), sum(c[0][t,] > 0 for t in x), sum(math.log10((c[0][t,] + 1) / (n_all + v + 1)) for t in x), sum(math.log10((f * w(of)).sum()) for of, f in estimates(x)))
        for i, x in texts.items()
    }


def scored(docs, order=lm.ORDER):
    return lm.score_documents(docs, remainder() == 2, remainder() == 5, order)


@pytest.mark.parametrize(("order", "block"), [(1, 1 << 20), (2, 2_000), (3, 3_000), (3, 1 << 20), (4, 5_000)])
def test_against_a_plain_model(spark, sf_dir, monkeypatch, order, block):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", block)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(70)
    want = plain([(d.doc_id, d.text) for d in docs.collect()], order)
    got = scored(docs, order).collect()
    assert len(got) == 70
    for r in got:
        n, known, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known) == (n, known) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(base, abs=1e-8) and r.score == pytest.approx(score, abs=1e-5)


def test_unknown_words_and_contexts_keep_a_share(spark):
    docs = spark.createDataFrame([(i, "a b a c" if i % 3 else "b b a", None, None) for i in range(40)], DDL)
    asked = [i for i in range(1_000, 9_000) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    got = {r.doc_id: r for r in scored(docs.union(spark.createDataFrame([(asked[0], "zzz", 0, ""), (asked[1], "a b a c", 0, ""), (asked[2], "c a b b", 0, "")], DDL))).collect()}
    unknown, usual, odd = (got[i] for i in asked)
    assert unknown.n_known == 1 and math.isfinite(unknown.score)
    assert usual.score > odd.score and usual.score > usual.base_score


def test_better_than_single_words_on_texts_held_out(spark):
    got = scored(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.9 * got[1]


def test_awkward_rows(spark):
    rows = [(None, "a b", 1, "x"), (1, None, 2, None), (2, "", None, ""), (3, "AÄ aä aÄ", 1, ""), (3, "AÄ aä aÄ", 1, ""), (4, "w " * 50_000, 1, "")]
    got = {(r.doc_id, r.n_tokens): r for r in scored(spark.createDataFrame(rows, DDL)).collect()}
    assert set(got) == {(None, 3), (1, 1), (2, 1), (3, 4), (4, 50_001)}
    assert all(math.isfinite(r.score) and r.score < 0 for r in got.values())
    assert scored(spark.createDataFrame(rows, DDL)).count() == 6
    assert scored(spark.createDataFrame([], DDL)).collect() == []


def test_nothing_to_learn_from(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    got = scored(spark.createDataFrame([(i, "a b", 1, "") for i in held], DDL)).collect()
    assert [(r.n_known, r.train_tokens, r.base_score) for r in got] == [(0, 0, 0.0)] * 3 and all(math.isfinite(r.score) for r in got)


def test_tables_are_dropped(spark, tmp_path):
    before = {t.name for t in spark.catalog.listTables()}
    scored(spark.createDataFrame([(i, "a b c", 1, "") for i in range(20)], DDL)).collect()
    assert {t.name for t in spark.catalog.listTables()} == before
