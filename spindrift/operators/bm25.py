"""BM25 ranking and token-overlap similarity."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import SPACE, tokenize
from spindrift.operators.topk import mmr, top_k

K1, B = 1.5, 0.75
LAMBDA, OVERSAMPLE = 0.7, 4


def idf(docs: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """(term, df, idf) over all docs (doc_id, text); only the given terms, if any."""
    t = docs.select(F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term"))
    if terms is not None:
        t = t.where(F.col("term").isin(terms))
    n = docs.agg(F.count("*").alias("n"))
    df = t.groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def query_terms(query: str) -> list[str]:
    """The query's terms, with repeats."""
    kept = "".join(c if c.isalnum() or c.isspace() else " " for c in query.lower())
    return kept.split()


def _equal(tokens: str, term: str):
    return F.filter(tokens, lambda x: x == F.lit(term))


def bm25_scores(docs: DataFrame, query: str, key: str = "doc_id") -> DataFrame:
    """(key, score) of every row of docs. A term counts as often as the query has it.

    One pass finds the statistics of the query's terms (a row of numbers), another scores: no
    document's terms are shuffled.
    """
    terms = query_terms(query)
    distinct = sorted(set(terms))
    tokens = docs.select(key, tokenize(F.col("text")).alias("_t"))
    counted = tokens.select(key, F.size("_t").alias("_len"), *(F.size(_equal("_t", t)).alias(f"_f{i}") for i, t in enumerate(distinct)))
    s = counted.agg(F.count("*").alias("n"), F.avg("_len").alias("avg"), *(F.sum(F.when(F.col(f"_f{i}") > 0, 1).otherwise(0)).alias(f"d{i}") for i in range(len(distinct)))).first()
    score = F.lit(0.0)
    for i, t in enumerate(distinct):
        d = s[f"d{i}"]
        if not d:
            continue
        weight = terms.count(t) * math.log(1 + (s.n - d + 0.5) / (d + 0.5))
        f = F.col(f"_f{i}")
        score = score + F.lit(weight) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_len") / F.lit(s.avg)))
    return counted.select(key, score.alias("score"))


def min_max(scored: DataFrame) -> DataFrame:
    """Scores to [0, 1]; left as they are if all are equal."""
    lim = scored.agg(F.min("score").alias("_mn"), F.max("score").alias("_mx"))
    new = F.when(F.col("_mx") > F.col("_mn"), (F.col("score") - F.col("_mn")) / (F.col("_mx") - F.col("_mn"))).otherwise(F.col("score"))
    return scored.crossJoin(F.broadcast(lim)).withColumn("score", new).drop("_mn", "_mx")


def overlap_similarity(weights: dict[str, float]):
    """Share of the weight of b's tokens that a has too; 0 where b has none. Tokens are raw words."""

    def sim(a: dict, b: dict) -> float:
        have = set(a["text"].split())
        total = sum(weights.get(w, 0.0) for w in b["text"].split())
        return sum(weights.get(w, 0.0) for w in b["text"].split() if w in have) / total if total else 0.0

    return sim


def select_top(chunks: DataFrame, query: str, most: int, key: str = "doc_id") -> DataFrame:
    """BM25, normalised, then the 4 * most best, of which MMR picks most for variety by token overlap.
    Result: key, text, score, rank. For chunks that are asked once; postings.select_top() is the same over a stored index."""
    chunks = chunks.select(key, "text")
    if most < 1:
        return picked(chunks, [], {}, most)
    best = top_k(min_max(bm25_scores(chunks, query, key)), OVERSAMPLE * most, key)
    got = [r.asDict() for r in best.join(chunks, key).select(key, "text", "score").orderBy(F.desc("score"), key).collect()]  # 4 * most rows
    words = words_of(got)
    weights = {r.term: r.idf for r in idf(chunks, words).collect()} if words else {}
    return picked(chunks, got, weights, most)


def words_of(rows: list[dict]) -> list[str]:
    """The raw words of some texts, each once: these are looked up among cleaned terms."""
    return sorted({w for r in rows for w in r["text"].split()})


def picked(chunks: DataFrame, rows: list[dict], weights: dict[str, float], most: int) -> DataFrame:
    """The rows (key, text, score) that MMR picks, with rank; chunks gives the types of key and text."""
    picks = mmr(rows, most, LAMBDA, overlap_similarity(weights))
    schema = ", ".join(f"{c} {t}" for c, t in chunks.dtypes) + ", score double, rank int"
    return chunks.sparkSession.createDataFrame([(*(p[c] for c in chunks.columns), p["score"], i) for i, p in enumerate(picks, 1)], schema)


def raw_words(c):
    return F.array_remove(F.split(c, SPACE + "+"), "")
