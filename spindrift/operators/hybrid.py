"""Symbol lookup first, then similarity: hybrid search with retry."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import text as tx
from spindrift.operators.topk import search, top_k

WEAK = 0.5
_PY_IDENTIFIER = re.compile(tx.IDENTIFIER)


def find_by_symbols(items: DataFrame, symbols: list[str], limit: int, prompt: str | None = None) -> DataFrame:
    """lookup_symbols() for the identifiers of one prompt (without it, the symbols themselves), in the order of the identifiers,
    and for each by score."""
    if limit < 1 or not symbols:
        return items.limit(0).withColumn("ident", F.lit(0)).withColumn("score", F.lit(0.0))
    prompt = " ".join(symbols) if prompt is None else prompt
    asked = items.sparkSession.createDataFrame([(i, s, prompt) for i, s in enumerate(symbols)], "ident int, symbol string, prompt string")
    # the identifiers of one prompt: as a filter they reach the files, which are sorted by symbol
    named = items.where(F.col("symbol").isin(sorted({s.rpartition(".")[2] for s in symbols})))
    found = lookup_symbols(named, F.broadcast(asked), limit)
    return found.orderBy("ident", "place").drop("place")


def lookup_symbols(items: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """Items of each symbol asked for (ident, symbol, prompt), which may be qualified: the first limit of each in the order
    of the table, with ident, score and their place by score (ties in the order of the table)."""
    asked = asked.select("ident", tx.normalize_symbol(F.col("symbol")).alias("symbol"), "prompt")
    w = Window.partitionBy("ident").orderBy("file_path", "start_line")
    found = items.join(asked, "symbol").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit)
    best = Window.partitionBy("ident").orderBy(F.desc("score"), "file_path", "start_line")
    ranked = found.withColumn("score", score_symbol(F.col("prompt"))).withColumn("place", F.row_number().over(best))
    return ranked.select(*items.columns, "ident", "score", "place")


def score_symbol(prompt):
    """1, and 1 more if the symbol is the whole prompt, less a thousandth for each line of its length."""
    return 1.0 + F.when(F.col("symbol") == prompt, 1.0).otherwise(0.0) - 0.001 * (F.col("end_line") - F.col("start_line"))


def hybrid_search(items: DataFrame, prompt: str, embed: Callable[[str], list[float]], k: int, mmr: bool = False, prefer_symbol: bool = False) -> DataFrame:
    """Symbols named in the prompt; if they give fewer than k items, the rest by similarity, but with
    prefer_symbol none. Items found both ways appear twice. More than k items may come back if the symbols alone give them."""
    symbols = [m.group() for m in _PY_IDENTIFIER.finditer(prompt)]
    columns = [*items.columns, "score"]
    found = find_by_symbols(items, symbols, k, prompt).select(*columns)
    n = found.count() if symbols else 0
    if n >= k or n and prefer_symbol:
        return found
    rest = search(items, embed(prompt), k - n, mmr).select(*columns)
    if not n:
        return rest
    return top_k(found.unionByName(rest), k, "file_path", "start_line")


def run_query(items: DataFrame, prompt: str, embed: Callable[[str], list[float]], k: int, mmr: bool = False, summary: str = "") -> DataFrame:
    """hybrid_search(), on the prompt enriched with the repository's summary if it is too vague;
    if the result is weak, once more by similarity with the summary."""
    searchable = items.sparkSession.createDataFrame([(prompt,)], "q string").select(tx.is_searchable(F.col("q"))).first()[0]
    enriched = f"{prompt}\n\n{summary}"
    out = hybrid_search(items, prompt if searchable else enriched, embed, k, mmr)
    if is_weak(out) and searchable and summary:
        out = search(items, embed(enriched), k, mmr).select(*items.columns, "score")
    return out


def is_weak(results: DataFrame) -> bool:
    """No result, or a best score under WEAK."""
    best = results.agg(F.max("score")).first()[0]
    return best is None or best < WEAK
