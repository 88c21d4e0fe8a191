"""Quality rules as a bitmask ledger, as DataFrame operations only.

Every rule is evaluated once per document. The ledger keeps what was measured and one bit
for each rule that the document fails. Policies are versioned masks over those bits:
applying one, comparing two, and finding what each rule alone costs are bitwise
operations and counts on the ledger, without another look at the texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import where_computed

SPACE = "[ \\t\\n\\u000B\\f\\r]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Rules by bit: name and the condition of failure, over the measurements. Positions never change;
#: a new rule takes the next bit. Fixed values.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("long_words", "word_chars > 20 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
)
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [n for n, _ in RULES]
        return sum(1 << names.index(r) for r in self.rules)


POLICIES = {
    p.version: p
    for p in (
        Policy("v1", BASE),
        Policy("v2", (*BASE, "symbols", "repeated_lines")),
        Policy("v3", (*BASE, "symbols", "repeated_lines", "long_words", "short_words")),
    )
}
CURRENT = "v3"


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the MEASURES of column text, each under its name after an underscore."""
    t = F.coalesce(F.col(text), F.lit(""))
    # expressions that others build on are columns of their own, so each is computed once
    d = docs.withColumn("_words", F.array_remove(F.split(t, SPACE), ""))
    d = d.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    window = ", ".join(f"_hashes[i + {k}]" for k in range(WINDOW))
    n_windows = F.size("_hashes") - (WINDOW - 1)
    d = d.withColumn("_windows", F.when(n_windows > 1, F.expr(f"transform(sequence(0, size(_hashes) - {WINDOW}), i -> xxhash64({window}))")).otherwise(F.array().cast("array<bigint>")))
    # texts without a repeated window, which are most, are done here
    d = d.withColumn("_repeats", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    d = d.withColumn("_sorted", F.when(F.col("_repeats"), F.expr("sort_array(transform(_windows, (h, i) -> struct(h, i)))")))
    twice = "coalesce(get(_sorted, k - 1).h = get(_sorted, k).h, false) or coalesce(get(_sorted, k + 1).h = get(_sorted, k).h, false)"
    d = d.withColumn("_starts", F.expr(f"sort_array(transform(filter(sequence(0, size(_sorted) - 1), k -> {twice}), k -> get(_sorted, k).i))"))
    d = d.withColumn("_lines", F.filter(F.split(t, "\n", -1), lambda x: x.rlike("[^ \\t\\n\\u000B\\f\\r]")))
    covered = f"aggregate(transform(_starts, (x, k) -> least({WINDOW}, coalesce(get(_starts, k + 1) - x, {WINDOW}))), 0L, (a, x) -> a + x)"
    return d.select(
        *docs.columns,
        F.size("_words").cast("long").alias("_n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("_word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("_n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("_n_dup_lines"),
        F.size("_lines").cast("long").alias("_n_lines"),
        F.when(F.col("_repeats"), F.expr(covered)).otherwise(F.lit(0)).cast("long").alias("_n_repeat_words"),
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")


def ledger(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, the MEASURES, failed (bit i: RULES[i] fails).

    Null text has no words. Other columns of docs aren't read, so their names don't matter;
    repeated rows get a row each.
    """
    m = measured(docs.select("doc_id", "text")).select("doc_id", *(F.col(f"_{c}").alias(c) for c in MEASURES))
    return m.withColumn("failed", failed_bits())


def failed_bits(prefix: str = "") -> Column:
    """Bit i: RULES[i] fails; the measurements are columns of their names after prefix."""
    bits = F.lit(0).cast("long")
    for i, (_, condition) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(_prefixed(condition, prefix)), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def kept(policy: Policy, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(policy.mask)) == 0


def report(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with base_failed and kept, the verdict of a policy."""
    base = F.col("failed").bitwiseAND(F.lit(POLICIES["v1"].mask)) != 0
    return ledger(docs).select("doc_id", *(c for c in MEASURES if c != "n_lines"), base.alias("base_failed"), kept(POLICIES[version]).alias("kept"), "failed")


def keep_good(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The rows of docs, with their columns, that pass a policy."""
    names = [f"_doc_{i}" for i in range(len(docs.columns))]  # no clash with names of our own
    text = names[docs.columns.index("text")]
    m = measured(docs.toDF(*names), text)
    m = m.withColumn("_failed", failed_bits("_"))
    return where_computed(m, kept(POLICIES[version], "_failed")).select(*names).toDF(*docs.columns)


def _prefixed(condition: str, prefix: str) -> str:
    return re.sub(r"\b(" + "|".join(MEASURES) + r")\b", prefix + r"\1", condition)


def ablation(ledger_rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: rule, n_failed (documents that fail it), n_only (documents that it
    alone rejects, which are kept without it), n_rejected (by the policy). The documents are first counted by
    failure bits, of which there are at most 2**len(RULES)."""
    policy = POLICIES[version]
    by_bits = ledger_rows.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    names = [n for n, _ in RULES]
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in policy.rules)))
    r = by_bits.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    return r.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("bits") != 0, F.col("n")).otherwise(0)).alias("n_rejected"),
    )
