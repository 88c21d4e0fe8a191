"""URL filter by a Bloom filter cascade, as DataFrame operations only.

Level 1 of a cascade encodes the listed keys. The keys of the corpus that it wrongly
lets through are encoded by level 2, listed keys that level 2 wrongly lets through by
level 3, and so on until a level makes no mistake. Walking the levels until one says no
then gives exact membership for every key of the corpus, and no join is needed: the
levels are bitmaps in the expression. A cascade over MAX_BYTES isn't put into an
expression; its keys are then looked up by a hash join on the whole key instead.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import cut

#: Rules: host suffix and path prefix. Fixed values.
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
#: Host labels that the method blocks where no rule fits. Fixed values.
BLOCKED_LABELS = ("adult-x", "free-bets", "ads-track", "casino", "porn", "xxx", "bets", "gambling", "malware", "phishing")
BITS_PER_KEY, HASHES = 10, 3
MAX_BYTES = 8 << 20
_WORD = 64


@dataclass
class Cascade:
    levels: list  # of (number of bits, words of 64 bits as signed integers)

    def bytes(self) -> int:
        return sum(8 * len(w) for _, w in self.levels)

    def contains(self, key: Column) -> Column:
        """Exact for every key that the cascade was built over."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(_probe(self.levels[i], key, i), out).otherwise(F.lit(i % 2 == 1))
        return out if self.levels else F.lit(False)


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * 16 + j)), F.lit(bits)) for j in range(HASHES)]


def _probe(level, key: Column, number: int) -> Column:
    bits, words = level
    table = F.array(*map(F.lit, words)) if len(words) <= 64 else F.from_json(F.lit("[" + ",".join(map(str, words)) + "]"), "array<bigint>")
    out = F.lit(True)
    for p in _positions(key, number, bits):
        word = F.get(table, (p / _WORD).cast("int"))
        out = out & (word.bitwiseAND(_bit(p)) != 0)
    return out


def _bit(p: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(p, F.lit(_WORD)).cast("int"))


def _level(keys: DataFrame, number: int, count: int):
    """Set the bits of the keys: one row for each word of the bitmap reaches the driver."""
    bits = max(_WORD, -(-count * BITS_PER_KEY // _WORD) * _WORD)
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), number, bits))).alias("p"))
    rows = at.groupBy((F.col("p") / _WORD).cast("int").alias("w")).agg(F.bit_or(_bit(F.col("p"))).alias("v")).collect()
    words = [0] * (bits // _WORD)
    for r in rows:
        words[r.w] = r.v
    return bits, words


def build_cascade(universe: DataFrame, listed: DataFrame) -> Cascade | None:
    """universe, listed: distinct keys (column key). Keys outside the universe are never asked
    for, so listed is taken within it. None, if the levels would exceed MAX_BYTES."""
    inside = cut(universe.join(listed, "key", "left_semi"))
    others = universe.join(listed, "key", "left_anti")
    yes, no = inside, others
    levels: list = []
    while True:
        n = yes.count()
        if not n:
            return Cascade(levels)
        cascade = Cascade(levels)
        if cascade.bytes() + n * BITS_PER_KEY // 8 > MAX_BYTES or len(levels) > 40:
            return None
        levels.append(_level(yes, len(levels), n))
        wrong = cut(no.where(_probe(levels[-1], F.col("key"), len(levels) - 1)))
        yes, no = wrong, yes


def parsed(pages: DataFrame) -> DataFrame:
    """pages with _host and _path; both empty if url is null or has no ://."""
    rest = F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.select("page_id", host.alias("host"), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"))


def lookup_keys(host: Column, path: Column) -> Column:
    """Every host suffix with every path prefix that ends in a slash."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.split(path, "/")
    prefixes = F.when(
        F.startswith(path, F.lit("/")),
        F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))),
    ).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def _member(keys: DataFrame, listed: DataFrame) -> tuple[DataFrame, Column]:
    """keys (column key, and others) with exact membership in listed as a column expression."""
    universe = cut(keys.select("key").distinct())
    cascade = build_cascade(universe, listed)
    if cascade is not None:
        return keys, cascade.contains(F.col("key"))
    marked = listed.select(F.col("key").alias("_listed"))
    return keys.join(marked, keys["key"] == marked["_listed"], "left"), F.col("_listed").isNotNull()


def filter_urls(pages: DataFrame, rules: dict[str, str] | None = None, blocked_labels: tuple = BLOCKED_LABELS) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict.

    A rule fits its host and all subdomains if the path starts with the rule's path; rule paths
    end in a slash; the longest rule that fits wins. Where none fits, a page whose host has a
    blocked label is blocked. Null urls and urls without :// have an empty host and path, no
    rule, and pass. Repeated rows get a row each.
    """
    rules = RULES if rules is None else rules
    spark = pages.sparkSession
    urls = parsed(pages)
    keys = urls.select(F.explode(lookup_keys(F.col("host"), F.col("path"))).alias("key"))
    labels = urls.select(F.explode(F.split("host", r"\.")).alias("key"))
    cascades = {}
    for name, frame, listed in (
        ("allow", keys, [k for k, v in rules.items() if v == "allow"]),
        ("block", keys, [k for k, v in rules.items() if v == "block"]),
        ("label", labels, list(blocked_labels)),
    ):
        cascades[name] = build_cascade(cut(frame.select("key").distinct()), _keys(spark, listed))
    if any(c is None for c in cascades.values()):
        return _joined(urls, rules, blocked_labels)
    found = F.filter(lookup_keys(F.col("host"), F.col("path")), lambda k: cascades["allow"].contains(k) | cascades["block"].contains(k))
    rule = F.expr("aggregate(found, cast(null as string), (a, k) -> if(a is null or length(k) > length(a), k, a))")
    by_label = F.exists(F.split("host", r"\."), lambda k: cascades["label"].contains(k))
    return urls.withColumn("found", found).withColumn("rule", rule).select(
        "page_id", "host", "path", "rule",
        F.when(F.col("rule").isNull(), F.when(by_label, "block").otherwise("allow"))
        .when(cascades["block"].contains(F.col("rule")), "block").otherwise("allow").alias("verdict"),
    )


def _joined(urls: DataFrame, rules: dict[str, str], blocked_labels: tuple) -> DataFrame:
    """filter_urls() where the lists are too long for filters: what they hold is found by joins, and the longest of each row stays."""
    spark = urls.sparkSession
    urls = cut(urls.withColumn("row", F.monotonically_increasing_id()))
    ruled = spark.createDataFrame(list(rules.items()), "key string, says string")
    keys = urls.select("row", F.explode(lookup_keys(F.col("host"), F.col("path"))).alias("key"))
    best = keys.join(ruled, "key").groupBy("row").agg(F.max(F.struct(F.length("key").alias("n"), "key", "says")).alias("best"))
    labels = urls.select("row", F.explode(F.array_distinct(F.split("host", r"\."))).alias("key"))
    bad = labels.join(_keys(spark, list(blocked_labels)), "key").select("row").distinct().withColumn("bad", F.lit(True))
    verdict = F.coalesce(F.col("best.says"), F.when(F.col("bad"), "block").otherwise("allow"))
    return urls.join(best, "row", "left").join(bad, "row", "left").select("page_id", "host", "path", F.col("best.key").alias("rule"), verdict.alias("verdict"))


def listed_urls(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """page_id and listed (boolean) of every row with a page_id: whether any host suffix with any path
    prefix is a key of listed (column key), which may have any size."""
    urls = parsed(pages)
    keys = urls.select("page_id", F.explode_outer(lookup_keys(F.col("host"), F.col("path"))).alias("key"))
    keys, member = _member(keys, listed.select("key").where("key is not null").distinct())
    return keys.groupBy("page_id").agg(F.coalesce(F.bool_or(F.coalesce(member, F.lit(False))), F.lit(False)).alias("listed"))


def _keys(spark: SparkSession, keys: list[str]) -> DataFrame:
    return spark.createDataFrame([(k,) for k in keys], "key string").distinct()
