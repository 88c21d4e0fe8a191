"""PII by information-theoretic sanitisation, as DataFrame operations only.

Patterns find the protected entities themselves: e-mail, IP, card and phone numbers. Other
words can give an entity away as well. How much a term tells about an entity is estimated
from the whole corpus, in bits. Of all places of terms, the share within REACH characters of an entity is the
chance to meet it, and its negative logarithm the uncertainty; of the term's own places the share there is the chance given the term, and
leaves some uncertainty. A term that stands by one entity in at least MIN_CONTEXTS different contexts and
tells at least MIN_BITS about it is generalised if at most GENERALISE_BITS are left, and
removed if at most REMOVE_BITS are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import cut, where_computed

KINDS = ("email", "ip", "card", "phone")
#: Possessive forms of the base patterns: runs that cannot match are not tried again from every
#: place in them. \G is the end of the match before. A card needs 12 digits, so shorter runs don't match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
HINTS = {"email": "contains(t, '@')", "ip": "t rlike '[0-9]\\\\.[0-9]'", "card": "t rlike '[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]'", "phone": "contains(t, '+')"}
REACH, MIN_CONTEXTS = 60, 5
#: Bits that a term must tell about an entity, and that it may leave open at most.
MIN_BITS, GENERALISE_BITS, REMOVE_BITS = 1.0, 1.0, 0.152
#: The same as shares of the term's places; a share that is equal to one counts.
GENERALISE, REMOVE = (round(2**-x, 4) for x in (GENERALISE_BITS, REMOVE_BITS))
#: As many terms may go into an expression; more are joined.
MAX_LITERAL_TERMS = 2000
_TERM = r"\p{L}{4,}"


_NONE = "cast(array() as array<struct<start:int, kind:int, end:int, value:string>>)"


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    x = f"(ascii(substr({digits}, length({digits}) + 1 - i, 1)) - 48)"
    return f"aggregate(sequence(1, length({digits})), 0, (a, i) -> a + if(i % 2 = 0, if({x} > 4, 2 * {x} - 9, 2 * {x}), {x})) % 10 = 0"


_VALID = {
    "email": "true",
    "ip": "forall(split(s.value, '[.]'), p -> length(ltrim('0', p)) <= 3 and cast(concat('0', right(p, 3)) as int) <= 255)",
    "card": f"length({_digits('s.value')}) between 12 and 19 and {_luhn(_digits('s.value'))}",
    "phone": f"length({_digits('s.value')}) between 9 and 15",
}


def _spans(kind: str, pattern: Column | None = None) -> Column:
    """Matches in column t as structs (start, kind, end, value): lengths of the text between the
    matches give their places."""
    p = "pattern" if pattern is not None else "r'" + PATTERNS[kind] + "'"
    number = len(KINDS) if kind == "term" else KINDS.index(kind)
    after = "a.at + length(x.b[i]) + length(x.m[i])"
    fold = (
        f"aggregate(sequence(0, size(x.m) - 1), named_struct('at', 0, 'out', {_NONE}), (a, i) -> named_struct('at', {after}, 'out', "
        f"array_append(a.out, named_struct('start', a.at + length(x.b[i]), 'kind', {number}, 'end', {after}, 'value', x.m[i])))).out"
    )
    both = f"array(named_struct('m', regexp_extract_all(t, {p}, 0), 'b', split(t, {p}, -1)))"
    return F.expr(f"transform({both}, x -> if(size(x.m) = 0, {_NONE}, {fold}))[0]")


def find_base(docs: DataFrame) -> DataFrame:
    """(doc_id, t, base): t is the text, null as empty; base the valid entities by start, then kind."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    for k in KINDS:
        d = d.withColumn(f"_{k}", F.when(F.expr(HINTS[k]), _spans(k)).otherwise(F.expr(_NONE)))
    valid = [F.expr(f"filter(_{k}, s -> {_VALID[k]})") for k in KINDS]
    return d.select("doc_id", "t", F.array_sort(F.concat(*valid)).alias("base"))


def disclosing_terms(found: DataFrame) -> DataFrame:
    """(term, share, bits): terms that give an entity away, the share of their places near it (-log2 of it is the
    uncertainty left), and the bits that the term tells about the entity. found: from find_base()."""
    e = where_computed(found, F.size("base") > 0).select("t", F.explode("base").alias("s"))
    near = F.concat(
        F.expr(f"substr(t, greatest(1, s.start - {REACH - 1}), least({REACH}, s.start))"), F.lit(" | "), F.expr(f"substr(t, s.end + 1, {REACH})")
    )
    e = e.select(F.lower("s.value").alias("entity"), near.alias("near"))
    e = e.select("entity", F.xxhash64("near").alias("context"), F.explode(F.transform(F.regexp_extract_all("near", F.lit(_TERM), F.lit(0)), lambda w: F.lower(w))).alias("term"))
    # copies of a text repeat its contexts: they count as places, not as evidence
    by_context = e.groupBy("entity", "term", "context").agg(F.count("*").alias("n"))
    pairs = by_context.groupBy("entity", "term").agg(F.count("*").alias("contexts"), F.sum("n").alias("n_et")).where(F.col("contexts") >= MIN_CONTEXTS)
    pairs = cut(pairs)
    n_terms = pairs.select("term").distinct().count()
    if not n_terms:
        return pairs.select("term", F.lit(0.0).alias("share"), F.lit(0.0).alias("bits")).limit(0)
    places = found.select(F.explode(F.transform(F.regexp_extract_all("t", F.lit(_TERM), F.lit(0)), lambda w: F.lower(w))).alias("term"))
    wanted = pairs.select("term").distinct()
    # the terms are few as long as they are counted to be; else both sides are dealt out by term
    wanted = wanted.withColumn("_wanted", F.col("term"))
    wanted = F.broadcast(wanted) if n_terms <= 50_000 else wanted
    # one pass: the places of each of them, and of all other terms together
    n_t = cut(places.join(wanted, "term", "left").groupBy("_wanted").agg(F.count("*").alias("n_t")))
    n = n_t.agg(F.sum("n_t")).first()[0]
    n_t = n_t.where("_wanted is not null").withColumnRenamed("_wanted", "term")
    n_e = by_context.groupBy("entity").agg(F.sum("n").alias("n_e"))  # the places near the entity
    share = F.col("n_et") / F.greatest("n_t", "n_et")
    before = -F.log2(F.least(F.col("n_e") / F.lit(float(n)), F.lit(1.0)))
    told = pairs.join(n_t, "term").join(n_e, "entity").select("term", share.alias("share"), (before + F.log2(share)).alias("bits"))
    told = told.where((F.col("bits") >= MIN_BITS) & (F.col("share") >= GENERALISE))
    return cut(told.groupBy("term").agg(F.max("share").alias("share"), F.max("bits").alias("bits")))


def _with_held(found: DataFrame, terms: DataFrame, name: str) -> DataFrame:
    """found with the terms that a row's text holds, as an array; by a join where they are more than MAX_LITERAL_TERMS."""
    known = terms.limit(MAX_LITERAL_TERMS + 1).collect()
    words = F.array_distinct(F.transform(F.regexp_extract_all("t", F.lit(_TERM), F.lit(0)), lambda w: F.lower(w)))
    if not known:
        return found.withColumn(name, F.array().cast("array<string>"))
    if len(known) <= MAX_LITERAL_TERMS:
        return found.withColumn(name, F.array_intersect(words, F.array(*(F.lit(r.term) for r in known))))
    own = found.withColumn("_row", F.xxhash64("doc_id", "t"))
    hits = own.select("_row", F.explode(words).alias("term")).join(terms, "term", "left_semi").groupBy("_row").agg(F.collect_set("term").alias(name))
    return own.join(hits, "_row", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>"))).drop("_row")


def with_terms(found: DataFrame, terms: DataFrame) -> DataFrame:
    """found with spans: base and the places of disclosing terms outside base, by start, then kind."""
    if terms.isEmpty():
        return found.withColumn("spans", F.col("base"))
    d = _with_held(found, terms, "_hit")
    pattern = F.concat(F.lit("(?iu)(?<!\\p{L})(?:"), F.array_join("_hit", "|"), F.lit(")(?!\\p{L})"))
    d = d.withColumn("pattern", pattern)
    d = d.withColumn("_terms", F.when(F.size("_hit") > 0, _spans("term", F.col("pattern"))).otherwise(F.expr(_NONE)))
    free = F.expr("filter(_terms, s -> not exists(base, b -> s.start < b.end and b.start < s.end))")
    return d.select("doc_id", "t", "base", F.array_sort(F.concat("base", free)).alias("spans"))


def _listed(column: str) -> Column:
    names = F.array(*(F.lit(k) for k in (*KINDS, "term")))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms.

    Null text counts as empty. Repeated rows get a row each; other columns aren't read.
    """
    found = find_base(docs)
    d = with_terms(found, disclosing_terms(found))
    return d.select(
        "doc_id",
        *(F.expr(f"size(filter(base, s -> s.kind = {i}))").cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_terms"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id and text, with entities and generalised terms replaced by their kind in brackets, and terms
    whose share is at least REMOVE left out."""
    found = find_base(docs)
    terms = disclosing_terms(found)
    d = _with_held(with_terms(found, terms), terms.where(F.col("share") >= REMOVE), "_gone")
    names = "array('email', 'ip', 'card', 'phone', 'term')"
    put = f"if(s.kind = {len(KINDS)} and array_contains(_gone, lower(s.value)), '', concat('[', {names}[s.kind], ']'))"
    text = (
        "aggregate(spans, named_struct('at', 0, 'out', ''), (a, s) -> if(s.start < a.at, a, "
        f"named_struct('at', s.end, 'out', concat(a.out, substr(t, a.at + 1, s.start - a.at), {put}))), "
        "a -> concat(a.out, substr(t, a.at + 1)))"
    )
    return d.select("doc_id", F.expr(text).alias("text"))
