"""Query analysis and tokenising, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
_A, _Z = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"  # ASCII word boundaries, whatever the regex engine's \b means
IDENTIFIER = _A + "([a-zA-Z]+[A-Z][a-zA-Z0-9]*|[a-z][a-z0-9]*_[a-z][a-z0-9_]*)" + _Z
FILE_REF = _A + r"[0-9A-Za-z_\-]*[0-9A-Za-z_][\-]*\.(go|ts|js|py|rs|java|cpp|c|rb|cs|json|yaml|yml|toml|md)" + _Z
PATH = r"[0-9A-Za-z_\-]+/[0-9A-Za-z_\-]+(/[0-9A-Za-z_\-]+)*"
ERRORS = "(?i)(panic:|error:|undefined:|cannot|failed to|nil pointer|index out of|no such file|unexpected token|syntax error)"
CODE_WORDS = ("function", "method", "struct", "interface", "command", "package", "module", "var", "handler", "client", "server", "config", "log")
SPACE = "(?U)\\s"


def tokenize(c: Column) -> Column:
    """Lower case; what is neither letter, number nor white space separates."""
    return F.array_remove(F.split(F.lower(c), "[^a-z0-9\\p{L}\\p{N}]+"), "")


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def identifiers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(IDENTIFIER), F.lit(0))


def is_searchable(c: Column) -> Column:
    low = F.lower(c)
    out = c.rlike(IDENTIFIER) | c.rlike(FILE_REF) | c.rlike(PATH) | c.rlike(ERRORS)
    for w in CODE_WORDS:
        out = out | low.contains(w)
    return F.coalesce((trim(c) != "") & out, F.lit(False))


def text_signals(c: Column) -> Column:
    return F.array_join(F.array_distinct(identifiers(c)), "\n")


def normalize_symbol(c: Column) -> Column:
    return F.substring_index(c, ".", -1)


def normalize_ext(c: Column) -> Column:
    t = F.lower(trim(c))
    return F.when(t == "", "").when(F.startswith(t, F.lit(".")), t).otherwise(F.concat(F.lit("."), t))


def normalize_model(c: Column) -> Column:
    return F.substring_index(c, ":", 1)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


#: What is said of a block that can't be read.
MALFORMED, UNTERMINATED = "malformed fenced code block", "unterminated fenced code block"


def code_block(c: Column) -> Column:
    """struct(content, language, error) of the first fenced block, as it stands, line ends included; without a fence the text itself."""
    fence = F.instr(c, "```")
    rest = F.substr(c, fence + 3)
    line = F.instr(rest, "\n")
    body = F.substr(rest, line + 1)
    end = F.instr(body, "```")
    error = F.when(fence == 0, None).when(line == 0, MALFORMED).when(end == 0, UNTERMINATED)
    good = (fence > 0) & error.isNull()
    return F.struct(
        F.when(fence == 0, c).when(good, F.substr(body, F.lit(1), end - 1)).otherwise("").alias("content"),
        F.when(good, trim(F.substr(rest, F.lit(1), line - 1))).otherwise("").alias("language"),
        error.alias("error"),
    )


def separator(language: Column) -> Column:
    return F.when(language.isin("go", "javascript", "js", "typescript", "ts"), "//").when(language.isin("python", "py"), "#").otherwise("")


def extract_json(c: Column) -> Column:
    """From the first { to the last }, or an empty string."""
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)


def enrich(prompt: Column, summary: Column) -> Column:
    return F.concat(prompt, F.lit("\n\n"), summary)


def clean_url(c: Column) -> Column:
    """A scheme for //host; the target of a redirect's uddg parameter; anything unreadable as it is."""
    full = F.when(F.startswith(c, F.lit("//")), F.concat(F.lit("https:"), c)).otherwise(c)
    target = F.try_url_decode(F.try_parse_url(full, F.lit("QUERY"), F.lit("uddg")))
    return F.when(F.length(target) > 0, target).otherwise(full)


def replace_lines(c: Column, start: int, end: int, content: str) -> Column:
    """Lines start to end (from 1, clamped) replaced by content."""
    lines = F.split(c, "\n", -1)
    a = max(1, start)
    head = F.slice(lines, 1, a - 1) if a > 1 else F.array().cast("array<string>")
    tail = F.slice(lines, F.lit(max(end, a - 1) + 1), F.greatest(F.size(lines) - max(end, a - 1), F.lit(0)))
    return F.array_join(F.concat(head, F.array(F.lit(content)), tail), "\n")


def line_range(c: Column, start: int, end: int) -> Column:
    lines = F.split(c, "\n", -1)
    return F.array_join(F.slice(lines, max(1, start), max(0, end - max(1, start) + 1)), "\n")


def config_hash(extensions: list[str], patterns: list[str], model: str = "") -> str:
    """A digest that tells any two settings apart, the model included."""
    import hashlib
    import json

    return hashlib.sha1(json.dumps([extensions, patterns, model]).encode()).hexdigest()


def index_name(root: str) -> str:
    import hashlib
    import os
    import re

    base = re.sub(r"[^a-z0-9._-]+", "_", os.path.basename(root.rstrip("/")).lower()).strip("_")
    return f"{base}_{hashlib.sha1(root.encode()).hexdigest()[:8]}"


def register(spark: SparkSession) -> None:
    """SQL functions of the same names."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION identifiers(s STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all(s, r'{IDENTIFIER}', 0)")


def add_signals(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn("signals", text_signals(F.col(column)))
