"""Ignore rules: the last rule that matches decides."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Fixed values.
DEFAULTS = (".git/", "node_modules/", "vendor/", "dist/", "build/", "*.lock", "*.min.js")


@dataclass(frozen=True)
class Rule:
    clean: str
    is_dir: bool
    negated: bool

    @property
    def compound(self) -> bool:
        return "/" in self.clean

    @property
    def regex(self) -> str:
        return "^" + glob_regex(self.clean) + "$"


def glob_regex(glob: str) -> str:
    """* and ? stay within a path segment; [...] is a class, with ^ for negation; \\ quotes."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        elif c == "[" and (z := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : z]
            out.append("[" + ("^" + inner[1:] if inner[0] == "^" else inner).replace("[", "\\[") + "]")
            i = z
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def parse(lines: list[str]) -> list[Rule]:
    rules = []
    for raw in lines:
        p = raw.strip()
        if not p:
            continue
        negated = p.startswith("!")
        p = p.removeprefix("!")
        rules.append(Rule(p.removesuffix("/"), p.endswith("/"), negated))
    return rules


def load(spark: SparkSession, root: str, user: list[str] | None = None) -> list[Rule]:
    """Defaults, the user's, .gitignore, .aiignore; blank lines and comments are dropped, missing files skipped."""
    lines = [*DEFAULTS, *(user or [])]
    for name in (".gitignore", ".aiignore"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path):  # Spark's readers pass over names that begin with a point
            stream = fs.open(path)
            text = bytes(spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode(errors="replace")
            stream.close()
            lines += [x.strip() for x in text.split("\n") if x.strip() and not x.strip().startswith("#")]
    return parse(lines)


def ignored(path: Column, is_dir: Column, rules: list[Rule]) -> Column:
    """Whether a relative path is ignored. Every rule is one predicate, so no join is needed."""
    base = F.regexp_extract(path, "([^/]*)/*$", 1)
    segments = F.split(path, "/")

    def match(r: Rule) -> Column:
        rx = r.regex
        if not r.compound:
            hit = F.exists(segments, lambda s: s.rlike(rx))
            return hit & ~((base == r.clean) & (is_dir != F.lit(r.is_dir)))
        hit = path.rlike(rx)
        if r.is_dir:
            hit = hit | (is_dir & ((path == r.clean) | F.startswith(path, F.lit(r.clean + "/"))))
        else:
            hit = hit | base.rlike(rx)
        return hit

    return reduce(lambda acc, r: F.when(match(r), F.lit(not r.negated)).otherwise(acc), rules, F.lit(False))


def excluded(path: Column, rules: list[Rule]) -> Column:
    """Whether a file is left out: it is ignored itself, or one of its folders is, whatever lies below."""
    parts = F.split(path, "/")
    above = F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i > 0), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.exists(above, lambda p: ignored(p, F.lit(True), rules)) | ignored(path, F.lit(False), rules)
