"""Repository summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST, README_BYTES = 20, 1000


def first_files(files: DataFrame, most: int = MOST) -> DataFrame:
    return files.select("path").orderBy("path").limit(most)


def distinct_symbols(signals: DataFrame, most: int = MOST) -> DataFrame:
    """The first symbols in alphabetical order; signals: newline-joined, a row per file."""
    s = signals.select(F.explode(F.split("signals", "\n")).alias("symbol")).where("symbol <> ''")
    return s.distinct().orderBy("symbol").limit(most)


def readme(files: DataFrame) -> DataFrame:
    """The first README_BYTES bytes of the first non-empty readme.md."""
    r = files.where(F.lower("path").endswith("readme.md") & (F.length(F.col("content").cast("binary")) > 0))
    return r.agg(F.min_by(F.substring(F.col("content").cast("binary"), 1, README_BYTES), "path").alias("readme")).select(F.expr("make_valid_utf8(cast(readme as string))").alias("readme"))


def build_summary(files: DataFrame, signals: DataFrame) -> str:
    """Files, symbols and readme as text: at most MOST names of each and one extract reach the driver."""
    names = [r.path for r in first_files(files).collect()]
    symbols = [r.symbol for r in distinct_symbols(signals).collect()]
    head = readme(files).first().readme
    out = "Files:\n" + "".join(f"- {n}\n" for n in names) + "\nSymbols:\n" + "".join(f"- {s}\n" for s in symbols)
    return out + (f"\nREADME:\n{head}" if head else "")
