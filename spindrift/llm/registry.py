"""The queries of this subpackage, over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import bpe, concurrency, decontam, line_dedup, lm, periodic, pii, quality, secrets, simhash, suffix_dedup, toxicity, url_filter
from spindrift.llm.common import read
from spindrift.llm.sql import ORACLES


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(read(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digests(read(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontamination_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(read(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(read(spark, sf_dir, "documents"))


def op11_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    return lm.score_documents(read(spark, sf_dir, "documents"), held_out=remainder == 2, tune=remainder == 5)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(periodic.stuttered(read(spark, sf_dir, "documents")))


def op13_peak_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales, lines, clients = (read(spark, sf_dir, t) for t in ("sales", "sale_lines", "clients"))
    return concurrency.sales_concurrency(sales, lines, clients, total=-2).withColumnsRenamed({"g": "nation_id", "open_sum": "open_cents"})


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_suffix_dedup, op3_decontamination, op4_simhash, op5_line_dedup,
        op6_url_filter, op7_quality_rules, op8_toxicity, op9_byte_bpe, op10_pii,
        op11_lm_score, op12_periodic_runs, op13_peak_concurrency,
    )
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
