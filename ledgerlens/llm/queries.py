"""The operators of this subpackage, applied to the given tables.

Each query takes ``(spark, sf_dir)``, reads its whole table and returns the
operator's full result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (fill_middle, filter_audit, html_text, license_scan, line_dedup, mixing, near_join,
               packing, quality, sharding, toxicity, url_filter, vector_search)
from ._common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from each document."""
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each document, with 24 shards and with 25."""
    return sharding.shard_slots(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near copies of each document."""
    return near_join.near_components(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of each document."""
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    return found.drop("spans")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on each page's url."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bin of each piece of each document."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    return vector_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics of each document and whether the rules keep it."""
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.withColumns({c: F.round(c, 6) for c in ("char_js", "word_js")})


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of each document."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes from each source, in every order."""
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's fill-in-middle form and of the text rebuilt from it."""
    return fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each document without the lines that ten documents or more share."""
    kept = line_dedup.drop_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_mixing, op2_sharding, op3_ngram_jaccard, op4_license_scan, op5_html_extraction,
    op6_url_filter, op7_best_fit_packing, op8_nearest_vectors, op9_quality_rules, op10_toxicity,
    op11_filter_audit, op12_fill_middle, op13_line_dedup)}
