"""Registered queries of the text operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import collocations, decontaminate, html_extract, line_templates, mixing, near_dedup, quality_model, quality_rules, sanitise, sharding, suffix_dedup, va_cluster, warc
from quillmill.llm.sql import ORACLES as ORACLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table; one in far fewer files than the cluster has cores is dealt out, as texts cost time to read."""
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name != "labels" and len(rows.inputFiles()) < cores // 2 else rows


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with its near-duplicate class; equal texts are members, not pairs."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "is_first")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op3_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms of every document."""
    found = sanitise.find_personal_data(table(spark, sf_dir, "documents"))
    counts = [sanitise.of_kind(F.col("base"), k).alias(f"n_{k}") for k in sanitise.PATTERNS]
    digest = F.sha2(sanitise.joined(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, sanitise.joined(F.col("spans")).alias("spans"))


def op4_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates."""
    out = line_templates.drop_recurring_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the bytes of passages that occurred earlier."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality_model.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, ledger bits and verdict of every document."""
    judged = quality_rules.judged(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of every language."""
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from the archives."""
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def op13_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every whole vector."""
    return va_cluster.cluster_vectors(table(spark, sf_dir, "embeddings"))


def quality_rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per rule of the production policy: documents that fail it, and those that it alone rejects."""
    return quality_rules.ablation(quality_rules.ledger(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_mix, op3_sanitise, op4_line_templates, op5_suffix_dedup, op6_html_extract, op7_shard, op8_quality, op9_decontaminate, op10_quality_rules, op11_collocations, op12_warc, op13_cluster, quality_rule_ablation)}
