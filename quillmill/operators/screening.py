"""Screening of items by an ensemble: signals per item, summaries per group and region, the cohort's trend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions.columns import binary_confidence, binary_entropy, canonical_group, continuum_verdict, group_rank, nan_to_null, roi_prediction
from quillmill.operators.metrics import roc_auc
from quillmill.operators.stats import kruskal_wallis, mann_whitney_adjacent, spearman_trend


def ensemble_signal(df: DataFrame, item: list[str], p: str, proto: str | None = None, ood: str | None = None) -> DataFrame:
    """Per item: mean p, its spread over members (epistemic, 0 for one member), confidence, entropy, mean prototype p and OOD score."""
    extra = [F.avg(nan_to_null(F.col(c).cast("double"))).alias(n) for c, n in ((proto, "p_proto"), (ood, "ood_score")) if c]
    out = df.groupBy(*item).agg(F.avg(p).alias("p"), F.stddev_pop(p).alias("epistemic"), *extra)
    return out.withColumns({"confidence": binary_confidence("p"), "entropy": binary_entropy("p")})


def with_group(df: DataFrame, raw: str) -> DataFrame:
    """``grp`` and ``group_rank`` of a group's name as written."""
    return df.withColumn("grp", canonical_group(raw)).withColumn("group_rank", group_rank("grp"))


def _means(df: DataFrame) -> list:
    return [F.avg(nan_to_null(F.col(c).cast("double"))).alias(f"mean_{c}") for c in ("p_proto", "ood_score", "confidence", "entropy", "epistemic") if c in df.columns]


def group_screening_summary(df: DataFrame, keys: list[str], p: str = "p", threshold: float = 0.5) -> DataFrame:
    """Per group: n, mean, population deviation, 95 % interval by the sample deviation (null for one row), median, means, percent positive."""
    half = F.when(F.count(p) > 1, 1.96 * F.stddev_samp(p) / F.sqrt(F.count(p).cast("double")))
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.stddev_pop(p).alias("std_p"), (F.avg(p) - half).alias("ci_low"), (F.avg(p) + half).alias("ci_high"),
        F.percentile(p, F.lit(0.5)).alias("median_p"), *_means(df), (100 * F.avg((F.col(p) >= threshold).cast("double"))).alias("percent_positive"))


def roi_screening_summary(df: DataFrame, keys: list[str], p: str = "p", threshold: float = 0.5) -> DataFrame:
    """Per group and region: n_frames, mean and deviation of p, mean confidence and OOD, and the region's prediction."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n_frames"), F.avg(p).alias("mean_p"), F.stddev_pop(p).alias("std_p"), *_means(df))
    return out.withColumn("prediction", roi_prediction("mean_p", threshold))


def normal_vs_cancer_auc(df: DataFrame, group: str = "grp", p: str = "p") -> DataFrame:
    """One row: AUC of p between the two groups whose truth is known."""
    known = df.filter(F.col(group).isin("normal", "cancer")).withColumn("_y", (F.col(group) == "cancer").cast("int"))
    return roc_auc(known, [], "_y", p)


def progression_statistics(df: DataFrame, rank: str = "group_rank", p: str = "p", group: str = "grp", groups: int = 3) -> DataFrame:
    """One row: trend, group test, AUC of the known groups and the verdict."""
    trend = spearman_trend(df, rank, p).select("rho", F.col("p").alias("rho_p"), "n")
    test = kruskal_wallis(df, rank, p, groups).select("h", F.col("p").alias("h_p"))
    auc = normal_vs_cancer_auc(df, group, p)
    return trend.join(F.broadcast(test)).join(F.broadcast(auc)).withColumn("verdict", continuum_verdict("rho", "rho_p"))


def screening_pipeline(members: DataFrame, item: list[str], raw_group: str, roi: str, p: str, threshold: float = 0.5) -> dict[str, DataFrame]:
    """Samples, groups, regions, neighbours and statistics of member predictions."""
    samples = ensemble_signal(with_group(members, raw_group), [*item, roi, "grp", "group_rank"], p)
    return {
        "samples": samples,
        "groups": group_screening_summary(samples, ["grp", "group_rank"], threshold=threshold),
        "rois": roi_screening_summary(samples, ["grp", roi], threshold=threshold),
        "adjacent": mann_whitney_adjacent(samples, "group_rank", "p"),
        "statistics": progression_statistics(samples),
    }
