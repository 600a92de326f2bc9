"""Roll-ups of run records: means over seeds and folds, long and wide tables, rankings, the benchmark score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.columns import nan_to_null

#: Sub-scores of the benchmark: their weight, and the metrics with whether more is better.
BENCHMARK = {
    "classification": (0.35, {"accuracy": True, "balanced_accuracy": True, "f1_macro": True, "mcc": True, "roc_auc": True, "pr_auc": True}),
    "feature": (0.25, {"silhouette": True, "calinski_harabasz": True, "fisher": True, "separation": True, "davies_bouldin": False, "compactness": False}),
    "calibration": (0.15, {"ece": False, "mce": False, "brier": False}),
    "robustness": (0.15, {"balanced_accuracy": True, "f1_macro_std": False, "mcc_std": False}),
    "efficiency": (0.10, {"parameters": False, "model_mb": False, "latency_ms": False}),
}


def _clean(name: str) -> Column:
    return nan_to_null(F.col(name).cast("double"))


def run_mean_std(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean and population deviation of each metric over the other keys, NaN left out."""
    return df.groupBy(*keys).agg(*[f(_clean(m)).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def _sample_std(m: Column) -> Column:
    return F.when(F.count(m) < 2, 0.0).otherwise(F.stddev_samp(m))


def cv_mean_std(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean and sample deviation over folds, 0 for one fold, and n_folds."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_folds"), *[x for m in metrics for x in (F.avg(_clean(m)).alias(f"{m}_mean"), _sample_std(_clean(m)).alias(f"{m}_std"))])


def metrics_long(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return df.select(*keys, *[F.col(m).cast("double") for m in metrics]).unpivot(keys, metrics, "metric", "value")


def cv_summary(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, mean, std, n_folds) with the sample deviation."""
    long = metrics_long(df, keys, metrics)
    return long.groupBy(*keys, "metric").agg(F.avg(nan_to_null("value")).alias("mean"), _sample_std(nan_to_null("value")).alias("std"), F.count("*").alias("n_folds"))


def cv_comparison(summary: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """The means of a summary as one column per metric."""
    return summary.groupBy(*keys).pivot("metric", metrics).agg(F.first("mean"))


def rank_by(df: DataFrame, best: list[str], ties: list[str], name: str = "rnk") -> DataFrame:
    """Place from 1 by several columns, largest first; the table is one of results, a row a model."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*[F.desc(c) for c in best], *ties)).cast("long"))


def bench_min_max(df: DataFrame, metrics: dict[str, bool]) -> DataFrame:
    """Each metric scaled to [0, 1] over the table, turned where less is better; missing or constant gives 0.5."""
    ends = df.agg(*[f(_clean(m)).alias(f"_{n}_{m}") for m in metrics for n, f in (("lo", F.min), ("hi", F.max))])

    def unit(m: str, up: bool) -> Column:
        x = F.try_divide(_clean(m) - F.col(f"_lo_{m}"), F.col(f"_hi_{m}") - F.col(f"_lo_{m}"))
        return F.coalesce(x if up else 1 - x, F.lit(0.5))

    return df.join(F.broadcast(ends)).withColumns({f"n_{m}": unit(m, up) for m, up in metrics.items()}).drop(*[f"_{n}_{m}" for m in metrics for n in ("lo", "hi")])


def benchmark_score(df: DataFrame, ties: list[str], parts: dict = BENCHMARK) -> DataFrame:
    """Sub-scores, their weighted sum ``overall`` and the place ``rnk``; metrics that the table lacks are left out.

    A sub-score without any metric counts 0.5.
    """
    have = {m: up for _, ms in parts.values() for m, up in ms.items() if m in df.columns}
    scaled, subs = bench_min_max(df, have), {}
    for name, (_, ms) in parts.items():
        known = [F.col(f"n_{m}") for m in ms if m in have]
        subs[name] = F.round(sum(known[1:], known[0]) / len(known), 6) if known else F.lit(0.5)
    scored = scaled.withColumns(subs)
    overall = [F.col(name) * w for name, (w, _) in parts.items()]
    return rank_by(scored.withColumn("overall", F.round(sum(overall[1:], overall[0]), 6)), ["overall"], ties)


#: Column lists of the tables that a ranked benchmark is written as.
BENCHMARK_TABLES = {
    "overall": ("overall", *BENCHMARK),
    "classification": tuple(BENCHMARK["classification"][1]),
    "feature": tuple(BENCHMARK["feature"][1]),
    "calibration": tuple(BENCHMARK["calibration"][1]),
    "efficiency": tuple(BENCHMARK["efficiency"][1]),
}


def benchmark_tables(ranked: DataFrame, ids: list[str], tables: dict = BENCHMARK_TABLES) -> dict[str, DataFrame]:
    """Projections of the ranked benchmark, each of the columns that exist."""
    return {name: ranked.select("rnk", *ids, *[c for c in columns if c in ranked.columns]) for name, columns in tables.items()}


def run_record_rollup(df: DataFrame, keys: list[str], metrics: list[str], *, seconds: str = "train_seconds", epoch: str = "best_epoch") -> DataFrame:
    """Mean and population deviation of metrics, mean seconds and best epoch, and seconds per best epoch."""
    timed = df.withColumn("epoch_seconds", F.try_divide(F.col(seconds).cast("double"), F.col(epoch).cast("double")))
    extra = [F.avg(c).alias(f"{c}_mean") for c in (seconds, epoch, "epoch_seconds")]
    spread = [f(_clean(m)).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return timed.groupBy(*keys).agg(*spread, *extra)


def best_epoch(history: DataFrame, keys: list[str], epoch: str = "epoch", score: str = "val_f1", loss: str = "val_loss") -> DataFrame:
    """The epoch of the highest score, ties by lowest loss, then the earliest."""
    by = F.struct(F.col(score), -F.col(loss), -F.col(epoch))
    best = history.groupBy(*keys).agg(F.max_by(F.struct(epoch, score, loss), by).alias("b"))
    return best.select(*keys, F.col(f"b.{epoch}").alias("best_epoch"), f"b.{score}", f"b.{loss}")


def ema_by_key(df: DataFrame, keys: list[str], order: str, value: str, beta: float = 0.99) -> DataFrame:
    """(keys, n, ema): the average that starts at a key's first value and keeps ``beta`` of itself at each next one.

    The weight of a value depends on its place from the end alone, so keys of any length are summed
    from buckets of places: no list of a key's values is built.
    """
    from quillmill.operators.running import numbered

    # places by the order itself, which falls evenly in a sequence
    placed = numbered(df.filter(F.col(value).isNotNull()), keys, [F.col(value)], spread=F.col(order))
    weight = F.pow(F.lit(beta), F.col("of") - F.col("nth")) * F.when(F.col("nth") == 1, 1.0).otherwise(1 - beta)
    return placed.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(weight * F.col(value)).alias("ema"))
