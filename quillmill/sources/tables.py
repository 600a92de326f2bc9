"""Stored tables: embedding banks, class references, predictions, histories, results, reuse by fingerprint."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators.runs import benchmark_tables

BANK = ["model", "experiment", "seed", "fold", "bank"]
RUN = ["model", "experiment", "seed", "fold"]
PREDICTION = {"Filename", "GroundTruth", "Prediction", "Probability_Cancer"}


def require_columns(df: DataFrame, wanted: set[str]) -> DataFrame:
    missing = sorted(wanted - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def write_embedding_bank(df: DataFrame, path: str, *, mode: str = "append") -> None:
    """Vectors with their derived columns, a folder per bank; banks are never pooled."""
    require_columns(df, set(BANK)).write.mode(mode).partitionBy(*BANK).parquet(path)


def read_embedding_banks(spark: SparkSession, path: str, **of: object) -> DataFrame:
    """Banks of a model, experiment and so on; the folders of others are not read."""
    rows = spark.read.parquet(path)
    for name, value in of.items():
        rows = rows.filter(F.col(name) == value)
    return rows


def write_class_reference(reference: DataFrame, path: str, thresholds: DataFrame | None = None, *, mode: str = "append") -> None:
    """(cls, n, centroid, variance) with the out-of-distribution threshold where given; the covariance is the variance's diagonal."""
    (reference if thresholds is None else reference.join(F.broadcast(thresholds))).write.mode(mode).parquet(path)


def write_predictions(df: DataFrame, path: str, *, mode: str = "append") -> None:
    require_columns(df, PREDICTION | set(RUN)).write.mode(mode).partitionBy(*RUN).parquet(path)


def read_predictions(spark: SparkSession, path: str, **of: object) -> DataFrame:
    return require_columns(read_embedding_banks(spark, path, **of), PREDICTION)


def import_predictions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """CSV files with headers as one table; files that lack a required column, or cannot be read, are left out."""
    kept = None
    for path in paths:  # a file a run
        try:
            df = spark.read.csv(path, header=True, inferSchema=True)
        except AnalysisException:
            continue
        if PREDICTION <= set(df.columns):
            df = df.withColumn("source_file", F.lit(path))
            kept = df if kept is None else kept.unionByName(df, allowMissingColumns=True)
    if kept is None:
        raise ValueError("no file has the required columns")
    return kept


def concat_class_results(parts: list[DataFrame]) -> DataFrame:
    """Score tables of classes as one; metrics that a part lacks are null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def append_training_history(df: DataFrame, path: str, batch: int | None = None) -> None:
    """Add epochs; ``batch`` numbers the write, by default with the time."""
    numbered = require_columns(df, {"run_id", "epoch"}).withColumn("_batch", F.lit(time.time_ns() if batch is None else batch).cast("long"))
    numbered.write.mode("append").parquet(path)


def training_history_table(spark: SparkSession, path: str) -> DataFrame:
    """One row per run and epoch: that of the last write; within one write, the greatest in column order."""
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    values = [c for c in rows.columns if c not in ("run_id", "epoch", "_batch")]
    return rows.groupBy("run_id", "epoch").agg(F.max(F.struct("_batch", *values)).alias("v")).select("run_id", "epoch", *[F.col(f"v.{c}") for c in values])


def write_selection_tables(scores: DataFrame, summary: DataFrame, dataset_metrics: DataFrame, path: str) -> None:
    """Three tables; scores lose their paths and helper columns."""
    helpers = [c for c in scores.columns if c in ("path", "original_idx", "v") or c.startswith("n_")]
    for name, df in (("scores", scores.drop(*helpers)), ("summary", summary), ("dataset_metrics", dataset_metrics)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_benchmark_tables(ranked: DataFrame, ids: list[str], path: str) -> None:
    for name, df in benchmark_tables(ranked, ids).items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_screening_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Samples, groups and regions as Parquet, statistics as one JSON row."""
    for name, df in tables.items():
        df.write.mode("overwrite").format("json" if name == "statistics" else "parquet").save(f"{path}/{name}")


def selected_manifest(chosen: DataFrame, columns: list[str], path: str | None = None) -> DataFrame:
    """The selected rows as the next stage's input; if a path is given, written and read back."""
    rows = chosen.filter("selected").select(*columns)
    if not path:
        return rows
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def fingerprint(files: DataFrame, config: str) -> str:
    """SHA-256 over path, size and time of a table of files, and the settings; files are hashed in groups first."""
    one = F.concat_ws(":", "path", F.col("length").cast("string"), F.col("modificationTime").cast("string"))
    parts = files.groupBy(F.pmod(F.xxhash64("path"), F.lit(4096)).alias("g")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(one)), "\n"), 256).alias("h"), F.count("*").alias("n"))
    whole = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "h", "n"))), lambda x: F.concat_ws(":", x["g"], x["h"], x["n"])), "\n"), 256)
    return parts.agg(F.sha2(F.concat_ws("|", whole, F.lit(config)), 256).alias("f")).first()["f"]


COMMIT = "fingerprint string, count long, files long, data string"


def _committed(spark: SparkSession, at: str):
    """The commit record of a stored result, or None."""
    try:
        rows = spark.read.schema(COMMIT).json(f"{at}/commit").filter("data IS NOT NULL").collect()  # one row
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows[-1] if rows else None


def materialize_by_fingerprint(spark: SparkSession, files: DataFrame, config: str | dict, compute, path: str) -> tuple[DataFrame, bool]:
    """(result, hit): the stored result if it was made from these files and settings, else ``compute()`` stored anew.

    Settings are text, or a dictionary of whatever the result depends on: model, width and so on; the number
    of files is part of the fingerprint too. A result is written to a folder of its own and counted, and a
    commit record that names both is written last. Without the record, or with another count of rows, what
    lies there is a miss and is made again; nothing of it is read. Every hit leaves a row in ``hits``.
    """
    settings = config if isinstance(config, str) else json.dumps(config, sort_keys=True, default=str)
    n = files.count()
    key = fingerprint(files, f"{settings}|{n}")
    at = f"{path.rstrip('/')}/{key}"
    record = _committed(spark, at)
    if record:
        stored = spark.read.parquet(f"{at}/{record['data']}")
        if stored.count() == record["count"]:
            spark.range(1).select(F.lit(time.time_ns()).alias("at")).write.mode("append").json(f"{at}/hits")
            return stored, True
    data = f"data-{uuid.uuid4().hex}"
    compute().write.parquet(f"{at}/{data}")
    stored = spark.read.parquet(f"{at}/{data}")
    spark.createDataFrame([(key, stored.count(), n, data)], COMMIT).coalesce(1).write.mode("overwrite").json(f"{at}/commit")
    return stored, False


def materialized_hits(spark: SparkSession, path: str) -> DataFrame:
    """(fingerprint, hits): how often each committed result under ``path`` was used again."""
    made = spark.read.schema(COMMIT).json(f"{path.rstrip('/')}/*/commit").select("fingerprint")
    try:
        used = spark.read.schema("at long").json(f"{path.rstrip('/')}/*/hits").select(F.element_at(F.split(F.input_file_name(), "/"), -3).alias("fingerprint"))
    except AnalysisException:
        return made.withColumn("hits", F.lit(0).cast("long"))
    return made.join(used.groupBy("fingerprint").agg(F.count("*").alias("hits")), "fingerprint", "left").na.fill(0, ["hits"])
