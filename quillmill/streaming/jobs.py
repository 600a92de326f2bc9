"""Streaming jobs: averages kept per key, and scores of arriving items against a fixed reference."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from quillmill.functions.columns import diag_mahalanobis
from quillmill.operators.vectors import class_vectors
from quillmill.storage import shared_dir


def file_stream(spark: SparkSession, folder: str, name: str, schema: StructType, files: int = 16) -> DataFrame:
    """The table ``name`` of a folder as a stream: a file, or the files of a folder of that name."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    return reader.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{folder}/{name}.parque[t]")


def ema_by_key_stream(stream: DataFrame, key: str, order: str, value: str, beta: float = 0.99) -> DataFrame:
    """(key, n, ema) after each batch; rows of a batch are taken in order, batches as they come.

    A batch of m values turns the average into ``beta ** m`` of itself plus their weighted sum, so it is one
    product of two arrays. A key keeps two numbers: there is nothing to expire and no watermark. A task
    holds a key's values of one batch, 16 bytes a value; the number of files a trigger bounds them.
    """

    def step(of: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ema = state.get if state.exists else (0, 0.0)
        parts = [f[["seq", "value"]].dropna(subset=["value"]).to_numpy(np.float64) for f in frames]
        rows = np.concatenate(parts)
        x = rows[np.lexsort((rows[:, 1], rows[:, 0])), 1]
        if len(x):
            if n == 0:
                ema, n, x = x[0], 1, x[1:]
            ema = beta ** len(x) * ema + (1 - beta) * float(beta ** np.arange(len(x) - 1, -1, -1.0) @ x)
            n += len(x)
        state.update((int(n), float(ema)))
        yield pd.DataFrame({"key": [of[0]], "n": [n], "ema": [ema]})

    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("seq"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("key").applyInPandasWithState(step, "key string, n long, ema double", "n long, ema double", "update", GroupStateTimeout.NoTimeout)


def score_items(items: DataFrame, reference: DataFrame) -> DataFrame:
    """(id, ood_score, nearest) of (id, v): least diagonal Mahalanobis distance; works on tables and on streams.

    The reference is one row of a few classes that meets every item.
    """
    one = class_vectors(reference).agg(F.array_sort(F.collect_list(F.struct("cls", "centroid", "variance"))).alias("classes"))
    met = items.select("id", "v").join(F.broadcast(one))
    best = F.array_min(F.transform("classes", lambda c: F.struct(diag_mahalanobis(F.col("v"), c["centroid"], c["variance"]).alias("d"), c["cls"].alias("cls"))))
    return met.withColumn("b", best).select("id", F.col("b.d").alias("ood_score"), F.col("b.cls").alias("nearest"))


def publish_reference(reference: DataFrame, path: str, version: int) -> None:
    """Store a class reference as a version; readers take the highest that is whole."""
    reference.write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={version}")


def newest_reference(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The reference of the highest version and that version; ``_SUCCESS`` marks the whole ones, so a half-written one has no rows here."""
    rows = spark.read.parquet(path)
    version = rows.agg(F.max("version")).first()[0]
    return rows.filter(F.col("version") == version).drop("version"), version


def score_arrivals(stream: DataFrame, path: str, *, delay: str = "1 hour", name: str = "arrivals", at: str | None = None) -> DataFrame:
    """(id, ood_score, nearest, version, batch) of a stream (id, v, arrived): each item once, by the reference of its batch.

    The references of ``path`` are looked up again for every batch. An item that comes again within
    ``delay`` is dropped by its id; a batch that is run again after a failure overwrites its own rows.
    ``at`` keeps the stream's place and its rows, so that a later call goes on from there.
    """
    spark = stream.sparkSession
    at = at or f"{shared_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"

    def store(batch: DataFrame, number: int) -> None:
        reference, version = newest_reference(batch.sparkSession, path)
        scored = score_items(batch, reference).withColumns({"version": F.lit(version).cast("long"), "batch": F.lit(number).cast("long")})
        scored.write.mode("overwrite").parquet(f"{at}/data/batch={number}")

    once = stream.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["id"])
    once.writeStream.foreachBatch(store).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("basePath", f"{at}/data").parquet(f"{at}/data")


def drained(stream: DataFrame, mode: str, name: str, latest: list[str] | None = None, *, at: str | None = None) -> DataFrame:
    """Run a stream over all that is there, into a table in the shared folder, and read it back.

    With ``latest`` keys only the rows of a key's last batch stay. ``at`` keeps the stream's place, so that
    a later call goes on from there.
    """
    spark = stream.sparkSession
    path = at or f"{shared_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"

    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data")
    if not latest:
        return rows.drop("batch")
    values = [c for c in rows.columns if c not in (*latest, "batch")]
    return rows.groupBy(*latest).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*latest, "v.*")
