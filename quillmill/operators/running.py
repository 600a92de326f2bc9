"""Running sums and tied ranks within keys, dealt over tasks when a key has many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.storage import written

#: Rows of one key that one task sorts, about.
BUCKET_ROWS = 200_000
#: Rows of carried sums, a key's buckets, up to which they are broadcast.
BROADCAST_ROWS = 200_000


def same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; no keys at all join one row with every row."""
    named = b.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    if not keys:
        return a.join(F.broadcast(named))
    test = on[0]
    for x in on[1:]:
        test = test & x
    return a.join(named, test, how).drop(*[f"_{k}" for k in keys])


def with_few(df: DataFrame, few: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``same`` with a table of a row or so a key, which is stored and then broadcast, so that a key's rows stay dealt over tasks."""
    few = written(few, "few")
    return same(df, F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, keys, how)


def bucketed(df: DataFrame, keys: list[str], order: list[str], bucket_rows: int) -> DataFrame | None:
    """``df`` stored with ``_b``: buckets of equal depth by splitters that Spark samples; None if no key needs any.

    ``order`` must tell rows of a key apart, else equal rows share a bucket. Buckets are numbered in the
    order of (keys, order), so those of one key rise with it.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.coalesce(F.sum("n"), F.lit(0)).alias("all")).first()
    if sizes["most"] <= bucket_rows:
        return None
    parts = -(-sizes["all"] // bucket_rows)
    return written(df.repartitionByRange(parts, *keys, *order).withColumn("_b", F.spark_partition_id()), "buckets")


def _carried(stored: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """``stored`` with ``_t_<name>``: what the key's buckets before this one add up to."""
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    # a row per key and bucket
    return with_few(stored, parts.select(*keys, "_b", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_t_{n}") for n in sums]), [*keys, "_b"])


def running_sums(df: DataFrame, keys: list[str], order: Column, sums: dict[str, Column], *, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with, per name in ``sums``, the sum over the rows of the key up to and with this one.

    ``order`` is a number, unique within a key. ``df`` is read more than once: pass a stored table. Keys
    of up to ``bucket_rows`` rows are sorted whole; else rows go to buckets of equal depth, sums by
    bucket give what comes before each, and only a bucket's rows are sorted together.
    """
    df = df.withColumns({"_o": order.cast("double")} | {f"_{n}": c for n, c in sums.items()})
    names = [f"_{n}" for n in sums]
    stored = bucketed(df, keys, ["_o"], bucket_rows)
    inside = Window.partitionBy(*keys, *([] if stored is None else ["_b"])).orderBy("_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if stored is None:
        return df.withColumns({n: F.sum(f"_{n}").over(inside) for n in sums}).drop("_o", *names)
    out = _carried(stored, keys, {n: F.col(f"_{n}") for n in sums})
    return out.withColumns({n: F.col(f"_t_{n}") + F.sum(f"_{n}").over(inside) for n in sums}).drop("_o", "_b", *names, *[f"_t_{n}" for n in sums])


def average_ranks(df: DataFrame, keys: list[str], value: str, *, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(keys, value, ties, rank): of each distinct value, how many rows have it and their average rank from 1."""
    kinds = written(df.groupBy(*keys, value).agg(F.count("*").alias("ties")), "kinds")
    upto = running_sums(kinds, keys, F.col(value), {"upto": F.col("ties")}, bucket_rows=bucket_rows)
    return upto.select(*keys, value, "ties", (F.col("upto") - (F.col("ties") - 1) / 2).alias("rank"))


def numbered(df: DataFrame, keys: list[str], order: list[Column], *, spread: Column, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with ``nth``, the place from 1 in a key by (``spread``, ``order``), and ``of``, the rows of the key.

    ``spread`` is a number and comes first; rows that tie in all of it stand in any order.
    """
    by = [f"_o{i}" for i in range(len(order) + 1)]
    df = written(df.withColumns(dict(zip(by, [spread.cast("double"), *order], strict=True))), "numbered")
    sizes = df.groupBy(*keys).agg(F.count("*").alias("of"))
    stored = bucketed(df, keys, by, bucket_rows)
    inside = Window.partitionBy(*keys, *([] if stored is None else ["_b"])).orderBy(*by)
    if stored is None:
        whole = Window.partitionBy(*keys)
        return df.withColumns({"nth": F.row_number().over(inside), "of": F.count("*").over(whole)}).drop(*by)
    out = _carried(stored, keys, {"n": F.lit(1)}).withColumn("nth", F.col("_t_n") + F.row_number().over(inside))
    return with_few(out, sizes, keys).drop("_b", "_t_n", *by)
