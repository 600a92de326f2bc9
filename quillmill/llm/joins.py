"""Joins with tables of counts whose keys may be very common."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that may count as common; as counts add up to ``total``, no more than so many exceed ``total / COMMON``.
COMMON = 10_000


def with_counts(rows: DataFrame, counts: DataFrame, on: dict[str, str], take: dict[str, str], weight: str, total: int) -> DataFrame:
    """Left join of ``rows`` with ``counts``: ``on`` maps columns of rows to keys, ``take`` columns of counts to new names.

    ``weight`` says how often a key of ``counts``, which is there once, occurs; together ``total`` at most.
    Keys that hold over 1/``COMMON`` of the total are at most ``COMMON`` rows and are broadcast; their rows
    are then dealt by all their columns, while the others meet their keys in the same shuffle, where no key
    is large. Null keys meet nothing.
    """
    common = F.col(weight) * COMMON > F.lit(total)
    # never true; a constant would be folded away
    zero = F.when(F.col(weight) < 0, 1).otherwise(0).cast("long")

    def side(which: str):
        return counts.filter(common if which == "h" else ~common).select(
            *[F.col(k).alias(f"_{which}k{i}") for i, k in enumerate(on.values())], *[F.col(a).alias(f"_{which}v{i}") for i, a in enumerate(take)], zero.alias(f"_{which}s"))

    def test(which: str):
        return reduce(lambda a, b: a & b, [F.col(r) == F.col(f"_{which}k{i}") for i, r in enumerate(on)])

    known = rows.join(F.broadcast(side("h")), test("h"), "left").withColumn("_deal", F.when(F.col("_hs").isNotNull(), F.xxhash64(*rows.columns)).otherwise(F.lit(0)))
    met = known.join(side("c"), test("c") & (F.col("_deal") == F.col("_cs")), "left")
    return met.select(*rows.columns, *[F.coalesce(f"_hv{i}", f"_cv{i}").alias(b) for i, b in enumerate(take.values())])
