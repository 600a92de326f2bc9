"""Column expressions shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A lambda re-evaluates an outer expression for every element; a lambda variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def n_chars(text: Column, chars: str) -> Column:
    """Characters of a regex class; the others are cut out run by run."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def indices(n: Column) -> Column:
    """0 .. n-1, empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def gram_hashes(w: Column, k: int) -> Column:
    """Hash of each run of k consecutive words."""
    return F.transform(indices(F.size(w) - (k - 1)), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))


def covered(starts: Column, width: int) -> Column:
    """How many positions sorted intervals ``[s, s + width)`` cover together."""
    gaps = F.transform(starts, lambda s, i: F.least(F.lit(width), F.coalesce(F.get(starts, i + 1) - s, F.lit(width))))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)
