"""Tails of distributions for the few rows of a result table, as Pandas functions over columns."""

from __future__ import annotations

import math
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_tail(z: float) -> float:
    """P(Z > z)."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi2_tail(x: float, k: int) -> float:
    """Upper tail of chi-squared with ``k`` degrees of freedom."""
    if x <= 0:
        return 1.0
    # from the closed forms for one and two degrees upwards
    tail, at = (math.erfc(math.sqrt(x / 2)), 1) if k % 2 else (math.exp(-x / 2), 2)
    while at < k:
        tail += math.exp(at / 2 * math.log(x / 2) - x / 2 - math.lgamma(at / 2 + 1))
        at += 2
    return tail


def t_tails(t: float, df: float) -> float:
    """P(abs(T) > abs(t)): the regularised incomplete beta function at df / (df + t^2)."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0

    def part(x: float, a: float, b: float) -> float:
        # Lentz's continued fraction
        d = 1 - (a + b) * x / (a + 1)
        c, d = 1.0, 1 / (d or 1e-300)
        out = d
        for m in range(1, 400):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / ((1 + num * d) or 1e-300), (1 + num / c) or 1e-300
                out *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return math.exp(a * math.log(x) + b * math.log1p(-x) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b)) * out / a

    return part(x, a, b) if x < (a + 1) / (a + b + 2) else 1 - part(1 - x, b, a)


def signed_rank_tails(w: float, n: int, tie_term: float = 0.0) -> float:
    """Two-sided p of the smaller signed-rank sum: exact up to 50 pairs without ties, else normal with their correction."""
    if n < 1:
        return math.nan
    if n <= 50 and tie_term == 0:
        ways = [1]
        for r in range(1, n + 1):
            grown = ways + [0] * r
            for i, x in enumerate(ways):
                grown[i + r] += x
            ways = grown
        return min(1.0, 2 * list(accumulate(ways))[int(w)] / 2**n)
    mean, var = n * (n + 1) / 4, (n * (n + 1) * (2 * n + 1) - tie_term / 2) / 24
    return min(1.0, 2 * normal_tail((mean - w) / math.sqrt(var)))


def rank_sum_less(u: float, n1: int, n2: int, tie_term: float) -> float:
    """P(U <= u): exact if either side has at most 8 rows and nothing ties, else normal with corrections."""
    if min(n1, n2) < 1:
        return math.nan
    if min(n1, n2) <= 8 and tie_term == 0:
        # ways[k][s]: k of the places so far, sum s of the counts below them
        ways = {(0, 0): 1}
        for _ in range(n1 + n2):
            grown: dict[tuple[int, int], int] = {}
            for (k, s), x in ways.items():
                for key in ((k + 1, s), (k, s + k)):
                    if key[0] <= n1:
                        grown[key] = grown.get(key, 0) + x
            ways = grown
        counts = {s: x for (k, s), x in ways.items() if k == n1}
        return sum(x for s, x in counts.items() if n1 * n2 - s <= u) / math.comb(n1 + n2, n1)
    n = n1 + n2
    var = n1 * n2 / 12 * ((n + 1) - tie_term / (n * (n - 1)))
    return 1.0 if var <= 0 else normal_tail(-(u + 0.5 - n1 * n2 / 2) / math.sqrt(var))


def _each(function, *columns: pd.Series) -> pd.Series:
    return pd.Series([None if any(x is None or x != x for x in row) else function(*row) for row in zip(*columns, strict=True)], dtype="float64")


def _udf(function, n: int):
    def one(a: pd.Series) -> pd.Series:
        return _each(function, a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return _each(function, a, b)

    def four(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return _each(function, a, b, c, d)

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return _each(function, a, b, c)

    return F.pandas_udf({1: one, 2: two, 3: three, 4: four}[n], "double")


def p_chi2(x: Column, k: int) -> Column:
    return _udf(lambda v: chi2_tail(v, k), 1)(x.cast("double"))


def p_t(t: Column, df: Column) -> Column:
    return _udf(t_tails, 2)(t.cast("double"), df.cast("double"))


def p_signed_rank(w: Column, n: Column, tie_term: Column) -> Column:
    return _udf(lambda a, b, c: signed_rank_tails(a, int(b), c), 3)(*[x.cast("double") for x in (w, n, tie_term)])


def p_rank_sum_less(u: Column, n1: Column, n2: Column, tie_term: Column) -> Column:
    return _udf(lambda a, b, c, d: rank_sum_less(a, int(b), int(c), d), 4)(*[x.cast("double") for x in (u, n1, n2, tie_term)])
