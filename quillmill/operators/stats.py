"""Tests and rank statistics over result tables and cohorts, with p-values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.pvalues import p_chi2, p_rank_sum_less, p_signed_rank, p_t
from quillmill.operators.running import average_ranks, running_sums, same


def paired(df: DataFrame, keys: list[str], pair: list[str], side: str, a: str, b: str, metrics: list[str]) -> DataFrame:
    """(keys, pair, metric, a, b, d): values of condition ``b`` against ``a`` where both exist.

    Keys whose two sides have unequal counts, or fewer than two rows, are left out.
    """
    long = df.select(*keys, *pair, side, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])))
    left = long.filter(F.col(side) == a).select(*keys, *pair, "metric", F.col("v").alias("a"))
    right = long.filter(F.col(side) == b).select(*keys, *pair, "metric", F.col("v").alias("b"))
    counts = df.groupBy(*keys).agg(F.count_if(F.col(side) == a).alias("_na"), F.count_if(F.col(side) == b).alias("_nb")).filter("_na = _nb AND _na >= 2").drop("_na", "_nb")
    both = same(left, right, [*keys, *pair, "metric"]).withColumn("d", F.col("b") - F.col("a"))
    return same(both, counts, keys) if keys else both


def paired_ttest(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, b_mean, a_mean, difference, t, p) over ``pairs`` with columns a, b, d; t and p null without spread."""
    n = F.count("d")
    t = F.try_divide(F.avg("d"), F.stddev_samp("d") / F.sqrt(n.cast("double")))
    out = pairs.groupBy(*keys).agg(n.alias("n"), F.avg("b").alias("b_mean"), F.avg("a").alias("a_mean"), F.avg("d").alias("difference"), t.alias("t"))
    return out.withColumn("p", p_t(F.col("t"), F.col("n") - 1))


def wilcoxon_signed_rank(pairs: DataFrame, keys: list[str], digits: int = 12) -> DataFrame:
    """(keys, n, w, p): the smaller rank sum of non-zero differences, ties averaged; keys of zeros only are left out."""
    d = pairs.select(*keys, F.round("d", digits).alias("d")).filter("d <> 0").withColumn("size", F.abs("d"))
    ranks = same(d, average_ranks(d, keys, "size"), [*keys, "size"])
    of = lambda test: F.sum(F.when(test, F.col("rank")).otherwise(0.0))
    out = ranks.groupBy(*keys).agg(F.count("*").alias("n"), F.least(of(F.col("d") > 0), of(F.col("d") < 0)).alias("w"), F.sum(F.col("ties") * F.col("ties") - 1).alias("tie"))
    return out.select(*keys, "n", "w", p_signed_rank(F.col("w"), F.col("n"), F.col("tie")).alias("p"))


def mcnemar(df: DataFrame, keys: list[str], item: str, member: str, correct: str) -> DataFrame:
    """(keys, member_a, member_b, only_a, only_b, statistic, p) of each pair of members in name order."""
    # an item's members stand in one row, and equal rows are one row with a count: no table meets itself
    judged = F.struct(F.col(member).alias("m"), F.col(correct).cast("int").alias("ok"))
    items = df.groupBy(*keys, item).agg(F.sort_array(F.collect_list(judged)).alias("_all"))
    kinds = items.groupBy(*keys, "_all").agg(F.count("*").alias("_n"))
    both = kinds.select(*keys, "_n", "_all", F.inline("_all").alias("member_a", "_a")).select(*keys, "_n", "member_a", "_a", F.inline("_all").alias("member_b", "_b")).filter("member_a < member_b")
    of = lambda test: F.sum(F.when(F.expr(test), F.col("_n")).otherwise(0))
    counts = both.groupBy(*keys, "member_a", "member_b").agg(of("_a = 1 AND _b = 0").alias("only_a"), of("_a = 0 AND _b = 1").alias("only_b"))
    off = (F.col("only_a") + F.col("only_b")).cast("double")
    stat = F.when(off == 0, 0.0).otherwise(F.pow(F.abs(F.col("only_a") - F.col("only_b")) - 1, 2) / off)
    tested = counts.withColumn("statistic", stat).withColumn("p", p_chi2(F.col("statistic"), 1))
    return tested.withColumn("p", F.when(F.col("only_a") + F.col("only_b") == 0, 1.0).otherwise(F.col("p")))


def spearman_trend(df: DataFrame, rank: str, value: str) -> DataFrame:
    """One row (rho, n, p): correlation of tied ranks, p two-sided by t with n - 2 degrees of freedom."""
    rows = df.select(F.col(rank).cast("double").alias("g"), F.col(value).cast("double").alias("v")).filter("g IS NOT NULL AND v IS NOT NULL")
    # equal rows are one row with a count, so nothing is ranked or correlated twice
    cells = rows.groupBy("g", "v").agg(F.count("*").cast("double").alias("n"))
    a, b = average_ranks(rows, [], "g").select("g", F.col("rank").alias("rg")), average_ranks(rows, [], "v").select("v", F.col("rank").alias("rv"))
    s = lambda x: F.sum(F.col("n") * x)
    g, v = F.col("rg"), F.col("rv")
    sums = cells.join(a, "g").join(b, "v").agg(F.sum("n").alias("n"), s(g).alias("g"), s(v).alias("v"), s(g * g).alias("gg"), s(v * v).alias("vv"), s(g * v).alias("gv"))
    rho = F.try_divide(F.col("gv") - F.col("g") * F.col("v") / F.col("n"), F.sqrt((F.col("gg") - F.col("g") * F.col("g") / F.col("n")) * (F.col("vv") - F.col("v") * F.col("v") / F.col("n"))))
    out = sums.select(rho.alias("rho"), F.col("n").cast("long").alias("n"))
    t = F.col("rho") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("rho") * F.col("rho")))
    return out.withColumn("p", F.coalesce(p_t(t, F.col("n") - 2), F.when(F.abs("rho") >= 1, 0.0)))


def kruskal_wallis(df: DataFrame, group: str, value: str, groups: int) -> DataFrame:
    """One row (h, n, p) with the tie correction; ``groups`` is how many groups there are."""
    rows = df.filter(F.col(group).isNotNull() & F.col(value).isNotNull())
    ranks = average_ranks(rows, [], value)
    ties = ranks.agg(F.sum(F.pow(F.col("ties").cast("double"), 3) - F.col("ties")).alias("tie"))
    cells = rows.groupBy(group, value).agg(F.count("*").cast("double").alias("n"))
    sums = cells.join(ranks, value).groupBy(group).agg(F.sum(F.col("n") * F.col("rank")).alias("s"), F.sum("n").alias("n"))
    all_ = sums.agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"), F.sum("n").alias("n"))
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("tie") / (n * n * n - n))
    out = all_.join(F.broadcast(ties)).select(h.alias("h"), n.cast("long").alias("n"))
    return out.withColumn("p", p_chi2(F.col("h"), groups - 1))


def mann_whitney_adjacent(df: DataFrame, rank: str, value: str) -> DataFrame:
    """(rank_low, rank_high, n1, n2, u, p): one-sided "less" between neighbouring ranks that are present."""
    rows = df.filter(F.col(rank).isNotNull() & F.col(value).isNotNull()).select(F.col(rank).alias("g"), F.col(value).alias("v"))
    present = rows.select("g").distinct().withColumn("next", F.lead("g").over(Window.orderBy("g")))
    low = present.filter("next IS NOT NULL").select(F.col("g").alias("rank_low"), F.col("next").alias("rank_high"))
    side = F.array(F.struct(F.col("rank_low").alias("g"), F.lit(1).alias("first")), F.struct(F.col("rank_high").alias("g"), F.lit(0).alias("first")))
    pairs = rows.join(F.broadcast(low.select("rank_low", "rank_high", F.inline(side))), "g")
    kinds = pairs.groupBy("rank_low", "rank_high", "v").agg(F.count("*").alias("n"), F.sum("first").alias("k"))
    upto = running_sums(kinds, ["rank_low", "rank_high"], F.col("v"), {"upto": F.col("n")})
    r = F.col("upto") - (F.col("n") - 1) / 2
    tie = F.pow(F.col("n").cast("double"), 3) - F.col("n")
    sums = upto.groupBy("rank_low", "rank_high").agg(F.sum("k").alias("n1"), F.sum(F.col("n") - F.col("k")).alias("n2"), F.sum(r * F.col("k")).alias("r1"), F.sum(tie).alias("tie"))
    sums = sums.withColumn("u", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2)
    return sums.select("rank_low", "rank_high", "n1", "n2", "u", p_rank_sum_less(F.col("u"), F.col("n1"), F.col("n2"), F.col("tie")).alias("p"))
