"""Train, validation and test roles by hash, by class and by group, and checks that groups do not leak."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions.columns import hash_number
from quillmill.operators.running import numbered, same


def hash_holdout(df: DataFrame, class_name: str, name: str, ties: list[str], *, share: float = 0.15, least: int = 2) -> DataFrame:
    """``role``: of each class the first max(2, round(share * n)) rows by SHA-256 of the name are val; halves round to even."""
    placed = numbered(df, [class_name], [F.col(t) for t in ties], spread=hash_number(name))
    most = F.greatest(F.lit(least), F.bround(F.col("of") * F.lit(share), 0).cast("long"))
    return placed.withColumn("role", F.when(F.col("nth") <= most, "val").otherwise("train")).drop("nth", "of")


def _roles(train: float, val: float):
    return F.when(F.col("nth") <= F.round(F.col("of") * train), "train").when(F.col("nth") <= F.round(F.col("of") * (train + val)), "val").otherwise("test")


def stratified_split(df: DataFrame, class_name: str, item: str, *, train: float = 0.7, val: float = 0.15, least: int = 10, seed: str = "0") -> DataFrame:
    """``role`` of each row, class by class; fewer than ``least`` rows of a class are an error."""
    placed = numbered(df, [class_name], [F.col(item)], spread=hash_number(F.concat_ws(":", F.lit(seed), F.col(item).cast("string"))))
    guard = F.when(F.col("of") < least, F.raise_error(F.concat(F.lit("too few rows of class "), F.col(class_name).cast("string")))).otherwise(_roles(train, val))
    return placed.withColumn("role", guard).drop("nth", "of")


def group_table(df: DataFrame, group: str, class_name: str) -> DataFrame:
    """(group, label, n): a group's commonest class, the lesser on ties, and its rows."""
    counts = df.groupBy(group, class_name).agg(F.count("*").alias("_c"))
    # the largest count, then the least class: arrays of a group's few classes
    by = F.sort_array(F.collect_list(F.struct((-F.col("_c")).alias("less"), F.col(class_name).alias("label"))))
    return counts.groupBy(group).agg(F.get(by, F.lit(0))["label"].alias("label"), F.sum("_c").alias("n"))


def stratified_group_split(df: DataFrame, group: str, class_name: str, *, train: float = 0.7, val: float = 0.15, least: int = 3, seed: str = "0") -> DataFrame:
    """``role`` of each row by its group, so that no group is in two roles; at least ``least`` groups a class."""
    groups = stratified_split(group_table(df, group, class_name), "label", group, train=train, val=val, least=least, seed=seed)
    return same(df, groups.select(group, "role"), [group])


def _assigned(group: str, folds: int):
    """Greedy fold of each group: uneven groups first, each to the fold that leaves class counts most even."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, classes = sorted(pdf["g"].unique()), sorted(pdf["c"].unique())
        counts = pdf.pivot_table(index="g", columns="c", values="n", aggfunc="sum", fill_value=0).reindex(index=names, columns=classes).to_numpy(float)
        total = counts.sum(0)
        load, of = np.zeros((folds, len(classes))), np.zeros(len(names), int)
        for i in np.lexsort((np.arange(len(names)), -counts.std(1))):
            best = None
            for f in range(folds):
                load[f] += counts[i]
                key = (round(float((load / total).std(0).mean()), 12), load[f].sum(), f)
                load[f] -= counts[i]
                best = min(best, key) if best else key
            of[i] = best[2]
            load[of[i]] += counts[i]
        return pd.DataFrame({"g": names, "fold": of})

    return run


def group_folds(df: DataFrame, group: str, class_name: str, folds: int) -> DataFrame:
    """(group, fold): every group in one fold, classes balanced. One task walks the table of groups, not the rows."""
    counts = df.groupBy(F.col(group).cast("string").alias("g"), F.col(class_name).cast("string").alias("c")).agg(F.count("*").alias("n"))
    smallest = counts.groupBy("c").agg(F.count("*").alias("k")).agg(F.min("k").alias("k")).first()["k"]
    if smallest is not None and smallest < folds:
        raise ValueError(f"{smallest} groups in the smallest class, {folds} folds")
    return counts.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(_assigned(group, folds), "g string, fold int")


def stratified_group_kfold(df: DataFrame, group: str, class_name: str, folds: int = 5) -> DataFrame:
    """Row per row and fold with ``role``: fold i is the test, the next one val, the rest train."""
    own = group_folds(df, group, class_name, folds).select(F.col("g").alias("_g"), F.col("fold").alias("_own"))
    placed = df.withColumn("_g", F.col(group).cast("string")).join(own, "_g").drop("_g")
    every = placed.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    turn = F.pmod(F.col("_own") - F.col("fold"), F.lit(folds))
    return every.withColumn("role", F.when(turn == 0, "test").when(turn == 1, "val").otherwise("train")).drop("_own")


def grouped_cv_holdout_val(df: DataFrame, group: str, class_name: str, folds: int = 5, *, val: float = 0.15) -> DataFrame:
    """As the k-fold above, numbered from 1, but val is a share of the other folds' groups of each class."""
    groups = group_table(df, group, class_name)
    short = groups.groupBy("label").count().filter(F.col("count") < folds + 2)
    if not short.isEmpty():
        raise ValueError(f"every class needs {folds + 2} groups")
    placed = group_folds(df, group, class_name, folds).select(F.col("g").alias("_g"), F.col("fold").alias("_own"))
    own = groups.withColumn("_g", F.col(group).cast("string")).join(placed, "_g")
    every = own.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    test = every.filter(F.col("_own") + 1 == F.col("fold")).withColumn("role", F.lit("test"))
    rest = numbered(every.filter(F.col("_own") + 1 != F.col("fold")), ["fold", "label"], [F.col("_g")], spread=hash_number("_g"))
    most = F.greatest(F.lit(1), F.round(F.col("of") * val))
    rest = rest.withColumn("role", F.when(F.col("nth") <= most, "val").otherwise("train"))
    roles = test.select(group, "fold", "role").unionByName(rest.select(group, "fold", "role"))
    return same(df, roles, [group])


def assert_group_disjoint(df: DataFrame, keys: list[str], group: str, role: str) -> DataFrame:
    """(keys, group, roles, leaks): a row per group; ``leaks`` is 1 for a group in more than one role."""
    seen = df.groupBy(*keys, group).agg(F.count_distinct(role).alias("roles"))
    return seen.withColumn("leaks", (F.col("roles") > 1).cast("int"))


def require_group_disjoint(df: DataFrame, keys: list[str], group: str, role: str) -> DataFrame:
    """``df``, or an error if a group is in two roles."""
    bad = assert_group_disjoint(df, keys, group, role).filter("leaks = 1")
    if not bad.isEmpty():
        raise ValueError(f"groups in more than one role, such as {bad.first()[group]}")
    return df


def pool_real(df: DataFrame, base: str, root_order: str, ties: list[str], classes: list[str] | None = None) -> DataFrame:
    """One row of each base name, of the first root that has it; only classes of the vocabulary."""
    kept = df.filter(F.col("class_name").isin(classes)) if classes else df
    row = F.struct(root_order, *ties, *[c for c in df.columns if c not in (root_order, *ties)])
    return kept.groupBy(F.col(base).alias("_k")).agg(F.min_by(row, F.struct(root_order, *ties)).alias("r")).select("r.*").select(*df.columns)


def expand_experiments(real: DataFrame, synthetic: DataFrame, models: DataFrame, experiments: DataFrame, seeds: DataFrame, augmented: str) -> DataFrame:
    """A row per run and item. ``real`` has a role; synthetic rows join the train role of ``augmented`` runs alone."""
    runs = F.broadcast(models.crossJoin(experiments).crossJoin(seeds))  # tables of a few names
    own = real.select("item", "class_name", "role", F.lit("").alias("only"))
    every = own.unionByName(synthetic.select("item", "class_name", F.lit("train").alias("role"), F.lit(augmented).alias("only")))
    return every.join(runs, (F.col("only") == "") | (F.col("only") == F.col("experiment"))).drop("only")
