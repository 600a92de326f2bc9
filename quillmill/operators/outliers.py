"""Outliers among vectors: isolation forest and local outlier factor."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions.columns import cos_to_euclid
from quillmill.operators.selection import capped_sample
from quillmill.operators.vectors import knn_join
from quillmill.storage import written


def _average_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _tree(x: np.ndarray, rng: np.random.Generator, depth: int, most: int) -> tuple:
    varied = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 else []
    if depth >= most or len(varied) == 0:
        return (depth + _average_path(len(x)),)
    f = int(rng.choice(varied))
    at = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    left = x[:, f] <= at
    return f, at, _tree(x[left], rng, depth + 1, most), _tree(x[~left], rng, depth + 1, most)


def _depths(tree: tuple, x: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    if len(tree) == 1:
        out[rows] += tree[0]
        return
    f, at, low, high = tree
    left = x[rows, f] <= at
    if left.any():
        _depths(low, x, rows[left], out)
    if not left.all():
        _depths(high, x, rows[~left], out)


def isolation_forest_flag(rows: DataFrame, *, trees: int = 100, sample: int = 256, least: int = 10, seed: int = 7) -> DataFrame:
    """(id, cls, score, outlier) of (id, cls, v): 1 where the mean path is so short that the score is over 0.5.

    One forest per class. A tree is grown by one task from its own ``sample`` rows, drawn by hash; the
    forests are broadcast and rows are scored where they lie. Classes under ``least`` rows have no outliers.
    """
    sizes = {r["cls"]: r["n"] for r in rows.groupBy("cls").agg(F.count("*").alias("n")).collect()}  # a row a class
    each = rows.select("id", "cls", "v", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    want = F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, min(1.0, 4 * sample / n))]) if sizes else F.create_map(F.lit(0), F.lit(1.0))
    unit = F.pmod(F.xxhash64("id", "tree", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    drawn = capped_sample(each.filter(unit <= want[F.col("cls")]), ["cls", "tree"], "id", sample, str(seed))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        import pickle

        pdf = pdf.sort_values("id")
        x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        rng = np.random.default_rng([seed, int(pdf["tree"].iloc[0])])
        tree = _tree(x, rng, 0, math.ceil(math.log2(max(2, len(x)))))
        return pd.DataFrame({"cls": pdf["cls"].iloc[:1].to_numpy(), "n": [len(x)], "tree": [pickle.dumps(tree)]})

    grown = drawn.groupBy("cls", "tree").applyInPandas(grow, "cls int, n int, tree binary").collect()  # trees of bounded size
    forest = rows.sparkSession.sparkContext.broadcast([(r["cls"], r["n"], bytes(r["tree"])) for r in grown if sizes[r["cls"]] >= least])

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pickle

        known: dict = {}
        for c, n, t in forest.value:
            known.setdefault(c, []).append((n, pickle.loads(t)))  # noqa: S301, our own bytes
        for f in frames:
            scores = np.zeros(len(f))
            for c, of in known.items():
                at = np.flatnonzero(f["cls"].to_numpy() == c)
                if len(at):
                    x, depth = np.stack(f["v"].to_numpy()[at]).astype(np.float64), np.zeros(len(at))
                    for _, t in of:
                        _depths(t, x, np.arange(len(at)), depth)
                    scores[at] = 2 ** (-depth / len(of) / max(_average_path(of[0][0]), 1e-9))
            yield pd.DataFrame({"id": f["id"], "cls": f["cls"], "score": scores, "outlier": (scores > 0.5).astype(float)})

    return rows.select("id", "cls", "v").mapInPandas(score, "id long, cls int, score double, outlier double")


def lof_flag(rows: DataFrame, *, k: int = 20, threshold: float = 1.5, scope: str = "own") -> DataFrame:
    """(id, lof, outlier) of (id, cls, v), unit vectors: 1 where the local outlier factor is over the threshold."""
    near = written(knn_join(rows, rows, k, scope=scope).select("qid", "did", cos_to_euclid("similarity").alias("d")), "near")  # read three times
    reach = near.groupBy("qid").agg(F.max("d").alias("kd"))
    met = near.join(reach.select(F.col("qid").alias("did"), "kd"), "did").select("qid", "did", F.greatest("kd", "d").alias("rd"))
    lrd = met.groupBy("qid").agg((1 / (F.avg("rd") + 1e-10)).alias("lrd"))
    of = met.join(lrd.select(F.col("qid").alias("did"), F.col("lrd").alias("theirs")), "did").groupBy("qid").agg(F.avg("theirs").alias("theirs"))
    out = of.join(lrd, "qid").select(F.col("qid").alias("id"), (F.col("theirs") / F.col("lrd")).alias("lof"))
    return out.withColumn("outlier", (F.col("lof") > threshold).cast("double"))
