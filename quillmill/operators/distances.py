"""Distances of two sets of vectors: moments, Frechet, kernel, precision and recall, memorisation, class separation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions.columns import cos_to_euclid, squared_distance
from quillmill.operators.cells import places, slices
from quillmill.operators.running import same
from quillmill.operators.selection import capped_sample
from quillmill.operators.vectors import block_pairs, class_reference, class_vectors, knn_join
from quillmill.storage import written


def _stack(x: pd.Series) -> np.ndarray:
    return np.stack(x.to_numpy()).astype(np.float64)


#: Keys whose sums one task holds before it passes them on.
HELD_KEYS = 64


def moment_sums(df: DataFrame, v: str = "v", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, pos, s): the sums of 1, of each place and of each product of two places, in one row-major list.

    A task adds its rows up by key and passes on a list per key; rows with a null key are left out.
    """
    names = list(keys)
    sound = df.dropna(subset=names) if names else df

    def out(sums: dict) -> pd.DataFrame:
        sizes = [len(s) for s in sums.values()]
        held = {n: np.repeat(np.array([k[i] for k in sums], object), sizes) for i, n in enumerate(names)}
        return pd.DataFrame(held | {"pos": np.concatenate([np.arange(n) for n in sizes]), "s": np.concatenate(list(sums.values()))})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {}
        for f in frames:
            for key, part in f.groupby(names) if names and len(f) else [((), f)] if len(f) else []:
                x = _stack(part[v])
                s = np.concatenate(([len(x)], x.sum(0), (x.T @ x).ravel()))
                sums[key] = sums[key] + s if key in sums else s
                if len(sums) > HELD_KEYS:
                    yield out(sums)
                    sums = {}
        if sums:
            yield out(sums)

    types = "".join(f"{n} {df.schema[n].dataType.simpleString()}, " for n in names)
    return sound.select(*names, v).mapInPandas(run, f"{types}pos long, s double").groupBy(*names, "pos").agg(F.sum("s").alias("s"))


def _moments(s: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and covariance (ddof 1) from a list of sums."""
    if not len(s):
        return 0, np.zeros(0), np.zeros((0, 0))
    d = int(round((-1 + (1 + 4 * (len(s) - 1)) ** 0.5) / 2))
    n, mean = int(s[0]), s[1 : 1 + d] / s[0]
    return n, mean, (s[1 + d :].reshape(d, d) - n * np.outer(mean, mean)) / max(n - 1, 1)


def mean_vector_moments(df: DataFrame, v: str = "v") -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and covariance (ddof 1). The driver gets a number per pair of places, whatever the rows."""
    return _moments(np.array([r["s"] for r in moment_sums(df, v).orderBy("pos").collect()]))


def _frechet(a: tuple, b: tuple) -> float | None:
    (n, m, s), (k, o, t) = a, b
    if min(n, k) < 2:
        return None
    w, q = np.linalg.eigh(s)
    half = (q * np.sqrt(np.maximum(w, 0))) @ q.T
    root = np.sqrt(np.maximum(np.linalg.eigvalsh(half @ t @ half), 0)).sum()
    return float(max(0.0, ((m - o) ** 2).sum() + np.trace(s) + np.trace(t) - 2 * root))


def frechet_distance(a: DataFrame, b: DataFrame, v: str = "v") -> float | None:
    """Distance of the two sets as normal distributions, not below 0; None with under two rows on a side."""
    return _frechet(mean_vector_moments(a, v), mean_vector_moments(b, v))


def frechet_by_class(a: DataFrame, b: DataFrame) -> DataFrame:
    """(cls, frechet) of the two sets (cls, v) in each class that both have; a class's task gets its sums, not its rows."""
    sums = moment_sums(a, "v", ("cls",)).withColumn("side", F.lit(0)).unionByName(moment_sums(b, "v", ("cls",)).withColumn("side", F.lit(1)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [_moments(pdf[pdf["side"] == i].sort_values("pos")["s"].to_numpy()) for i in (0, 1)]
        return pd.DataFrame({"cls": pdf["cls"].iloc[:1].to_numpy(), "frechet": [_frechet(*sides)]}) if min(s[0] for s in sides) else pd.DataFrame({"cls": [], "frechet": []})

    return sums.groupBy("cls").applyInPandas(run, f"cls {a.schema['cls'].dataType.simpleString()}, frechet double")


def _cubic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x @ y.T / x.shape[1] + 1) ** 3


def _two_sides(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys, "id", "v", F.lit(0).alias("side")).unionByName(b.select(*keys, "id", "v", F.lit(1).alias("side")))


def kernel_distance_biased(a: DataFrame, b: DataFrame, *, cap: int = 1000, least: int = 10) -> DataFrame:
    """One row (n, distance): cubic-kernel MMD with the diagonal, not below 0, of equal samples of up to ``cap`` rows; 0 under ``least``."""
    n = min(cap, a.count(), b.count())
    if n < least:
        return a.sparkSession.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(0.0).alias("distance"))
    both = _two_sides(capped_sample(a.withColumn("_k", F.lit(0)), ["_k"], "id", n), capped_sample(b.withColumn("_k", F.lit(0)), ["_k"], "id", n), [])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x, y = _stack(pdf["v"][pdf["side"] == 0]), _stack(pdf["v"][pdf["side"] == 1])
        return pd.DataFrame({"n": [len(x)], "distance": [max(0.0, _cubic(x, x).mean() + _cubic(y, y).mean() - 2 * _cubic(x, y).mean())]})

    # the sample is bounded by the cap
    return both.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "n long, distance double")


def kernel_by_class(a: DataFrame, b: DataFrame, *, cap: int = 1000, least: int = 10) -> DataFrame:
    """(cls, kernel): ``kernel_distance_biased`` of each class that both sets (id, cls, v) have."""

    def drawn(df: DataFrame, side: int) -> DataFrame:
        return capped_sample(df.select("id", "cls", "v").dropna(subset=["cls"]), ["cls"], "id", cap, place="place").withColumn("side", F.lit(side))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = (pdf[pdf["side"] == i].sort_values("place")["v"] for i in (0, 1))
        n = min(len(x), len(y))
        if not n:
            return pd.DataFrame({"cls": [], "kernel": []})
        x, y = _stack(x[:n]), _stack(y[:n])
        value = max(0.0, _cubic(x, x).mean() + _cubic(y, y).mean() - 2 * _cubic(x, y).mean()) if n >= least else 0.0
        return pd.DataFrame({"cls": pdf["cls"].iloc[:1].to_numpy(), "kernel": [value]})

    # a class's sample is bounded by the cap
    return drawn(a, 0).unionByName(drawn(b, 1)).groupBy("cls").applyInPandas(run, f"cls {a.schema['cls'].dataType.simpleString()}, kernel double")


def kernel_distance_subsets(a: DataFrame, b: DataFrame, *, subsets: int = 100, size: int = 24, seed: int = 0) -> DataFrame:
    """(cls, distance): unbiased cubic-kernel MMD of each class, the mean over subsets drawn by hash; both (id, cls, v)."""

    def drawn(df: DataFrame) -> DataFrame:
        counts = df.groupBy("cls").agg(F.count("*").alias("_n"))
        unit = F.pmod(F.xxhash64("id", "subset", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
        every = same(df, counts, ["cls"]).withColumn("subset", F.explode(F.sequence(F.lit(0), F.lit(subsets - 1)))).withColumn("_u", unit)
        # eight times the wanted rows are drawn, and the lowest of them taken
        return capped_sample(every.filter(F.col("_u") * F.col("_n") <= 8 * size).drop("_n", "_u"), ["cls", "subset"], "id", size, str(seed))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x, y = pdf["v"][pdf["side"] == 0], pdf["v"][pdf["side"] == 1]
        m = min(len(x), len(y))
        if m < 2:
            return pd.DataFrame({"cls": [], "subset": [], "d": []})
        x, y = _stack(x[:m]), _stack(y[:m])
        kx, ky = _cubic(x, x), _cubic(y, y)
        d = (kx.sum() - np.trace(kx) + ky.sum() - np.trace(ky)) / (m * (m - 1)) - 2 * _cubic(x, y).mean()
        return pd.DataFrame({"cls": pdf["cls"].iloc[:1].to_numpy(), "subset": pdf["subset"].iloc[:1].to_numpy(), "d": [d]})

    keys = ["cls", "subset"]
    return _two_sides(drawn(a), drawn(b), keys).groupBy(*keys).applyInPandas(run, "cls int, subset int, d double").groupBy("cls").agg(F.avg("d").alias("distance"))


def radii(rows: DataFrame, k: int) -> DataFrame:
    """(id, cls, v, r): distance of unit vectors to their k-th nearest other row."""
    far = knn_join(rows, rows, k).groupBy(F.col("qid").alias("id")).agg(F.max(cos_to_euclid("similarity")).alias("r"))
    return written(rows.join(far, "id"), "radii")


def _balls(g: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
    """Of generated and real rows with radii: how many balls of the other side each is in, and whether its own ball is met."""
    x, y, own, far = _stack(g["v"]), _stack(r["v"]).T, g["r"].to_numpy(), r["r"].to_numpy()
    balls, met, covered = np.zeros(len(g), int), np.zeros(len(r), int), np.zeros(len(r), int)
    # no product under this one is within a radius
    low_own, low_far = (1 - x * x / 2 - 1e-9 for x in (own, far))
    for part in slices(len(g), len(r)):
        s = x[part] @ y
        i, j = places(s >= np.minimum.outer(low_own[part], low_far))
        d = np.sqrt(np.maximum(2 - 2 * s[i, j], 0))
        in_real = d <= far[j] + 1e-12
        balls[part] = np.bincount(i[in_real], minlength=len(s))
        met[j[d <= own[part][i] + 1e-12]] = 1
        covered[j[in_real]] = 1
    return pd.DataFrame({
        "side": np.repeat([0, 1], [len(g), len(r)]), "cls": np.concatenate((g["cls"], r["cls"])), "id": np.concatenate((g["id"], r["id"])),
        "balls": np.concatenate((balls, met)), "covered": np.concatenate((np.zeros(len(g), int), covered))})


def _shares(met: DataFrame, keys: list[str], k) -> DataFrame:
    rows = met.groupBy(*keys, "side", "id").agg(F.sum("balls").alias("balls"), F.max("covered").alias("covered"))
    of = lambda side, x: F.avg(F.when(F.col("side") == side, x))
    hit = (F.col("balls") > 0).cast("double")
    out = rows.groupBy(*keys).agg(of(0, hit).alias("precision"), of(1, hit).alias("recall"), of(0, F.col("balls")).alias("_balls"), of(1, F.col("covered")).alias("coverage"))
    out = same(out, k, keys) if keys else out.withColumn("k", F.lit(k))
    return out.select(*keys, "precision", "recall", (F.col("_balls") / F.col("k")).alias("density"), "coverage")


def prdc(real: DataFrame, generated: DataFrame, k: int = 3) -> DataFrame:
    """One row (precision, recall, density, coverage) over balls to the k-th neighbour; both (id, cls, v), unit vectors."""
    k = max(1, min(k, real.count() - 1, generated.count() - 1))
    met = block_pairs(radii(generated, k), radii(real, k), _balls, f"side int, cls {real.schema['cls'].dataType.simpleString()}, id long, balls long, covered long")
    return _shares(met, [], k)


def prdc_by_class(real: DataFrame, generated: DataFrame, k: int = 3) -> DataFrame:
    """(cls, precision, recall, density, coverage): ``prdc`` of each class with two rows or more on both sides, in one plan."""
    sizes = [df.dropna(subset=["cls"]).groupBy("cls").agg(F.count("*").alias(n)) for df, n in ((real, "_r"), (generated, "_g"))]
    at = sizes[0].join(sizes[1], "cls").filter("_r > 1 AND _g > 1").select("cls", F.least(F.lit(k), F.col("_r") - 1, F.col("_g") - 1).cast("int").alias("k"))
    at = written(at, "class-k")

    def reach(rows: DataFrame) -> DataFrame:
        near = knn_join(rows.select("id", "cls", "v"), rows.select("id", "cls", "v"), k, scope="own").select(F.col("qid").alias("id"), "similarity", "rnk")
        far = near.join(rows.select("id", "cls"), "id").join(at, "cls").filter("rnk = k").select("id", cos_to_euclid("similarity").alias("r"))
        return written(rows.select("id", "cls", "v").join(far, "id"), "radii")

    met = block_pairs(reach(generated), reach(real), _balls, f"side int, cls {real.schema['cls'].dataType.simpleString()}, id long, balls long, covered long", keys=["cls"])
    return _shares(met, ["cls"], at)


def set_distances(real: DataFrame, generated: DataFrame, k: int = 3) -> DataFrame:
    """(cls, n_real, n_generated, frechet, kernel, precision, recall, density, coverage) of each class that both sets (id, cls, v) have.

    A class with one row on a side has no Frechet distance and no balls: null there.
    """
    real, generated = (written(df.select("id", "cls", F.col("v").cast("array<double>").alias("v")), "set") for df in (real, generated))
    n = real.groupBy("cls").agg(F.count("*").alias("n_real")).join(generated.groupBy("cls").agg(F.count("*").alias("n_generated")), "cls")
    return n.join(frechet_by_class(real, generated), "cls", "left").join(kernel_by_class(real, generated), "cls", "left").join(prdc_by_class(real, generated, k), "cls", "left")


def improved_precision_recall(real: DataFrame, generated: DataFrame, k: int = 3) -> DataFrame:
    return prdc(real, generated, k).select("precision", "recall")


def memorization_check(real: DataFrame, generated: DataFrame) -> DataFrame:
    """One row: lower median distance of generated rows to the nearest real one, and of real ones to another real one."""

    def median(near: DataFrame, name: str) -> DataFrame:
        return near.select(cos_to_euclid("similarity").alias("d")).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY d)").alias(name))

    return median(knn_join(generated, real, 1), "generated_to_real").join(F.broadcast(median(knn_join(real, real, 1), "real_to_real")))


def feature_separation(rows: DataFrame) -> DataFrame:
    """One row over (id, cls, v): silhouette, davies_bouldin, calinski_harabasz, compactness, separation, fisher.

    Null with under two classes or three rows. The silhouette compares all pairs, block by block.
    """
    centroids = class_vectors(class_reference(rows)).select("cls", "n", "centroid")
    own = rows.join(F.broadcast(centroids), "cls").select("id", "cls", "n", squared_distance("v", "centroid").alias("d2"))
    spread = own.groupBy("cls", "n").agg(F.avg(F.sqrt("d2")).alias("s"), F.sum("d2").alias("w"))
    named = centroids.join(spread.select("cls", "s", "w"), "cls")
    other = named.select(F.col("cls").alias("o"), F.col("centroid").alias("oc"), F.col("s").alias("os"))
    # classes with classes: a few rows
    gaps = named.join(F.broadcast(other), F.col("cls") != F.col("o")).select("cls", "o", "s", "os", F.sqrt(squared_distance("centroid", "oc")).alias("gap"))
    worst = gaps.groupBy("cls").agg(F.max((F.col("s") + F.col("os")) / F.col("gap")).alias("worst"))
    bouldin = worst.agg(F.avg("worst").alias("davies_bouldin"), F.count("*").alias("k"))
    apart = gaps.filter("cls < o").agg(F.avg("gap").alias("separation"))
    long = rows.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m"))
    middle = long.agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("g"))
    from_middle = named.join(F.broadcast(middle)).select("n", "w", squared_distance("centroid", "g").alias("b"))
    between = from_middle.agg(F.sum(F.col("n") * F.col("b")).alias("b"), F.avg("b").alias("b_mean"), F.sum("w").alias("w"), F.sum("n").alias("n"))
    tight = own.agg(F.avg(F.sqrt("d2")).alias("compactness"), F.avg("d2").alias("w_mean"))

    def sums(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        a, b, xid, yid, cls = _stack(x["v"]), _stack(y["v"]), x["id"].to_numpy(), y["id"].to_numpy(), y["cls"].to_numpy()
        kinds, parts = np.unique(y["cls"]), []
        for part in slices(len(a), len(b)):
            d = np.sqrt(np.maximum((a[part] * a[part]).sum(1)[:, None] + (b * b).sum(1) - 2 * a[part] @ b.T, 0))
            d[xid[part][:, None] == yid] = 0
            parts.append(np.stack([d[:, cls == c].sum(1) for c in kinds], 1))
        at = np.concatenate(parts)
        return pd.DataFrame({"id": np.repeat(x["id"].to_numpy(), len(kinds)), "other": np.tile(kinds, len(x)), "s": at.ravel()})

    far = block_pairs(rows.select("id", "cls", "v"), rows.select("id", "cls", "v"), sums, "id long, other int, s double").groupBy("id", "other").agg(F.sum("s").alias("s"))
    each = rows.select("id", "cls").join(far, "id").join(F.broadcast(centroids.select(F.col("cls").alias("other"), F.col("n").alias("on"))), "other")
    mine = F.max(F.when(F.col("cls") == F.col("other"), F.try_divide(F.col("s"), F.col("on") - 1))).alias("a")
    ab = each.groupBy("id", "cls").agg(mine, F.min(F.when(F.col("cls") != F.col("other"), F.col("s") / F.col("on"))).alias("b"))
    silhouette = ab.agg(F.avg(F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))).alias("silhouette"))
    out = bouldin.join(F.broadcast(apart)).join(F.broadcast(between)).join(F.broadcast(tight)).join(F.broadcast(silhouette))
    ch = (F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))
    return out.filter((F.col("k") >= 2) & (F.col("n") >= 3)).select("silhouette", "davies_bouldin", ch.alias("calinski_harabasz"), "compactness", "separation", (F.col("b_mean") / (F.col("w_mean") + 1e-12)).alias("fisher"))


def pca_2d(rows: DataFrame) -> DataFrame:
    """(id, x, y): two principal components of centred vectors; each has its largest loading positive."""
    vectors = rows.select("id", array_to_vector(F.transform("v", lambda x: x.cast("double"))).alias("f"))
    centred = StandardScaler(inputCol="f", outputCol="c", withMean=True, withStd=False).fit(vectors).transform(vectors)
    model = PCA(k=2, inputCol="c", outputCol="p").fit(centred)
    loads = model.pc.toArray()
    sign = [1.0 if loads[np.abs(loads[:, i]).argmax(), i] >= 0 else -1.0 for i in range(2)]
    p = vector_to_array("p")
    return model.transform(centred).select("id", (p[0] * sign[0]).alias("x"), (p[1] * sign[1]).alias("y"))


def score_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r): Pearson correlation of each pair of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])))


def metric_histogram(df: DataFrame, keys: list[str], value: str, *, selected: str | None = None, most: int = 30, least: int = 10) -> DataFrame:
    """(keys, [selected,] bin, bins, n): counts per bin; as many bins as distinct values, within bounds; constant keys are left out."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count_distinct(value).alias("_d")).filter("_hi > _lo")
    bins = F.least(F.lit(most), F.greatest(F.lit(least), F.col("_d"))).cast("int")
    placed = same(df, ends.withColumn("bins", bins), keys)
    at = F.least(F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.col("bins")), F.col("bins") - 1).cast("int")
    return placed.filter(F.col(value).isNotNull()).groupBy(*keys, *([selected] if selected else []), "bins", at.alias("bin")).agg(F.count("*").alias("n"))
