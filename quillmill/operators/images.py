"""Descriptors of images, one row an image; aggregates over them are ordinary group-bys.

Images are rows (id, height, width, channels, data) with bytes by row, then place, then channel, the
last in the order blue, green, red, as Spark's image source gives them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions.columns import hinge_excess, rel_mse
from quillmill.operators.distances import moment_sums

SCHEMA = "id string, height int, width int, channels int, data binary"


def from_source(images: DataFrame) -> DataFrame:
    """Rows of Spark's image source as (id, height, width, channels, data)."""
    i = F.col("image")
    return images.select(i["origin"].alias("id"), i["height"].alias("height"), i["width"].alias("width"), i["nChannels"].alias("channels"), i["data"].alias("data"))


def from_values(rows: DataFrame, values: str, width: int) -> DataFrame:
    """Gray images of ``width`` columns from (id, array of numbers in [-1, 1])."""
    byte = lambda x: F.lpad(F.hex(F.least(F.greatest(F.round((x.cast("double") + 1) * 127.5), F.lit(0)), F.lit(255)).cast("int")), 2, "0")
    return rows.select(F.col("id").cast("string").alias("id"), (F.size(values) / width).cast("int").alias("height"), F.lit(width).alias("width"), F.lit(1).alias("channels"), F.unhex(F.array_join(F.transform(values, byte), "")).alias("data"))


def _described(images: DataFrame, function: Callable[[np.ndarray], tuple], names: list[str]) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [function(np.frombuffer(d, np.uint8).reshape(h, w, c)) for h, w, c, d in zip(f["height"], f["width"], f["channels"], f["data"], strict=True)]
            yield pd.DataFrame(rows, columns=names, dtype=float).assign(id=f["id"].to_numpy())[["id", *names]]

    return images.select("id", "height", "width", "channels", "data").mapInPandas(run, "id string, " + ", ".join(f"{n} double" for n in names))


def gray(pixels: np.ndarray) -> np.ndarray:
    """Luma in [0, 1]."""
    x = pixels.astype(np.float64)
    return (x[..., 0] if x.shape[2] == 1 else 0.114 * x[..., 0] + 0.587 * x[..., 1] + 0.299 * x[..., 2]) / 255


def otsu(signal: np.ndarray) -> int:
    """The first of the thresholds with the largest variance between its sides."""
    n = np.bincount(signal.ravel(), minlength=256).astype(np.float64)
    w, m = np.cumsum(n), np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (m[-1] * w / w[-1] - m) ** 2 / (w * (w[-1] - w))
    return int(np.argmax(np.nan_to_num(between, nan=0.0, posinf=0.0)))


def _box(pixels: np.ndarray) -> tuple:
    signal = pixels.max(2)
    h, w = signal.shape
    full = (0, 0, w, h, 1.0, 0.0)
    if signal.max() < 8:
        return full
    at = otsu(signal)
    mask = signal > max(6, at)
    share = float(mask.mean())
    if not 0.01 <= share <= 0.92:
        return (0, 0, w, h, share, at)
    rows, columns = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    top, bottom, left, right = rows[0], rows[-1] + 1, columns[0], columns[-1] + 1
    pad = math.ceil(0.08 * max(bottom - top, right - left))
    top, left, bottom, right = max(0, top - pad), max(0, left - pad), min(h, bottom + pad), min(w, right + pad)
    return (0, 0, w, h, share, at) if min(bottom - top, right - left) < 8 else (left, top, right, bottom, share, at)


def foreground_box(images: DataFrame) -> DataFrame:
    """(id, left, top, right, bottom, coverage, threshold); the whole frame where nothing stands out."""
    return _described(images, _box, ["left", "top", "right", "bottom", "coverage", "threshold"])


def _closed(mask: np.ndarray) -> np.ndarray:
    """A 3 by 3 closing: grown, then shrunk."""

    def over(m: np.ndarray, reduce: Callable, edge: bool) -> np.ndarray:
        p = np.pad(m, 1, constant_values=edge)
        return reduce(np.stack([p[i : i + m.shape[0], j : j + m.shape[1]] for i in range(3) for j in range(3)]), axis=0)

    return over(over(mask, np.any, False), np.all, True)


def tissue_coverage(images: DataFrame, threshold: float | None = None, *, smooth: bool = False) -> DataFrame:
    """(id, coverage): share of pixels whose largest channel is over a threshold, or over the image's 20th percentile."""

    def run(pixels: np.ndarray) -> tuple:
        light = pixels.max(2).astype(np.float64)
        mask = light > (np.percentile(light, 20) if threshold is None else threshold)
        return (float((_closed(mask) if smooth else mask).mean()),)

    return _described(images, run, ["coverage"])


def _haar(pixels: np.ndarray) -> tuple:
    g = gray(pixels)
    g = g[: g.shape[0] // 2 * 2, : g.shape[1] // 2 * 2]
    a, b, c, d = g[::2, ::2], g[::2, 1::2], g[1::2, ::2], g[1::2, 1::2]
    if not a.size:
        return 0.0, 0.0, 0.0
    return tuple(float(np.abs(x).mean() * 0.5) for x in (a - b + c - d, a + b - c - d, a - b - c + d))


def haar_energy(images: DataFrame) -> DataFrame:
    """(id, lh, hl, hh): mean size of the details of 2 by 2 cells."""
    return _described(images, _haar, ["lh", "hl", "hh"])


def total_variation(images: DataFrame) -> DataFrame:
    """(id, tv): mean size of vertical plus of horizontal differences."""

    def run(pixels: np.ndarray) -> tuple:
        g = gray(pixels)
        return (sum(float(np.abs(np.diff(g, axis=i)).mean()) if g.shape[i] > 1 else 0.0 for i in (0, 1)),)

    return _described(images, run, ["tv"])


def fluorescence_stats(images: DataFrame, k: float = 0.5, tau: float = 0.08) -> DataFrame:
    """(id, coverage, fg_mean, fg_std) under a soft mask around mean + k deviations."""

    def run(pixels: np.ndarray) -> tuple:
        g = gray(pixels)
        mask = 1 / (1 + np.exp(-(g - (g.mean() + k * g.std())) / tau))
        mean = float((mask * g).sum() / (mask.sum() + 1e-8))
        return float(mask.mean()), mean, float(np.sqrt((mask * (g - mean) ** 2).sum() / (mask.sum() + 1e-8)))

    return _described(images, run, ["coverage", "fg_mean", "fg_std"])


#: Weights of the terms of the gap.
GAP = {"gram": 1.0, "featstat": 1.0, "wavelet": 0.5, "tv": 0.1, "fluor": 0.5}


def texture_gap(described: DataFrame, vectors: DataFrame, kind: str = "set", generated: str = "synth", real: str = "real") -> DataFrame:
    """(cls, gram, featstat, wavelet, tv, fluor, gap) of the generated set against the real one.

    ``described`` is (cls, set, lh, hl, hh, tv, coverage, fg_mean, fg_std) and ``vectors`` (cls, set, v).
    A class that lacks a set is left out.
    """
    means = described.groupBy("cls", kind).agg(
        F.array(*[F.avg(c) for c in ("lh", "hl", "hh")]).alias("wavelet"), F.avg("tv").alias("tv"), F.array(*[F.avg(c) for c in ("coverage", "fg_mean", "fg_std")]).alias("fluor"))
    places = vectors.select("cls", kind, F.posexplode("v").alias("pos", "x")).groupBy("cls", kind, "pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    in_order = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("pos", c))), lambda x: x[c])
    stats = places.groupBy("cls", kind).agg(F.concat(in_order("m"), in_order("s")).alias("featstat"))
    width = F.floor(F.sqrt(F.size("s")))
    # after the rows' number and the width sums come width times width products
    products = moment_sums(vectors, "v", ("cls", kind)).groupBy("cls", kind).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("s"))
    upper = F.filter(F.slice("s", (width + 2).cast("int"), (width * width).cast("int")), lambda x, at: F.floor(at / width) <= at % width)
    gram = products.select("cls", kind, F.transform(upper, lambda x: x / F.get("s", F.lit(0))).alias("gram"))
    sets = means.join(stats, ["cls", kind]).join(gram, ["cls", kind])
    a = sets.filter(F.col(kind) == generated).drop(kind)
    b = sets.filter(F.col(kind) == real).select("cls", *[F.col(c).alias(f"r_{c}") for c in ("wavelet", "tv", "fluor", "featstat", "gram")])
    both = a.join(b, "cls").select("cls", *[rel_mse(c, f"r_{c}").alias(c) for c in ("gram", "featstat", "wavelet", "fluor")], hinge_excess("tv", "r_tv").alias("tv"))
    return both.withColumn("gap", sum((F.col(c) * w for c, w in list(GAP.items())[1:]), F.col("gram") * GAP["gram"]))
