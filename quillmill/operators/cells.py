"""Cells of a vector table around pivots, and which of them a query has to meet.

Every vector belongs to the pivot at the least angle from it, and a cell keeps the range of those angles
and of its vectors' lengths. By the triangle inequality of angles, a vector of a cell is at least
``angle(q, pivot) - hi``, ``lo - angle(q, pivot)`` and half of ``angle(q, pivot) - angle(q, nearest pivot)``
away from a query; with the lengths this bounds every product of the query with the cell. A query meets
its nearest cells first, until they hold k rows, and then those cells alone whose bound reaches its k-th
product so far. Rows of a table are never copied to cells that no query wants.

A cell with many rows is cut into parts, and so are the queries that meet it, so no task holds more than
two parts. The driver holds the pivots and a row per cell, ``MOST_BLOCKS`` at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.storage import written

MOST_PIVOTS = 4096
MOST_BLOCKS = 65_536
#: Classes share so many kinds at most; cells of a kind hold its classes, told apart when they are compared.
MOST_KINDS = 256


#: Entries of a matrix of products that a task holds at once, about.
CHUNK = 2_000_000
#: Rows, with their vectors, that a task passes on at once.
OUT_ROWS = 16_384


def slices(rows: int, columns: int) -> Iterator[slice]:
    """Runs of rows that make a matrix of about ``CHUNK`` entries with so many columns."""
    step = max(1, CHUNK // max(columns, 1))
    return (slice(i, i + step) for i in range(0, rows, step))


def places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each true entry."""
    return np.divmod(np.flatnonzero(mask), max(mask.shape[1], 1))


def stack(x: pd.Series) -> np.ndarray:
    return np.stack(x.to_numpy()).astype(np.float64)


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.sqrt((x * x).sum(axis=1))
    return x / np.maximum(length, 1e-300)[:, None], length


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))


@dataclass
class Cells:
    """``rows`` is (did, dcls, dv, block); the arrays have an entry per block, in the order of ``block``."""

    rows: DataFrame | None
    pivots: np.ndarray
    kinds: int
    block: np.ndarray
    n: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    short: np.ndarray
    long: np.ndarray
    only: np.ndarray

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """What a product of each query with a vector of each block cannot exceed."""
        unit, length = _units(q)
        angle = _angles(unit, self.pivots)
        at = angle[:, self.block % len(self.pivots)]
        least = np.maximum.reduce([np.zeros_like(at), at - self.hi, self.lo - at, (at - angle.min(axis=1)[:, None]) / 2])
        c = np.cos(np.minimum(least, np.pi))
        return length[:, None] * np.where(c >= 0, self.long, self.short) * c


def kind(cls: str, kinds: int) -> Column:
    return F.pmod(F.xxhash64(cls), F.lit(kinds)).cast("long")


def cells(table: DataFrame, *, by_class: bool, cell_rows: int) -> Cells:
    """Cells of a table (id, cls, v), of about ``cell_rows`` rows; by class, a cell holds one kind of class."""
    n, classes = table.count(), table.select("cls").distinct().count() if by_class else 1
    kinds = min(MOST_KINDS, 4 * classes) if by_class and classes > 1 else 1
    most = max(1, min(MOST_PIVOTS, MOST_BLOCKS // min(max(classes, 1), kinds), -(-n // cell_rows)))
    # the driver gets ``most`` vectors
    drawn = [r["v"] for r in table.orderBy(F.xxhash64("id"), "id").limit(most).select("v").collect()]
    pivots, _ = _units(np.array(drawn or [[0.0]], np.float64))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                unit, length = _units(stack(f["dv"]))
                angle = _angles(unit, pivots)
                cell = angle.argmin(axis=1)
                yield f.assign(block=f["block"] * len(pivots) + cell, angle=angle[np.arange(len(f)), cell], length=length)

    given = table.select(F.col("id").alias("did"), F.col("cls").alias("dcls"), F.col("v").cast("array<double>").alias("dv"), kind("cls", kinds).alias("block"))
    c = given.schema["dcls"].dataType.simpleString()
    rows = written(given.mapInPandas(place, f"did long, dcls {c}, dv array<double>, block long, angle double, length double"), "cells")
    stats = rows.groupBy("block").agg(
        F.count("*").alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.min("length").alias("short"), F.max("length").alias("long"),
        F.when((F.min("dcls") == F.max("dcls")) & (F.count("dcls") == F.count("*")), F.min("dcls")).alias("only")).orderBy("block").toPandas()
    of = lambda name: stats[name].to_numpy()
    # the margins cover what doubles round off
    return Cells(rows.drop("angle", "length"), pivots, kinds, of("block"), of("n"), of("lo") - 1e-7, of("hi") + 1e-7, of("short"), of("long"), of("only"))


def wanted_blocks(queries: DataFrame, c: Cells, k: int, scope: str, *, probes: int = 1, after: bool = False) -> DataFrame:
    """(qid, qcls, qv, block) of queries (qid, qcls, qv, kind, [least]): the blocks that each meets.

    First those of the highest bounds that hold over k rows together, ``probes`` of them at least; with
    ``after``, the others whose bound is not under ``least``.
    """
    c = replace(c, rows=None)  # what goes to the tasks
    step = max(1, 2_000_000 // max(1, len(c.block)))
    single = np.array([x is not None and x == x for x in c.only], bool)

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames if len(c.block) else ():
            for i in range(0, len(f), step):
                part = f.iloc[i : i + step]
                bound = c.bounds(stack(part["qv"]))
                if scope == "own":
                    bound[(c.block // len(c.pivots))[None, :] != part["kind"].to_numpy()[:, None]] = -np.inf
                elif scope == "other":
                    bound[single[None, :] & (np.asarray(c.only, object)[None, :] == part["qcls"].to_numpy()[:, None])] = -np.inf
                order = np.argsort(-bound, axis=1, kind="stable")
                held = np.cumsum(c.n[order], axis=1) - c.n[order]
                rank = np.arange(len(c.block))[None, :]
                first = (held <= k) | (rank < probes)
                take = np.zeros_like(first)
                np.put_along_axis(take, order, first, axis=1)
                if after:
                    take = ~take & (bound >= part["least"].to_numpy()[:, None] - 1e-9)
                rows, at = np.nonzero(take & np.isfinite(bound))
                for j in range(0, len(rows), OUT_ROWS):
                    row = rows[j : j + OUT_ROWS]
                    yield pd.DataFrame({"qid": part["qid"].to_numpy()[row], "qcls": part["qcls"].to_numpy()[row], "qv": part["qv"].to_numpy()[row], "block": c.block[at[j : j + OUT_ROWS]]})

    kind_ = queries.schema["qcls"].dataType.simpleString()
    return queries.mapInPandas(choose, f"qid long, qcls {kind_}, qv array<double>, block long")


def meet(wanted: DataFrame, c: Cells, function: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, block_rows: int) -> DataFrame:
    """``function(queries, rows)`` of every block with the queries that want it, in parts of about ``block_rows`` each."""
    spark = wanted.sparkSession
    sizes = spark.createDataFrame(pd.DataFrame({"block": c.block, "dparts": -(-c.n // block_rows)}), "block long, dparts int")
    asked = wanted.groupBy("block").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("qparts"))
    parts = F.broadcast(asked.join(sizes, "block"))  # a row a block, MOST_BLOCKS at most
    deal = lambda id_, n: F.pmod(F.xxhash64(id_), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = wanted.join(parts, "block").select("qid", "qcls", "qv", "block", deal("qid", "qparts").alias("qp"), every("dparts").alias("dp"))
    d = c.rows.join(parts, "block").select("did", "dcls", "dv", "block", deal("did", "dparts").alias("dp"), every("qparts").alias("qp"))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return function(x, y) if len(x) and len(y) else pd.DataFrame({n: [] for n in names})

    return q.groupBy("block", "qp", "dp").cogroup(d.groupBy("block", "qp", "dp")).applyInPandas(run, schema)
