"""Centroid clustering over a vector-approximation file.

Every vector has, beside its integer components, a cell of ``BITS`` bits per dimension and the distance
from the middle of its cells (``slack``), in one table bucketed by row: a round reads the cells' columns
alone. Lookup tables, one entry per dimension and cell, give the squared distance from the middle of a
vector's cells to each centroid. With ``b`` the centroid nearest to the middle ``m``, any ``c`` has

    |x-c|^2 - |x-b|^2 = |m-c|^2 - |m-b|^2 - 2 (x-m).(c-b),

an interval of half-width ``2 * slack * |c-b|``. Centroids whose interval lies above zero are out; a row
with others left has its components fetched, by a join of buckets that moves no vector. Sums of clusters
are kept up by what moved: a vector's components are read when its cluster changes or is open, not else.
The driver holds ``k`` centroids and their sums, at any number of rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from quillmill.storage import shared_dir, written

BITS = 6
#: Rows a bucket should hold, about.
BUCKET_ROWS = 250_000
#: Scaled components are held to this range, so that a squared distance fits in a long.
MOST = 1 << 27


def whole_vectors(rows: DataFrame, id_: str, vector: str, dim: int, scale: int) -> DataFrame:
    """(id, v) of vectors with exactly ``dim`` finite components, each as floor(scale * x)."""
    v = F.col(vector)
    sound = (F.size(v) == dim) & F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    scaled = lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-float(MOST))), F.lit(float(MOST)))).cast("int")
    return rows.filter(F.coalesce(sound, F.lit(False))).select(F.col(id_).alias("id"), F.transform(v, scaled).alias("v"))


def _matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), dim).astype(np.int64)


def pack(cells: np.ndarray) -> list[bytes]:
    bits = np.unpackbits(cells.astype(np.uint8)[:, :, None], axis=2)[:, :, 8 - BITS :]
    return [x.tobytes() for x in np.packbits(bits.reshape(len(cells), -1), axis=1)]


def unpack(packed: pa.Array, dim: int) -> np.ndarray:
    flat = np.frombuffer(b"".join(packed.to_pylist()), np.uint8).reshape(len(packed), -1)
    bits = np.unpackbits(flat, axis=1)[:, : dim * BITS].reshape(len(packed), dim, BITS)
    return bits @ (1 << np.arange(BITS - 1, -1, -1))


def _with_cells(low: np.ndarray, width: np.ndarray):
    """(row, id, v) -> the same with cells and slack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(2), len(low))
            cells = np.clip((v - low) // width, 0, (1 << BITS) - 1)
            twice = 2 * v - (2 * (low + cells * width) + width - 1)
            slack = np.sqrt((twice.astype(np.float64) ** 2).sum(axis=1)) / 2
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pack(cells), pa.binary()), pa.array(slack)], ["row", "id", "v", "cells", "slack"])

    return run


def _guesses(centroids: np.ndarray, low: np.ndarray, width: np.ndarray):
    """(row, prev, cells, slack) -> (row, prev, guess, open): the nearest centroid, or the bits of those that may be."""
    k, dim = centroids.shape
    middle = low[:, None] + np.arange(1 << BITS)[None, :] * width[:, None] + (width[:, None] - 1) / 2
    table = (middle[:, :, None] - centroids.T[:, None, :].astype(np.float64)) ** 2  # dimension, cell, centroid
    apart = np.sqrt(((centroids[:, None, :] - centroids[None]).astype(np.float64) ** 2).sum(axis=2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, slack = unpack(batch.column(2), dim), batch.column(3).to_numpy()
            far = np.zeros((len(cells), k))
            for d in range(dim):
                far += table[d, cells[:, d]]
            best = far.argmin(axis=1)
            least = far[np.arange(len(far)), best]
            # the margin covers what doubles round off
            half = 2 * slack[:, None] * apart[best] * (1 + 1e-9) + 1e-9 * (far + least[:, None]) + 1e-6
            maybe = far - least[:, None] <= half
            sure = maybe.sum(axis=1) == 1
            guess = pa.array(best.astype(np.int32), mask=~sure)
            bits = pa.array([None if s else x.tobytes() for s, x in zip(sure, np.packbits(maybe, axis=1), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), guess, bits], ["row", "prev", "guess", "open"])

    return run


def _nearest(v: np.ndarray, guess: pa.Array, bits: pa.Array, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of each vector, exact in integers; ties go to the smaller number."""
    cluster = guess.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    far = np.full(len(v), np.iinfo(np.int64).max)
    maybe = np.zeros((len(v), len(centroids)), bool)
    known = np.flatnonzero(cluster >= 0)
    maybe[known, cluster[known]] = True
    left = np.flatnonzero(cluster < 0)
    if len(left):
        packed = np.frombuffer(b"".join(bits.take(pa.array(left)).to_pylist()), np.uint8).reshape(len(left), -1)
        maybe[left] = np.unpackbits(packed, axis=1)[:, : len(centroids)].astype(bool)
    for c in range(len(centroids)):
        rows = np.flatnonzero(maybe[:, c])
        d = ((v[rows] - centroids[c]) ** 2).sum(axis=1)
        nearer = d < far[rows]
        far[rows[nearer]], cluster[rows[nearer]] = d[nearer], c
    return cluster, far


def _settle(centroids: np.ndarray):
    """(row, prev, guess, open, v) -> each row's cluster, then what the task's rows move between the sums."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        names = ["row", "cluster", "n", "sums"]
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(4), dim)
            cluster, _ = _nearest(v, batch.column(2), batch.column(3), centroids)
            prev = batch.column(1).fill_null(-1).to_numpy(zero_copy_only=False)
            moved = np.flatnonzero(prev != cluster)
            np.add.at(counts, cluster[moved], 1)
            np.add.at(sums, cluster[moved], v[moved])
            had = moved[prev[moved] >= 0]
            np.subtract.at(counts, prev[had], 1)
            np.subtract.at(sums, prev[had], v[had])
            none = pa.nulls(len(v))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), none.cast(pa.int64()), none.cast(pa.list_(pa.int64()))], names)
        touched = np.flatnonzero((counts != 0) | (sums != 0).any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(touched), pa.int64()), pa.array(touched, pa.int32()), pa.array(counts[touched]), pa.array(list(sums[touched]), pa.list_(pa.int64()))], names)

    return run


def _distances(centroids: np.ndarray):
    """(id, guess, open, v) -> (id, cluster, distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, far = _nearest(_matrix(batch.column(3), centroids.shape[1]), batch.column(1), batch.column(2), centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array(far)], ["id", "cluster", "distance"])

    return run


class _Buckets:
    """Tables of one run, bucketed and sorted by row, so that their joins shuffle nothing."""

    def __init__(self, like: DataFrame, n: int) -> None:
        self.spark, self.n, self.names = like.sparkSession, n, []

    def write(self, df: DataFrame) -> DataFrame:
        name = f"quillmill_va_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark).rstrip('/')}/{name}"
        df.repartition(self.n, "row").sortWithinPartitions("row").write.bucketBy(self.n, "row").sortBy("row").option("path", path).saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def drop(self) -> None:
        """Forget the names; the files stay in the shared folder."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def cluster_vectors(
    rows: DataFrame, *, id_: str = "vec_id", vector: str = "embedding", dim: int = 64, k: int = 40, rounds: int = 5, scale: int = 256, salt: str = "2:", fetched: list | None = None
) -> DataFrame:
    """One row per whole vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    The ``k`` vectors whose sha256 of ``salt`` and id is least are the first centroids, in that order.
    A round assigns every vector to the nearest centroid and replaces every non-empty one by the floor
    of its vectors' mean. All arithmetic that decides is in integers.

    Vectors of another length, or with a null, NaN or infinite component, are left out; scaled
    components beyond 2**27 either way count as that. Repeated rows are vectors of their own; those of
    one id are ordered by their components for the first centroids, and a null id hashes as an empty
    one. With fewer vectors than ``k``, each is a centroid; an empty table gives no rows. Other columns
    are not read. ``fetched`` receives, per round and last, (vectors, vectors whose components were read).
    """
    spark = rows.sparkSession
    kept = written(whole_vectors(rows, id_, vector, dim, scale).withColumn("row", F.monotonically_increasing_id()).select("row", "id", "v"), "vectors")
    named = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    # k rows
    first = [r["v"] for r in kept.orderBy(named, "v").limit(k).select("v").collect()]
    out = "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], out).withColumnRenamed("id", id_)
    centroids = np.array(first, np.int64)
    k = len(centroids)

    ends = kept.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.percentile_approx("x", [0.002, 0.998], 1000).alias("e")).collect()  # a row a dimension
    low, high = (np.array([r["e"][i] for r in sorted(ends, key=lambda r: r["d"])], np.int64) for i in (0, 1))
    width = np.maximum(1, -(-(high - low + 1) >> BITS))
    n = kept.count()
    tables = _Buckets(kept, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BUCKET_ROWS)))
    vectors = tables.write(kept.mapInArrow(_with_cells(low, width), "row long, id long, v array<int>, cells binary, slack double"))
    counts, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)

    state = None
    for at in range(rounds + 1):
        scan = vectors.select("row", "cells", "slack")
        scan = scan.withColumn("prev", F.lit(None).cast("int")) if state is None else scan.join(state, "row")
        near = tables.write(scan.select("row", "prev", "cells", "slack").mapInArrow(_guesses(centroids, low, width), "row long, prev int, guess int, open binary"))
        wanted = near.filter(~F.col("prev").eqNullSafe(F.col("guess")) | F.col("guess").isNull())
        if fetched is not None:
            fetched.append((n, wanted.count() if at < rounds else n))
        if at == rounds:
            break
        settled = wanted.join(vectors.select("row", "v"), "row").select("row", "prev", "guess", "open", "v")
        moved = written(settled.mapInArrow(_settle(centroids), "row long, cluster int, n long, sums array<long>"), "va-moved")
        # rows here are clusters by task, with their sums in one array each
        added = [F.sum(F.get("sums", F.lit(d))) for d in range(dim)]
        change = moved.filter("row is null").groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*added).alias("sums"))
        for r in change.collect():  # at most k rows
            counts[r["cluster"]] += r["n"]
            sums[r["cluster"]] += np.array(r["sums"], np.int64)
        some = counts > 0
        centroids = centroids.copy()
        centroids[some] = sums[some] // counts[some, None]
        new = moved.filter("row is not null").select("row", "cluster")
        state = near.join(new, "row", "left").select("row", F.coalesce("cluster", "guess").alias("prev"))

    last = near.join(vectors.select("row", "id", "v"), "row").select("id", "guess", "open", "v").mapInArrow(_distances(centroids), "id long, cluster int, distance long")
    found = written(last, "va-clusters")
    tables.drop()
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # at most k rows
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    by_cluster = spark.createDataFrame([Row(cluster=c, cluster_inertia=s, inertia=sum(inertia.values()), centroid_sha256=digest[c]) for c, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = found.join(F.broadcast(by_cluster), "cluster")  # k rows
    return joined.select(F.col("id").alias(id_), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
