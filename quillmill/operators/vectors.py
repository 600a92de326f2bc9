"""Operators over embedding columns: exact nearest neighbours in blocks, class references, scores."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quillmill.functions.columns import cosine, diag_mahalanobis, l2_normalize, total
from quillmill.operators.cells import cells, kind, meet, places, slices, stack, wanted_blocks
from quillmill.operators.running import running_sums, same
from quillmill.storage import written

#: Rows of a side that one task compares; their products are made a few rows at a time.
BLOCK_ROWS = 16_384
CELL_ROWS = 2048
#: So many pairs of blocks, or fewer, are compared without cells, pack by pack.
WHOLE_BLOCKS = 1600
#: Rows of one pack, about.
PACK_ROWS = 4096
#: Partitions that the packs of the left and of the right side are read in, at most; a row of the left gives results once per right one.
PACK_PARTS = 16, 6
NEAR = "qid long, did long, similarity double"


def _blocks(df: DataFrame, rows: int) -> int:
    return max(1, -(-df.count() // rows))


def _best(k: int, scope: str):
    """The k most similar of a part's rows for each query; ties go to the lower id, and a query never meets its own id.

    With ``held``, what the queries found in other parts, the k best of both; only rows that reach a query's k-th are looked at.
    """

    def best(left: pd.DataFrame, right: pd.DataFrame, held: pd.DataFrame | None = None) -> pd.DataFrame:
        right = right.sort_values("did")
        queries, rows_of, qids, dids = stack(left["qv"]), stack(right["dv"]), left["qid"].to_numpy(), right["did"].to_numpy()
        codes = pd.factorize(pd.concat([left["qcls"], right["dcls"]]))[0]  # -1 for null
        qc, dc = codes[: len(left)], codes[len(left) :]
        reached = np.full(len(left), -np.inf) if held is None else _reached(held, qids, k)
        found = [] if held is None else [held]
        for c in np.unique(qc[qc >= 0]) if scope != "all" else [None]:
            mine = np.arange(len(left)) if c is None else np.flatnonzero(qc == c)
            theirs = np.arange(len(right)) if c is None else np.flatnonzero(dc == c if scope == "own" else (dc != c) & (dc >= 0))
            d, did = rows_of[theirs].T, dids[theirs]
            for part in slices(len(mine), len(did)) if len(did) else []:
                at_q = mine[part]
                s, qid, least = queries[at_q] @ d, qids[at_q], reached[at_q]
                itself = np.flatnonzero(np.isin(qid, did))
                if len(itself):
                    s[itself] = np.where(qid[itself][:, None] == did, -np.inf, s[itself])
                hits = s >= (least - 1e-11)[:, None]
                if s.shape[1] > k and np.count_nonzero(hits) > 4 * k * len(s):
                    # all that reach the k-th value, so that ties are cut by id and not by the partition
                    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                    hits = s >= (least - 1e-11)[:, None]
                rows, at = places(hits)
                found.append(_first(pd.DataFrame({"qid": qid[rows], "did": did[at], "similarity": s[rows, at]}), k))
        return _first(pd.concat(found), k) if found else pd.DataFrame({"qid": qids[:0], "did": dids[:0], "similarity": np.zeros(0)})

    return best


def _first(near: pd.DataFrame, k: int) -> pd.DataFrame:
    """The first k rows of each query, in order."""
    near = near[np.isfinite(near["similarity"].to_numpy())]
    qid = near["qid"].to_numpy()
    order = np.lexsort((near["did"].to_numpy(), -np.round(near["similarity"].to_numpy(), 12), qid))
    qid = qid[order]
    return near.iloc[order[np.arange(len(qid)) - np.searchsorted(qid, qid) < k]]


def _reached(held: pd.DataFrame, qids: np.ndarray, k: int) -> np.ndarray:
    """The k-th similarity that each query holds, rounded; minus infinity where it holds fewer."""
    full = held.groupby("qid")["similarity"].agg(["size", "min"])
    least = full["min"].round(12).where(full["size"] >= k, -np.inf)
    return least.reindex(qids).fillna(-np.inf).to_numpy()


def knn_join(
    queries: DataFrame, database: DataFrame, k: int, *, scope: str = "all", block_rows: int = BLOCK_ROWS, cell_rows: int | None = None, probes: int | None = None, report: list | None = None
) -> DataFrame:
    """(qid, did, similarity, rnk): the k most similar rows of ``database`` for each query, exactly.

    Both sides are (id, cls, v). ``scope`` is all, own (equal classes) or other (all other classes).
    Ties go to the lower id; the query's own id is left out; null classes are in no own or other.
    A few blocks are compared whole. Larger tables go through cells of ``cell_rows`` rows (see
    ``cells``): a query meets the cells that may hold one of its k, and ``report`` receives the pairs
    (query, block) met and those that there are. With ``probes``, it meets its nearest cells alone,
    so many of them at least: an index, whose recall the caller measures.
    """
    if cell_rows is None and probes is None and _blocks(queries, block_rows) * _blocks(database, block_rows) <= WHOLE_BLOCKS:
        return _ranked(_whole(queries, database, _best(k, scope), NEAR, block_rows, fold=True), k)
    c = cells(database, by_class=scope != "all", cell_rows=cell_rows or CELL_ROWS)
    q = queries.select(F.col("id").alias("qid"), F.col("cls").alias("qcls"), F.col("v").cast("array<double>").alias("qv"), kind("cls", c.kinds).alias("kind"))
    if scope != "all":
        q = q.filter("qcls IS NOT NULL")
    asked = written(wanted_blocks(q, c, k, scope, probes=probes or 1), "first-cells")
    near = meet(asked, c, _best(k, scope), NEAR, block_rows)
    if probes is None:
        near = written(near, "first-near")
        upto = near.groupBy("qid").agg(F.sort_array(F.collect_list("similarity"), asc=False).alias("s")).select("qid", F.get("s", F.lit(k - 1)).alias("least"))
        rest = q.join(upto, "qid", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        again = written(wanted_blocks(rest, c, k, scope, after=True), "more-cells")
        near = near.unionByName(meet(again, c, _best(k, scope), NEAR, block_rows))
        asked = asked.unionByName(again)
    if report is not None:
        report.append((asked.count(), q.count() * len(c.block)))
    return _ranked(near, k)


def _packs(rows: DataFrame, side: str, keys: list[str], pack_rows: int, parts: int) -> DataFrame:
    """``rows`` stored as (<side>_<key>, <side>_no, <side>): arrays of about ``pack_rows`` rows, dealt by the hash of the id."""
    no = F.pmod(F.xxhash64("id"), F.lit(_blocks(rows, pack_rows))).alias(f"{side}_no")
    packed = rows.groupBy(*[F.col(x).alias(f"{side}_{x}") for x in keys], no).agg(F.collect_list(F.struct(*rows.columns)).alias(side))
    return written(packed, "packs").coalesce(parts)


def _every(left: DataFrame, right: DataFrame, function, schema: str, *, keys: list[str], block_rows: int, fold: bool = False) -> DataFrame:
    """``function(x, y)`` of every pack of ``left`` with every pack of ``right`` of equal ``keys``.

    Each side is shuffled once, into packs; a task then reads a partition of packs of either side, so no row
    is copied into a shuffle for the packs that it meets. With ``fold``, ``function(x, y, held)`` gives what
    is held of x after y, and that alone is passed on, once a task and pack.
    """
    pack_rows = min(block_rows, PACK_ROWS)
    a, b = _packs(left, "a", keys, pack_rows, PACK_PARTS[0]), _packs(right, "b", keys, pack_rows, PACK_PARTS[1])
    on = reduce(lambda x, y: x & y, [F.col(f"a_{x}").eqNullSafe(F.col(f"b_{x}")) for x in keys], F.lit(True))
    pairs = a.join(b.hint("shuffle_replicate_nl"), on) if keys else a.crossJoin(b.hint("shuffle_replicate_nl"))
    names = [f"a_{x}" for x in (*keys, "no")]
    out = to_arrow_schema(StructType.fromDDL(schema))

    def rows_of(batch: pa.RecordBatch, side: str, i: int) -> pd.DataFrame:
        return pa.RecordBatch.from_struct_array(batch.column(side)[i].values).to_pandas()

    def passed(frame: pd.DataFrame) -> pa.RecordBatch:
        return pa.RecordBatch.from_pandas(frame, schema=out, preserve_index=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, held, at = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                now = [batch.column(n)[i].as_py() for n in names]
                if now != at:
                    if held is not None:
                        yield passed(held)
                    x, held, at = rows_of(batch, "a", i), None, now
                y = rows_of(batch, "b", i)
                if fold:
                    held = function(x, y, held)
                else:
                    yield passed(function(x, y))
        if held is not None:
            yield passed(held)

    return pairs.select(*names, "a", "b").mapInArrow(run, schema)


def _whole(queries: DataFrame, database: DataFrame, function, schema: str, block_rows: int, *, fold: bool = False) -> DataFrame:
    """``function`` of every pack of queries with every pack of the database."""
    q = queries.select("id", F.col("id").alias("qid"), F.col("cls").alias("qcls"), F.col("v").alias("qv"))
    d = database.select("id", F.col("id").alias("did"), F.col("cls").alias("dcls"), F.col("v").alias("dv"))
    return _every(q, d, function, schema, keys=[], block_rows=block_rows, fold=fold)


def _ranked(near: DataFrame, k: int) -> DataFrame:
    place = Window.partitionBy("qid").orderBy(F.round("similarity", 12).desc(), "did")
    return near.withColumn("rnk", F.row_number().over(place)).filter(F.col("rnk") <= k)


def knn_recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (wanted, hit, recall): how many of the exact neighbours were found."""
    both = exact.select("qid", "did").join(found.select("qid", "did", F.lit(1).alias("_hit")), ["qid", "did"], "left")
    return both.agg(F.count("*").alias("wanted"), F.count("_hit").alias("hit")).withColumn("recall", F.try_divide(F.col("hit"), F.col("wanted")))


def similar_pairs(rows: DataFrame, above: float, *, keys: list[str] | None = None, block_rows: int = BLOCK_ROWS, cell_rows: int | None = None) -> DataFrame:
    """(a, b), a < b: pairs of rows (id, v) of equal ``keys`` whose similarity is over ``above``.

    A row meets the cells whose bound reaches ``above``, and of a cell only higher ids. Rows of one id are
    not a pair; null keys pair with none.
    """
    keys = keys or []
    kin = F.struct(*keys).cast("string") if keys else F.lit("")
    sound = reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x in keys], F.lit(True))
    own = rows.filter(sound).select("id", kin.alias("cls"), "v")

    def over(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        q, d, qid, did = stack(x["qv"]), stack(y["dv"]).T, x["qid"].to_numpy(), y["did"].to_numpy()
        codes = pd.factorize(pd.concat([x["qcls"], y["dcls"]]))[0]
        qc, dc = codes[: len(x)], codes[len(x) :]
        found = []
        for part in slices(len(q), len(did)):
            s = q[part] @ d
            i, j = places(s > above - 1e-11)
            r, i = np.round(s[i, j], 12), i + part.start
            some = (r > above) & (qid[i] < did[j]) & (qc[i] == dc[j])
            found.append(pd.DataFrame({"a": qid[i[some]], "b": did[j[some]]}))
        return pd.concat(found).drop_duplicates()

    if cell_rows is None and _blocks(own, block_rows) ** 2 <= WHOLE_BLOCKS:
        return _whole(own, own, over, "a long, b long", block_rows)
    c = cells(own, by_class=bool(keys), cell_rows=cell_rows or CELL_ROWS)
    q = own.select(F.col("id").alias("qid"), F.col("cls").alias("qcls"), F.col("v").cast("array<double>").alias("qv"), kind("cls", c.kinds).alias("kind"), F.lit(float(above)).alias("least"))
    asked = written(wanted_blocks(q, c, -1, "own" if keys else "all", probes=0, after=True), "similar-cells")
    return meet(asked, c, over, "a long, b long", block_rows)


def block_pairs(left: DataFrame, right: DataFrame, function, schema: str, *, keys: list[str] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``function(a, b)`` of every pack of ``left`` with every pack of ``right``, both Pandas frames with an id.

    It sees each pair of rows of equal ``keys`` once and returns partial results for a later sum. Both
    tables are read twice: pass stored ones if they take work.
    """
    return _every(left, right, function, schema, keys=keys or [], block_rows=block_rows)


def retrieve_similar(bank: DataFrame, query: list[float], k: int) -> DataFrame:
    """(id, similarity): the k rows of ``bank`` (id, v, unit vectors) nearest to one vector; ties by id."""
    width = bank.select(F.max(F.size("v"))).first()[0]
    if width is not None and width != len(query):
        raise ValueError(f"a query of {len(query)} numbers for vectors of {width}")
    norm = max(sum(x * x for x in query) ** 0.5, 1e-8)
    unit = F.array(*[F.lit(x / norm) for x in query])
    scored = bank.select("id", total(F.zip_with("v", unit, lambda x, y: x.cast("double") * y)).alias("similarity"))
    return scored.orderBy(F.round("similarity", 12).desc(), "id").limit(max(1, k))


def normalised(rows: DataFrame, v: str = "v") -> DataFrame:
    return rows.withColumn(v, l2_normalize(v))


def nearest_centroid(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """(id, nearest, similarity): the class whose centroid is most alike by cosine."""
    met = rows.select("id", "v").join(F.broadcast(class_vectors(reference)))
    return met.groupBy("id").agg(F.max_by("cls", F.struct(cosine("v", "centroid"), -F.col("cls"))).alias("nearest"), F.max(cosine("v", "centroid")).alias("similarity"))


def class_reference(rows: DataFrame, floor: float = 1e-8) -> DataFrame:
    """(cls, pos, n, centroid, variance): population variance, floored, one row per dimension."""
    long = rows.select("cls", F.posexplode("v").alias("pos", "x"))
    return long.groupBy("cls", "pos").agg(F.count("*").alias("n"), F.avg("x").alias("centroid"), F.greatest(F.var_pop("x"), F.lit(floor)).alias("variance"))


def class_vectors(reference: DataFrame) -> DataFrame:
    """(cls, n, centroid, variance) with arrays, a row per class, from a class reference."""
    cells = F.sort_array(F.collect_list(F.struct("pos", "centroid", "variance")))
    return reference.groupBy("cls").agg(F.first("n").alias("n"), cells.alias("c")).select("cls", "n", F.transform("c", lambda x: x["centroid"]).alias("centroid"), F.transform("c", lambda x: x["variance"]).alias("variance"))


def mahalanobis(rows: DataFrame, reference: DataFrame, eps: float = 0.0) -> DataFrame:
    """(id, cls, distance): squared diagonal Mahalanobis distance of every row to every class; the classes are broadcast."""
    return rows.select("id", "v").join(F.broadcast(class_vectors(reference))).select("id", "cls", diag_mahalanobis("v", "centroid", "variance", eps).alias("distance"))


def mahalanobis_ood(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """(id, ood_score, nearest): the least distance to a class, and that class."""
    return mahalanobis(rows, reference).groupBy("id").agg(F.min("distance").alias("ood_score"), F.min_by("cls", F.struct("distance", "cls")).alias("nearest"))


def prototype_probability(rows: DataFrame, reference: DataFrame, eps: float = 1e-8) -> DataFrame:
    """(id, cls, probability): softmax over classes of minus the distance."""
    d = mahalanobis(rows, reference, eps)
    low = d.groupBy("id").agg(F.min("distance").alias("low"))
    raised = d.join(low, "id").withColumn("e", F.exp(F.col("low") - F.col("distance")))
    whole = raised.groupBy("id").agg(F.sum("e").alias("whole"))
    return raised.join(whole, "id").select("id", "cls", (F.col("e") / F.col("whole")).alias("probability"))


def quantile_threshold(df: DataFrame, keys: list[str], score: str, q: float = 0.95) -> DataFrame:
    """(keys, threshold): the linearly interpolated quantile of validation scores; null scores are left out, a key of them alone has null.

    Distinct scores are counted up in buckets of equal depth, so no task holds all those of a large key.
    """
    kinds = written(df.filter(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("_s")).agg(F.count("*").alias("_n")), "scores")
    upto = running_sums(kinds, keys, F.col("_s"), {"_upto": F.col("_n")})
    sizes = kinds.groupBy(*keys).agg((F.lit(q) * (F.sum("_n") - 1)).alias("_at"))
    value = lambda place: F.min(F.when(F.col("_upto") > place, F.col("_s")))
    low, high, share = value(F.floor("_at")), value(F.ceil("_at")), F.first(F.col("_at") - F.floor("_at"))
    found = same(upto, sizes, keys).groupBy(*keys).agg((low * (1 - share) + high * share).alias("threshold"))
    return same(df.select(*keys).distinct(), found, keys, "left") if keys else found


def ood_rate(df: DataFrame, keys: list[str], score: str, threshold: str, nearest: str, pred: str) -> DataFrame:
    """(keys, ood_rate, prototype_agreement): share over the threshold, and share whose nearest class is the prediction."""
    return df.groupBy(*keys).agg(F.avg((F.col(score) > F.col(threshold)).cast("double")).alias("ood_rate"), F.avg((F.col(nearest) == F.col(pred)).cast("double")).alias("prototype_agreement"))


#: Pairs, about, that one range of priorities holds.
RANGE_PAIRS = 500_000


def _decided(pdf: pd.DataFrame) -> pd.DataFrame:
    """(pos, kept) of the rows of one range that can be decided: by known better rows, then by one another in order."""
    pdf = pdf.sort_values("worse")
    worse, better, given = pdf["worse"].to_numpy(), pdf["better"].to_numpy(), pdf["better_kept"].to_numpy(object)
    ids, at = np.unique(np.concatenate((better, worse)), return_inverse=True)
    at = at[: len(better)]
    # 1 kept, 0 not, -1 not known yet
    state = np.full(len(ids), -1, np.int8)
    known = pd.notna(given)
    state[at[known]] = given[known].astype(bool)
    names, first = np.unique(worse, return_index=True)
    place, ends, out = np.searchsorted(ids, names), [*first[1:], len(worse)], []
    for w, p, i, j in zip(names, place, first, ends, strict=True):
        states = state[at[i:j]]
        if (states == 1).any() or (states == 0).all():
            state[p] = not (states == 1).any()
            out.append((w, state[p] == 1))
    return pd.DataFrame(out, columns=["pos", "kept"]).astype({"pos": "int64", "kept": "bool"})


def diversity_filter(rows: DataFrame, pairs: DataFrame, *, range_pairs: int = RANGE_PAIRS, report: list | None = None) -> DataFrame:
    """(id, kept): greedy selection by priority, without walking all rows one by one.

    ``rows`` is (id, priority), lower first and unique; ``pairs`` (a, b) are rows too alike to keep
    both. Rows are dealt to ranges of their priority. In each round every range decides in order what
    the rows known so far let it decide, and only decisions on rows that others wait for are passed
    on. As a row waits for better rows alone, the first range that is not done is done after the next
    round: there are never more rounds than ranges, however long a chain is. ``report`` receives the
    numbers of rounds and ranges.
    """
    pairs = written(pairs.select("a", "b").filter("a <> b"), "alike")
    ranges = max(1, -(-pairs.count() // range_pairs))
    # ids that rise with the partition and the place in it
    ranked = written(rows.repartitionByRange(ranges, "priority").sortWithinPartitions("priority").select("id", F.monotonically_increasing_id().alias("pos")), "ranked")
    place = lambda side: ranked.select(F.col("id").alias(side), F.col("pos").alias(f"p{side}"))
    edges = pairs.join(place("a"), "a").join(place("b"), "b").select(F.least("pa", "pb").alias("better"), F.greatest("pa", "pb").alias("worse")).distinct()
    edges = written(edges, "edges")
    waiting = edges.select(F.col("worse").alias("better"), F.lit(False).alias("_first")).distinct()
    # a row that none is better than is kept
    open_ = written(edges.join(waiting, "better", "left").select("better", "worse", F.coalesce("_first", F.lit(True)).alias("_first")).select("better", "worse", F.when(F.col("_first"), True).alias("better_kept")), "open")
    gone, rounds = [], 0
    while not open_.isEmpty():
        rounds += 1
        step = written(open_.groupBy(F.shiftright("worse", 33).alias("range")).applyInPandas(_decided, "pos long, kept boolean"), "decided")
        gone.append(step.filter("NOT kept").select("pos"))
        left = open_.join(step.select(F.col("pos").alias("worse")), "worse", "left_anti")
        fresh = step.select(F.col("pos").alias("better"), F.col("kept").alias("_now"))
        open_ = written(left.join(fresh, "better", "left").select("better", "worse", F.coalesce("better_kept", "_now").alias("better_kept")), "open")
    if report is not None:
        report.append((rounds, ranges))
    dropped = reduce(DataFrame.unionByName, gone, ranked.select("pos").limit(0)).withColumn("kept", F.lit(False))
    return ranked.join(dropped, "pos", "left").select("id", F.coalesce("kept", F.lit(True)).alias("kept"))
