"""Evaluation queries on tables that once broke them: large ones, scores at an edge, skewed runs."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from quillmill import catalog
from quillmill.functions.columns import rounded
from quillmill.operators import metrics, stats


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def judged(spark):
    rng = np.random.default_rng(6)
    rows = [(int(k) if k else None, int(i), m, int(rng.integers(0, 2)) if i % 5 else None) for k in range(3) for i in range(40) for m in "abcd" if (i + ord(m)) % 7]
    return [*rows, rows[0], (1, 3, None, 1)]


def test_members_meet_without_a_join(spark):
    rows = judged(spark)
    df = spark.createDataFrame(rows, "k int, i int, m string, ok int")
    tested = stats.mcnemar(df, ["k"], "i", "m", "ok")
    assert "Join" not in plan(tested)  # a broadcast table of items once filled the driver
    want = {}
    for k, i, a, x in rows:
        for l, j, b, y in rows:
            if k == l and i == j and a is not None and b is not None and a < b:
                one = want.setdefault((k, a, b), [0, 0])
                one[0] += (x, y) == (1, 0)
                one[1] += (x, y) == (0, 1)
    assert {(r.k, r.member_a, r.member_b): [r.only_a, r.only_b] for r in tested.collect()} == want


def test_alignment_counts_rows_of_one_item(spark):
    rows = [(r[0], r[1], r[2], r[1] % 2) for r in judged(spark)]
    df = spark.createDataFrame(rows, "k int, i int, m string, y int")
    got = metrics.align_predictions(df, ["k"], "m", "i", "y", "a")
    joins = [x for x in plan(got).splitlines() if "Join" in x]
    assert all("k#" in x and "i#" not in x for x in joins)  # only totals of a key meet
    for r in got.collect():
        own = [x for x in rows if x[0] == r.k and x[2] == r.m]
        base = [x for x in rows if x[0] == r.k and x[2] == "a"]
        hits = [sum(b[1] == x[1] for b in base) for x in own]
        assert r.both_n == sum(hits)
        assert r.aligned == int(sum(max(h, 1) for h in hits) == len(base) == sum(hits))


def test_temperature_is_fitted_without_a_row_per_place(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k, scale in ((None, 0.7), ("b", 3.0)):
        for i in range(900):
            z = rng.normal(0, 1, 2 + i % 2)
            w = np.exp(z - z.max())
            rows.append((k, int(rng.choice(len(z), p=w / w.sum())), [float(x) for x in scale * z]))
    odd = [("b", 7, [1.0, 2.0]), ("b", 0, [0.5, None]), ("b", None, [0.5, 1.0]), ("b", 1, None), ("one", 0, [1.0, 0.0]), ("none", 5, [1.0]), ("none", 5, [])]
    df = spark.createDataFrame([*rows, *odd], "k string, y int, z array<double>")
    before, made = metrics.same, []

    def watched(*args, **named):
        made.append(before(*args, **named))
        return made[-1]

    metrics.same = watched
    try:
        got = {r.k: r for r in metrics.fit_temperature(df, ["k"], "y", "z").collect()}
    finally:
        metrics.same = before
    # a pass once made a row per place of every row
    assert made and all("Generate" not in plan(x) for x in made)
    for k, scale in ((None, 0.7), ("b", 3.0)):
        own = [(y, np.array(z)) for kk, y, z in rows if kk == k]

        def loss(t, own=own):
            return np.mean([np.log(np.exp(z / t).sum()) - z[y] / t for y, z in own])

        at = got[k].temperature
        assert abs(got[k].nll - loss(at)) < 1e-9 and loss(at) < min(loss(at * 1.001), loss(at / 1.001))
        assert abs(at / scale - 1) < 0.3
    assert got["one"].temperature == 1.0 and abs(got["one"].nll - np.log(1 + np.exp(-1))) < 1e-12 and got["none"].nll is None


def test_a_score_one_rounding_below_an_edge(spark):
    p = 0.7 * (313.5 / 353.5) + 0.3 * 94 / 101
    assert p < 0.9 and p * 10 == 9.0  # floor(p * 10), as the query's SQL has it
    df = spark.createDataFrame([(1, p), (0, 0.85), (1, 1.0), (0, 0.0)], "y int, p double")
    got = {round(r.bin_lower, 1): r.n for r in metrics.reliability_bins(df, [], "y", "p").collect()}
    assert got == {0.0: 1, 0.8: 1, 0.9: 2}


def test_rounding_is_that_of_the_oracle(spark):
    rng = np.random.default_rng(8)
    # the first has the shortest digits of a tie and lies under it
    values = [0.5291015625, 0.5, -2.5, 0.0, -1e-12, 1e300, float("inf"), *rng.normal(0, 3, 500).tolist(), *(rng.integers(-9999, 9999, 500) / 2000).tolist()]
    df = spark.createDataFrame([(float(x),) for x in values], "x double")
    c = duckdb.connect()
    for digits in (0, 3, 9):
        got = [r[0] for r in df.select(rounded("x", digits)).collect()]
        assert got == [c.execute("select round(?::double, ?)", [float(x), digits]).fetchone()[0] for x in values]
    assert df.select(rounded(F.lit(None).cast("double"), 3)).first()[0] is None


def test_curve_with_a_threshold_at_a_tie(spark, tmp_path):
    base = duckdb.sql("select * replace (event_id + 101000 as event_id, 123.84e0 as value) from '/root/testdata/sf0.001/events.parquet'")  # noqa: F841
    duckdb.sql(f"copy (select * from base union all select * from '/root/testdata/sf0.001/events.parquet') to '{tmp_path}/events.parquet' (format parquet)")
    c = duckdb.connect()
    c.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    df = catalog.queries()["roc_curve"](spark, str(tmp_path))
    want = c.sql(f"select {', '.join(df.columns)} from ({catalog.oracles()['roc_curve']})").fetchall()
    assert any(r[3] == 0.529101562 for r in want)
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_a_run_is_not_one_tasks_rows(spark):
    rng = np.random.default_rng(9)
    rows = [(k, float(rng.integers(0, 60)) / 60, int(rng.integers(0, 2)), i, "ab"[i % 2]) for k in (None, "x") for i in range(300)] + [("none", 0.5, 0, 0, "a")]
    df = spark.createDataFrame(rows, "k string, p double, y int, i int, m string").withColumn("q", 1 - F.col("p"))
    curve = metrics.roc_curve(df, ["k"], "y", "p")
    cuts = metrics.youden_threshold(df, ["k", "m"], "y", "p")
    assert "SortMergeJoin" not in plan(curve) and "SortMergeJoin" not in plan(metrics.soft_vote(df, ["k"], "i", "m", "y", "p", cuts, 1))
    both = {r.k: r for r in metrics.auc_and_precision(df, ["k"], "y", "p").collect()}
    auc = {r.k: r.roc_auc for r in metrics.roc_auc(df, ["k"], "y", "p").collect()}
    ap = {r.k: r.average_precision for r in metrics.average_precision(df, ["k"], "y", "p").collect()}
    micro = {r.k: r.micro for r in metrics.roc_auc_macro_micro(df, ["k"], "y", {1: "p", 0: "q"}).collect()}
    assert set(both) == {None, "x", "none"} and both["none"].roc_auc is None
    for k in (None, "x"):
        own = [r for r in rows if r[0] == k]
        p, y = np.array([r[1] for r in own]), np.array([r[2] for r in own])

        def area(p, y):
            gap = p[y == 1][:, None] - p[y == 0]
            return ((gap > 0) + (gap == 0) / 2).mean()

        assert abs(both[k].roc_auc - area(p, y)) < 1e-12 and abs(auc[k] - area(p, y)) < 1e-12 and abs(both[k].average_precision - ap[k]) < 1e-12
        assert abs(micro[k] - area(np.concatenate((p, 1 - p)), np.concatenate((y, 1 - y)))) < 1e-12
    # equal rows are counted before each class has its own
    each = metrics._one_against_rest(df, ["k"], "y", {1: "p", 0: "q"})
    assert each.count() == 2 * len({(r[0], r[1], r[2]) for r in rows})
