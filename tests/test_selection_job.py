"""The selection as one job: its parts class by class against numpy, greedy walks in ranges, exact quantiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.operators import distances, images, running
from quillmill.operators import vectors as V
from quillmill.operators.selection_job import selection_pipeline


def sequential(n, pairs):
    kept, near = set(), {}
    for a, b in pairs:
        near.setdefault(max(a, b), set()).add(min(a, b))
    for i in range(n):
        if not near.get(i, set()) & kept:
            kept.add(i)
    return kept


def test_a_long_chain_ends_within_the_ranges(spark):
    n = 10_000
    pairs = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    seen = []
    out = V.diversity_filter(spark.range(n).select("id", F.col("id").alias("priority")), pairs, range_pairs=2500, report=seen)
    assert {r["id"] for r in out.filter("kept").collect()} == set(range(0, n, 2)) and out.count() == n
    rounds, ranges = seen[0]
    assert ranges == 4 and rounds <= ranges


@pytest.mark.parametrize("range_pairs", [60, 10_000])
def test_greedy_walk_over_ranges_is_the_sequential_one(spark, range_pairs):
    rng = np.random.default_rng(range_pairs)
    n, order = 300, rng.permutation(300)
    at = {int(x): i for i, x in enumerate(order)}
    pairs = [(int(a), int(b)) for a, b in rng.integers(n, size=(500, 2))] + [(0, 0), (1, 2), (2, 1)]
    want = {int(order[i]) for i in sequential(n, [(at[a], at[b]) for a, b in pairs if a != b])}
    # ids that stand in a struct of score and id, as the job passes them
    rows = spark.createDataFrame([(i, float(at[i] // 3), at[i]) for i in range(n)], "id long, s double, i int").select("id", F.struct("s", "i").alias("priority"))
    out = V.diversity_filter(rows, spark.createDataFrame(pairs, "a long, b long"), range_pairs=range_pairs)
    assert {r["id"] for r in out.filter("kept").collect()} == want
    none = V.diversity_filter(rows, spark.createDataFrame([], "a long, b long"))
    assert none.count() == n and none.filter("NOT kept").isEmpty()


def units(rng, n, shift):
    x = rng.normal(size=(n, 5)) + shift
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def framed(spark, parts):
    """Rows (id, cls, v) of the given {class: vectors}; ids run on from 0."""
    rows, i = [], 0
    for c, x in parts.items():
        for v in x:
            rows.append((i, c, [float(y) for y in v]))
            i += 1
    return spark.createDataFrame(rows, "id long, cls int, v array<double>")


def test_distances_class_by_class(spark):
    rng = np.random.default_rng(4)
    real = {0: units(rng, 30, 0.5), 1: units(rng, 40, -0.5), 2: units(rng, 6, 0), None: units(rng, 3, 0), 5: units(rng, 4, 0)}
    made = {0: units(rng, 25, 0.6), 1: units(rng, 12, 0.5), 2: units(rng, 1, 0), None: units(rng, 5, 0), 7: units(rng, 4, 0)}
    a, b = framed(spark, real), framed(spark, made)
    got = {r["cls"]: r for r in distances.set_distances(a, b).collect()}
    assert set(got) == {0, 1, 2} and (got[2]["frechet"], got[2]["kernel"], got[2]["precision"]) == (None, 0.0, None)
    for c in (0, 1):
        x, y = real[c], made[c]
        assert (got[c]["n_real"], got[c]["n_generated"]) == (len(x), len(y))
        s, t = np.cov(x.T), np.cov(y.T)
        root = np.sqrt(np.maximum(np.linalg.eigvals(s @ t).real, 0)).sum()
        assert got[c]["frechet"] == pytest.approx(((x.mean(0) - y.mean(0)) ** 2).sum() + np.trace(s) + np.trace(t) - 2 * root, abs=1e-8)
        d = lambda p, q: np.sqrt(np.maximum(2 - 2 * p @ q.T, 0))
        near = lambda p: np.sort(d(p, p) + np.diag([np.inf] * len(p)), axis=1)[:, 2]
        m, rx, ry = d(y, x), near(x), near(y)
        want = ((m <= rx).any(1).mean(), (m <= ry[:, None]).any(0).mean(), (m <= rx).sum(1).mean() / 3, (m <= rx).any(0).mean())
        assert [got[c][k] for k in ("precision", "recall", "density", "coverage")] == pytest.approx(want)
        one = distances.kernel_distance_biased(a.filter(F.col("cls") == c), b.filter(F.col("cls") == c)).first()["distance"]
        assert got[c]["kernel"] == pytest.approx(one) and one > 0
    assert distances.set_distances(a, b.limit(0)).count() == 0


def test_sums_by_key_over_many_keys(spark):
    """More keys than a task holds at once."""
    rng = np.random.default_rng(6)
    rows = [(int(k), "ab"[i % 2], [float(x) for x in rng.normal(size=2)]) for i, k in enumerate(rng.integers(150, size=900))]
    got = {(r["k"], r["side"], r["pos"]): r["s"] for r in distances.moment_sums(spark.createDataFrame(rows, "k int, side string, v array<double>"), "v", ("k", "side")).collect()}
    want = {}
    for k, side, (x, y) in rows:
        for pos, s in enumerate((1, x, y, x * x, x * y, x * y, y * y)):
            want[(k, side, pos)] = want.get((k, side, pos), 0) + s
    assert got == pytest.approx(want)


def test_texture_gap_against_numpy(spark):
    rng = np.random.default_rng(8)
    names = ("lh", "hl", "hh", "tv", "coverage", "fg_mean", "fg_std")
    x = {(c, k): rng.normal(size=(9, 4)) + c for c in (0, 1) for k in ("real", "synth")}
    described = {key: rng.uniform(0.2, 1, size=(9, 7)) for key in x}
    d = spark.createDataFrame([(c, k, *map(float, r)) for (c, k), rows in described.items() for r in rows], "cls int, set string, " + ", ".join(f"{n} double" for n in names))
    v = spark.createDataFrame([(c, k, [float(y) for y in r]) for (c, k), rows in x.items() for r in rows] + [(9, "real", [1.0] * 4)], "cls int, set string, v array<double>")
    got = {r["cls"]: r for r in images.texture_gap(d, v).collect()}
    assert set(got) == {0, 1}
    rel = lambda p, q: ((p - q) ** 2).mean() / ((q * q).mean() + 1e-8)
    for c in (0, 1):
        s, r = x[(c, "synth")], x[(c, "real")]
        up = np.triu_indices(4)
        gram = rel((s.T @ s / 9)[up], (r.T @ r / 9)[up])
        stat = rel(np.concatenate((s.mean(0), s.std(0))), np.concatenate((r.mean(0), r.std(0))))
        ms, mr = described[(c, "synth")].mean(0), described[(c, "real")].mean(0)
        wave, fluor, tv = rel(ms[:3], mr[:3]), rel(ms[4:], mr[4:]), max(ms[3] - mr[3], 0) ** 2 / (mr[3] ** 2 + 1e-8)
        assert [got[c][n] for n in ("gram", "featstat", "wavelet", "fluor", "tv")] == pytest.approx([gram, stat, wave, fluor, tv])
        assert got[c]["gap"] == pytest.approx(gram + stat + 0.5 * wave + 0.1 * tv + 0.5 * fluor)


def test_quantiles_of_skewed_tied_and_empty_keys(spark, monkeypatch):
    monkeypatch.setattr(running.running_sums, "__kwdefaults__", {"bucket_rows": 50})
    rng = np.random.default_rng(3)
    parts = {"big": rng.exponential(size=700), "tied": np.repeat([1.0, 2.0, 9.0], [80, 15, 5]), "one": np.array([4.0])}
    rows = [(k, float(x)) for k, xs in parts.items() for x in xs] + [("none", None), ("one", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    for q in (0.0, 0.5, 0.95, 1.0):
        got = {r["k"]: r["threshold"] for r in V.quantile_threshold(df, ["k"], "x", q).collect()}
        assert got.pop("none") is None and got == pytest.approx({k: np.quantile(x, q) for k, x in parts.items()})
    assert V.quantile_threshold(df, [], "x", 0.5).first()["threshold"] == pytest.approx(np.quantile(np.concatenate(list(parts.values())), 0.5))
    assert [r["threshold"] for r in V.quantile_threshold(df.limit(0), [], "x").collect()] == [None]


def test_selection_leaves_copies_out_and_summarises_all_candidates(spark):
    rng = np.random.default_rng(2)
    real = framed(spark, {0: units(rng, 30, 1.0), 1: units(rng, 30, -1.0)}).withColumn("content", F.concat(F.lit("real"), "id"))
    made = framed(spark, {0: units(rng, 20, 0.8), 1: units(rng, 20, -0.8)})
    text = F.when(F.col("id") == 3, "real4").when(F.col("id") == 25, "real4").when(F.col("id").isin(7, 9), "same").otherwise(F.concat(F.lit("made"), "id"))
    out = selection_pipeline(made.withColumn("content", text), real, near=0.9999, diversity=0.9, content="content")
    rows = {r["qid"]: r for r in out["scores"].collect()}
    # 3 copies a real row of its class, 25 one of another class; 9 repeats 7
    assert set(rows) == set(range(40)) - {3, 9}
    s = {r["cls"]: r for r in out["summary"].collect()}
    assert (s[0]["copies_excluded"], s[0]["duplicates_excluded"], s[0]["n_generated"]) == (1, 1, 18) and (s[1]["copies_excluded"], s[1]["duplicates_excluded"]) == (0, 0)
    for c in (0, 1):
        mine = [r for r in rows.values() if r["cls"] == c]
        assert s[c]["mean_score"] == pytest.approx(np.mean([r["score"] for r in mine])) and s[c]["mean_margin"] == pytest.approx(np.mean([r["margin"] for r in mine]))
        assert s[c]["n_selected"] == sum(r["selected"] for r in mine) <= min(int(0.4 * len(mine)), 15)
        assert s[c]["near_duplicates_removed"] == sum(r["reason"] == "near_duplicate" for r in mine)
    d = {r["cls"]: r for r in out["distances"].collect()}
    assert {c: d[c]["n_generated"] for c in d} == {c: s[c]["n_selected"] for c in s} and all(0 <= d[c]["precision"] <= 1 for c in d)
