import math
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.functions import columns as C
from quillmill.functions import pvalues
from quillmill.operators import distances, images, metrics, outliers, runs, selection, splits, stats
from quillmill.operators.running import average_ranks, numbered, running_sums
from quillmill.operators.vectors import class_reference, mahalanobis_ood
from quillmill.sources import folders, tables


def test_tails_of_distributions():
    assert abs(pvalues.chi2_tail(3.841459, 1) - 0.05) < 1e-6 and abs(pvalues.chi2_tail(5.991465, 2) - 0.05) < 1e-6 and abs(pvalues.chi2_tail(7.814728, 3) - 0.05) < 1e-6
    assert abs(pvalues.t_tails(2.228139, 10) - 0.05) < 1e-6 and abs(pvalues.t_tails(4.302653, 2) - 0.05) < 1e-6
    assert abs(pvalues.normal_tail(1.959964) - 0.025) < 1e-7
    assert pvalues.signed_rank_tails(0, 5) == 2 / 32 and pvalues.signed_rank_tails(3, 3) == 1.0
    # all orders of two samples of 3 and 2: one of ten has U = 0, two have U <= 1
    assert abs(pvalues.rank_sum_less(0, 3, 2, 0) - 0.1) < 1e-12 and abs(pvalues.rank_sum_less(1, 3, 2, 0) - 0.2) < 1e-12


def test_edges_of_column_functions(spark):
    row = spark.range(1).select(
        C.region_group(F.lit("a_roi_1_20240101_101010.png")).alias("a"), C.roi_id(F.lit("a_roi_1_20240101_101010.png")).alias("b"), C.region_group(F.lit("d/x.png")).alias("c"),
        C.canonical_group(F.lit(" Smo-ker_")).alias("d"), C.rank_order(F.lit("?")).alias("e"), C.safe_divide(F.lit(1), F.lit(0), 7.0).alias("f"), C.positive_index(F.array(F.lit("cancer"), F.lit("normal"))).alias("g"),
        C.positive_index(F.array(F.lit("a"), F.lit("b"))).alias("h"), C.argmax_class(F.array(F.lit(0.5), F.lit(0.5))).alias("i"), C.extension(F.lit("x/y.PnG")).alias("j")).first()
    assert tuple(row) == ("roi1_20240101", "a_roi_1_20240101_101010.png", "x.png", "smoke", 99, 7.0, 0, 1, 0, "png")
    spread = C.redistribute_weights({"a": 0.3, "b": 0.3, "c": 0.2, "d": 0.2}, {"a", "b", "d"})
    assert spread == {"a": 0.375, "b": 0.375, "d": 0.25} and C.redistribute_weights({"a": 1.0}, set()) == {}


def test_running_sums_in_many_buckets(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i % 3) if i % 7 else None, float(i) ** 2, int(rng.integers(0, 9))) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, o double, x int")
    got = {r.o: r.s for r in running_sums(df, ["k"], F.col("o"), {"s": F.col("x")}, bucket_rows=10).collect()}
    for k in (0, 1, 2, None):
        run = 0
        for _, o, x in sorted(r for r in rows if r[0] == k):
            run += x
            assert got[o] == run
    ranks = {r.x: r["rank"] for r in average_ranks(df, [], "x", bucket_rows=10).collect()}
    xs = np.sort([r[2] for r in rows])
    assert all(abs(r - (np.flatnonzero(xs == x).mean() + 1)) < 1e-9 for x, r in ranks.items())
    nth = numbered(df, ["k"], [F.col("o")], spread=F.col("x"), bucket_rows=10).collect()
    for k in (0, 1, 2, None):
        of = sorted((r.x, r.o, r.nth) for r in nth if r.k == k)
        assert [n for _, _, n in of] == list(range(1, len(of) + 1))


def test_norms_and_bins(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", math.nan), ("a", 5.0), ("b", 3.0), ("b", 3.0)], "k string, x double")
    got = sorted((r.k, r.n_x) for r in selection.min_max_norm(df, ["k"], {"x": False}).filter("n_x IS NOT NULL").collect())
    assert got == [("a", 0.0), ("a", 0.25), ("a", 1.0), ("b", 0.5), ("b", 0.5)]
    assert sorted(r.n_x for r in runs.bench_min_max(df.filter("k = 'a'"), {"x": True}).collect()) == [0.0, 0.25, 0.5, 1.0]
    p = spark.createDataFrame([(1, 0.6), (1, 1.0), (0, 0.1)], "y int, p double")
    assert sorted((round(r.bin_lower, 1), r.n) for r in metrics.reliability_bins(p, [], "y", "p").collect()) == [(0.1, 1), (0.6, 1), (0.9, 1)]
    e = metrics.ece_mce(spark.createDataFrame([(1, 0.6), (1, 0.55)], "y int, p double"), [], "y", "p").first()
    assert abs(e.ece - 0.425) < 1e-9  # 0.6 lies in (0.5, 0.6]
    one = metrics.roc_auc(spark.createDataFrame([(1, 0.6), (1, 0.55)], "y int, p double"), [], "y", "p").first()
    assert one.roc_auc is None
    y = metrics.youden_threshold(spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "y int, p double"), [], "y", "p").first()
    assert y.threshold == 0.9 and y.youden == 0.5


def test_metrics_of_three_classes(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("b", "a"), ("a", "a")]
    m = metrics.classification_metrics(spark.createDataFrame(rows, "t string, p string"), [], "t", "p", ["a", "b", "c"]).first()
    assert abs(m.accuracy - 4 / 6) < 1e-9 and abs(m.f1_macro - 2 / 3 * 2 / 3) < 1e-9 and abs(m.kappa - 1 / 3) < 1e-9 and abs(m.mcc - 1 / 3) < 1e-9
    w = {r["class"]: r.weight for r in metrics.class_weights(spark.createDataFrame(rows, "t string, p string"), [], "t", ["a", "b", "c"]).collect()}
    assert w == {"a": 7 / 9, "b": 7 / 9, "c": 7 / 3}


def test_temperature_of_known_scale(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(int)
    df = spark.createDataFrame([(int(a), [0.0, float(2.5 * b)]) for a, b in zip(y, z, strict=True)], "y int, z array<double>")
    got = metrics.fit_temperature(df, [], "y", "z").first()
    at = np.linspace(0.5, 6, 5501)
    loss = [np.log1p(np.exp(-np.where(y, 1, -1) * 2.5 * z / t)).mean() for t in at]
    assert abs(got.temperature - at[np.argmin(loss)]) < 2e-3 and abs(got.nll - min(loss)) < 1e-6
    assert metrics.fit_temperature(df.limit(1), [], "y", "z").first().temperature == 1.0


def test_paired_tests(spark):
    rows = [("m", s, e, v) for s, (a, b) in enumerate([(0.5, 0.6), (0.55, 0.7), (0.6, 0.62)]) for e, v in (("r", a), ("s", b))]
    pairs = stats.paired(spark.createDataFrame(rows, "model string, seed int, e string, x double"), ["model"], ["seed"], "e", "r", "s", ["x"])
    t, w = stats.paired_ttest(pairs, ["model"]).first(), stats.wilcoxon_signed_rank(pairs, ["model"]).first()
    d = np.array([0.1, 0.15, 0.02])
    want = d.mean() / (d.std(ddof=1) / 3**0.5)
    assert abs(t.t - want) < 1e-9 and abs(t.p - (1 - want / (2 + want * want) ** 0.5)) < 1e-9 and (w.w, w.p) == (0.0, 0.25)
    even = spark.createDataFrame([(0, "a", 1), (0, "b", 1)], "i int, m string, ok int")
    r = stats.mcnemar(even, [], "i", "m", "ok").first()
    assert (r.statistic, r.p) == (0.0, 1.0)


def test_splits_keep_groups_apart(spark):
    df = spark.createDataFrame([(i, f"g{i % 37}", "ab"[i % 37 % 2]) for i in range(400)], "id int, g string, c string")
    k = splits.stratified_group_kfold(df, "g", "c", 5)
    assert k.count() == 2000 and splits.assert_group_disjoint(k, ["fold"], "g", "role").filter("leaks = 1").count() == 0
    tests = k.filter("role = 'test'").groupBy("fold", "c").count().collect()
    assert len(tests) == 10 and max(r["count"] for r in tests) - min(r["count"] for r in tests) <= 25
    assert sum(r["count"] for r in tests) == 400
    v = splits.grouped_cv_holdout_val(df, "g", "c", 5)
    assert v.select("fold").distinct().count() == 5 and splits.assert_group_disjoint(v, ["fold"], "g", "role").filter("leaks = 1").count() == 0
    with pytest.raises(ValueError):
        splits.stratified_group_kfold(df, "g", "c", 30).count()
    with pytest.raises(ValueError):
        splits.require_group_disjoint(df.withColumn("role", F.when(F.col("id") < 99, "a").otherwise("b")), [], "g", "role")
    for n, want in ((3, 2), (50, 8), (30, 4)):
        rows = spark.createDataFrame([(i, f"n{i}", "c") for i in range(n)], "id int, name string, c string")
        assert splits.hash_holdout(rows, "c", "name", ["id"]).filter("role = 'val'").count() == want


def _sets(spark, n=60, d=6):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(2 * n, d)) + np.repeat([[0.0], [0.7]], n, 0)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    return a, [spark.createDataFrame([(i, i % 2, a[i].tolist()) for i in part], "id long, cls int, v array<double>") for part in (range(n), range(n, 2 * n))]


def test_frechet_and_moments(spark):
    a, (x, y) = _sets(spark)
    n, m, s = distances.mean_vector_moments(x)
    assert n == 60 and np.allclose(m, a[:60].mean(0)) and np.allclose(s, np.cov(a[:60].T))
    t = np.cov(a[60:].T)
    w = np.linalg.eigvals(s @ t)
    want = ((a[:60].mean(0) - a[60:].mean(0)) ** 2).sum() + np.trace(s) + np.trace(t) - 2 * np.sqrt(np.maximum(w.real, 0)).sum()
    assert abs(distances.frechet_distance(x, y) - want) < 1e-8 and distances.frechet_distance(x, y.limit(1)) is None
    assert distances.kernel_distance_biased(x, y.limit(9)).first().distance == 0.0
    p = {r.id: (r.x, r.y) for r in distances.pca_2d(x).collect()}
    c = a[:60] - a[:60].mean(0)
    var = np.linalg.eigvalsh(np.cov(c.T))[::-1][:2]
    got = np.array([p[i] for i in range(60)])
    assert np.allclose(got.mean(0), 0, atol=1e-9) and np.allclose(got.var(0, ddof=1), var)


def test_outliers_stand_out(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(0, 0.05, (80, 4)) + [1, 0, 0, 0]
    v[7] = [-0.4, 0.9, 0, 0]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, 0, x.tolist()) for i, x in enumerate(v)], "id long, cls int, v array<double>")
    f = {r.id: r.outlier for r in outliers.isolation_forest_flag(df).collect()}
    assert f[7] == 1.0 and sum(f.values()) < 25 and len(f) == 80
    flagged = {r.id: r.lof for r in outliers.lof_flag(df).filter("outlier = 1").collect()}
    assert max(flagged, key=flagged.get) == 7 and len(flagged) < 8
    assert {r.outlier for r in outliers.isolation_forest_flag(df.filter("id < 9")).collect()} == {0.0}
    near = {r.id: r.nearest for r in mahalanobis_ood(df, class_reference(df)).collect()}
    assert set(near.values()) == {0}


def _png(path, pixels):
    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + pixels[i].tobytes() for i in range(h))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


@pytest.fixture(scope="module")
def pictures(tmp_path_factory):
    root = tmp_path_factory.mktemp("pictures")
    for c in ("normal", "Cancer"):
        os.mkdir(root / c)
        for i in range(3):
            p = np.zeros((64, 64, 3), np.uint8)
            p[16:48, 20 : 40 + i] = [200, 100, 50]
            _png(root / c / f"roi_{i}_20240101_1010{i:02}.{'png' if i else 'PNG'}", p)
    _png(root / "normal" / "black.png", np.zeros((64, 64, 3), np.uint8))
    (root / "normal" / "bad.png").write_bytes(b"junk")
    (root / "normal" / "notes.txt").write_text("x")
    return str(root)


def test_scans_of_folders(spark, pictures):
    found = folders.scan_class_folders(spark, pictures).groupBy("class_name").count().collect()
    assert sorted((r.class_name, r["count"]) for r in found) == [("cancer", 3), ("normal", 5)]
    assert folders.scan_recursive_strict(spark, pictures, ["normal", "cancer"]).count() == 8
    with pytest.raises(ValueError):
        folders.scan_recursive_strict(spark, pictures, ["normal"])
    valid, bad = folders.scan_valid_images(spark, pictures)
    assert valid.count() == 7 and [os.path.basename(r.path) for r in bad.collect()] == ["bad.png"]
    flagged = folders.keep_invalid_flagged(spark, pictures)
    assert flagged.count() == 8 and [os.path.basename(r.path) for r in flagged.filter("NOT is_valid").collect()] == ["bad.png"]
    key = tables.fingerprint(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(pictures), "v1")
    assert key != tables.fingerprint(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(pictures), "v2")


def test_image_descriptors(spark, pictures):
    i = images.from_source(folders.scan_valid_images(spark, pictures)[0])
    boxes = {os.path.basename(r.id): r for r in images.foreground_box(i).filter("id LIKE '%normal%'").collect()}
    b = boxes["roi_1_20240101_101001.png"]
    assert (b.left, b.top, b.right, b.bottom) == (17, 13, 44, 51) and abs(b.coverage - 32 * 21 / 4096) < 1e-9
    assert (boxes["black.png"].left, boxes["black.png"].right) == (0, 64)
    tv = {os.path.basename(r.id): r.tv for r in images.total_variation(i).collect()}
    gray = (0.299 * 200 + 0.587 * 100 + 0.114 * 50) / 255
    assert abs(tv["roi_1_20240101_101001.png"] - gray * (2 * 21 + 2 * 32) / (63 * 64)) < 1e-9 and tv["black.png"] == 0
    assert {os.path.basename(r.id): r.coverage for r in images.tissue_coverage(i, 150, smooth=True).collect()}["roi_2_20240101_101002.png"] == 32 * 22 / 4096
    f = {os.path.basename(r.id): r for r in images.fluorescence_stats(i).collect()}["roi_1_20240101_101001.png"]
    assert 0 < f.coverage < 1 and f.fg_mean > 0.3
    assert images.haar_energy(i).count() == 7


def test_predictions_from_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Filename,GroundTruth,Prediction,Probability_Cancer\nx,normal,cancer,0.7\n")
    (tmp_path / "b.csv").write_text("Filename,Other\nx,1\n")
    got = tables.import_predictions(spark, [str(tmp_path / n) for n in ("a.csv", "b.csv", "none.csv")])
    assert got.count() == 1 and got.first().Probability_Cancer == 0.7
    with pytest.raises(ValueError):
        tables.require_columns(got, {"nothing"})


def test_benchmark_of_five_parts(spark):
    names = [m for _, ms in runs.BENCHMARK.values() for m in ms]
    every = list(dict.fromkeys(names))
    low = {m for _, ms in runs.BENCHMARK.values() for m, up in ms.items() if not up}
    rows = [("good", *[0.0 if m in low else 1.0 for m in every]), ("bad", *[1.0 if m in low else 0.0 for m in every])]
    df = spark.createDataFrame(rows, ["model", *every])
    got = {r.model: (r.overall, r.rnk) for r in runs.benchmark_score(df, ["model"]).collect()}
    assert got == {"good": (1.0, 1), "bad": (0.0, 2)}
    assert set(runs.benchmark_tables(runs.benchmark_score(df, ["model"]), ["model"])) == {"overall", "classification", "feature", "calibration", "efficiency"}


def test_buckets_stay_even_where_scores_crowd(spark):
    """99 of 100 of a million scores lie within a millionth of 0 or 1."""
    from quillmill.operators.running import bucketed

    u, side = F.rand(3), F.col("id") % 2
    score = F.when(F.col("id") % 100 == 0, u).when(side == 0, u * 1e-6).otherwise(1 - u * 1e-6)
    rows = spark.range(1_000_000).select(F.lit("a").alias("run"), score.alias("p"))
    sizes = [r["count"] for r in bucketed(rows, ["run"], ["p"], 50_000).groupBy("_b").count().collect()]
    assert sum(sizes) == 1_000_000 and max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_a_class_that_no_threshold_beats_chance_on(spark):
    from quillmill.operators import metrics

    rows = [("b", 0.9, 0.1), ("b", 0.8, 0.2), ("a", 0.1, 1.3), ("a", 0.2, 1.2)]
    got = {r["class"]: r for r in metrics.per_class_youden(spark.createDataFrame(rows, "y string, pa double, pb double"), [], "y", {"a": "pa", "b": "pb", "c": "pa"}).collect()}
    assert got["a"]["threshold"] == float("inf") and got["a"]["youden"] == 0
    assert got["b"]["threshold"] == float("inf") and got["c"]["threshold"] == 0.5 and got["c"]["youden"] is None


def test_mean_curve_is_that_of_interpolation(spark):
    from quillmill.operators import metrics

    rng = np.random.default_rng(1)
    rows = [(f, int(y), float(np.round(np.clip(0.5 * y + rng.normal() * 0.4, -1, 2), 2))) for f in range(3) for y in rng.integers(2, size=150)]
    got = {r["k"]: r for r in metrics.mean_roc_on_grid(spark.createDataFrame(rows, "fold int, y int, p double"), [], "fold", "y", "p", 50).collect()}
    grid, curves = np.linspace(0, 1, 50), []
    for f in range(3):
        y, p = np.array([r[1] for r in rows if r[0] == f]), np.array([r[2] for r in rows if r[0] == f])
        cuts = np.unique(p)[::-1]
        fpr = np.concatenate(([0], [(p[y == 0] >= c).mean() for c in cuts]))
        tpr = np.concatenate(([0], [(p[y == 1] >= c).mean() for c in cuts]))
        curve = np.interp(grid, fpr, tpr)
        curve[0] = 0
        curves.append(curve)
    np.testing.assert_allclose([got[k]["tpr_mean"] for k in range(50)], np.mean(curves, axis=0), atol=1e-9)
    np.testing.assert_allclose([got[k]["tpr_std"] for k in range(50)], np.std(curves, axis=0), atol=1e-9)
