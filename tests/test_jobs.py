"""Stored tables after crashes and rewrites, streams over several batches, user functions, the evaluation as one job."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.functions.columns import apply_threshold
from quillmill.operators import distances, evaluation, metrics, models, runs, selection
from quillmill.operators import vectors as V
from quillmill.sources import tables
from quillmill.streaming import jobs


def test_a_half_written_result_is_a_miss_and_hits_are_counted(spark, tmp_path):
    files = spark.createDataFrame([("a", 1, 5), ("b", 2, 6)], "path string, length long, modificationTime long")
    made, path = [], str(tmp_path / "m")

    def compute():
        made.append(1)
        return spark.range(7)

    ask = lambda of=files, c="v1": tables.materialize_by_fingerprint(spark, of, c, compute, path)
    assert [ask()[1], ask()[1], ask()[1]] == [False, True, True] and len(made) == 1
    assert [r["hits"] for r in tables.materialized_hits(spark, path).collect()] == [2]
    assert not ask(c={"model": "m", "dim": 4})[1] and ask(c={"dim": 4, "model": "m"})[1]
    assert not ask(files.limit(1))[1]
    # a lost job: data without a commit record, then a record whose data lost a file
    key = tables.fingerprint(files, "v2|2")
    spark.range(3).write.parquet(f"{path}/{key}/data-half")
    rows, hit = ask(c="v2")
    assert not hit and rows.count() == 7
    where = f"{path}/{key}/{tables._committed(spark, f'{path}/{key}')['data']}"
    os.remove(next(f"{where}/{f}" for f in sorted(os.listdir(where), reverse=True) if f.endswith(".parquet")))
    assert not ask(c="v2")[1] and ask(c="v2")[1]


def test_the_last_written_epoch_counts(spark, tmp_path):
    path = str(tmp_path / "h")
    frame = lambda rows: spark.createDataFrame(rows, "run_id int, epoch int, f1 double")
    tables.append_training_history(frame([(1, 1, 0.9), (1, 2, 0.8)]), path)
    tables.append_training_history(frame([(1, 2, 0.1), (1, 3, 0.2)]), path)
    tables.append_training_history(frame([(1, 3, None)]).withColumn("loss", F.lit(1.0)), path)
    got = sorted((r["epoch"], r["f1"], r["loss"]) for r in tables.training_history_table(spark, path).collect())
    assert got == [(1, 0.9, None), (2, 0.1, None), (3, None, 1.0)]


@pytest.mark.parametrize("parts", [1, 3, 10])
def test_averages_are_the_same_in_any_number_of_batches(spark, tmp_path, parts):
    """And after the stream is stopped and goes on from its checkpoint."""
    rng = np.random.default_rng(parts)
    rows = [(int(k), i, float(x)) for i, (k, x) in enumerate(zip(rng.integers(3, size=300), rng.normal(size=300), strict=True))] + [(1, 300, None)]
    df = spark.createDataFrame(rows, "k int, seq long, x double")
    want = {str(r["k"]): (r["n"], r["ema"]) for r in runs.ema_by_key(df, ["k"], "seq", "x").collect()}
    folder, at = str(tmp_path / "in"), str(tmp_path / "at")

    def go():
        return jobs.drained(jobs.ema_by_key_stream(jobs.file_stream(spark, folder, "events", df.schema, files=1), "k", "seq", "x"), "update", "ema", ["key"], at=at)

    step = -(-301 // parts)
    for i in range(parts):
        df.filter((F.col("seq") >= i * step) & (F.col("seq") < (i + 1) * step)).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
        if i % 2 == 0 or i == parts - 1:
            out = go()
    got = {r["key"]: (r["n"], r["ema"]) for r in out.collect()}
    assert got.keys() == want.keys()
    for k, (n, ema) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(ema, abs=1e-9)


def test_arrivals_are_scored_once_by_the_reference_of_their_batch(spark, tmp_path):
    folder, at, refs = str(tmp_path / "in"), str(tmp_path / "at"), str(tmp_path / "refs")
    reference = lambda x: V.class_reference(spark.createDataFrame([(0, [x, 0.0]), (0, [x + 2, 2.0])], "cls int, v array<double>"))
    items = lambda ids: spark.createDataFrame([(i, [1.0, 1.0]) for i in ids], "id long, v array<double>").withColumn("arrived", F.to_timestamp(F.lit("2024-01-01 10:00:00")))

    def go(ids):
        items(ids).coalesce(1).write.mode("append").parquet(f"{folder}/items.parquet")
        stream = jobs.file_stream(spark, folder, "items", items([1]).schema, files=1)
        return sorted((r["id"], round(r["ood_score"], 6), r["version"]) for r in jobs.score_arrivals(stream, refs, at=at).collect())

    jobs.publish_reference(reference(0.0), refs, 1)
    assert go([1, 2]) == [(1, 0.0, 1), (2, 0.0, 1)]
    jobs.publish_reference(reference(5.0), refs, 2)
    # 2 comes again and is dropped; 3 meets the new reference
    assert go([2, 3]) == [(1, 0.0, 1), (2, 0.0, 1), (3, 25.0, 2)]


def test_user_functions_over_batches(spark):
    # within the test, as executors cannot import it
    def doubled():
        return lambda x: np.concatenate((x, 2 * x), axis=1)

    def farthest():
        def far(a, b):
            assert len(a) <= 3
            return np.abs(a - b).max(axis=1)

        return far

    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0]), (5, [1.0, None])], "id long, v array<double>")
    got = {r["id"]: r["e"] for r in models.embed(rows, doubled, "v", 2).collect()}
    n = np.array([3, 4, 6, 8]) / np.sqrt(125)
    np.testing.assert_allclose(got[1], n, atol=1e-6)
    assert got[2] is None and got[3] is None and got[5] is None and list(got[4]) == [0.0] * 4
    pairs = spark.createDataFrame([(i, [float(i), 1.0], [0.0, 5.0] if i % 4 else None) for i in range(10)], "id long, a array<double>, b array<double>").coalesce(1)
    far = {r["id"]: r["distance"] for r in models.pair_metric(pairs, "a", "b", farthest, batch=3).collect()}
    assert far == {i: None if i % 4 == 0 else float(max(i, 4)) for i in range(10)}
    assert {r["distance"] for r in models.pair_metric(pairs, "a", "b", None).collect()} == {0.0}


def test_named_metrics_are_merged_with_their_direction(spark):
    f = spark.createDataFrame([(i, 0, i / 4) for i in range(5)], "qid long, cls int, own_mean double")
    up, down = f.select("qid", F.col("own_mean").alias("sharp")), f.filter("qid > 0").select("qid", F.col("own_mean").alias("noise"))
    merged, less = models.extra_quality_metrics(f, "qid", {"sharp": (up, False), "noise": (down, True)})
    assert less == ("noise",)
    got = {r["qid"]: r["score"] for r in selection.composite_score(merged, ["cls"], {"own_mean": 0.5, "sharp": 0.25, "noise": 0.25, "absent": 0.0}, inverted=less).collect()}
    assert got[4] == pytest.approx(0.75) and got[1] == pytest.approx(0.5 * 0.25 + 0.25 * 0.25 + 0.25) and got[0] == 0
    with pytest.raises(ValueError, match="already"):
        models.extra_quality_metrics(f, "qid", {"own_mean": (up, False)})


def test_bins_of_a_histogram_follow_the_distinct_values(spark):
    df = spark.range(600).select(F.lit("k").alias("k"), (F.col("id") % 12).cast("double").alias("x")).unionByName(spark.range(40).select(F.lit("few"), (F.col("id") % 3).cast("double")).toDF("k", "x")).unionByName(spark.range(90).select(F.lit("many"), F.col("id").cast("double")).toDF("k", "x"))
    got = {r["k"]: r["bins"] for r in distances.metric_histogram(df, ["k"], "x").select("k", "bins").distinct().collect()}
    assert got == {"k": 12, "few": 10, "many": 30}


def test_evaluation_tables_are_those_of_their_parts(spark):
    rng = np.random.default_rng(0)
    rows = []
    for m in "AB":
        for c in ("Raw", "Synthetic"):
            for s in (1, 2, 3):
                for i in range(90):
                    y = int(i * 7 % 5 < 2)
                    rows.append((m, c, s, i, y, float(np.clip(0.25 + 0.4 * y + rng.normal() * (0.2 if m == "A" else 0.35), 0, 1)), i % 3 == 0))
    rows += [("A", "Raw", 1, 900, None, 0.5, False), ("A", "Raw", 1, 901, 1, None, True)]
    run = ["model", "experiment", "seed"]
    df = spark.createDataFrame(rows, "model string, experiment string, seed int, filename long, y int, p double, validation boolean")
    bank = spark.createDataFrame([(i, i % 2, i % 2, [float(x) for x in rng.normal(size=3) + 3 * (i % 2)], ("train", "validation", "test")[i % 3]) for i in range(120)], "id long, cls int, pred int, v array<double>, part string")
    out, seen = evaluation.evaluation_pipeline(df, run=run, model="model", condition="experiment", seed="seed", conditions=("Raw", "Synthetic"), temperatures=[0.5, 1.0, 2.0], bank=bank)
    assert seen.get == {"n": 1082, "n_missing": 2, "n_validation": 360, "n_test": 720}
    one = {tuple(r[k] for k in run): r for r in out["runs"].collect()}
    assert len(one) == 12
    clean = df.filter("y IS NOT NULL AND p IS NOT NULL")
    held = clean.withColumn("p", F.least(F.greatest("p", F.lit(1e-12)), F.lit(1 - 1e-12)))
    t = {tuple(r[k] for k in run): r["temperature"] for r in metrics.temperature_grid(held.filter("validation"), run, "y", "p", [0.5, 1.0, 2.0]).collect()}
    assert {k: r["temperature"] for k, r in one.items()} == t
    # the parts by hand for one run
    key = ("B", "Synthetic", 2)
    mine = held.filter("model = 'B' AND experiment = 'Synthetic' AND seed = 2").withColumn("p", 1 / (1 + F.exp(-F.ln(F.col("p") / (1 - F.col("p"))) / t[key])))
    cut = metrics.youden_threshold(mine.filter("validation"), run, "y", "p").first()["threshold"]
    test = mine.filter("NOT validation").withColumn("pred", apply_threshold("p", cut))
    assert one[key]["threshold"] == pytest.approx(cut) and one[key]["roc_auc"] == pytest.approx(metrics.roc_auc(test, run, "y", "p").first()["roc_auc"])
    assert one[key]["mcc"] == pytest.approx(metrics.classification_metrics(test, run, "y", "pred", [0, 1]).first()["mcc"])
    assert one[key]["ece"] == pytest.approx(metrics.ece_mce(test, run, "y", "p").first()["ece"])
    # the others from the runs and the judged rows
    b = [one[("B", c, s)]["f1_macro"] for c in ("Raw", "Synthetic") for s in (1, 2, 3)]
    mean = {(r["model"], r["experiment"]): r["f1_macro_mean"] for r in out["summary"].collect()}
    assert mean[("B", "Raw")] == pytest.approx(np.mean(b[:3]))
    d = {(r["seed"], r["metric"]): r["d"] for r in out["paired"].filter("model = 'B'").collect()}
    assert [d[(s, "f1_macro")] for s in (1, 2, 3)] == pytest.approx([b[3 + i] - b[i] for i in range(3)])
    tt = {(r["model"], r["metric"]): r["t"] for r in out["ttest"].collect()}
    x = np.array([b[3 + i] - b[i] for i in range(3)])
    assert tt[("B", "f1_macro")] == pytest.approx(x.mean() / (x.std(ddof=1) / np.sqrt(3)))
    assert out["ranking"].count() == 4 and out["ood"].count() == 2 and out["mcnemar"].count() == 6 and out["vote"].count() == 6 and out["hard"].count() == 120


def test_draws_are_balanced_over_classes(spark):
    df = spark.range(1000).select(F.col("id").alias("item"), F.when(F.col("id") < 900, "big").when(F.col("id") < 990, "mid").otherwise("small").alias("cls"))
    got = selection.class_balanced_draws(df, "cls", "item", 6000).groupBy("cls").agg(F.count("*").alias("n"), F.count_distinct("item").alias("items")).collect()
    assert sum(r["n"] for r in got) == 6000 and all(1850 < r["n"] < 2150 for r in got)
    assert {r["cls"]: r["items"] for r in got}["small"] == 10


def test_selection_and_benchmark_tables_are_written(spark, tmp_path):
    scores = spark.createDataFrame([(1, 0, 0.5, "x", 0.1)], "qid long, cls int, score double, path string, n_score double")
    tables.write_selection_tables(scores, scores.select("cls"), scores.select("score"), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s/scores")).columns == ["qid", "cls", "score"] and spark.read.parquet(str(tmp_path / "s/summary")).count() == 1
    ranked = runs.benchmark_score(spark.createDataFrame([("a", 0.5, 0.1), ("b", 0.7, 0.3)], "model string, accuracy double, brier double"), ["model"])
    tables.write_benchmark_tables(ranked, ["model"], str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b/overall")).count() == 2 and "accuracy" in spark.read.parquet(str(tmp_path / "b/classification")).columns


def test_kernel_distance_over_subsets_that_hold_all_rows(spark):
    """With subsets as large as the classes, each is the unbiased estimate over all rows."""
    rng = np.random.default_rng(9)
    sets = {(side, c): rng.normal(size=(20, 4)) + side * c for side in (0, 1) for c in (0, 1)}
    a, b = (spark.createDataFrame([(100 * c + i, c, [float(x) for x in v]) for c in (0, 1) for i, v in enumerate(sets[(side, c)])], "id long, cls int, v array<double>") for side in (0, 1))
    got = {r["cls"]: r["distance"] for r in distances.kernel_distance_subsets(a, b, subsets=3, size=24).collect()}
    for c in (0, 1):
        x, y = sets[(0, c)], sets[(1, c)]
        k = lambda p, q: (p @ q.T / 4 + 1) ** 3
        off = lambda m: (m.sum() - np.trace(m)) / (20 * 19)
        assert got[c] == pytest.approx(off(k(x, x)) + off(k(y, y)) - 2 * k(x, y).mean())
    assert got[1] > got[0]
