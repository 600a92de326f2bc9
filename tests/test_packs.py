"""Pairs of packs: each row is shuffled once, whatever it meets, and shared results are made once."""

import glob
import uuid

import numpy as np
import pytest

from quillmill.operators import distances, outliers, selection, vectors
from quillmill.sources import tables


def frame(spark, n, seed, first=0):
    v = np.random.default_rng(seed).normal(size=(n, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return spark.createDataFrame([(first + i, i % 2, [float(y) for y in x]) for i, x in enumerate(v)], "id long, cls int, v array<double>")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def runs(monkeypatch):
    """Names of the tables of neighbours that were asked for."""
    seen, real = [], vectors._every

    def every(*args, **named):
        seen.append(1)
        return real(*args, **named)

    monkeypatch.setattr(vectors, "_every", every)
    return seen


def test_rows_are_not_copied_into_a_shuffle(spark):
    q, d = frame(spark, 90, 1), frame(spark, 120, 2, 1000)
    near = vectors._whole(q, d, vectors._best(3, "own"), vectors.NEAR, 10, fold=True)
    assert "CartesianProduct" in plan(near) and "Exchange" not in plan(near) and "Generate" not in plan(near)
    got = {(r["qid"], r["did"]) for r in vectors.knn_join(q, d, 3, scope="own", block_rows=10).collect()}
    assert got == {(r["qid"], r["did"]) for r in vectors.knn_join(q, d, 3, scope="own").collect()} and len(got) == 270


def test_balls_over_many_packs(spark, monkeypatch):
    real, made = frame(spark, 150, 3), frame(spark, 130, 4, 1000)
    once = distances.prdc(real, made).first()
    by_class = sorted(distances.prdc_by_class(real, made).collect())
    monkeypatch.setattr(vectors, "PACK_ROWS", 20)
    assert distances.prdc(real, made).first() == once
    assert sorted(distances.prdc_by_class(real, made).collect()) == by_class and len(by_class) == 2


def test_many_equal_vectors_over_many_packs(spark):
    same_v = [1.0, 0.0]
    rows = spark.createDataFrame([(i, [0, 1, None][i % 3], same_v) for i in range(200)], "id long, cls int, v array<double>")
    for scope in ("all", "own", "other"):
        few, many = ({tuple(r) for r in vectors.knn_join(rows, rows, 4, scope=scope, block_rows=b).select("qid", "did", "rnk").collect()} for b in (4000, 7))
        assert few == many and len(few) == 4 * (200 if scope == "all" else 134)


def test_stored_features_and_outliers_are_not_made_again(spark):
    q, d = frame(spark, 60, 5), frame(spark, 60, 6, 1000)
    features = selection.quality_features(q, d, 5).join(outliers.lof_flag(q, k=5).selectExpr("id AS qid", "outlier"), "qid", "left")
    scored = selection.composite_score(features, ["cls"], outlier="outlier")
    assert "MapInArrow" not in plan(scored) and "Cartesian" not in plan(scored)
    assert "MapInArrow" not in plan(outliers.lof_flag(q, k=5))
    assert "MapInArrow" not in plan(distances.radii(q, 3))
    assert scored.count() == 60


def test_a_manifest_is_read_back(spark, tmp_path):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    chosen = spark.range(9).selectExpr("id AS qid", "id % 3 = 0 AS selected")
    rows = tables.selected_manifest(chosen, ["qid"], path)
    assert sorted(r["qid"] for r in rows.collect()) == [0, 3, 6]
    assert "FileScan" in plan(rows) and glob.glob(f"{path}/*.parquet")


def test_a_summary_makes_no_distances(spark, runs, monkeypatch):
    from quillmill.operators import selection_job

    monkeypatch.setattr(selection_job, "set_distances", lambda *a: pytest.fail("not asked for"))
    got = selection_job.selection_pipeline(frame(spark, 40, 7), frame(spark, 40, 8, 1000), distances=False)
    assert set(got) == {"scores", "summary"} and len(runs) == 3
    assert got["summary"].agg({"n_generated": "sum"}).first()[0] == 40


def test_a_metric_of_the_user_is_measured_once(spark):
    from quillmill.plans import jobs

    scored = jobs.extra_quality_metric(spark, "/root/testdata/sf0.001")
    assert not any(x in plan(scored) for x in ("Cartesian", "CoGroup", "ArrowEvalPython"))
    assert scored.count() == 250


def test_packs_are_small(spark):
    sizes = [r["n"] for r in vectors._packs(frame(spark, 300, 9), "a", ["cls"], 20, 16).selectExpr("size(a) AS n").collect()]
    assert sum(sizes) == 300 and max(sizes) <= 40
