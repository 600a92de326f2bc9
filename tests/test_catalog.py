import glob
import math
import os

import duckdb
import numpy as np
import pytest

from quillmill import catalog
from quillmill.operators.vectors import diversity_filter, knn_join, similar_pairs

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(rows):
    out = [tuple(None if isinstance(v, float) and math.isnan(v) else round(v, 5) if isinstance(v, float) else v for v in r) for r in rows]
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", ["classification_metrics", "ece_mce", "reliability_bins", "roc_auc", "youden_threshold", "mcnemar", "kruskal_wallis", "group_screening_summary", "dedup_by_content", "pool_real", "selection_scores", "mahalanobis_ood", "hash_holdout", "stratified_group_split", "mann_whitney_adjacent", "wilcoxon_signed_rank", "prdc", "feature_separation", "ema_by_key_stream", "score_stream", "training_history_table"])
def test_matches_oracle(spark, oracle, name):
    df, want = catalog.queries()[name](spark, DIR), oracle.sql(catalog.oracles()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert plain([r[c] for c in cols] for r in df.collect()) == plain([r[i] for i in at] for r in want.fetchall())


def vectors(spark, n=60, d=5):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(n, d))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v, spark.createDataFrame([(i, i % 2, x.tolist()) for i, x in enumerate(v)], "id long, cls int, v array<double>")


def test_knn_in_many_blocks(spark):
    v, df = vectors(spark)
    got = {(r.qid, r.rnk): r.did for r in knn_join(df, df, 4, block_rows=7).collect()}
    s = v @ v.T
    np.fill_diagonal(s, -9)
    for i in range(len(v)):
        assert [got[i, k] for k in range(1, 5)] == np.argsort(-s[i], kind="stable")[:4].tolist()


def test_diversity_equals_the_sequential_walk(spark):
    v, df = vectors(spark)
    kept = []
    for i in range(len(v)):
        if not kept or (v[kept] @ v[i]).max() <= 0.5:
            kept.append(i)
    pairs = similar_pairs(df, 0.5, block_rows=9)
    got = diversity_filter(df.selectExpr("id", "id AS priority"), pairs).filter("kept").collect()
    assert sorted(r.id for r in got) == kept
