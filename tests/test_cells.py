"""Neighbours through cells against every product."""

import numpy as np
import pytest

from quillmill.operators import vectors as V


def frame(spark, rows):
    return spark.createDataFrame([(i, c, [float(x) for x in v]) for i, c, v in rows], "id long, cls int, v array<double>")


def clustered(n, dim=8, centres=12, seed=0, spread=0.15, unit=True):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    x = c[rng.integers(centres, size=n)] + rng.normal(size=(n, dim)) * spread
    x = x / np.linalg.norm(x, axis=1)[:, None] if unit else x * rng.uniform(0.1, 3, size=(n, 1))
    return x


def brute(q, d, k, scope):
    out = []
    for i, c, v in q:
        near = sorted(((-round(float(v @ w), 12), j) for j, e, w in d if j != i and (scope == "all" or (c is not None and e is not None and (c == e) == (scope == "own")))))
        out += [(i, j, r + 1) for r, (_, j) in enumerate(near[:k])]
    return sorted(out)


@pytest.mark.parametrize("scope", ["all", "own", "other"])
@pytest.mark.parametrize("unit", [True, False])
def test_neighbours_through_cells_are_exact(spark, scope, unit):
    x = clustered(700, unit=unit)
    rows = [(i, [0, 1, 2, None][i % 7 % 4], v) for i, v in enumerate(x)]
    # ties: many copies of one vector; and a zero vector
    rows += [(800 + i, i % 2, x[3]) for i in range(60)] + [(900, 1, np.zeros(8))]
    q = rows[::3]
    got = V.knn_join(frame(spark, q), frame(spark, rows), 5, scope=scope, cell_rows=20, block_rows=50)
    assert sorted((r["qid"], r["did"], r["rnk"]) for r in got.collect()) == brute(q, rows, 5, scope)


def test_queries_meet_few_cells_and_growth_is_far_from_quadratic(spark):
    met = []
    for n in (2000, 8000):
        x = clustered(n, dim=6, centres=n // 40, seed=n, spread=0.03)
        d, report = frame(spark, [(i, 0, v) for i, v in enumerate(x)]), []
        V.knn_join(d, d, 5, cell_rows=100, report=report).count()
        met.append(report[0])
    assert all(a < 0.35 * b for a, b in met)
    # the pairs (query, cell) that there are grow 16-fold
    assert met[1][0] < 9 * met[0][0]


def test_the_index_finds_nine_of_ten(spark):
    x = clustered(3000, dim=16, centres=40, seed=2, spread=0.3)
    d = frame(spark, [(i, 0, v) for i, v in enumerate(x)])
    q = d.filter("id % 50 = 0")
    got = V.knn_recall(V.knn_join(q, d, 10, cell_rows=100, probes=8), V.knn_join(q, d, 10)).first()
    assert got["wanted"] == 600 and got["recall"] >= 0.9


@pytest.mark.parametrize("keys", [[], ["cls"]])
def test_similar_pairs_through_cells(spark, keys):
    x = clustered(500, seed=4)
    rows = [(i, [0, 1, None][i % 5 % 3], v) for i, v in enumerate(x)]
    got = sorted(map(tuple, V.similar_pairs(frame(spark, rows), 0.9, keys=keys, cell_rows=25, block_rows=40).collect()))
    same = lambda a, b: not keys or (a is not None and a == b)
    want = sorted((i, j) for i, c, v in rows for j, e, w in rows if i < j and same(c, e) and round(float(v @ w), 12) > 0.9)
    assert got == want == sorted(map(tuple, V.similar_pairs(frame(spark, rows), 0.9, keys=keys).collect()))


def test_neighbours_in_an_empty_table(spark):
    none = frame(spark, [])
    some = frame(spark, [(1, 0, [1.0, 0.0])])
    for q, d in ((none, none), (some, none), (none, some)):
        assert V.knn_join(q, d, 3).count() == 0
        assert V.knn_join(q, d, 3, cell_rows=10).count() == 0
