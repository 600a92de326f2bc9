"""What one task holds when blocks of vectors are compared."""

import tracemalloc

import numpy as np
import pandas as pd

from quillmill.operators import distances, vectors


def frame(n: int, side: str, seed: int) -> pd.DataFrame:
    v = np.random.default_rng(seed).normal(size=(n, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return pd.DataFrame({f"{side}id": np.arange(n), f"{side}cls": np.arange(n) % 2, f"{side}v": list(v)})


def peak(function, *args):
    tracemalloc.start()
    try:
        return function(*args), tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def test_neighbours_hold_a_few_rows_of_products():
    q, d = frame(3000, "q", 1), frame(3000, "d", 2)
    found, mb = peak(vectors._best(3, "own"), q, d)
    assert mb < 130  # all products are 69 MB, and were held four times
    s = np.round(np.stack(q["qv"]) @ np.stack(d["dv"]).T, 12)
    s[(q["qcls"].to_numpy()[:, None] != d["dcls"].to_numpy()) | (np.arange(3000)[:, None] == np.arange(3000))] = -np.inf
    want = np.argsort(-s, axis=1, kind="stable")[:, :3]
    assert {(a, b) for a, b in zip(found["qid"], found["did"], strict=True)} == {(i, j) for i in range(3000) for j in want[i]}


def test_balls_hold_a_few_rows_of_distances():
    g, r = (frame(3000, "", i).assign(r=0.05 + 0.01 * i) for i in (1, 2))
    got, mb = peak(distances._balls, g, r)
    assert mb < 130
    d = np.sqrt(np.maximum(2 - 2 * np.stack(g["v"]) @ np.stack(r["v"]).T, 0))
    assert got["balls"].tolist() == [*(d <= 0.07 + 1e-12).sum(1), *(d <= 0.06 + 1e-12).any(0)]
    assert got["covered"].tolist() == [0] * 3000 + [*(d <= 0.07 + 1e-12).any(0)]


def test_a_ranges_pairs_are_held_as_numbers():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 20_000, (2, 200_000))
    pairs = pd.DataFrame({"better": np.minimum(a, b), "worse": np.maximum(a, b)})[a != b]
    firsts = ~pairs["better"].isin(pairs["worse"])
    pairs["better_kept"] = np.where(firsts, True, None)
    got, mb = peak(vectors._decided, pairs)
    kept = dict.fromkeys(pairs["better"][firsts], True)
    for w, own in pairs.sort_values("worse").groupby("worse")["better"]:
        kept[w] = not any(kept[x] for x in own)
    assert dict(zip(got["pos"], got["kept"], strict=True)) == {w: kept[w] for w in pairs["worse"].unique()}
    assert mb < 40
