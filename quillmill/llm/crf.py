"""A linear-chain conditional random field with two labels and binary features, in numpy."""

from __future__ import annotations

import numpy as np


def _scores(weights: np.ndarray, page: list[list[int]]) -> np.ndarray:
    return np.array([weights[f].sum(0) for f in page]).reshape(len(page), 2)


def train(pages: list[list[list[int]]], labels: list[list[int]], n_features: int, *, rounds: int = 60, l2: float = 1e-4, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """(weights [n_features, 2], transitions [2, 2]) by Adam on the penalised log-likelihood.

    Pages are padded to one length and all chains are run at once.
    """
    n, most = len(pages), max(map(len, pages))
    block = np.repeat(np.arange(n * most).reshape(n, most)[:, :1], most, 1) + np.arange(most)
    flat_block = np.concatenate([block[i, t] * np.ones(len(f), np.int64) for i, p in enumerate(pages) for t, f in enumerate(p)])
    flat_feature = np.concatenate([np.array(f, np.int64) for p in pages for f in p])
    size = np.array([len(p) for p in pages])
    real = np.arange(most) < size[:, None]
    y = np.zeros((n, most), np.int64)
    for i, ls in enumerate(labels):
        y[i, : len(ls)] = ls
    total = real.sum()
    w, trans = np.zeros((n_features, 2)), np.zeros((2, 2))
    params = [w, trans]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    one_hot = np.eye(2)[y] * real[..., None]
    pair_real = real[:, 1:]
    observed = np.zeros((2, 2))
    np.add.at(observed, (y[:, :-1][pair_real], y[:, 1:][pair_real]), 1)
    for step in range(1, rounds + 1):
        emit = np.zeros((n * most, 2))
        np.add.at(emit, flat_block, w[flat_feature])
        emit = emit.reshape(n, most, 2)
        alpha, beta = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        alpha[:, 0] = emit[:, 0]
        for t in range(1, most):
            go = np.logaddexp(alpha[:, t - 1, 0, None] + trans[0], alpha[:, t - 1, 1, None] + trans[1]) + emit[:, t]
            alpha[:, t] = np.where(real[:, t, None], go, alpha[:, t - 1])
        for t in range(most - 2, -1, -1):
            x = beta[:, t + 1] + emit[:, t + 1]
            go = np.logaddexp(trans[:, 0] + x[:, :1], trans[:, 1] + x[:, 1:])
            beta[:, t] = np.where(real[:, t + 1, None], go, 0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        mean = np.exp(alpha + beta - z[:, None, None]) * real[..., None]
        pair = np.exp(alpha[:, :-1, :, None] + trans + (beta + emit)[:, 1:, None, :] - z[:, None, None, None])
        gap = (mean - one_hot).reshape(-1, 2)
        grad_w = np.zeros_like(w)
        np.add.at(grad_w, flat_feature, gap[flat_block])
        grads = [grad_w / total + l2 * w, ((pair * pair_real[..., None, None]).sum((0, 1)) - observed) / total + l2 * trans]
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w, trans


def viterbi(weights: np.ndarray, trans: np.ndarray, page: list[list[int]]) -> list[int]:
    """The best labelling of a page's blocks."""
    if not page:
        return []
    emit = _scores(weights, page).tolist()
    (t00, t01), (t10, t11) = trans.tolist()
    a, b = emit[0]
    back = []
    for e0, e1 in emit[1:]:
        f0, f1 = b + t10 > a + t00, b + t11 > a + t01
        back.append((int(f0), int(f1)))
        a, b = (b + t10 if f0 else a + t00) + e0, (b + t11 if f1 else a + t01) + e1
    out = [int(b > a)]
    for step in reversed(back):
        out.append(step[out[-1]])
    return out[::-1]
