"""Weighted MinHash signatures of word-shingle multisets, on Arrow batches with numpy.

The weight of a shingle is how often it occurs. Weights are discretised to the unit steps of the
dyadic intervals [0,1), [1,2), [2,4), [4,8), ... Every (shingle, interval) has a Poisson process of
its own whose points fall on (slot, step, time) at rate 1 a slot and step. A document takes the
points on steps below the weight; a point's step is drawn from the low bits of its hash, as many as
the interval has halvings, so in an interval that the weight cuts only the points under the cut count.
A slot keeps its earliest point. Two documents agree in a slot
with the probability of their weighted Jaccard similarity.

Points are drawn in order of time and drawing stops when the next point is later than the latest
slot, so a document costs about as many draws as it has shingles, plus a number that depends on
the slots alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quillmill.llm.spans import POWERS, chunks, mix

SHINGLE = 5
ROWS = 5
BANDS = 26
SLOTS = ROWS * BANDS
_A, _B, _C = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)
_ALL = (1 << 64) - 1
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each word: a run of bytes other than ASCII white space."""
    inside = ~_IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | edge[1:])) + 1
    up, down = POWERS.get(len(data) + 1)
    total = np.concatenate(([np.uint64(0)], np.cumsum(up[: len(data)] * (data.astype(np.uint64) + np.uint64(1)))))
    h = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _C)
    return np.searchsorted(offsets, starts, "right") - 1, h


def shingles(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each run of SHINGLE words; a shorter text is one shingle."""
    if not len(doc):
        return doc, h
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    length = np.diff(np.concatenate((first, [len(doc)])))
    count = np.maximum(length - SHINGLE + 1, 1)
    at = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
    size = np.repeat(np.minimum(length, SHINGLE), count)
    out = np.zeros(len(at), np.uint64)
    for j in range(SHINGLE):
        some = size > j
        out[some] = mix(out[some] * _A + h[at[some] + j] + _B)
    return np.repeat(doc[first], count), out


def counted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight), sorted by both."""
    by = np.lexsort((h, doc))
    doc, h = doc[by], h[by]
    head = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])))) if len(doc) else np.zeros(0, np.int64)
    return doc[head], h[head], np.diff(np.concatenate((head, [len(doc)])))


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """[n, SLOTS] earliest times."""
    owner, seed, low, limit = [], [], [], []
    level, bottom = 0, 0
    rest = np.arange(len(doc))
    while len(rest):
        owner.append(doc[rest])
        seed.append(mix(h[rest] + np.uint64(level * int(_A) & _ALL)))
        low.append(np.full(len(rest), level))
        limit.append(weight[rest] - bottom)
        bottom = max(1, 2 * bottom)
        level += 1
        rest = rest[weight[rest] > bottom] if level > 1 else rest[weight[rest] > 1]
    if not owner:
        return np.full((n, SLOTS), np.inf)
    owner, seed, level_, limit = (np.concatenate(x) for x in (owner, seed, low, limit))
    width = np.where(level_ > 0, 1 << np.maximum(level_ - 1, 0), 1)
    limit = np.minimum(limit, width)
    flat = np.full(n * SLOTS, np.inf)
    time, k = np.zeros(len(owner)), 0
    live = np.arange(len(owner))
    while len(live):
        for _ in range(1 if len(live) > 4000 else 8):
            k += 1
            r = mix(seed[live] + np.uint64(k * int(_B) & _ALL))
            u = ((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            time[live] -= np.log(u) / (width[live] * SLOTS)
            r = mix(r + _C)
            slot = (r & np.uint64(0xFFFFFFFF)).astype(np.int64) * SLOTS >> 32
            step = (r >> np.uint64(32)).astype(np.int64) & (width[live] - 1)
            ok = step < limit[live]
            np.minimum.at(flat, owner[live[ok]] * SLOTS + slot[ok], time[live[ok]])
        docs = np.unique(owner[live])
        latest = np.zeros(n)
        latest[docs] = flat.reshape(n, SLOTS)[docs].max(1)
        live = live[time[live] <= latest[owner[live]]]
    return flat.reshape(n, SLOTS)


def bands(sig: np.ndarray) -> np.ndarray:
    """[n, BANDS] one hash per group of ROWS slots."""
    bits = sig.view(np.uint64).reshape(len(sig), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _A, bits.shape[:2]).copy()
    for j in range(ROWS):
        out = mix(out * _B + bits[:, :, j])
    return out


SKETCH = "id long, key long, h1 long, h2 long, bands array<long>"


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, key) -> one row each with a digest of its words and its bands (null without words)."""
    for batch in batches:
        for row, data, offsets in chunks(batch.column(1), 1 << 20):
            n = len(offsets) - 1
            doc, h = word_hashes(data, offsets)
            up, _ = POWERS.get(len(h) + 1)
            at = np.arange(len(h)) - np.searchsorted(doc, np.arange(n))[doc]
            sums = []
            for salt in (_A, _B):
                terms, out = mix(h ^ salt) * up[at], np.zeros(n, np.uint64)
                np.add.at(out, doc, terms)
                sums.append(mix(out + np.bincount(doc, minlength=n).astype(np.uint64) * salt))
            sig = bands(signatures(*counted(*shingles(doc, h)), n))
            words = np.bincount(doc, minlength=n) > 0
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * BANDS, BANDS), pa.int32()), pa.array(sig.ravel().view(np.int64)), mask=pa.array(~words))
            ids, key = batch.column(0).slice(row, n), batch.column(2).slice(row, n)
            yield pa.RecordBatch.from_arrays([ids, key, pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), lists], ["id", "key", "h1", "h2", "bands"])


def overlap(texts_a: pa.Array, texts_b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per pair of texts: shingles in common and in either, as multisets."""
    n = len(texts_a)
    parts, sizes = [], np.zeros(n, np.int64)
    for side, texts in enumerate((texts_a, texts_b)):
        for row, data, offsets in chunks(texts, 1 << 20):
            doc, h, weight = counted(*shingles(*word_hashes(data, offsets)))
            sizes += np.bincount(doc + row, weight, n).astype(np.int64)
            parts.append((doc + row, h, weight, np.full(len(doc), side)))
    doc, h, weight, _ = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4
    by = np.lexsort((h, doc))
    doc, h, weight = doc[by], h[by], weight[by]
    same = np.flatnonzero((doc[1:] == doc[:-1]) & (h[1:] == h[:-1]))
    common = np.bincount(doc[same], np.minimum(weight[same], weight[same + 1]), n).astype(np.int64)
    return common, sizes - common


def verified(threshold: float):
    """(a, b, text_a, text_b) -> the pairs whose shingle multisets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                common, either = overlap(part.column(2), part.column(3))
                ok = pa.array((either > 0) & (common >= threshold * either - 1e-9))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(ok), part.column(1).filter(ok)], ["a", "b"])

    return run
