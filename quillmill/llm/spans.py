"""Byte-level anchors of repeated passages, computed on Arrow string batches with numpy.

A passage of ``SPAN`` bytes is represented by one *anchor*: the position of its leftmost
smallest ``K``-byte hash.  The anchor depends on the passage's bytes alone, so two copies of a
passage have their anchors at the same offset.  All passages that share one anchor position form
one *segment* ``[first, last + SPAN)``.  Suffixes are sorted only at anchors, one per about 39
bytes, and still no passage is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPAN = 100
K = 24
WINDOW = SPAN - K + 1
CHUNK = 1 << 18
_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_BASE = np.uint64(0x5851F42D4C957F2D)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit of 64-bit values (in place on a copy)."""
    x = x ^ (x >> np.uint64(32))
    x *= _MUL[3]
    x ^= x >> np.uint64(29)
    return x


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            n = max(n, CHUNK + 4096)
            self.up = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n - 1, _BASE, np.uint64))))
            self.down = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n - 1, inverse, np.uint64))))
        return self.up, self.down


POWERS = _Powers()


def chunks(texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of the first text, bytes, offsets) of runs of whole texts of about ``most`` bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def window_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values: one prefix and one suffix minimum per block of w."""
    n = len(v) - w + 1
    blocks = -(-len(v) // w)
    full = np.full(blocks * w, np.iinfo(v.dtype).max, v.dtype)
    full[: len(v)] = v
    cut = full.reshape(blocks, w)
    head = np.minimum.accumulate(cut, axis=1).ravel()
    tail = np.minimum.accumulate(cut[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """One row per anchor: doc (row in the chunk), at, first, last (chunk positions), key, segment.

    ``first`` and ``last`` are the first and last starts of the passages it stands for; ``key``
    hashes its K bytes and ``segment`` the bytes of all its passages.
    """
    n, none = len(data), np.zeros(0, np.int64)
    lengths = np.diff(offsets)
    if n < SPAN or lengths.max(initial=0) < SPAN:
        return {"doc": none, "at": none, "first": none, "last": none, "key": none.astype(np.uint64), "segment": none.astype(np.uint64)}
    word = np.ndarray((n - 7,), "<u8", np.ascontiguousarray(data), 0, (1,))
    m = n - K + 1
    key = mix(word[:m] * _MUL[0] + word[8 : 8 + m] * _MUL[1] + word[16 : 16 + m] * _MUL[2])
    low = max(21, int(n).bit_length())
    mask = np.uint64((1 << low) - 1)
    at = (window_min((key & ~mask) | np.arange(m, dtype=np.uint64), WINDOW) & mask).astype(np.int64)
    # starts of passages that lie inside one document
    keep = np.flatnonzero(lengths >= SPAN)
    start, count = offsets[keep], lengths[keep] - SPAN + 1
    p = np.repeat(start - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
    doc = np.repeat(keep, count)
    a = at[p]
    turn = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (doc[1:] != doc[:-1]))))
    until = np.concatenate((turn[1:], [len(p)])) - 1
    first, last, a = p[turn], p[until], a[turn]
    up, down = POWERS.get(n + 1)
    total = np.concatenate(([np.uint64(0)], np.cumsum(up[:n] * (data.astype(np.uint64) + np.uint64(1)))))
    body = (total[last + SPAN] - total[first]) * down[first]
    shape = ((a - first) * 4096 + (last - first)).astype(np.uint64)
    return {"doc": doc[turn], "at": a, "first": first, "last": last, "key": key[a], "segment": mix(body + shape * _MUL[1])}
