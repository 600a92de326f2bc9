"""Words of Arrow string batches as numbers, with numpy; windows bound what one very long text takes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from quillmill.llm.spans import chunks

WINDOW_BYTES = 2 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0 within a word, 1 between words, 2 between pieces.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[32, 9]] = 1
_CLASS[[46, 44, 59, 58, 33, 63, 10, 11, 12, 13]] = 2


@dataclass
class Tokens:
    """Tokens in order: ``code`` into ``words``, ``joined`` to the next one, ``own`` of them counted in this window."""

    code: np.ndarray
    words: pa.Array
    joined: np.ndarray
    own: int
    start: np.ndarray

    def runs(self, n: int) -> np.ndarray:
        """Where ``n`` words of one piece start, among the window's own tokens."""
        at = np.arange(min(self.own, max(0, len(self.code) - n + 1)))
        for j in range(n - 1):
            at = at[self.joined[at + j]]
        return at


def _tokens(data: np.ndarray, offsets: np.ndarray, more: bool) -> Tokens:
    kind = _CLASS[data]
    inside = kind == 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    place = np.concatenate(([0], np.cumsum(end - start)))
    joined = np.zeros(len(start), bool)
    if len(start) > 1:
        piece = np.searchsorted(np.flatnonzero(kind == 2), start)
        text = np.searchsorted(offsets, start, "right")
        joined[:-1] = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])
    values = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(place.astype(np.int64)), pa.py_buffer(_LOWER[data[inside]])])
    coded = values.dictionary_encode()
    return Tokens(coded.indices.to_numpy().astype(np.int64), coded.dictionary, joined, len(start) - 2 if more else len(start), start)


def windows(texts: pa.Array, most: int = WINDOW_BYTES) -> Iterator[Tokens]:
    """Tokens of the texts in windows of about ``most`` bytes.

    A longer text gives several windows; each shows two tokens more than it owns, which the next owns,
    so every run of up to three words starts in one window and is whole there.
    """
    for _, data, offsets in chunks(texts.fill_null(""), most):
        offsets = offsets - offsets[0]
        if len(data) <= most or len(offsets) > 2:
            yield _tokens(data, offsets, False)
            continue
        at, size = 0, most
        while at < len(data):
            end = at + size
            if end < len(data):
                gap = np.flatnonzero(_CLASS[data[at:end]] != 0)
                end = at + int(gap[-1]) if len(gap) else at
            found = _tokens(data[at : min(end, len(data))], np.array([0, min(end, len(data)) - at]), end < len(data)) if end > at else None
            if end >= len(data):
                yield found
                break
            if found is None or found.own < 1:
                size *= 2  # a word that does not fit
                continue
            yield found
            at, size = at + int(found.start[found.own]), most
