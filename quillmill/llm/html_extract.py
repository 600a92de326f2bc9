"""Main text of web pages by a linear-chain CRF over DOM leaf blocks.

The labelled pages are those whose own markup sets the main part off (``article`` or ``main``). A
bounded sample of them, by hash, trains the chain; every page is used twice, once with the features
that name the main part hidden, so that the text, link and furniture features can carry pages
without such markup. Pages are then decoded by Viterbi where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.crf import train, viterbi
from quillmill.llm.dom_blocks import N_FEATURES, blocks, features, is_marked, placed

#: The only bounds: how many labelled pages train the model, and how long those may be.
TRAIN_PAGES = 300
TRAIN_CHARS = 60_000


def _furnished(page: list[dict], marks: list[int]) -> tuple[list[dict], list[int]]:
    """A training page with three of its main blocks repeated as furniture: a header, a notice and a comment.

    Real comments and headers read like an article; this teaches that their place outweighs that.
    """
    main = [b for b, m in zip(page, marks, strict=True) if m]

    def as_(block: dict, tags: str, word: str = "") -> dict:
        return block | {"frame": placed(tags, word)}

    top = [as_(main[0], "html body header h1")]
    end = [as_(main[-1], "html body div", "notice"), as_(main[len(main) // 2], "html body section p", "comments"), as_(main[-1], "html body article section p", "comments")]
    return [*top, *page, *end], [0, *marks, 0, 0, 0]


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen, hidden, labels = [], [], []
        for html in batch.column(0).to_pylist():
            page = blocks(html)
            marks = [int(is_marked(b)) for b in page]
            if sum(marks):
                page, marks = _furnished(page, marks)
                seen.append(features(page))
                hidden.append(features(page, hide_main=True))
                labels.append(marks)
        lists = pa.list_(pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(seen, lists), pa.array(hidden, lists), pa.array(labels, pa.list_(pa.int32()))], ["seen", "hidden", "labels"])


def fit(pages: DataFrame, *, train_pages: int = TRAIN_PAGES) -> tuple[np.ndarray, np.ndarray]:
    """Weights from the labelled pages; without any, weights that only avoid page furniture."""
    marked = pages.filter(F.length("html").between(1, TRAIN_CHARS) & F.col("html").rlike("(?i)<(article|main)\\b")).select("html", F.xxhash64("html").alias("h"))
    rows = marked.orderBy("h", "html").limit(train_pages).select("html").mapInArrow(_examples, "seen array<array<int>>, hidden array<array<int>>, labels array<int>").collect()
    if rows:
        xs = [x for r in rows for x in (r["seen"], r["hidden"])]
        return train(xs, [r["labels"] for r in rows for _ in range(2)], N_FEATURES)
    weights = np.zeros((N_FEATURES, 2))
    plain, odd = (features([{"text": "a b", "frame": placed(tags), "linked": 0}])[0] for tags in ("", "nav"))
    for f in set(odd) - set(plain):
        weights[f, 0] += 1.0
    for f in plain:
        weights[f, 1] += 0.1
    return weights, np.zeros((2, 2))


def _decoded(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, trans = model.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = []
                for html in part.column(2).to_pylist():
                    page = blocks(html or "")
                    texts.append("\n".join(b["text"] for b, main in zip(page, viterbi(weights, trans, features(page)), strict=True) if main))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, *, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    A null or empty page has no text; repeated rows give repeated rows; pages of equal hash are
    ordered by their html, so the model does not depend on the order of rows; an empty table gives
    no rows; other columns are not read. The time for a page is in proportion to its length, tags
    that never close included.
    """
    model = pages.sparkSession.sparkContext.broadcast(fit(pages, train_pages=train_pages))
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_decoded(model), "page_id long, url string, text string, n_chars long")
