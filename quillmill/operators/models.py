"""Functions of the user over batches: a model's embeddings, a distance of pairs, metrics merged by name.

A factory makes the function on the executor, once a worker, so a model is loaded there and is never sent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from quillmill.functions.columns import l2_normalize


def embed(rows: DataFrame, factory: Callable[[], Callable[[np.ndarray], np.ndarray]], values: str, width: int, *, batch: int = 256, name: str = "e") -> DataFrame:
    """``rows`` with the model's vector of each array of ``width`` numbers, of length one; null for a null or another width.

    ``factory()`` gives a function from (rows, width) to (rows, any width).
    """
    infer = predict_batch_udf(factory, return_type=ArrayType(FloatType()), batch_size=batch, input_tensor_shapes=[[width]])
    sound = F.coalesce((F.size(values) == width) & ~F.exists(values, lambda x: x.isNull()), F.lit(False))
    given = F.when(sound, F.col(values).cast("array<float>")).otherwise(F.array_repeat(F.lit(0.0).cast("float"), width))
    # the model sees each batch once; its result is read twice by the normalisation
    made = rows.withColumn("_given", given).withColumn("_raw", infer("_given"))
    return made.withColumn(name, F.when(sound, l2_normalize("_raw"))).drop("_given", "_raw")


def pair_metric(pairs: DataFrame, a: str, b: str, factory: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]] | None, *, name: str = "distance", batch: int = 1024) -> DataFrame:
    """``pairs`` with a distance of the user's of two array columns; 0 without a factory, null where a side is null.

    ``factory()`` gives a function from two matrices of equal shape to a vector.
    """
    if factory is None:
        return pairs.withColumn(name, F.lit(0.0))

    @F.pandas_udf("double")
    def measured(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        function = factory()
        for x, y in frames:
            out = np.full(len(x), np.nan)
            known = np.flatnonzero(x.notna().to_numpy() & y.notna().to_numpy())
            for i in range(0, len(known), batch):
                at = known[i : i + batch]
                out[at] = function(np.stack(x.to_numpy()[at]).astype(np.float64), np.stack(y.to_numpy()[at]).astype(np.float64))
            yield pd.Series(out)

    return pairs.withColumn(name, F.nanvl(measured(a, b), F.lit(None).cast("double")))


def extra_quality_metrics(features: DataFrame, item: str, extra: dict[str, tuple[DataFrame, bool]]) -> tuple[DataFrame, tuple[str, ...]]:
    """``features`` with a column per named metric, and the names of those of which less is better.

    ``extra`` maps a name to ((item, <name>), less is better). Items that a table lacks are null there, so
    the score's weights go to what an item has; a name already among the columns is an error.
    """
    for name, (table, _) in extra.items():
        if name in features.columns:
            raise ValueError(f"there is a column {name} already")
        features = features.join(table.select(item, name), item, "left")
    return features, tuple(n for n, (_, less) in extra.items() if less)
