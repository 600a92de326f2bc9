"""Quality classifier: a sparse ensemble of rules over text statistics.

A small random forest proposes rules: every path from a root to a node is a conjunction of
thresholds on statistics. A lasso logistic regression over the rules keeps few of them, and those
compile into one Spark column expression, so scoring is a projection without a model object.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.quality_rules import measurements
from quillmill.llm.words import let, n_chars, words
from quillmill.storage import cut

#: Labelled rows that the model is fitted on, at most, taken by hash.
TRAIN_ROWS = 20_000
TREES, DEPTH, LASSO = 12, 3, 0.001
THRESHOLD = 0.3
STATISTICS = ("n_words", "word_length", "symbols", "bangs", "bars", "capitals", "digits", "repeats", "distinct", "dup_lines", "line_words", "stops")


def statistics(text: Column) -> Column:
    """Struct of the statistics as doubles; a null text is measured as an empty one."""
    text = F.coalesce(text, F.lit(""))

    def over(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    distinct = let(words(text), lambda w: F.size(F.array_distinct(w)))

    def stats(m: Column) -> Column:
        n, chars = m["w"]["n_words"], m["w"]["word_chars"]
        values = (
            n, over(chars, n), over(m["n_symbols"], chars), over(n_chars(text, "!"), n), over(n_chars(text, "|"), n), over(m["n_upper"], m["n_letters"]),
            over(n_chars(text, "0-9"), chars), over(m["w"]["n_repeat_words"], n), over(distinct, n), over(m["l"]["n_dup_lines"], m["l"]["n_lines"]),
            over(n, m["l"]["n_lines"]), over(n_chars(text, ".?"), n),
        )
        return F.struct(*[v.cast("double").alias(k) for k, v in zip(STATISTICS, values, strict=True)])

    return let(measurements(text), stats)


@dataclass(frozen=True)
class Model:
    """Rules are tuples of (statistic, above, threshold); a rule holds if all its parts do."""

    rules: tuple[tuple[tuple[str, bool, float], ...], ...]
    weights: tuple[float, ...]
    bias: float

    def score(self) -> Column:
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total = total + F.when(compiled(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def compiled(rule: tuple[tuple[str, bool, float], ...]) -> Column:
    out = F.lit(True)
    for name, above, threshold in rule:
        out = out & ((F.col(name) > threshold) if above else (F.col(name) <= threshold))
    return out


def _paths(node, path: tuple = ()) -> list[tuple]:
    """Conjunctions from the root to every node below it."""
    found = [path] if path else []
    if node.subtreeDepth() > 0:
        name, threshold = STATISTICS[node.split().featureIndex()], node.split().threshold()
        found += _paths(node.leftChild(), (*path, (name, False, threshold)))
        found += _paths(node.rightChild(), (*path, (name, True, threshold)))
    return found


def fit(docs: DataFrame, labels: DataFrame, *, train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from labelled rows outside the held-out fifth; without both labels, a constant."""
    usable = labels.filter(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("double").alias("label"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(train_rows)
    # a bounded number of ids: they go to the documents
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "label", statistics(F.col("text")).alias("s")).select("doc_id", "label", "s.*")
    # the sample is bounded and narrow, so one partition keeps the many short passes of the fits short
    rows = cut(rows.repartition(1).sortWithinPartitions("doc_id", *STATISTICS))
    seen = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(seen) < 2:
        return Model((), (), {1.0: 5.0, 0.0: -5.0}.get(next(iter(seen), 1.0)))
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="x").transform(rows).select("label", "x", *STATISTICS)
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=7, minInstancesPerNode=5).fit(vectors)
    rules = sorted({tuple(p) for t in forest.trees for p in _paths(t._java_obj.rootNode())})
    if not rules:
        return Model((), (), 5.0 if seen[1.0] >= seen[0.0] else -5.0)
    holds = F.array(*[F.when(compiled(r), 1.0).otherwise(0.0) for r in rules])
    chosen = LogisticRegression(featuresCol="r", labelCol="label", elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=60)
    # rows that the same rules hold for are one row with a weight
    ruled = cut(rows.groupBy("label", holds.alias("r")).agg(F.count("*").cast("double").alias("n")).coalesce(1).sortWithinPartitions("label", "r"))
    fitted = chosen.setWeightCol("n").fit(ruled.select("label", "n", array_to_vector("r").alias("r")))
    kept = [(r, float(w)) for r, w in zip(rules, fitted.coefficients.toArray(), strict=True) if w]
    return Model(tuple(r for r, _ in kept), tuple(w for _, w in kept), float(fitted.intercept))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def score(docs: DataFrame, labels: DataFrame, *, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts are scored by the statistics of an empty one; repeated rows score alike; ties
    of the sample's order are settled by id and label; a doc_id with two labels counts as two rows;
    without labels of both kinds the score is a constant; an empty table gives no rows; of ``docs``
    only doc_id and text are read.
    """
    model = fit(docs, labels, train_rows=train_rows)
    stats = docs.select("doc_id", statistics(F.col("text")).alias("s")).select("doc_id", "s.*")
    scored = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
