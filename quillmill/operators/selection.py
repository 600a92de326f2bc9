"""Selection of candidates against real items: exact copies, quality features, score, diversity, top n, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.columns import cos_to_euclid, eligible, hash_number, nan_to_null, redistribute_weights, selection_reason
from quillmill.operators.running import numbered, same
from quillmill.operators.vectors import diversity_filter, knn_join, similar_pairs
from quillmill.storage import cut, written

#: Desired weights of the metrics and whether less is better.
WEIGHTS = {"own_mean": 0.266667, "clip": 0.16, "lpips": 0.106667, "nn_distance": 0.093333, "density": 0.04, "margin": 0.333333}
INVERTED = ("lpips", "nn_distance", "density")
#: The reference study never counts the nearest distance; pass include_nn_distance to count it.
UNCOUNTED = "nn_distance"


def exclude_real_copies(candidates: DataFrame, real: DataFrame, keys: list[str], content: str) -> DataFrame:
    """Candidates with ``real_copy``: 1 if a real item of the same keys has equal content (SHA-256)."""
    known = real.select(*keys, F.sha2(F.col(content).cast("binary"), 256).alias("_h")).distinct().withColumn("_hit", F.lit(1))
    hashed = candidates.withColumn("_h", F.sha2(F.col(content).cast("binary"), 256))
    return same(hashed, known, [*keys, "_h"], "left").withColumn("real_copy", F.coalesce("_hit", F.lit(0))).drop("_h", "_hit")


def synthetic_not_in_raw(synthetic: DataFrame, raw: DataFrame, class_name: str, *, name: str | None = None, content: str | None = None) -> DataFrame:
    """Synthetic rows whose (class, name), or (class, MD5 of content), no raw row has."""
    key = F.md5(F.col(content).cast("binary")) if content else F.col(name)
    known = raw.select(F.col(class_name).alias("_c"), key.alias("_k")).distinct()
    rows = synthetic.withColumn("_key", key)
    return rows.join(known, (rows[class_name] == known["_c"]) & (rows["_key"] == known["_k"]), "left_anti").drop("_key")


def dedup_by_content(candidates: DataFrame, keys: list[str], content: str, order: list[str]) -> DataFrame:
    """The first candidate of each content; run ``exclude_real_copies`` before it."""
    digest = F.sha2(F.col(content).cast("binary"), 256)
    firsts = candidates.groupBy(*keys, digest.alias("_h")).agg(F.min(F.struct(*order)).alias("_first"))
    rows = candidates.withColumn("_h", digest).withColumn("_first", F.struct(*order))
    # rows that tie in every column of the order are equal rows; one stays
    return same(rows, firsts, [*keys, "_h", "_first"]).dropDuplicates([*keys, *order]).drop("_h", "_first")


def min_max_norm(df: DataFrame, keys: list[str], metrics: dict[str, bool]) -> DataFrame:
    """``n_<metric>`` in [0, 1] within keys, turned where the flag says; 0.5 if constant, null for null and NaN."""
    finite = lambda m: F.when(F.abs(nan_to_null(F.col(m).cast("double"))) < float("inf"), F.col(m).cast("double"))
    ends = df.groupBy(*keys).agg(*[f(finite(m)).alias(f"_{n}_{m}") for m in metrics for n, f in (("lo", F.min), ("hi", F.max))])

    def unit(m: str, turned: bool) -> Column:
        x = (F.col(m) - F.col(f"_lo_{m}")) / (F.col(f"_hi_{m}") - F.col(f"_lo_{m}"))
        flat = F.col(f"_lo_{m}").isNull() | (F.col(f"_hi_{m}") == F.col(f"_lo_{m}"))
        return F.when(flat, 0.5).when(nan_to_null(F.col(m).cast("double")).isNotNull(), 1 - x if turned else x)

    return same(df, ends, keys).withColumns({f"n_{m}": unit(m, t) for m, t in metrics.items()}).drop(*[f"_{n}_{m}" for m in metrics for n in ("lo", "hi")])


def quality_features(candidates: DataFrame, real: DataFrame, k: int = 10) -> DataFrame:
    """(qid, cls, own_mean, own_max, nn_distance, density, other_mean, other_max, margin), both sides (id, cls, v).

    Density is the mean distance to the k nearest; without another class the margin is 0.
    """
    far = cos_to_euclid("similarity")
    own = knn_join(candidates, real, k, scope="own").groupBy("qid").agg(F.avg("similarity").alias("own_mean"), F.max("similarity").alias("own_max"), F.min(far).alias("nn_distance"), F.avg(far).alias("density"))
    other = knn_join(candidates, real, k, scope="other").groupBy("qid").agg(F.avg("similarity").alias("other_mean"), F.max("similarity").alias("other_max"))
    both = candidates.select(F.col("id").alias("qid"), "cls").join(own, "qid").join(other, "qid", "left")
    return both.withColumn("margin", F.coalesce(F.col("own_mean") - F.col("other_mean"), F.lit(0.0)))


def composite_score(features: DataFrame, keys: list[str], weights: dict[str, float] = WEIGHTS, *, outlier: str | None = None, include_nn_distance: bool = False, inverted: tuple[str, ...] = INVERTED) -> DataFrame:
    """``n_<metric>`` and ``score``: weighted sum over the metrics at hand, times 1 - 0.25 * outlier.

    Weights of absent metrics are spread over the others first; less is better of the ``inverted`` ones.
    The features are stored once, as their ends and every use of the score read them again.
    """
    features = written(features, "features")
    used = redistribute_weights(weights, set(features.columns))
    scaled = min_max_norm(features, keys, {m: m in inverted for m in used})
    terms = [F.coalesce(F.col(f"n_{m}"), F.lit(0.0)) * w for m, w in used.items() if include_nn_distance or m != UNCOUNTED]
    score = sum(terms[1:], terms[0])
    return scaled.withColumn("score", F.round(score * (1 - 0.25 * F.col(outlier)) if outlier else score, 6))


def select_top_n(scored: DataFrame, keys: list[str], item: str, *, near: float = 0.995, kept: str = "kept", share: float = 0.4, real: DataFrame | None = None, of_real: float = 0.5) -> DataFrame:
    """``eligible``, ``selected`` and ``reason``: per key the best of the eligible rows that the diversity filter kept.

    At most ``share`` of all rows of the key, and ``of_real`` of the rows of ``real`` (keys, n_real).
    """
    flagged = scored.withColumn("eligible", eligible("own_max", "margin", near)).withColumn("_in", F.col("eligible") & F.col(kept))
    counts = flagged.groupBy(*keys).agg(F.count("*").alias("_n"))
    most = F.greatest(F.lit(1), F.floor(F.col("_n") * share))
    if real is not None:
        counts = same(counts, real.select(*keys, "n_real"), keys, "left")
        most = F.least(most, F.greatest(F.lit(1), F.floor(F.coalesce("n_real", F.lit(0)) * of_real)))
    ranked = numbered(flagged.filter("_in"), keys, [F.col(item)], spread=-F.col("score")).select(*keys, item, F.col("nth").alias("_nth"))
    out = same(same(flagged, counts.select(*keys, most.alias("_most")), keys), ranked, [*keys, item], "left")
    chosen = F.coalesce(F.col("_nth") <= F.col("_most"), F.lit(False))
    return out.withColumn("selected", chosen).withColumn("reason", selection_reason(F.col("selected"), F.col(kept), "own_max", "margin", near)).drop("_in", "_most", "_nth")


def diverse(scored: DataFrame, vectors: DataFrame, keys: list[str], item: str, threshold: float, *, near: float = 0.995) -> DataFrame:
    """``kept``: walking the eligible rows of a key by score, whether a row is not over ``threshold`` like one kept before."""
    able = scored.filter(eligible("own_max", "margin", near))
    rows = able.select(F.col(item).alias("id"), *keys, F.struct((-F.col("score")).alias("s"), F.col(item).alias("i")).alias("priority"))
    with_vectors = cut(rows.join(vectors.select("id", "v"), "id"))
    pairs = similar_pairs(with_vectors, threshold, keys=keys)
    decided = diversity_filter(rows.select("id", "priority"), pairs).select(F.col("id").alias(item), "kept")
    return scored.join(decided, item, "left").withColumn("kept", F.coalesce("kept", F.lit(True)))


def selection_summary(chosen: DataFrame, keys: list[str], audit: DataFrame, near: float = 0.995) -> DataFrame:
    """Per key: counts of candidates and of each reason, and means over all candidates; ``audit`` has a row per key to join."""
    means = [F.avg(m).alias(f"mean_{m}") for m in ("own_mean", "margin", "clip", "lpips", "score") if m in chosen.columns]
    counts = [
        F.count("*").alias("n_generated"), F.count_if("selected").alias("n_selected"), F.count_if(F.col("reason") == "near_duplicate").alias("near_duplicates_removed"),
        F.count_if(F.col("own_max") >= near).alias("near_copies_rejected"), F.count_if(F.col("margin") <= 0).alias("ambiguous_rejected")]
    outliers = [F.sum("outlier").cast("long").alias("outliers")] if "outlier" in chosen.columns else []
    return same(chosen.groupBy(*keys).agg(*counts, *outliers, *means), audit, keys, "left")


def best_worst_n(df: DataFrame, keys: list[str], score: str, item: str, n: int = 50) -> DataFrame:
    """The first and the last ``n`` rows of each key by score, as ``side`` best or worst with the place from that end."""
    def side(name: str, *order: Column) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return df.withColumn("place", place).filter(F.col("place") <= n).withColumn("side", F.lit(name))

    return side("best", F.desc(score), F.col(item)).unionByName(side("worst", F.asc(score), F.desc(item)))


def capped_sample(df: DataFrame, keys: list[str], item: str, n: int, seed: str = "0", place: str | None = None) -> DataFrame:
    """At most ``n`` rows of each key, the lowest by hash of the item: the same rows at any partitioning; ``place`` names their order."""
    order = hash_number(F.concat_ws(":", F.lit(seed), F.col(item).cast("string")))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("_h", item))
    drawn = df.withColumn("_h", order).withColumn("_r", first).filter(F.col("_r") <= n).drop("_h")
    return drawn.withColumnRenamed("_r", place) if place else drawn.drop("_r")


def class_balanced_draws(df: DataFrame, class_name: str, item: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` draws with replacement, every class equally likely: (draw, class, item)."""
    placed = numbered(df.filter(F.col(class_name).isNotNull()), [class_name], [F.col(item)], spread=hash_number(F.col(item).cast("string")))
    sizes = placed.groupBy(class_name).agg(F.max("of").alias("_of"))
    names = [r[0] for r in sizes.select(class_name).orderBy(class_name).collect()]  # a row a class
    unit = lambda salt: F.pmod(F.xxhash64("id", F.lit(f"{seed}:{salt}")), F.lit(1 << 40)) / float(1 << 40)
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), F.get(F.array(*[F.lit(x) for x in names]), F.floor(unit("class") * len(names)).cast("int")).alias(class_name), unit("row").alias("_u"))
    draws = draws.join(F.broadcast(sizes), class_name).withColumn("_nth", F.floor(F.col("_u") * F.col("_of")) + 1)
    return draws.join(placed.select(F.col(class_name).alias("_c"), F.col("nth"), item), (F.col(class_name) == F.col("_c")) & (F.col("_nth") == F.col("nth"))).select("draw", class_name, item)
