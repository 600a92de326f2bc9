"""Vector queries: neighbours, selection, class references, outliers, distances of sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions import columns as C
from quillmill.operators import distances as D
from quillmill.operators import selection as L
from quillmill.operators import vectors as V
from quillmill.operators.outliers import isolation_forest_flag as forest
from quillmill.operators.outliers import lof_flag as lof
from quillmill.operators.running import same
from quillmill.operators.selection_job import selection_pipeline as pipeline
from quillmill.plans.fixtures import rounded, table, vectors

NEAR, DIVERSE = 0.42, 0.33


def _named(df: DataFrame) -> DataFrame:
    return df.select("qid", "did", C.rounded("similarity", 6).alias("similarity"), F.col("rnk").cast("long"))


def _both(spark, sf_dir):
    return vectors(spark, sf_dir, 1), vectors(spark, sf_dir, 0)


def knn_join(spark, sf_dir):
    return _named(V.knn_join(*_both(spark, sf_dir), 10, scope="own"))


def nearest_pair(spark, sf_dir):
    return _named(V.knn_join(*_both(spark, sf_dir), 1, scope="own"))


def other_class_knn(spark, sf_dir):
    return _named(V.knn_join(*_both(spark, sf_dir), 10, scope="other"))


def retrieve_similar(spark, sf_dir):
    """The ten rows nearest to the first row's vector."""
    rows = vectors(spark, sf_dir)
    return rounded(V.retrieve_similar(rows, list(rows.orderBy("id").first()["v"]), 10))


def l2_normalize(spark, sf_dir):
    """Norm before and after, and the cosine with the vector turned around."""
    r = vectors(spark, sf_dir).withColumn("w", F.transform("v", lambda x: 3 * x)).withColumn("u", C.l2_normalize("w"))
    return rounded(r.select("id", F.sqrt(C.dot("w", "w")).alias("norm"), F.sqrt(C.dot("u", "u")).alias("unit"), C.cosine("w", F.reverse("v")).alias("turned")))


def quality_features(spark, sf_dir):
    names = ("own_mean", "own_max", "nn_distance", "density", "other_mean", "other_max", "margin")
    return rounded(L.quality_features(*_both(spark, sf_dir)).select("qid", "cls", *names))


def composite_score(spark, sf_dir):
    """Scores with the outlier factor of the local outlier factor."""
    q, d = _both(spark, sf_dir)
    f = L.quality_features(q, d).join(lof(q).select(F.col("id").alias("qid"), "outlier"), "qid", "left")
    return L.composite_score(f, ["cls"], outlier="outlier").select("qid", "cls", "outlier", "score")


def selection_scores(spark, sf_dir):
    """Score, eligibility, place and reason of every candidate; nothing is dropped for likeness to another candidate."""
    q, d = _both(spark, sf_dir)
    scored = L.composite_score(L.quality_features(q, d), ["cls"]).withColumn("kept", F.lit(True))
    chosen = L.select_top_n(scored, ["cls"], "qid", near=NEAR, real=d.groupBy("cls").agg(F.count("*").alias("n_real")))
    return chosen.select("qid", "cls", "score", F.col("eligible").cast("int").alias("eligible"), F.col("selected").cast("int").alias("selected"), "reason")


def _with_content(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Candidates and real rows, each with a document's text as its content; every seventh id takes another's of its class."""
    rows = vectors(spark, sf_dir)
    of = F.when(F.col("id") % 7 == 0, F.col("id") % 14 + 14 * F.col("cls")).otherwise(F.col("id"))
    text = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_d"), F.col("text").alias("content"))
    held = rows.withColumn("_d", of).join(text, "_d", "left").drop("_d")
    return held.filter("id % 2 = 1"), held.filter("id % 2 = 0")


def _pipeline(spark, sf_dir, distances: bool = False) -> dict[str, DataFrame]:
    return pipeline(*_with_content(spark, sf_dir), near=NEAR, diversity=DIVERSE, outliers=lof, content="content", distances=distances)


def selection_pipeline(spark, sf_dir):
    """Every candidate that is no copy, with its score, what was decided and why."""
    c = _pipeline(spark, sf_dir)["scores"]
    flags = [F.col(x).cast("int").alias(x) for x in ("eligible", "kept", "selected")]
    return rounded(c.select("qid", "cls", "outlier", "score", *flags, "reason"))


def selection_summary(spark, sf_dir):
    return rounded(_pipeline(spark, sf_dir)["summary"], 5)


def selection_distances(spark, sf_dir):
    """Distances of the selected candidates from the real rows, class by class."""
    return rounded(_pipeline(spark, sf_dir, distances=True)["distances"])


def best_worst_n(spark, sf_dir):
    q, d = _both(spark, sf_dir)
    scored = L.composite_score(L.quality_features(q, d), ["cls"])
    return L.best_worst_n(scored, ["cls"], "score", "qid", 50).select("qid", "cls", "score", "side", F.col("place").cast("long").alias("place"))


def diversity_filter(spark, sf_dir):
    """Greedy selection in id order, over exact pairs."""
    e = vectors(spark, sf_dir)
    return V.diversity_filter(e.select("id", F.col("id").alias("priority")), V.similar_pairs(e, DIVERSE)).select("id", F.col("kept").cast("int").alias("kept"))


def class_prototypes(spark, sf_dir):
    return rounded(V.class_reference(vectors(spark, sf_dir, 0)).select("cls", F.col("pos").cast("long").alias("pos"), "n", "centroid", "variance"))


def mahalanobis_ood(spark, sf_dir):
    return rounded(V.mahalanobis_ood(vectors(spark, sf_dir), V.class_reference(vectors(spark, sf_dir, 0))), 4)


def prototype_probability(spark, sf_dir):
    return rounded(V.prototype_probability(vectors(spark, sf_dir), V.class_reference(vectors(spark, sf_dir, 0))), 5)


def ood_rate(spark, sf_dir):
    """Share of synthetic rows over the 0.95 quantile of every third real row's score, which the reference leaves out."""
    real = vectors(spark, sf_dir, 0)
    reference = V.class_reference(real.filter("id % 3 <> 0"))
    validation = V.mahalanobis_ood(real.filter("id % 3 = 0"), reference)
    threshold = V.quantile_threshold(validation, [], "ood_score")
    synthetic = vectors(spark, sf_dir, 1)
    scored = same(V.mahalanobis_ood(synthetic, reference), threshold, []).join(synthetic.select("id", "cls"), "id")
    return rounded(V.ood_rate(scored, ["cls"], "ood_score", "threshold", "nearest", "cls"), 5)


def quantile_threshold(spark, sf_dir):
    scored = V.mahalanobis_ood(vectors(spark, sf_dir), V.class_reference(vectors(spark, sf_dir, 0))).join(vectors(spark, sf_dir).select("id", "cls"), "id")
    return rounded(V.quantile_threshold(scored, ["cls"], "ood_score"), 4)


def lof_flag(spark, sf_dir):
    return rounded(lof(vectors(spark, sf_dir, 1)), 5)


def isolation_forest_flag(spark, sf_dir):
    return rounded(forest(vectors(spark, sf_dir, 1)))


def frechet_distance(spark, sf_dir):
    q, d = _both(spark, sf_dir)
    value = D.frechet_distance(d, q)
    return d.agg(F.count("*").alias("n_real")).withColumn("distance", F.lit(value).cast("double"))


def mean_vector_moments(spark, sf_dir):
    """Sums over the vectors: how many, of each place and of each product of two."""
    return rounded(D.moment_sums(vectors(spark, sf_dir)).withColumnRenamed("s", "total"), 4)


def kernel_distance_biased(spark, sf_dir):
    q, d = _both(spark, sf_dir)
    return rounded(D.kernel_distance_biased(d, q), 7)


def kernel_distance_subsets(spark, sf_dir):
    q, d = _both(spark, sf_dir)
    return D.kernel_distance_subsets(d, q)


def prdc(spark, sf_dir):
    q, d = _both(spark, sf_dir)
    return rounded(D.prdc(d, q))


def improved_precision_recall(spark, sf_dir):
    q, d = _both(spark, sf_dir)
    return rounded(D.improved_precision_recall(d, q))


def memorization_check(spark, sf_dir):
    q, d = _both(spark, sf_dir)
    return rounded(D.memorization_check(d, q))


def feature_separation(spark, sf_dir):
    return rounded(D.feature_separation(vectors(spark, sf_dir)), 5)


def pca_2d(spark, sf_dir):
    return rounded(D.pca_2d(vectors(spark, sf_dir)))


NAMES = (
    "knn_join nearest_pair other_class_knn retrieve_similar l2_normalize quality_features composite_score selection_scores selection_pipeline selection_summary selection_distances best_worst_n diversity_filter class_prototypes"
    " mahalanobis_ood prototype_probability ood_rate quantile_threshold lof_flag isolation_forest_flag frechet_distance mean_vector_moments kernel_distance_biased kernel_distance_subsets prdc"
    " improved_precision_recall memorization_check feature_separation pca_2d"
)
QUERIES = {n: globals()[n] for n in NAMES.split()}
