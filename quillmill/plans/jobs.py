"""Queries that store and read back tables, run streams, and describe images made of vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions import columns as C
from quillmill.operators import images as I
from quillmill.operators import models as U
from quillmill.operators import screening as S
from quillmill.operators import selection as L
from quillmill.operators import vectors as V
from quillmill.plans import vectors as vector_queries
from quillmill.plans.fixtures import RUN, classified, history, members, rounded, table, vectors
from quillmill.sources import tables as T
from quillmill.storage import shared_dir, written
from quillmill.streaming import jobs as J


def _place(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def embedding_bank(spark, sf_dir):
    """One bank of a written table, with the other banks' folders pruned."""
    path = _place(spark, "bank")
    rows = vectors(spark, sf_dir).withColumns({"model": F.lit("ModelA"), "experiment": F.lit("Raw"), "seed": F.lit(42), "fold": (F.col("id") % 5).cast("int"), "bank": F.when(F.col("id") % 2 == 0, "train").otherwise("test")})
    T.write_embedding_bank(rows, path)
    return rounded(T.read_embedding_banks(spark, path, model="ModelA", fold=2).select("id", "cls", "fold", "bank", C.dot("v", "v").alias("norm")), 5)


def class_reference_table(spark, sf_dir):
    path = _place(spark, "reference")
    real = vectors(spark, sf_dir, 0)
    reference = V.class_reference(real)
    T.write_class_reference(V.class_vectors(reference), path, V.quantile_threshold(V.mahalanobis_ood(real, reference), [], "ood_score").withColumnRenamed("threshold", "ood_threshold"))
    return rounded(spark.read.parquet(path).select("cls", "n", F.size("centroid").alias("width"), F.aggregate("variance", F.lit(0.0), lambda a, x: a + x).alias("spread"), "ood_threshold"), 4)


def predictions_table(spark, sf_dir):
    path = _place(spark, "predictions")
    named = classified(spark, sf_dir).select(*RUN, (F.col("filename") % 2).cast("int").alias("fold"), F.col("filename").cast("string").alias("Filename"), F.col("y").alias("GroundTruth"), F.col("pred").alias("Prediction"), F.col("p").alias("Probability_Cancer"))
    T.write_predictions(named, path)
    back = T.read_predictions(spark, path, model="ModelB", experiment="Raw")
    return rounded(back.groupBy("model", "experiment", "seed", "fold").agg(F.count("*").alias("n"), F.avg("Probability_Cancer").alias("mean_p")))


def training_history_table(spark, sf_dir):
    """Written in two parts that overlap, the second with other, mostly smaller values; every epoch is read once, as last written."""
    path, rows = _place(spark, "history"), history(spark, sf_dir)
    T.append_training_history(rows.filter("epoch <= 20"), path)
    T.append_training_history(rows.filter("epoch > 10").withColumn("val_f1", F.col("val_f1") / 2), path)
    return rounded(T.training_history_table(spark, path))


def selected_manifest(spark, sf_dir):
    chosen = vector_queries.selection_scores(spark, sf_dir).withColumn("selected", F.col("selected") == 1)
    return T.selected_manifest(chosen, ["qid", "cls", "score"], _place(spark, "manifest"))


def concat_class_results(spark, sf_dir):
    s = written(vector_queries.quality_features(spark, sf_dir), "features")  # both parts are read from it
    return T.concat_class_results([s.filter("cls = 0"), s.filter("cls = 1").drop("density")]).select("qid", "cls", "own_mean", "density")


def screening_tables(spark, sf_dir):
    """The regions' table as written and read back."""
    path = _place(spark, "screening")
    T.write_screening_tables(S.screening_pipeline(members(spark, sf_dir), ["filename"], "raw_group", "roi", "p"), path)
    return rounded(spark.read.parquet(f"{path}/rois").select("grp", "roi", "n_frames", "mean_p", "prediction"))


def materialize_by_fingerprint(spark, sf_dir):
    """The same result asked for twice: computed, then read."""
    files = spark.read.format("binaryFile").load(f"{sf_dir}/embeddings.parquet").select("path", "length", "modificationTime")
    make = lambda: vectors(spark, sf_dir).groupBy("cls").agg(F.count("*").alias("n"))
    path = _place(spark, "reuse")
    _, first = T.materialize_by_fingerprint(spark, files, "v1", make, path)
    rows, second = T.materialize_by_fingerprint(spark, files, "v1", make, path)
    return rows.select("cls", "n", F.lit(int(first)).alias("hit_before"), F.lit(int(second)).alias("hit_after"))


def ema_by_key_stream(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    stream = J.file_stream(spark, sf_dir, "events", events.schema)
    out = J.drained(J.ema_by_key_stream(stream, "event_type", "event_id", "value"), "update", "ema", ["key"])
    return rounded(out.select(F.col("key").alias("event_type"), "n", "ema"), 5)


def score_stream(spark, sf_dir):
    source = table(spark, sf_dir, "embeddings")
    stream = J.file_stream(spark, sf_dir, "embeddings", source.schema).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return rounded(J.drained(J.score_items(stream, V.class_reference(vectors(spark, sf_dir, 0))), "append", "scores"), 4)


def _images(spark, sf_dir) -> DataFrame:
    """Every vector as a gray image of eight columns."""
    return I.from_values(vectors(spark, sf_dir), "v", 8)


def _keyed(df: DataFrame) -> DataFrame:
    return rounded(df.withColumn("id", F.col("id").cast("long")))


def foreground_box(spark, sf_dir):
    return _keyed(I.foreground_box(_images(spark, sf_dir)))


def tissue_coverage(spark, sf_dir):
    return _keyed(I.tissue_coverage(_images(spark, sf_dir), 127))


def haar_energy(spark, sf_dir):
    return _keyed(I.haar_energy(_images(spark, sf_dir)))


def total_variation(spark, sf_dir):
    return _keyed(I.total_variation(_images(spark, sf_dir)))


def fluorescence_stats(spark, sf_dir):
    return _keyed(I.fluorescence_stats(_images(spark, sf_dir)))


def texture_gap(spark, sf_dir):
    i = _images(spark, sf_dir)
    described = I.haar_energy(i).join(I.total_variation(i), "id").join(I.fluorescence_stats(i), "id")
    sets = vectors(spark, sf_dir).withColumn("set", F.when(F.col("id") % 2 == 0, "real").otherwise("synth"))
    return rounded(I.texture_gap(described.withColumn("id", F.col("id").cast("long")).join(sets.select("id", "cls", "set"), "id"), sets))


def grayscale(spark, sf_dir):
    """Luma of three places of a vector taken as colours."""
    v = F.col("v")
    return rounded(vectors(spark, sf_dir).select("id", C.grayscale(v[0], v[1], v[2]).alias("gray"), C.rel_mse(v, F.reverse(v)).alias("rel_mse"), C.hinge_excess(v[0] + 1, v[1] + 1).alias("hinge")))


def softmax(spark, sf_dir):
    """Class probabilities of the first four places at temperature 0.5, their entropy and the likeliest."""
    p = C.softmax(F.slice("v", 1, 4), 0.5)
    r = vectors(spark, sf_dir).select("id", p.alias("p"))
    return rounded(r.select("id", C.confidence("p").alias("confidence"), C.entropy("p").alias("entropy"), C.argmax_class("p").alias("best")))


def _halves():
    """A fixed projection: the two halves of a vector added up."""
    return lambda x: x[:, :32] + x[:, 32:]


def _city_block():
    return lambda x, y: abs(x - y).sum(axis=1)


def embed(spark, sf_dir):
    """Batch inference of a model from a factory; results have length one."""
    e = U.embed(vectors(spark, sf_dir), _halves, "v", 64)
    return e.select("id", F.round(F.col("e")[0], 4).alias("first"), F.round(C.dot("e", "e"), 4).alias("norm"))


def _nearest(spark, sf_dir) -> DataFrame:
    """Each candidate with its nearest real row, and both vectors."""
    near = V.knn_join(vectors(spark, sf_dir, 1), vectors(spark, sf_dir, 0), 1, scope="own")
    q, d = vectors(spark, sf_dir, 1).select(F.col("id").alias("qid"), F.col("v").alias("a")), vectors(spark, sf_dir, 0).select(F.col("id").alias("did"), F.col("v").alias("b"))
    return near.join(q, "qid").join(d, "did").select("qid", "did", "a", "b")


def pair_metric(spark, sf_dir):
    """A distance of the user's over each candidate and its nearest real row."""
    return rounded(U.pair_metric(_nearest(spark, sf_dir), "a", "b", _city_block, name="city_block").select("qid", "did", "city_block"))


def extra_quality_metric(spark, sf_dir):
    """Scores with a metric of the user's, of which less is better, beside similarity and margin."""
    features = L.quality_features(vectors(spark, sf_dir, 1), vectors(spark, sf_dir, 0)).select("qid", "cls", "own_mean", "margin")
    table = U.pair_metric(_nearest(spark, sf_dir), "a", "b", _city_block, name="city_block").select("qid", "city_block")
    merged, less = U.extra_quality_metrics(features, "qid", {"city_block": (table, True)})
    weights = {"own_mean": 0.5, "margin": 0.3, "city_block": 0.2}
    return L.composite_score(merged, ["cls"], weights, inverted=less).select("qid", "cls", F.round("city_block", 6).alias("city_block"), "score")


def averaged_views(spark, sf_dir):
    """Mean class probability over four turned views of each vector."""
    turned = F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(i.alias("view"), C.softmax(F.slice("v", i * 2 + 1, 2)).alias("p"))))
    views = vectors(spark, sf_dir).select("id", turned.alias("t"))
    mean = views.groupBy("id").agg(F.avg(F.col("t.p")[1]).alias("p"))
    return rounded(mean.select("id", "p", C.apply_threshold("p", 0.5).alias("pred")))


NAMES = (
    "embedding_bank class_reference_table predictions_table training_history_table selected_manifest concat_class_results screening_tables materialize_by_fingerprint ema_by_key_stream score_stream"
    " foreground_box tissue_coverage haar_energy total_variation fluorescence_stats texture_gap grayscale softmax embed pair_metric extra_quality_metric averaged_views"
)
QUERIES = {n: globals()[n] for n in NAMES.split()}
