"""Manifest queries: keys from names, exact copies, splits, pools and draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions import columns as C
from quillmill.operators import selection as L
from quillmill.operators import splits as P
from quillmill.plans.fixtures import files
from quillmill.sources.folders import class_vocabulary_filter as in_vocabulary


def _sides(spark, sf_dir):
    f = files(spark, sf_dir)
    return f.filter("origin = 'synth'"), f.filter("origin = 'real'")


def class_counts(spark, sf_dir):
    return files(spark, sf_dir).groupBy("origin", "class_name").agg(F.count("*").alias("n"))


def region_group(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", C.region_group("filename").alias("region"))


def roi_id(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", C.roi_id("filename", "class_name").alias("roi"))


def path_parts(spark, sf_dir):
    path = F.concat_ws("/", F.lit("data"), "class_name", "filename")
    return files(spark, sf_dir).select("doc_id", C.basename(path).alias("base"), C.extension(path).alias("ext"), C.parent_folder(path).alias("folder"), F.round(C.hash_unit("filename"), 9).alias("unit"))


def class_vocabulary_filter(spark, sf_dir):
    return in_vocabulary(files(spark, sf_dir), ["cancer"]).select("doc_id", "class_name")


def sha256_content(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", C.sha256_content("content").alias("sha256"), C.md5_content("content").alias("md5"))


def exclude_real_copies(spark, sf_dir):
    synthetic, real = _sides(spark, sf_dir)
    return L.exclude_real_copies(synthetic, real, ["class_name"], "content").select("doc_id", "class_name", "real_copy")


def synthetic_not_in_raw(spark, sf_dir):
    synthetic, real = _sides(spark, sf_dir)
    return L.synthetic_not_in_raw(synthetic, real, "class_name", name="filename").select("doc_id", "class_name", "filename")


def synthetic_not_in_raw_by_content(spark, sf_dir):
    synthetic, real = _sides(spark, sf_dir)
    return L.synthetic_not_in_raw(synthetic, real, "class_name", content="content").select("doc_id", "class_name", "filename")


def dedup_by_content(spark, sf_dir):
    synthetic, real = _sides(spark, sf_dir)
    own = L.exclude_real_copies(synthetic, real, ["class_name"], "content").filter("real_copy = 0")
    return L.dedup_by_content(own, ["class_name"], "content", ["filename", "doc_id"]).select("doc_id", "class_name", "filename")


def pool_real(spark, sf_dir):
    rows = files(spark, sf_dir).select("doc_id", "class_name", (F.col("doc_id") % 3).alias("root_order"), F.concat(F.lit("f"), F.col("doc_id") % 700).alias("base"))
    return P.pool_real(rows, "base", "root_order", ["class_name", "doc_id"], ["normal", "cancer"])


def common_classes(spark, sf_dir):
    synthetic, real = _sides(spark, sf_dir)
    return real.select("class_name").intersect(synthetic.select("class_name")).filter(~F.col("class_name").startswith("."))


def missing_classes(spark, sf_dir):
    vocabulary = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in ("normal", "cancer", "benign")])).alias("class_name"))
    return vocabulary.join(files(spark, sf_dir).select("class_name").distinct(), "class_name", "left_anti")


def add_selected_synthetic(spark, sf_dir):
    synthetic, real = _sides(spark, sf_dir)
    own = real.select("doc_id", "class_name", F.lit("real").alias("part"), F.lit("train").alias("role"))
    return own.unionByName(synthetic.filter("doc_id % 5 = 0").select("doc_id", "class_name", F.lit("synth").alias("part"), F.lit("train").alias("role")))


def hash_holdout(spark, sf_dir):
    return P.hash_holdout(files(spark, sf_dir).select("doc_id", "class_name", "filename"), "class_name", "filename", ["doc_id"]).select("doc_id", "class_name", "role")


def stratified_split(spark, sf_dir):
    return P.stratified_split(files(spark, sf_dir).select("doc_id", "class_name"), "class_name", "doc_id").select("doc_id", "class_name", "role")


def _grouped(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", "class_name", C.region_group("filename").alias("region"))


def stratified_group_split(spark, sf_dir):
    return P.stratified_group_split(_grouped(spark, sf_dir), "region", "class_name").select("doc_id", "region", "role")


def stratified_group_kfold(spark, sf_dir):
    return P.stratified_group_kfold(_grouped(spark, sf_dir), "region", "class_name", 5).select("doc_id", "region", "fold", "role")


def grouped_cv_holdout_val(spark, sf_dir):
    return P.grouped_cv_holdout_val(_grouped(spark, sf_dir), "region", "class_name", 5).select("doc_id", "region", "fold", "role")


def group_disjoint(spark, sf_dir):
    """Leaks of a split by rows, that a split by groups would not have."""
    rows = _grouped(spark, sf_dir).withColumn("role", F.when(F.col("doc_id") % 4 == 0, "test").otherwise("train"))
    return P.assert_group_disjoint(rows, [], "region", "role").select("region", "roles", "leaks")


def expand_experiments(spark, sf_dir):
    synthetic, real = _sides(spark, sf_dir)
    names = lambda column, *values: spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(column))
    own = real.select(F.col("doc_id").alias("item"), "class_name", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("role"))
    every = P.expand_experiments(own, synthetic.select(F.col("doc_id").alias("item"), "class_name"), names("model", "A", "B"), names("experiment", "Raw", "Raw_SelectedSynthetic"), names("seed", 42, 100), "Raw_SelectedSynthetic")
    return every.groupBy("model", "experiment", "seed", "role", "class_name").agg(F.count("*").alias("n"))


def capped_sample(spark, sf_dir):
    return L.capped_sample(files(spark, sf_dir).select("doc_id", "class_name"), ["class_name"], "doc_id", 50)


def class_balanced_draws(spark, sf_dir):
    return L.class_balanced_draws(files(spark, sf_dir).select("doc_id", "class_name"), "class_name", "doc_id", files(spark, sf_dir).count())


NAMES = (
    "class_counts region_group roi_id path_parts class_vocabulary_filter sha256_content exclude_real_copies synthetic_not_in_raw synthetic_not_in_raw_by_content dedup_by_content pool_real common_classes missing_classes"
    " add_selected_synthetic hash_holdout stratified_split stratified_group_split stratified_group_kfold grouped_cv_holdout_val group_disjoint expand_experiments capped_sample class_balanced_draws"
)
QUERIES = {n: globals()[n] for n in NAMES.split()}
