"""Scans of image folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.columns import extension, parent_folder

EXTENSIONS = ("png", "jpg", "jpeg", "bmp", "tif", "tiff")


def _glob(extensions: tuple[str, ...]) -> str:
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in x) for x in extensions) + "}"


def _files(spark: SparkSession, root: str, extensions: tuple[str, ...], recursive: bool) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", _glob(extensions)).option("recursiveFileLookup", str(recursive).lower()).load(root if recursive else f"{root.rstrip('/')}/*")


def scan_class_folders(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, length, class_name) of the images one class folder below ``root``; contents are not read.

    A missing root is Spark's error; a root without images is ours.
    """
    found = _files(spark, root, extensions, False).select("path", "length", parent_folder("path").alias("class_name"))
    if found.isEmpty():
        raise FileNotFoundError(f"no images below {root}")
    return found


def scan_recursive_strict(spark: SparkSession, root: str, classes: list[str], extensions: tuple[str, ...] = (*EXTENSIONS, "webp")) -> DataFrame:
    """(path, length, class_name) at any depth; a folder that is no class is an error."""
    found = _files(spark, root, extensions, True).select("path", "length", parent_folder("path").alias("class_name"))
    odd = found.filter(~F.col("class_name").isin(classes)).select("class_name").distinct().limit(5).collect()
    if odd:
        raise ValueError(f"folders that are no classes: {sorted(r[0] for r in odd)}")
    return found


def class_vocabulary_filter(df: DataFrame, classes: list[str], class_name: str = "class_name") -> DataFrame:
    return df.filter(F.col(class_name).isin(classes))


def scan_valid_images(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> tuple[DataFrame, DataFrame]:
    """(images that decode, paths of those that do not)."""
    valid = spark.read.format("image").option("dropInvalid", "true").option("pathGlobFilter", _glob(extensions)).option("recursiveFileLookup", "true").load(root)
    every = _files(spark, root, extensions, True).select("path")
    good = valid.select(F.col("image.origin").alias("path"))
    plain = lambda c: F.regexp_replace(F.col(c), "^file:/+", "/")
    return valid, every.join(good.withColumn("_p", plain("path")).select("_p"), plain("path") == F.col("_p"), "left_anti")


def keep_invalid_flagged(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Every file as (path, is_valid, image); the image of an unreadable one is null and never a blank."""
    rows = spark.read.format("image").option("dropInvalid", "false").option("pathGlobFilter", _glob(extensions)).option("recursiveFileLookup", "true").load(root)
    ok = F.col("image.height") > 0
    return rows.select(F.col("image.origin").alias("path"), F.coalesce(ok, F.lit(False)).alias("is_valid"), F.when(ok, F.col("image")).alias("image"), parent_folder("image.origin").alias("class_name"))


__all__ = ["EXTENSIONS", "class_vocabulary_filter", "extension", "keep_invalid_flagged", "scan_class_folders", "scan_recursive_strict", "scan_valid_images"]
