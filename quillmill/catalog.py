"""All registered queries of the library and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmill.plans import evaluation, files, jobs, sql_evaluation, sql_files, sql_jobs, sql_vectors, vectors


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return evaluation.QUERIES | files.QUERIES | vectors.QUERIES | jobs.QUERIES


def oracles() -> dict[str, str]:
    return sql_evaluation.ORACLES | sql_files.ORACLES | sql_vectors.ORACLES | sql_jobs.ORACLES
