"""The selection of candidates as one job, from copies left out to distances of what was selected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.operators.distances import set_distances
from quillmill.operators.running import same
from quillmill.operators.selection import composite_score, dedup_by_content, diverse, exclude_real_copies, quality_features, select_top_n, selection_summary
from quillmill.storage import cut


def selection_pipeline(
    candidates: DataFrame, real: DataFrame, *, near: float = 0.995, diversity: float = 0.98, k: int = 10, outliers=None, content: str | None = None, distances: bool = True
) -> dict[str, DataFrame]:
    """Scores with reasons, the summary, and distances of the selected, of ``candidates`` (id, cls, v) against ``real`` (id, cls, v).

    With ``content`` both tables have that column; copies of real items and later copies of a candidate
    are left out first. ``outliers`` maps (id, cls, v) to (id, outlier). Without ``distances`` none are made.
    """
    audit = real.groupBy("cls").agg(F.count("*").alias("n_real"))
    if content:
        marked = exclude_real_copies(candidates, real, ["cls"], content)
        own = cut(dedup_by_content(marked.filter("real_copy = 0"), ["cls"], content, ["id"]).select("id", "cls", "v"))
        copies = marked.groupBy("cls").agg(F.sum("real_copy").alias("copies_excluded"), F.count_if(F.col("real_copy") == 0).alias("_own"))
        left = own.groupBy("cls").agg(F.count("*").alias("_left"))
        dropped = same(copies, left, ["cls"], "left").select("cls", "copies_excluded", (F.col("_own") - F.coalesce("_left", F.lit(0))).alias("duplicates_excluded"))
        audit, candidates = same(audit, dropped, ["cls"], "left"), own
    features = quality_features(candidates.select("id", "cls", "v"), real.select("id", "cls", "v"), k)
    if outliers:
        features = features.join(outliers(candidates.select("id", "cls", "v")).select(F.col("id").alias("qid"), "outlier"), "qid", "left")
    scored = cut(composite_score(features, ["cls"], outlier="outlier" if outliers else None))
    kept = diverse(scored, candidates.select("id", "v"), ["cls"], "qid", diversity, near=near)
    chosen = cut(select_top_n(kept, ["cls"], "qid", near=near, real=audit))
    taken = candidates.select("id", "cls", "v").join(chosen.filter("selected").select(F.col("qid").alias("id")), "id")
    out = {"scores": chosen, "summary": selection_summary(chosen, ["cls"], audit, near)}
    return out | {"distances": set_distances(real, taken)} if distances else out
