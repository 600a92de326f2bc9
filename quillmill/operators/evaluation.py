"""The evaluation of many runs as one job: calibration and threshold on validation rows, everything else on test rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quillmill.functions.columns import apply_threshold, augmentation_verdict
from quillmill.operators import metrics as M
from quillmill.operators import runs as R
from quillmill.operators import stats as T
from quillmill.operators import vectors as V
from quillmill.operators.running import same
from quillmill.storage import written

#: What a paired test compares, and what is averaged over seeds.
COMPARED = ["accuracy", "f1_macro", "roc_auc"]


def calibrated(rows: DataFrame, run: list[str], item: str, label: str, score: str, validation: str, temperatures: list[float] | None) -> tuple[DataFrame, DataFrame]:
    """(rows with ``p``, a row per run with its temperature): scores divided by the temperature that validation rows fit best."""
    held = F.least(F.greatest(F.col(score), F.lit(1e-12)), F.lit(1 - 1e-12))
    z = F.ln(held / (1 - held))
    fit = rows.filter(validation)
    if temperatures:
        best = M.temperature_grid(fit.withColumn("_p", held), run, label, "_p", temperatures)
    else:
        best = M.fit_temperature(fit.withColumn("_z", F.array(F.lit(0.0), z)), run, label, "_z")
    best = written(best.select(*run, "temperature", "nll"), "temperatures")  # a row a run
    known = same(rows.select(*run, item, label, validation, z.alias("_z")), F.broadcast(best.select(*run, "temperature")), run, "left")
    return known.withColumn("p", 1 / (1 + F.exp(-F.col("_z") / F.coalesce("temperature", F.lit(1.0))))).drop("_z", "temperature"), best


def evaluation_pipeline(
    rows: DataFrame, *, run: list[str], model: str, condition: str, seed: str, conditions: tuple[str, str], item: str = "filename", label: str = "y", score: str = "p",
    validation: str = "validation", temperatures: list[float] | None = None, bank: DataFrame | None = None, hard: int = 10,
) -> tuple[dict[str, DataFrame], Observation]:
    """Tables of an evaluation, by name, and the counts seen while its predictions were stored.

    ``rows`` has a row per run and item: label 0 or 1, a score, and whether the item is for validation.
    ``run`` are the columns model, condition and seed. Validation rows fit the temperature and then the
    threshold of the largest TPR - FPR; test rows never do. Their calibrated scores and classes are
    stored once, and all tables are read from there:

    - ``runs``: temperature, threshold, classification metrics, roc_auc, average_precision, ece, mce, brier
    - ``calibration``: bins of mean score and observed share; ``hard``: the worst rows of each run
    - ``summary``: mean and population deviation over seeds; ``ranking``: models by benchmark score
    - ``paired``: the two ``conditions`` of each model and seed with a verdict; ``ttest``, ``wilcoxon``
    - ``mcnemar``: models against each other; ``vote``: metrics of the models' mean score
    - ``ood``, with a ``bank`` (id, cls, pred, v, part): part is train, validation or test. References come
      from train, the threshold from validation, the share of test rows over it from test.

    Rows without label or score are counted and left out. A run without validation rows keeps temperature
    1 and threshold 0.5. The observation has n, n_missing, n_validation and n_test.
    """
    seen = Observation("evaluation")
    missing = F.col(label).isNull() | F.col(score).isNull()
    counted = rows.observe(seen, F.count("*").alias("n"), F.count_if(missing).alias("n_missing"), F.count_if(~missing & F.col(validation)).alias("n_validation"), F.count_if(~missing & ~F.col(validation)).alias("n_test"))
    stored = written(counted.filter(~missing).select(*run, item, F.col(label).cast("int").alias(label), F.col(score).cast("double").alias(score), validation), "evaluated")
    scored, temperature = calibrated(stored, run, item, label, score, validation, temperatures)
    scored = written(scored, "calibrated")
    threshold = written(M.youden_threshold(scored.filter(validation), run, label, "p"), "thresholds")  # a row a run
    test = same(scored.filter(~F.col(validation)), F.broadcast(threshold.select(*run, "threshold")), run, "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.5)))
    test = written(test.withColumn("pred", apply_threshold("p", F.col("threshold"))).withColumn("ok", (F.col("pred") == F.col(label)).cast("int")), "judged")

    runs = M.classification_metrics(test, run, label, "pred", [0, 1])
    for part in (M.auc_and_precision(test, run, label, "p"), M.ece_mce(test, run, label, "p"), M.brier_score(test, run, label, "p"), temperature, threshold):
        runs = same(runs, part, run, "left")
    runs = written(runs, "runs")  # a row a run
    out = {"runs": runs, "calibration": M.reliability_bins(test, run, label, "p"), "hard": M.hard_examples(test, run, item, label, "p", hard)}
    numbers = [*M.OVERALL, "roc_auc", "average_precision", "ece", "mce", "brier"]
    out["summary"] = R.run_mean_std(runs, [model, condition], numbers)
    means = runs.groupBy(model, condition).agg(*[F.avg(c).alias("pr_auc" if c == "average_precision" else c) for c in numbers], F.stddev_pop("f1_macro").alias("f1_macro_std"), F.stddev_pop("mcc").alias("mcc_std"))
    out["ranking"] = R.benchmark_score(means, [model, condition])
    paired = T.paired(runs, [model], [seed], condition, *conditions, COMPARED)
    out["paired"] = paired.withColumn("verdict", augmentation_verdict("d"))
    out["ttest"] = T.paired_ttest(paired, [model, "metric"])
    out["wilcoxon"] = T.wilcoxon_signed_rank(paired, [model, "metric"])
    out["mcnemar"] = T.mcnemar(test, [condition, seed], item, model, "ok")
    voted = M.soft_vote(test, [condition, seed], item, model, label, "p", threshold)
    out["vote"] = M.classification_metrics(voted, [condition, seed], label, "pred", [0, 1])
    if bank is not None:
        reference = V.class_reference(bank.filter("part = 'train'"))
        far = written(V.mahalanobis_ood(bank.filter("part <> 'train'"), reference).join(bank.select("id", "part", "cls", "pred"), "id"), "distances")
        limit = V.quantile_threshold(far.filter("part = 'validation'"), [], "ood_score")
        out["ood"] = V.ood_rate(same(far.filter("part = 'test'"), limit, []), ["cls"], "ood_score", "threshold", "nearest", "pred")
    return out, seen
