"""Evaluation, calibration, screening and history queries: operators applied to the derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions import columns as C
from quillmill.operators import evaluation as E
from quillmill.operators import metrics as M
from quillmill.operators import runs as R
from quillmill.operators import screening as S
from quillmill.operators import stats as T
from quillmill.operators.distances import metric_histogram as histogram
from quillmill.operators.distances import score_correlation as correlation
from quillmill.operators.running import running_sums, same
from quillmill.operators.selection import min_max_norm as min_max
from quillmill.plans.fixtures import RUN, classified, history, members, predictions, rounded, table

ALL = list(M.OVERALL)
GRID = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0]
BOTH = {1: "p", 0: "q"}


def _runs(spark, sf_dir) -> DataFrame:
    return M.classification_metrics(classified(spark, sf_dir), RUN, "y", "pred", [0, 1])


def _two_scores(spark, sf_dir) -> DataFrame:
    # twelve digits, so that equal scores of both classes tie
    return predictions(spark, sf_dir).withColumns({"p": C.rounded("p", 12), "q": C.rounded(1 - C.rounded("p", 12), 12)})


def _samples(spark, sf_dir) -> DataFrame:
    return S.ensemble_signal(S.with_group(members(spark, sf_dir), "raw_group"), ["filename", "roi", "grp", "group_rank"], "p")


def _ranked_samples(spark, sf_dir) -> DataFrame:
    return _samples(spark, sf_dir).withColumn("p", C.rounded("p", 9))


def class_weights(spark, sf_dir):
    return rounded(M.class_weights(predictions(spark, sf_dir), RUN, "y", [0, 1]).withColumnRenamed("class", "label"))


def confusion_matrix(spark, sf_dir):
    return M.confusion_matrix(classified(spark, sf_dir), RUN, "y", "pred", [0, 1])


def classification_metrics(spark, sf_dir):
    return rounded(_runs(spark, sf_dir))


def per_class_metrics(spark, sf_dir):
    m = M.per_class_metrics(classified(spark, sf_dir), RUN, "y", "pred", [0, 1])
    return rounded(m.select(*RUN, F.col("class").alias("label"), "support", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "specificity"))


def brier_score(spark, sf_dir):
    return rounded(M.brier_score(predictions(spark, sf_dir), RUN, "y", "p"))


def ece_mce(spark, sf_dir):
    return rounded(M.ece_mce(predictions(spark, sf_dir), RUN, "y", "p"))


def reliability_bins(spark, sf_dir):
    return rounded(M.reliability_bins(predictions(spark, sf_dir), RUN, "y", "p"))


def run_mean_std(spark, sf_dir):
    return rounded(R.run_mean_std(_runs(spark, sf_dir), RUN[:2], ALL))


def cv_mean_std(spark, sf_dir):
    return rounded(R.cv_mean_std(_runs(spark, sf_dir), RUN[:2], ALL))


def _cells(spark, sf_dir) -> DataFrame:
    m = M.confusion_matrix(classified(spark, sf_dir), RUN, "y", "pred", [0, 1])
    return m.groupBy(*RUN).agg(*[F.sum(F.when(F.col("truth") == t, F.col(f"pred_{p}")).otherwise(0)).alias(n) for n, t, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))])


def mean_confusion(spark, sf_dir):
    return rounded(_cells(spark, sf_dir).groupBy(*RUN[:2]).agg(*[F.avg(c).alias(c) for c in ("tn", "fp", "fn", "tp")]))


def pooled_confusion(spark, sf_dir):
    return _cells(spark, sf_dir).groupBy(*RUN[:2]).agg(*[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")])


def metrics_long(spark, sf_dir):
    return rounded(R.metrics_long(_runs(spark, sf_dir), RUN, ALL))


def cv_summary(spark, sf_dir):
    return rounded(R.cv_summary(_runs(spark, sf_dir), RUN[:2], ALL))


def cv_comparison(spark, sf_dir):
    return rounded(R.cv_comparison(R.cv_summary(_runs(spark, sf_dir), RUN[:2], ALL), RUN[:2], ALL))


def _with_auc(spark, sf_dir) -> DataFrame:
    return same(_runs(spark, sf_dir), M.roc_auc(predictions(spark, sf_dir), RUN, "y", "p"), RUN)


def rank_models(spark, sf_dir):
    means = rounded(_with_auc(spark, sf_dir).groupBy(*RUN[:2]).agg(F.avg("f1_macro").alias("f1"), F.avg("roc_auc").alias("auc"), F.avg("accuracy").alias("acc")))
    return R.rank_by(means, ["f1", "auc", "acc"], RUN[:2])


def roc_auc(spark, sf_dir):
    return rounded(M.roc_auc(predictions(spark, sf_dir), RUN, "y", "p"))


def roc_auc_macro_micro(spark, sf_dir):
    return rounded(M.roc_auc_macro_micro(_two_scores(spark, sf_dir), RUN, "y", BOTH))


def roc_auc_per_class(spark, sf_dir):
    return rounded(M.roc_auc_per_class(_two_scores(spark, sf_dir), RUN, "y", BOTH).withColumnRenamed("class", "label"))


def roc_curve(spark, sf_dir):
    c = M.roc_curve(predictions(spark, sf_dir), RUN, "y", "p")
    return c.select(*RUN, C.rounded("threshold", 9).alias("threshold"), C.rounded("fpr", 6).alias("fpr"), C.rounded("tpr", 6).alias("tpr"))


def average_precision(spark, sf_dir):
    return rounded(M.average_precision(predictions(spark, sf_dir), RUN, "y", "p"))


def pr_auc_mean(spark, sf_dir):
    return rounded(M.pr_auc_mean(predictions(spark, sf_dir), RUN[:2], "seed", "y", "p"))


def youden_threshold(spark, sf_dir):
    y = M.youden_threshold(predictions(spark, sf_dir), RUN, "y", "p")
    return y.select(*RUN, C.rounded("threshold", 9).alias("threshold"), C.rounded("youden", 6).alias("youden"))


def per_class_youden(spark, sf_dir):
    return rounded(M.per_class_youden(_two_scores(spark, sf_dir), RUN, "y", BOTH).withColumnRenamed("class", "label"))


def mean_roc_on_grid(spark, sf_dir):
    return rounded(M.mean_roc_on_grid(predictions(spark, sf_dir), RUN[:2], "seed", "y", "p").drop("fpr_grid"), 5)


def temperature_grid(spark, sf_dir):
    return rounded(M.temperature_grid(predictions(spark, sf_dir), RUN, "y", "p", GRID))


def fit_temperature(spark, sf_dir):
    z = F.array(F.lit(0.0), F.ln(F.col("p") / (1 - F.col("p"))))
    return rounded(M.fit_temperature(predictions(spark, sf_dir).withColumn("z", z), RUN, "y", "z"), 4)


def apply_threshold(spark, sf_dir):
    p = predictions(spark, sf_dir)
    pair = F.array(1 - F.col("p"), F.col("p"))
    return p.select(*RUN, "filename", C.apply_threshold("p", 0.45).alias("at_threshold"), C.argmax_class(pair).alias("argmax_class"), C.rounded(C.confidence(pair), 6).alias("confidence"), C.rounded(C.entropy(pair), 6).alias("entropy"))


def hard_examples(spark, sf_dir):
    return rounded(M.hard_examples(predictions(spark, sf_dir), RUN, "filename", "y", "p"), 6, ("hardness",))


def stratified_pick(spark, sf_dir):
    return M.stratified_pick(classified(spark, sf_dir), RUN, "filename", "y", "pred", 16, 2)


def soft_vote(spark, sf_dir):
    p = predictions(spark, sf_dir)
    voted = M.soft_vote(p, ["experiment", "seed"], "filename", "model", "y", "p", M.youden_threshold(p, RUN, "y", "p"))
    return rounded(M.classification_metrics(voted, ["experiment", "seed"], "y", "pred", [0, 1]))


def align_predictions(spark, sf_dir):
    short = predictions(spark, sf_dir).filter("NOT (model = 'ModelC' AND filename % 1000 = 7)")
    return M.align_predictions(short, ["experiment", "seed"], "model", "filename", "y", "ModelA")


def mcnemar(spark, sf_dir):
    m = T.mcnemar(classified(spark, sf_dir), ["experiment", "seed"], "filename", "model", "ok")
    return rounded(m.withColumnsRenamed({"member_a": "model_a", "member_b": "model_b"}))


def _pairs(spark, sf_dir, names: list[str]) -> DataFrame:
    return T.paired(_runs(spark, sf_dir), ["model"], ["seed"], "experiment", "Raw", "Raw_SelectedSynthetic", names)


def pair_experiments(spark, sf_dir):
    p = _pairs(spark, sf_dir, ["f1_macro"])
    return rounded(p.select("model", "seed", F.col("a").alias("raw_f1"), F.col("b").alias("synthetic_f1"), F.col("d").alias("delta"), C.augmentation_verdict("d").alias("verdict")))


def paired_ttest(spark, sf_dir):
    t = T.paired_ttest(_pairs(spark, sf_dir, ["accuracy", "f1_macro"]), ["model", "metric"])
    return t.select("model", "metric", "n", *[C.rounded(c, 6).alias(c) for c in ("b_mean", "a_mean", "difference")], C.rounded("t", 4).alias("t"), C.rounded("p", 4).alias("p"))


def wilcoxon_signed_rank(spark, sf_dir):
    return rounded(T.wilcoxon_signed_rank(_pairs(spark, sf_dir, ["accuracy", "f1_macro"]), ["model", "metric"]))


def benchmark_score(spark, sf_dir):
    p = predictions(spark, sf_dir)
    runs = same(same(_runs(spark, sf_dir), M.ece_mce(p, RUN, "y", "p"), RUN), M.brier_score(p, RUN, "y", "p"), RUN)
    runs = same(runs, M.auc_and_precision(p, RUN, "y", "p").withColumnRenamed("average_precision", "pr_auc"), RUN)
    means = [F.avg(c).alias(c) for c in ("accuracy", "balanced_accuracy", "f1_macro", "mcc", "roc_auc", "pr_auc", "ece", "mce", "brier")]
    means = runs.groupBy(*RUN[:2]).agg(*means, F.stddev_pop("f1_macro").alias("f1_macro_std"), F.stddev_pop("mcc").alias("mcc_std"))
    scored = R.benchmark_score(means, RUN[:2])
    return scored.select(*RUN[:2], "classification", "feature", "calibration", "robustness", "efficiency", C.rounded("overall", 5).alias("overall"), "rnk")


def bench_min_max(spark, sf_dir):
    """The two columns that are scaled, and no others, are made."""
    runs = same(_runs(spark, sf_dir), M.brier_score(predictions(spark, sf_dir), RUN, "y", "p"), RUN)
    means = runs.groupBy(*RUN[:2]).agg(F.avg("accuracy").alias("accuracy"), F.avg("brier").alias("brier"))
    return rounded(R.bench_min_max(means, {"accuracy": True, "brier": False}).select(*RUN[:2], "n_accuracy", "n_brier"), 5)


def limitation_flags(spark, sf_dir):
    e = M.ece_mce(predictions(spark, sf_dir), RUN, "y", "p")
    flags = C.limitation_flags(F.when(F.col("model") == "ModelC", 31e6).otherwise(5e6), F.col("ece"), F.when(F.col("seed") == 42, 25.0).otherwise(8.0))
    return e.select(*RUN, F.array_join(flags, "; ").alias("flags"))


def canonical_group(spark, sf_dir):
    return S.with_group(members(spark, sf_dir), "raw_group").groupBy("raw_group", "grp", "group_rank").agg(F.count("*").alias("n"), F.min(C.rank_order("grp")).alias("sort_key"))


def ensemble_signal(spark, sf_dir):
    return rounded(_samples(spark, sf_dir).select("filename", "roi", "grp", "p", "epistemic", "confidence", "entropy"))


def group_screening_summary(spark, sf_dir):
    return rounded(S.group_screening_summary(_samples(spark, sf_dir), ["grp", "group_rank"]))


def roi_screening_summary(spark, sf_dir):
    return rounded(S.roi_screening_summary(_samples(spark, sf_dir), ["grp", "roi"]))


def spearman_trend(spark, sf_dir):
    return rounded(T.spearman_trend(_ranked_samples(spark, sf_dir), "group_rank", "p"))


def kruskal_wallis(spark, sf_dir):
    return rounded(T.kruskal_wallis(_ranked_samples(spark, sf_dir), "group_rank", "p", 3), 4)


def mann_whitney_adjacent(spark, sf_dir):
    return rounded(T.mann_whitney_adjacent(_ranked_samples(spark, sf_dir), "group_rank", "p"), 4)


def normal_vs_cancer_auc(spark, sf_dir):
    return rounded(S.normal_vs_cancer_auc(_ranked_samples(spark, sf_dir)))


def progression_statistics(spark, sf_dir):
    return rounded(S.progression_statistics(_ranked_samples(spark, sf_dir)), 4)


def metric_histogram(spark, sf_dir):
    h = histogram(table(spark, sf_dir, "events").withColumn("selected", (F.col("event_id") % 5 == 0).cast("int")), ["event_type"], "value", selected="selected")
    return h.select("event_type", "selected", "bin", "n")


def score_correlation(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return rounded(correlation(e, ["event_id", "user_id", "value"]))


def otsu_by_key(spark, sf_dir):
    """The value that splits the values of each event type best."""
    v = F.least(F.floor("value"), F.lit(255)).cast("int")
    h = table(spark, sf_dir, "events").groupBy("event_type", v.alias("v")).agg(F.count("*").cast("double").alias("n"))
    whole = h.groupBy("event_type").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.col("v")).alias("mt"))
    c = same(running_sums(h, ["event_type"], F.col("v"), {"w": F.col("n"), "m": F.col("n") * F.col("v")}), whole, ["event_type"])
    gap = F.col("m") / F.col("w") - F.try_divide(F.col("mt") - F.col("m"), F.col("t") - F.col("w"))
    between = F.coalesce(F.col("w") * (F.col("t") - F.col("w")) * gap * gap, F.lit(0.0))
    return c.groupBy("event_type").agg(F.max_by("v", F.struct(C.rounded(between, 3), -F.col("v"))).alias("threshold"))


def best_epoch(spark, sf_dir):
    return rounded(R.best_epoch(history(spark, sf_dir), ["run_id"]))


def run_record_rollup(spark, sf_dir):
    best = R.best_epoch(history(spark, sf_dir), ["run_id"]).withColumn("grp", F.col("run_id") % 3).withColumn("train_seconds", F.col("run_id") * 10 + 5)
    return rounded(R.run_record_rollup(best, ["grp"], ["val_f1", "val_loss"]))


def min_max_norm(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value", F.col("value").alias("turned"))
    m = min_max(e, ["event_type"], {"value": False, "turned": True})
    return m.select("event_id", "event_type", C.rounded("n_value", 6).alias("norm"), C.rounded("n_turned", 6).alias("inverted"))


def ema_by_key(spark, sf_dir):
    return rounded(R.ema_by_key(table(spark, sf_dir, "events"), ["event_type"], "event_id", "value"), 5)


def evaluation_pipeline(spark, sf_dir):
    """The runs' table of the whole evaluation, a row per metric; every third item is for validation."""
    rows = predictions(spark, sf_dir).withColumn("validation", F.col("filename") % 3 == 0)
    tables, _ = E.evaluation_pipeline(rows, run=RUN, model="model", condition="experiment", seed="seed", conditions=("Raw", "Raw_SelectedSynthetic"), temperatures=GRID)
    names = [*M.OVERALL, "roc_auc", "average_precision", "ece", "mce", "brier", "temperature", "threshold", "youden"]
    return rounded(R.metrics_long(tables["runs"], RUN, names), 5)


NAMES = (
    "class_weights confusion_matrix classification_metrics per_class_metrics brier_score ece_mce reliability_bins run_mean_std cv_mean_std mean_confusion pooled_confusion metrics_long cv_summary"
    " cv_comparison rank_models roc_auc roc_auc_macro_micro roc_auc_per_class roc_curve average_precision pr_auc_mean youden_threshold per_class_youden mean_roc_on_grid temperature_grid fit_temperature"
    " apply_threshold hard_examples stratified_pick soft_vote align_predictions mcnemar pair_experiments paired_ttest wilcoxon_signed_rank benchmark_score bench_min_max limitation_flags canonical_group"
    " ensemble_signal group_screening_summary roi_screening_summary spearman_trend kruskal_wallis mann_whitney_adjacent normal_vs_cancer_auc progression_statistics metric_histogram score_correlation"
    " otsu_by_key best_epoch run_record_rollup min_max_norm ema_by_key evaluation_pipeline"
)
QUERIES = {n: globals()[n] for n in NAMES.split()}
