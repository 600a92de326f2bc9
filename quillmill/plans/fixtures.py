"""Tables that the registered queries work on, derived from the given ones: predictions, cohorts, manifests, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import columns as C

RUN = ["model", "experiment", "seed"]
#: Names and the step that each adds to a run's noise.
MODELS = {"ModelA": 0, "ModelB": 1, "ModelC": 2}
EXPERIMENTS = {"Raw": 0, "Raw_SelectedSynthetic": 1}
SEEDS = {42: 0, 100: 1, 123: 2}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """Rows over all cores where fewer partitions are read, for queries that make many rows of each."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, experiment, seed, filename, user_id, y, p): every event scored in 18 runs."""
    runs = [(m, x, s, 7 + 2 * i + 4 * j + 6 * k) for m, i in MODELS.items() for x, j in EXPERIMENTS.items() for s, k in SEEDS.items()]
    each = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(x).alias("experiment"), F.lit(s).alias("seed"), F.lit(k).alias("step")) for m, x, s, k in runs])
    base = dealt(table(spark, sf_dir, "events").select("event_id", "user_id", "value")).selectExpr("event_id", "user_id", "value/(value+40e0) AS p0")
    base = base.withColumn("y", F.expr("CASE WHEN 7e-1*p0 + 3e-1*((event_id*13)%97)/97e0 > 5e-1 THEN 1 ELSE 0 END"))
    p = F.expr("7e-1*p0 + 3e-1*((event_id*step)%101)/101e0")
    return base.select("*", F.inline(each)).select(*RUN, F.col("event_id").alias("filename"), "user_id", "y", p.alias("p"))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with the class at 0.5 and whether it is right."""
    return predictions(spark, sf_dir).withColumn("pred", (F.col("p") >= 0.5).cast("int")).withColumn("ok", (F.col("pred") == F.col("y")).cast("int"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(filename, roi, member, raw_group, p) of one condition's three models, later groups a little likelier."""
    rows = predictions(spark, sf_dir).filter("experiment = 'Raw' AND seed = 42")
    place = F.pmod("filename", F.lit(3))
    raw = F.when(place == 0, "healthy").when(place == 1, " Smo-ker").otherwise("OSCC")
    raised = F.least(F.lit(1.0), F.col("p") + 0.05 * place)
    return rows.select("filename", F.col("user_id").alias("roi"), F.col("model").alias("member"), raw.alias("raw_group"), raised.alias("p"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, epoch, val_f1, val_loss) of twelve runs, epochs in event order."""
    from quillmill.operators.running import numbered

    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 12).alias("run_id"), "event_id", F.expr("value/(value+40e0)").alias("val_f1"), F.expr("1e0/(1e0+value)").alias("val_loss"))
    return numbered(rows, ["run_id"], [F.col("event_id")], spread=F.col("event_id")).select("run_id", F.col("nth").alias("epoch"), "val_f1", "val_loss")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, origin, class_name, filename, content): documents as a manifest of real and synthetic files."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "CASE WHEN CAST(substr(source,4) AS INT)%2=0 THEN 'real' ELSE 'synth' END AS origin", "CASE WHEN doc_id%3=0 THEN 'cancer' ELSE 'normal' END AS class_name",
        "concat('roi_',(doc_id*7)%41,'_',20240101+doc_id%5,'_',100000+doc_id%60,'.png') AS filename", "text AS content")


def vectors(spark: SparkSession, sf_dir: str, origin: int | None = None) -> DataFrame:
    """(id, cls, v): embeddings in two classes; even ids are real (0), odd ones synthetic (1)."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % 2).cast("int").alias("cls"), F.col("embedding").cast("array<double>").alias("v"))
    return e if origin is None else e.filter(F.col("id") % 2 == origin)


def rounded(df: DataFrame, digits: int = 6, but: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[C.rounded(c, digits).alias(c) if t == "double" and c not in but else F.col(c) for c, t in df.dtypes])
