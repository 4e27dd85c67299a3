"""Delay model: preparation, training, metrics, gates, scoring, shadow comparison."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.pipeline import Pipeline
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from headway.config import DEFAULT, Config
from headway.operators.tables import exists

#: Our own choice of what the delay model sees.
FEATURES = ("latitude", "longitude", "hour_of_day", "day_of_week", "historical_avg_delay", "avg_dwell_time_ms", "historical_arrival_count", "delay_trend", "speed_ms")


#: What a training job reads of the stop mart.
TRAINING = ("stop_id", "line_id", "hour_of_day", "day_of_week", "historical_arrival_count", "historical_avg_delay", "avg_dwell_time_ms")


class BadTrainingData(Exception):
    """Target or features are missing, or there is too little to learn from."""


def prepare(rows: DataFrame, target: str, features=FEATURES, keep_target: bool = False) -> tuple[DataFrame, list[str]]:
    """Target and available features as doubles (a text that is no number raises when it runs), nulls as 0."""
    if target not in rows.columns:
        raise BadTrainingData(f"no target {target}")
    have = [f for f in features if f in rows.columns and (keep_target or f != target)]
    if not have:
        raise BadTrainingData("no feature")
    keep = [F.col(f).cast("double").alias(f) for f in have if f != target]
    return rows.where(F.col(target).isNotNull()).select(*keep, F.col(target).cast("double").alias("label"), *([F.col(target).cast("double").alias(target)] if target in have else [])).fillna(0.0), have


def training_set(mart: DataFrame) -> DataFrame:
    """The mart's training columns; without any row there is nothing to learn from."""
    if mart.isEmpty():
        raise BadTrainingData("the mart has no rows")
    return mart.select(*TRAINING)


def split(rows: DataFrame, *keys: str, test_share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """By hash of the key, so that a row's side never changes."""
    side = F.pmod(F.xxhash64(*(keys or rows.columns)), F.lit(10_000)) < int(test_share * 10_000)
    return rows.where(~side), rows.where(side)


def mature(rows: DataFrame, least: int = 50) -> bool:
    return rows.limit(least).count() >= least


def train(rows: DataFrame, features: list[str], trees: int = 100, depth: int = 6, rate: float = 0.1) -> PipelineModel:
    """Each level of each tree is one pass over all rows, so they are dealt evenly over the cores first, once."""
    gbt = GBTRegressor(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=rate, seed=42)
    even = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism).persist()
    try:
        return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), gbt]).fit(even)
    finally:
        even.unpersist()


def importances(spark: SparkSession, model: PipelineModel, features: list[str]) -> DataFrame:
    """(feature, importance) of a trained model."""
    return spark.createDataFrame(list(zip(features, model.stages[-1].featureImportances.toArray().tolist(), strict=True)), "feature string, importance double")


def mean_predictor(rows: DataFrame) -> float:
    return rows.agg(F.avg("label")).first()[0] or 0.0


def train_or_mean(rows: DataFrame, features: list[str], **options) -> PipelineModel | float:
    """A model, or the labels' mean where there are too few rows to learn from."""
    return train(rows, features, **options) if mature(rows) else mean_predictor(rows)


def metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    y, p = F.col(label), F.col(prediction)
    sse, sst = F.sum((y - p) * (y - p)), F.sum(y * y) - F.sum(y) * F.sum(y) / F.count(y)
    return scored.agg(F.avg(F.abs(y - p)).alias("mae"), F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"), (1 - F.try_divide(sse, sst)).alias("r2"))


def gate(found: DataFrame, r2: float = 0.75, mae: float = 120.0) -> DataFrame:
    return found.withColumn("passed", (F.col("r2") >= r2) & (F.col("mae") <= mae))


def score(model: PipelineModel | float | None, rows: DataFrame, features: list[str]) -> DataFrame:
    """Predictions to one decimal; missing features are 0; a number stands for a mean; without a model the current delay stands in."""
    if isinstance(model, float):
        return rows.withColumn("prediction", F.round(F.lit(model), 1))
    if model is None:
        return rows.withColumn("prediction", F.round(F.coalesce(F.col("current_delay").cast("double"), F.lit(0.0)), 1))
    full = rows.withColumns({f: F.coalesce(F.col(f).cast("double") if f in rows.columns else F.lit(None), F.lit(0.0)) for f in features})
    return model.transform(full).withColumn("prediction", F.round("prediction", 1)).drop("features")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(spark: SparkSession, path: str) -> PipelineModel | None:
    """A saved pipeline; None if there is none, as before the first training."""
    return PipelineModel.load(path) if exists(spark, f"{path}/metadata") else None


def _predicting(model: PipelineModel | None, rows: DataFrame, name: str) -> DataFrame:
    """rows with a model's prediction, to one decimal; columns that the pipeline makes inside go again.

    Missing features are 0; a row that the model can't predict (a feature that is no finite number, or no model at all) has 0.0.
    """
    if model is None:
        return rows.withColumn(name, F.lit(0.0))
    features, made = model.stages[0].getInputCols(), model.stages[-1].getPredictionCol()
    value = {f: F.coalesce(F.col(f"_row.{f}").cast("double") if f in rows.columns else F.lit(None).cast("double"), F.lit(0.0)) for f in features}
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    fine = F.forall(F.array(*value.values()), finite)
    held = rows.select(F.struct("*").alias("_row")).select("_row", fine.alias("_fine"), *[F.when(finite(x), x).otherwise(F.lit(0.0)).alias(f) for f, x in value.items()])
    found = F.when(F.col("_fine") & finite(F.col(made)), F.round(made, 1)).otherwise(F.lit(0.0))
    return model.transform(held).select("_row.*", F.coalesce(found, F.lit(0.0)).alias(name))


def score_two(rows: DataFrame, production: PipelineModel | None, candidate: PipelineModel | None, c: Config = DEFAULT) -> DataFrame:
    """Both models' predictions (``prod``, ``shadow``) of every row in one pass, and how far they agree."""
    return shadow(_predicting(candidate, _predicting(production, rows, "prod"), "shadow"), c=c)


def compared(scored: DataFrame, predictions: dict[str, Column], label: str = "label") -> DataFrame:
    """(model, mae, rmse, r2, passed) of several predictions of the same rows against the gate, in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), p.cast("double").alias("prediction")) for n, p in predictions.items()]))
    rows = scored.select(F.col(label).alias("_y"), each.alias("m")).select("_y", "m.*")
    y, p = F.col("_y"), F.col("prediction")
    sse, sst = F.sum((y - p) * (y - p)), F.sum(y * y) - F.sum(y) * F.sum(y) / F.count(y)
    return gate(rows.groupBy("model").agg(F.avg(F.abs(y - p)).alias("mae"), F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"), (1 - F.try_divide(sse, sst)).alias("r2")))


def shadow(rows: DataFrame, prod: str = "prod", other: str = "shadow", c: Config = DEFAULT) -> DataFrame:
    """Differences of two models' predictions; a failed one counts as 0."""
    diff = F.abs(F.coalesce(prod, F.lit(0.0)) - F.coalesce(other, F.lit(0.0)))
    return rows.withColumns({"diff": diff, "agreed": diff <= c.shadow_agree, "divergent": diff > c.shadow_diverge})


def running_agreement(compared: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Comparisons and the share that agreed so far, by key."""
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return compared.withColumns({"compared": F.count("*").over(so_far), "agreement_rate": F.avg(F.col("agreed").cast("double")).over(so_far)})


def agreement(compared: DataFrame) -> DataFrame:
    return compared.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.col("agreed").cast("double")), F.lit(0.0)).alias("agreement_rate"), F.count_if("divergent").alias("divergent"), F.avg("diff").alias("mean_diff"))
