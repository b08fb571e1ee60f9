"""Imbalance-aware boosted-tree classifier (M4-M6).

MLlib's GBT trains tree by tree with distributed histogram aggregation over
the cached training rows; nothing is collected but the trees themselves.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.constants import GBT_PARAMS, SEED
from faultline.operators.sampling import stratified_split
from faultline.session import tables_dir

#: Part of the training rows that a validated training holds back.
VALIDATION_FRACTION = 0.1


def train_classifier(train: DataFrame, features: list[str], label: str = "is_significant",
                     weight: str | None = "weight", validation: str | None = None, **params) -> PipelineModel:
    """Assemble ``features`` and fit a weighted GBT with log loss (M4).

    Defaults: 100 trees, depth 6, step 0.1, seed 42; ``params`` override them.
    ``validation`` names a boolean column: its rows aren't trained on, and no more trees are
    added once their loss no longer falls by ``validationTol`` (0.01) of itself.
    The boosting state is checkpointed every 10 trees to the shared folder, so a
    lost executor never replays more than 10 trees.
    """
    sc = train.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(tables_dir(train.sparkSession))
    p = dict(GBT_PARAMS)
    p.update(params)
    gbt = GBTClassifier(featuresCol="features", labelCol=label, lossType="logistic",
                        cacheNodeIds=False, checkpointInterval=10, **p)
    if weight:
        gbt = gbt.setWeightCol(weight)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    prepared = train.withColumn(label, F.col(label).cast("double"))
    return Pipeline(stages=[assembler, gbt]).fit(prepared)


def validation_rows(train: DataFrame, fraction: float = VALIDATION_FRACTION, label: str = "is_significant",
                    key: str = "quake_id", seed: int = SEED + 1, flag: str = "is_validation") -> DataFrame:
    """``train`` with the same part of each class flagged for validation, the same rows on every run."""
    return stratified_split(train, label, fraction, key, seed, flag)


def loss_series(model: PipelineModel, df: DataFrame, label: str = "is_significant") -> DataFrame:
    """Mean log loss on ``df`` after each tree: ``trees, loss``; one row per tree."""
    prepared = model.stages[0].transform(df.withColumn(label, F.col(label).cast("double")))
    losses = model.stages[-1].evaluateEachIteration(prepared)
    return df.sparkSession.createDataFrame([(k + 1, float(v)) for k, v in enumerate(losses)], "trees int, loss double")


def score_quality(pred: DataFrame, label: str = "is_significant") -> DataFrame:
    """How well probabilities order and fit the labels, both classes weighing the same:
    ``n, log_loss, base_log_loss`` (of the classes' equal shares) and ``auc`` (by 1,000 bins)."""
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("probability")))
    own = F.col(label)
    stats = pred.agg(
        F.count(F.lit(1)).alias("n"),
        ((F.avg(F.when(own == 1, -F.log(p))) + F.avg(F.when(own == 0, -F.log(1 - p)))) / 2).alias("log_loss"),
        F.when(F.count_if(own == 1) * F.count_if(own == 0) > 0, -F.log(F.lit(0.5))).alias("base_log_loss"))
    auc = BinaryClassificationEvaluator(rawPredictionCol="probability", labelCol=label, numBins=1000).evaluate(
        pred.select(F.col("probability"), F.col(label).cast("double").alias(label)))
    return stats.withColumn("auc", F.lit(float(auc)))


def predict(model: PipelineModel, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Class prediction (0/1) and the positive-class probability (M5)."""
    out = model.transform(df)
    cols = keep if keep is not None else [c for c in df.columns]
    return out.select(*cols, F.col("prediction").cast("int").alias("prediction"),
                      vector_to_array("probability")[1].alias("probability"))


def feature_importance(model: PipelineModel, names: list[str]) -> DataFrame:
    """Importance per feature name, summing to 1 (M6); one row per feature."""
    spark = SparkSession.getActiveSession()
    imp = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, imp)], "feature string, importance double")


def top_features(importance: DataFrame, k: int = 10) -> DataFrame:
    """Features by importance descending (ties by name), numbered 1..k (O3, V9)."""
    top = importance.orderBy(F.col("importance").desc(), F.col("feature")).limit(k)
    w = Window.orderBy(F.col("importance").desc(), F.col("feature"))
    return top.select(F.row_number().over(w).alias("rank"), "feature", "importance")
