"""Boosted-tree regression of visits: one distributed ``GBTRegressor`` over all counters.

A single model sees every counter, with the counter id as an indexed feature when asked, so training
is one Spark ML job whose work is split by rows, not a driver loop over counters; a small booster per
counter is ``keyed_trees``. Tree size maps leaves to depth (9 leaves ~ depth 4,
31 leaves ~ depth 5).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from footfall import schemas
from footfall.functions import literal_table

# --- fixed values: columns that are identifiers or route attributes, never features -------------
ID_COLUMNS = ["parkCode", "counterIdPave", "date_day", "year", "counterId"]
ROUTE_COLUMNS = ["track_name", "difficulty", "length_km", "duration_min"] + schemas.ROUTE_FLAGS
# --------------------------------------------------------------------------------------------------
SPREAD = 4  # training tasks for each split of the training table, with patience


def feature_table(df: DataFrame, label: str = "visits", keep: Sequence[str] = (),
                  drop: Sequence[str] = tuple(ID_COLUMNS + ROUTE_COLUMNS)) -> DataFrame:
    """Drop identifiers and route attributes, holiday -> 0/1, missing (NULL or NaN) -> 0.

    ``keep`` names columns to carry along untouched (e.g. keys for joining predictions back).
    """
    keep = list(keep)
    out = df.drop(*[c for c in drop if c not in keep])
    for f in out.schema.fields:
        if isinstance(f.dataType, BooleanType) and f.name not in keep:
            out = out.withColumn(f.name, F.col(f.name).cast("int"))
    numeric = [f.name for f in out.schema.fields if isinstance(f.dataType, NumericType) and f.name not in keep]
    return out.fillna(0, subset=numeric)


def feature_names(df: DataFrame, label: str = "visits", exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name != label and f.name not in exclude]


def fit_visits_gbt(train: DataFrame, features: Sequence[str], label: str = "visits",
                   valid: DataFrame | None = None, max_iter: int = 7, step_size: float = 0.05,
                   max_depth: int = 4, key_feature: str | None = None, validation_tol: float = 0.01,
                   seed: int = 7, spread: int = 1) -> PipelineModel:
    """Fit a GBT on ``features``; with ``valid``, boosting stops early on the validation error. Give
    it a saved table: training reads its rows more than once. With ``spread`` above 1 each split of the
    table is dealt to so many tasks: its rows grow several times over in training."""
    cols = list(features)
    if key_feature:
        # the id enters as an ordinal feature: trees split it into id ranges, and the cost does
        # not grow with the number of counters the way a categorical split would
        cols.append(key_feature)
    assembler = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep")
    kw = dict(featuresCol="features", labelCol=label, maxIter=max_iter, stepSize=step_size,
              maxDepth=max_depth, seed=seed)
    data = train
    if valid is not None:
        data = (train.withColumn("_is_valid", F.lit(False))
                .unionByName(valid.withColumn("_is_valid", F.lit(True))))
        kw.update(validationIndicatorCol="_is_valid", validationTol=validation_tol)
    stages = [assembler, GBTRegressor(**kw)]
    # boosting passes over the data many times: keep the training columns on the executors' disks
    # while it runs; a lost block is read again from the caller's saved table
    keep = dict.fromkeys([*cols, label, *(["_is_valid"] if valid is not None else [])])
    data = data.withColumn(label, F.col(label).cast("double")).select(*keep)
    if spread > 1:
        data = data.repartition(spread * max(1, data.rdd.getNumPartitions()))
    data = data.persist(StorageLevel.DISK_ONLY)
    try:
        return Pipeline(stages=stages).fit(data)
    finally:
        data.unpersist()


def staged_errors(model: PipelineModel, valid: DataFrame, label: str = "visits") -> list[float]:
    """Mean squared error on ``valid`` after each boosting round: one pass over its rows."""
    *before, gbt = model.stages
    data = valid.withColumn(label, F.col(label).cast("double")).where(F.col(label).isNotNull())
    return list(gbt.evaluateEachIteration(PipelineModel(before).transform(data), "squared"))


def patient_rounds(errors: Sequence[float], patience: int = 5, min_gain: float = 1e-9) -> int:
    """Rounds to keep: the best so far when ``patience`` rounds have passed without a gain on it (a gain
    is a relative fall of more than ``min_gain``), or the best of all rounds."""
    best, kept = float("inf"), 0
    for k, error in enumerate(errors, 1):
        if error < best * (1 - min_gain) or not kept:
            best, kept = error, k
        elif k - kept >= patience:
            break
    return kept


def first_rounds(model: PipelineModel, rounds: int) -> PipelineModel:
    """The same pipeline with the first ``rounds`` trees of its ensemble only."""
    *before, gbt = model.stages
    spark = SparkSession.active()
    jvm, java = spark.sparkContext._jvm, gbt._java_obj
    trees, weights = list(java.trees())[:rounds], list(gbt.treeWeights)[:rounds]
    tree_array = spark.sparkContext._gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    weight_array = spark.sparkContext._gateway.new_array(jvm.double, len(weights))
    for k, (tree, weight) in enumerate(zip(trees, weights)):
        tree_array[k], weight_array[k] = tree, weight
    cut = jvm.org.apache.spark.ml.regression.GBTRegressionModel(java.uid(), tree_array, weight_array)
    cut.setFeaturesCol(gbt.getFeaturesCol())
    cut.setPredictionCol(gbt.getPredictionCol())
    return PipelineModel([*before, GBTRegressionModel(cut)])


def fit_patient_gbt(train: DataFrame, valid: DataFrame, features: Sequence[str], label: str = "visits", patience: int = 5,
                    max_iter: int = 20, **options) -> tuple[PipelineModel, list[float]]:
    """Boosting that stops after ``patience`` rounds without gain on ``valid``: (model, staged errors).

    All ``max_iter`` rounds are trained, their errors on ``valid`` come from one more pass, and the
    ensemble is cut to its best prefix, which is the model that stopping early would have kept."""
    model = fit_visits_gbt(train, features, label, max_iter=max_iter, **{"spread": SPREAD, **options})
    errors = staged_errors(model, valid, label)
    return first_rounds(model, patient_rounds(errors, patience)), errors


def predict_visits(model: PipelineModel, df: DataFrame, out_col: str = "visits_pred") -> DataFrame:
    return model.transform(df).withColumnRenamed("prediction", out_col).drop("features")


def regression_error(df: DataFrame, label: str = "visits", pred: str = "visits_pred") -> DataFrame:
    """One row: n and RMSE of predictions, over rows where both are present."""
    from footfall.operators.forecast import forecast_error
    return forecast_error(df, label, pred, by=None).select("n", "rmse")


def feature_importance(spark: SparkSession, model: PipelineModel, names: Sequence[str]) -> DataFrame:
    """(feature, importance), least important first."""
    gbt = model.stages[-1]
    assembler = model.stages[-2]
    cols = assembler.getInputCols()
    imp = gbt.featureImportances.toArray().tolist()
    rows = [(c, float(imp[i]) if i < len(imp) else 0.0) for i, c in enumerate(cols)]
    return literal_table(spark, rows, "feature STRING, importance DOUBLE").orderBy("importance", "feature")
