"""Fitted scores. The model is one ranking signal among others; it decides nothing."""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

FEATURES = ["load_z", "errors_z", "load_slope7", "rest_gap"]


def _numeric(df: DataFrame) -> DataFrame:
    return df.withColumns({f"x_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in FEATURES})


def fit_logreg(train: DataFrame, reg: float = 0.0) -> PipelineModel:
    """Logistic regression on labelled rows; ``reg`` > 0 gives the L2-penalised form.

    A missing departure enters as 0 = "no departure known"; it is never counted for or against in the rule scores.
    """
    assemble = VectorAssembler(inputCols=[f"x_{c}" for c in FEATURES], outputCol="x")
    regression = LogisticRegression(
        featuresCol="x", labelCol="label", regParam=reg, elasticNetParam=0.0, maxIter=500, tol=1e-12, standardization=False
    )
    return Pipeline(stages=[assemble, regression]).fit(_numeric(train.filter("label is not null")))


def coefficients(model: PipelineModel) -> dict[str, float]:
    """Fitted weights by feature, and the intercept."""
    fitted = model.stages[-1]
    return dict(zip(FEATURES, map(float, fitted.coefficients)), intercept=float(fitted.intercept))


def first_order(train: DataFrame, weights: dict[str, float], reg: float, tolerance: float = 1e-5) -> DataFrame:
    """Per coefficient: labels times feature, summed, and whether the penalised likelihood has no slope left there.

    The slope is the mean of (probability - label) x feature, plus ``reg`` times the weight; the intercept has the
    feature 1 and no penalty.
    """
    rows = with_score(_numeric(train.filter("label is not null")), weights)
    names = [*FEATURES, "intercept"]
    x = {c: F.col(f"x_{c}") if c in FEATURES else F.lit(1.0) for c in names}
    sums = rows.agg(
        *[F.round(F.sum(F.col("label") * x[c]), 4).alias(f"y_{c}") for c in names],
        *[(F.avg((F.col("_p") - F.col("label")) * x[c]) + (reg * weights[c] if c in FEATURES else 0.0)).alias(f"g_{c}") for c in names],
    )
    parts = F.array(*[F.struct(F.lit(c).alias("coefficient"), F.col(f"y_{c}").alias("label_sum"), (F.abs(f"g_{c}") <= tolerance).alias("settled")) for c in names])
    return sums.select(F.inline(parts))


def with_score(numeric: DataFrame, weights: dict[str, float]) -> DataFrame:
    linear = F.lit(weights["intercept"])
    for c in FEATURES:
        linear = linear + weights[c] * F.col(f"x_{c}")
    return numeric.withColumn("_p", 1 / (1 + F.exp(-linear)))


def stored_score(features: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``model_score`` from a stored table of weights, as ``model_score`` gives it from a model."""
    scored = with_score(_numeric(features), weights)
    return scored.withColumn("model_score", F.round("_p", 6)).select(*features.columns, "model_score")


def model_score(features: DataFrame, model: PipelineModel) -> DataFrame:
    """Add ``model_score``, the fitted probability."""
    scored = model.transform(_numeric(features))
    probability = vector_to_array("probability")[1]
    return scored.withColumn("model_score", F.round(probability, 6)).select(*features.columns, "model_score")
