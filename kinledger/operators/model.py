"""Match models: scorers as expressions, training with MLlib and by :mod:`kinledger.operators.trees`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinledger.operators.trees import TreeModel, grow


def sigmoid(x: Column) -> Column:
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def logistic_score(coefficients: dict[str, float], intercept: float) -> Column:
    z = F.lit(intercept)
    for name, w in coefficients.items():
        z = z + F.col(name) * F.lit(w)
    return sigmoid(z)


def tree_score(tree: dict) -> Column:
    """A tree {feature, threshold, left, right} or {value} as nested CASE; a value equal to the threshold goes left."""
    if "value" in tree:
        return F.lit(float(tree["value"]))
    return F.when(F.col(tree["feature"]) <= F.lit(tree["threshold"]), tree_score(tree["left"])).otherwise(tree_score(tree["right"]))


def forest_score(trees: list[dict]) -> Column:
    total = F.lit(0.0)
    for t in trees:
        total = total + tree_score(t)
    return total / len(trees)


def boosted_score(trees: list[dict], base: float, rate: float) -> Column:
    z = F.lit(base)
    for t in trees:
        z = z + F.lit(rate) * tree_score(t)
    return sigmoid(z)


def fit_models(train: DataFrame, features: list[str], label: str, seed: int = 20260629, trees: int = 120, rounds: int = 200):
    """{name: fitted model, for :func:`score_with`} of logistic regression, random forest and boosted trees."""
    grown = grow(train, features, label, seed, {"trees": trees, "depth": 12, "least": 20}, {"rounds": rounds, "depth": 3, "rate": 0.1})
    return {"logistic": fit_logistic(train, features, label), **grown}


def fit_logistic(train: DataFrame, features: list[str], label: str):
    """Standardised logistic regression (C = 1) as a fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    scale = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True)
    fit = LogisticRegression(featuresCol="scaled", labelCol=label, maxIter=200, regParam=1.0 / max(train.count(), 1))
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw"), scale, fit]).fit(train)


def export_logistic(fitted, features: list[str]) -> tuple[dict[str, float], float]:
    """({feature: weight}, bias) of a :func:`fit_logistic` pipeline, on the features as they are."""
    _, scaler, fit = fitted.stages
    # a feature that never varies is scaled to nothing
    weights = {f: float(w / s) if s else 0.0 for f, w, s in zip(features, fit.coefficients, scaler.std, strict=True)}
    return weights, float(fit.intercept - sum(weights[f] * m for f, m in zip(features, scaler.mean, strict=True)))


def score_with(model, df: DataFrame) -> DataFrame:
    """``df`` plus ``p``, the probability of class 1."""
    if isinstance(model, TreeModel):
        return df.withColumn("p", model.probability())
    from pyspark.ml.functions import vector_to_array

    return model.transform(df).withColumn("p", vector_to_array("probability")[1]).drop("raw", "scaled", "rawPrediction", "probability", "prediction")


def max_difference(a: DataFrame, b: DataFrame, key: str, score: str) -> DataFrame:
    """Largest absolute difference of two scorings of the same rows."""
    return a.select(key, F.col(score).alias("x")).join(b.select(key, F.col(score).alias("y")), key).agg(F.max(F.abs(F.col("x") - F.col("y"))).alias("max_difference"))
