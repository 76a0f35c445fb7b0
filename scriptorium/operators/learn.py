"""Weighted logistic verifier, calibrator, attribution and configuration choice."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.metrics import finite


@dataclass(frozen=True)
class Verifier:
    """Standardised linear margin over named features."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float

    def margin(self) -> Column:
        """Margin of a row, as an expression."""
        return sum((F.lit(w) * self.z(i) for i, w in enumerate(self.weights)), F.lit(self.bias))

    def z(self, i: int) -> Column:
        return (F.col(self.features[i]) - F.lit(self.means[i])) / F.lit(self.scales[i])

    def contributions(self, top: int = 10) -> Column:
        """The `top` largest parts of a row's margin: array of (feature, part), by size."""
        parts = F.array(*(F.struct((F.lit(w) * self.z(i)).alias("part"), F.lit(f).alias("feature")) for i, (f, w) in enumerate(zip(self.features, self.weights))))
        by_size = F.reverse(F.array_sort(F.transform(parts, lambda p: F.struct(F.abs(p["part"]).alias("size"), p["feature"].alias("feature"), p["part"].alias("part")))))
        return F.transform(F.slice(by_size, 1, top), lambda p: F.struct(p["feature"], p["part"]))


def _logistic(df: DataFrame, features: list[str], weight: str, reg: float) -> tuple[list[float], float]:
    rows = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(df)
    model = LogisticRegression(featuresCol="_x", labelCol="label", weightCol=weight, regParam=reg, elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9).fit(rows)
    return [float(w) for w in model.coefficients], float(model.intercept)


def fit_verifier(df: DataFrame, features: list[str], root_weight: str = "weight", balanced_weight: str = "balanced_weight", c: float = 0.1) -> Verifier:
    """Standardise with the root weights, then an L2 logistic fit with the balanced weights and strength 1 / (c x total weight). A constant feature has scale 1. Rows with a null or NaN feature are left out."""
    ok = df.where(F.forall(F.array(*(F.coalesce(F.col(f), F.lit(float("nan"))) for f in features)), lambda x: ~F.isnan(x)) & F.col("label").isNotNull())
    w = F.col(root_weight)
    first = ok.agg(F.sum(w).alias("_w"), F.sum(balanced_weight).alias("_b"), *(F.sum(w * F.col(f)).alias(f"m{i}") for i, f in enumerate(features))).first()
    means = [first[f"m{i}"] / first._w for i in range(len(features))]
    second = ok.agg(*(F.sum(w * F.pow(F.col(f) - F.lit(m), F.lit(2))).alias(f"v{i}") for i, (f, m) in enumerate(zip(features, means)))).first()
    scales = [s if (s := (second[f"v{i}"] / first._w) ** 0.5) > 1e-12 else 1.0 for i in range(len(features))]
    z = ok.select("label", balanced_weight, *(((F.col(f) - F.lit(m)) / F.lit(s)).alias(f"z{i}") for i, (f, m, s) in enumerate(zip(features, means, scales))))
    weights, bias = _logistic(z, [f"z{i}" for i in range(len(features))], balanced_weight, 1.0 / (c * first._b))
    return Verifier(tuple(features), tuple(means), tuple(scales), tuple(weights), bias)


def fit_boosted(df: DataFrame, features: list[str], weight: str = "balanced_weight"):  # noqa: ANN201
    """Gradient-boosted challenger: 50 shallow trees. An approximation: Spark's trees grow by level and have no leaf cap."""
    rows = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(df)
    return GBTClassifier(featuresCol="_x", labelCol="label", weightCol=weight, maxIter=50, maxDepth=3, stepSize=0.05, minInstancesPerNode=2, seed=42).fit(rows)


def boosted_margin(model, df: DataFrame, features: list[str]) -> DataFrame:  # noqa: ANN001
    rows = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(df)
    return model.transform(rows).withColumn("margin", vector_to_array("rawPrediction")[1]).drop("_x", "rawPrediction", "probability", "prediction")


def fit_calibrator(df: DataFrame, margin: str = "margin") -> tuple[float, float]:
    """(a, b) of sigmoid(a margin + b): a logistic fit of strength 1 in which each class weighs 1 in all. Non-finite margins are left out; one class alone is an error."""
    ok = df.where(finite(margin) & F.col("label").isin(0, 1)).select("label", F.col(margin).alias("m"))
    sizes = {r.label: r.n for r in ok.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        raise ValueError("calibration needs both classes")
    w = ok.withColumn("w", F.when(F.col("label") == 1, 1.0 / sizes[1]).otherwise(1.0 / sizes[0]))
    (a,), b = _logistic(w, ["m"], "w", 0.5)
    return a, b


def calibrated(margin: Column, a: float, b: float) -> Column:
    return 1 / (1 + F.exp(-(F.lit(a) * margin + F.lit(b))))


def choose_verifier(plain: dict[str, float], boosted: dict[str, float]) -> str:
    """Boosting only for an AUROC gain of 0.02 or more without loss at 5 % false positives."""
    return "boosted" if round(boosted["auroc"] - plain["auroc"], 9) >= 0.02 and boosted["tpr_at_5"] >= plain["tpr_at_5"] else "logistic"


def better_configuration(new: dict[str, float], old: dict[str, float]) -> bool:
    """A configuration replaces the one ahead of it if it is strictly better at 5 % false positives and no worse elsewhere by more than the tolerances."""
    return new["tpr_at_5"] > old["tpr_at_5"] and round(old["auroc"] - new["auroc"], 9) <= 0.01 and round(old["tpr"] - new["tpr"], 9) <= 0.03 and new["brier"] <= old["brier"]


def accept_half_precision(figures: dict[str, float]) -> bool:
    """Whether an encoder may run at half precision: all decisions alike, score drift within 0.5 points on average and 1.5 at most, AUROC and Brier no worse by more than 0.005, and a fifth faster."""
    return (
        figures["decision_agreement"] >= 1.0 and figures["mean_drift"] <= 0.5 and figures["max_drift"] <= 1.5 and figures["auroc_decline"] <= 0.005 and figures["brier_increase"] <= 0.005 and figures["speedup"] >= 0.2
    )
