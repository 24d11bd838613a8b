"""Weighted logistic regression and forests on cell tables, by Spark ML."""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderframe.operators import trials
from cinderframe.operators.probability import best_cutoff, cutoff_counts, roc_auc
from cinderframe.session import written

TARGET = "ignited"
WEIGHT = "sample_weight"

# Bounds of the search space and of the gap classes.
C_RANGE = (1e-4, 100.0)
POSITIVE_WEIGHT_RANGE = (1.0, 20.0)
MINIMAL_GAP, OPTIMISTIC_GAP = 0.03, 0.05


@dataclass(frozen=True)
class Recipe:
    """Penalty, strength and class weights of a logistic regression."""

    penalty: str = "l2"
    C: float = 1.0
    l1_ratio: float = 0.0
    class_weight: str = "balanced"  # balanced, custom or none
    positive_weight: float = 1.0

    @property
    def elastic_net(self) -> float:
        return {"l2": 0.0, "l1": 1.0}.get(self.penalty, self.l1_ratio)


@dataclass(frozen=True)
class TrainingStats:
    """Means, population SDs and class sizes of a training set, from one pass."""

    means: dict[str, float]
    scales: dict[str, float]
    negatives: int
    positives: int

    def weights(self, recipe: Recipe) -> tuple[float, float]:
        if recipe.class_weight == "balanced":
            n = self.negatives + self.positives
            return n / (2 * max(self.negatives, 1)), n / (2 * max(self.positives, 1))
        return 1.0, recipe.positive_weight if recipe.class_weight == "custom" else 1.0

    def total_weight(self, recipe: Recipe) -> float:
        w0, w1 = self.weights(recipe)
        return w0 * self.negatives + w1 * self.positives


def standardisation(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``feature, mean, scale``: population SD, 1 for a constant column."""
    stats = df.agg(
        *[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]
    )
    rows = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), F.col(f"m_{f}").alias("mean"), F.col(f"s_{f}").alias("sd"))
            for f in features
        ]
    )
    long = stats.select(F.explode(rows).alias("s")).select("s.*")
    return long.select("feature", "mean", F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0).alias("scale"))


def standardise(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Replace features by their standardised values; a constant column becomes 0."""
    stats = df.agg(
        F.struct(
            *[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]
        )
    ).scalar()
    out = df.withColumn("__stats", stats)
    for f in features:
        sd = F.col(f"__stats.s_{f}")
        centred = F.col(f) - F.col(f"__stats.m_{f}")
        out = out.withColumn(f, F.when(sd > 0, centred / F.when(sd > 0, sd)).otherwise(0.0))
    return out.drop("__stats")


def training_stats(df: DataFrame, features: Sequence[str], label: str = TARGET) -> TrainingStats:
    """The few numbers a fit needs on the driver: two per feature and two counts."""
    row = df.agg(
        *[F.avg(f).alias(f"m_{f}") for f in features],
        *[F.stddev_pop(f).alias(f"s_{f}") for f in features],
        F.count_if(F.col(label) == 0).alias("n0"),
        F.count_if(F.col(label) == 1).alias("n1"),
    ).first()
    return TrainingStats(
        means={f: row[f"m_{f}"] for f in features},
        scales={f: row[f"s_{f}"] or 1.0 for f in features},
        negatives=row["n0"],
        positives=row["n1"],
    )


def _weighted(df: DataFrame, weights: tuple[float, float], label: str) -> DataFrame:
    return df.withColumn(WEIGHT, F.when(F.col(label) == 1, F.lit(weights[1])).otherwise(F.lit(weights[0])))


def fit_logistic(
    df: DataFrame, features: Sequence[str], recipe: Recipe = Recipe(), *, label: str = TARGET, stats: TrainingStats | None = None
) -> PipelineModel:
    """Standardise, then fit a weighted logistic regression.

    The loss is averaged over the total weight, so a strength ``C`` becomes
    ``regParam = 1 / (C * total weight)``. Scaling is a stage of its own:
    the fit's own standardisation would use weighted sample SDs. Equal rows are counted once and weigh
    as many, so an iteration reads the distinct rows only.
    """
    stats = stats or training_stats(df, features, label)
    scaled = ", ".join(f"({f} - {stats.means[f]!r}D) / {stats.scales[f]!r}D AS z_{f}" for f in features)
    scaler = SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__")
    vectors = VectorAssembler(inputCols=[f"z_{f}" for f in features], outputCol="features")
    regression = LogisticRegression(
        labelCol=label,
        weightCol=WEIGHT,
        regParam=1.0 / (recipe.C * stats.total_weight(recipe)),
        elasticNetParam=recipe.elastic_net,
        standardization=False,
        maxIter=300,
        tol=1e-7,
    )
    counted = _weighted(trials.count_equal(df, [*features, label]), stats.weights(recipe), label)
    rows = vectors.transform(scaler.transform(counted.withColumn(WEIGHT, F.col(WEIGHT) * F.col("n_rows"))))
    model = regression.fit(rows.select(label, WEIGHT, "features"))
    return PipelineModel([scaler, vectors, model])


def fit_forest(
    df: DataFrame, features: Sequence[str], *, trees: int = 200, depth: int = 15, balanced: bool = True, label: str = TARGET, seed: int = 42
) -> PipelineModel:
    """Random forest with class weights from the whole training set."""
    stats = training_stats(df, features, label)
    recipe = Recipe(class_weight="balanced" if balanced else "none")
    vectors = VectorAssembler(inputCols=list(features), outputCol="features")
    forest = RandomForestClassifier(
        labelCol=label,
        weightCol=WEIGHT,
        numTrees=trees,
        maxDepth=depth,
        featureSubsetStrategy="sqrt",
        seed=seed,
        maxMemoryInMB=2048,
    )
    rows = vectors.transform(_weighted(df, stats.weights(recipe), label)).select(label, WEIGHT, "features")
    return PipelineModel([vectors, forest.fit(rows)])


@dataclass(frozen=True)
class LinearModel:
    """A fitted logistic regression, with what proves it optimal.

    ``coefficients`` belong to raw features, ``scaled`` to standardised ones. ``pulls`` are the penalty's part of the
    gradient of the mean weighted loss; together with the loss's own part they vanish, up to ``residual``.
    """

    features: tuple[str, ...]
    intercept: float
    coefficients: tuple[float, ...]
    scaled: tuple[float, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, float]
    pulls: tuple[float, ...]
    residual: float

    def probability(self) -> Column:
        z = F.lit(self.intercept)
        for feature, value in zip(self.features, self.coefficients):
            z = z + F.col(feature).cast("double") * F.lit(value)
        return 1 / (1 + F.exp(-z))

    def predict(self, df: DataFrame, keep: Sequence[str], p: str = "p") -> DataFrame:
        return df.select(*keep, self.probability().alias(p))

    def table(self, spark) -> DataFrame:
        """Signed standardised coefficients, one row per feature."""
        rows = [(f, "coefficient", c, abs(c)) for f, c in zip(self.features, self.scaled)]
        return spark.createDataFrame(rows, "feature string, kind string, coef double, abs_coef double")


def fit_linear(df: DataFrame, features: Sequence[str], recipes: Mapping[str, Recipe], label: str = TARGET, *, count: str | None = None) -> dict[str, LinearModel]:
    """Fit all recipes in the same passes; results do not depend on the partitioning of ``df``, whose rows stand for ``count`` equal ones each."""
    found = trials.fit(df, features, list(recipes.values()), label=label, count=count)
    residual, out = found.residual(), {}
    for i, name in enumerate(recipes):
        slope, beta = found.slope[i, 1:], found.beta[i, 1:]
        sign = np.where(beta != 0, np.sign(beta), np.clip(-slope / max(found.l1[i], 1e-300), -1, 1) if found.l1[i] > 0 else 0.0)
        out[name] = LinearModel(
            tuple(features), float(found.raw.beta[i, 0]), tuple(found.raw.beta[i, 1:].tolist()), tuple(beta.tolist()),
            tuple(found.mean[i].tolist()), tuple(found.sd[i].tolist()), tuple(found.raw.weight[i].tolist()),
            tuple((found.l2[i] * beta + found.l1[i] * sign).tolist()), float(residual[i].max()),
        )
    return out


def fitted_moments(df: DataFrame, models: Mapping[str, LinearModel], label: str = TARGET) -> DataFrame:
    """``model, feature, moment``: weighted means of standardised features under the fitted probabilities, plus the penalty's pull.

    At the optimum, and only there, they equal the same means under the labels themselves. ``intercept`` is the mean of 1.
    One pass scores the rows of all models.
    """
    sums = []
    for name, model in models.items():
        w = F.when(F.col(label) == 1, F.lit(model.weights[1])).otherwise(F.lit(model.weights[0]))
        p = w * model.probability()
        parts = [("intercept", F.sum(p) / F.sum(w))]
        for feature, mean, scale, pull in zip(model.features, model.means, model.scales, model.pulls):
            z = (F.col(feature).cast("double") - F.lit(mean)) / F.lit(scale)
            parts.append((feature, F.sum(p * z) / F.sum(w) + F.lit(pull)))
        sums += [F.struct(F.lit(name).alias("model"), F.lit(f).alias("feature"), m.alias("moment")) for f, m in parts]
    return df.agg(F.array(*sums).alias("m")).select(F.explode("m").alias("m")).select("m.*")


def predict(model: PipelineModel, df: DataFrame, keep: Sequence[str], p: str = "p") -> DataFrame:
    """Ignition probability per row, computed in the JVM."""
    return model.transform(df).select(*keep, vector_to_array("probability")[1].alias(p))


def coefficient_table(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """Signed coefficients or importances, one row per feature."""
    fitted = model.stages[-1]
    if hasattr(fitted, "coefficients"):
        kind, values = "coefficient", fitted.coefficients.toArray()
    elif hasattr(fitted, "featureImportances"):
        kind, values = "importance", fitted.featureImportances.toArray()
    else:
        raise TypeError("the model exposes neither coefficients nor importances")
    rows = [(f, kind, float(v), abs(float(v))) for f, v in zip(features, values)]
    return spark.createDataFrame(rows, "feature string, kind string, coef double, abs_coef double")


def rank_features(coefficients: DataFrame) -> DataFrame:
    """Features numbered by falling absolute coefficient (one row per feature).

    Sizes that agree to 9 places tie and are ordered by name, so that the last
    bit of a sum does not decide.
    """
    order = Window.orderBy(F.round("abs_coef", 9).desc(), "feature")
    return coefficients.withColumn("rank", F.row_number().over(order))


def evaluate(
    scored: DataFrame, label: str = TARGET, p: str = "p", cutoff: float | None = None, also: float | None = None, *, count: str | None = None
) -> dict[str, float]:
    """Cutoff (best of 16 unless given), precision, recall, F1, Jaccard and AUC.

    ``also`` adds F1, recall and precision at a second cutoff. A row stands for ``count`` equal ones. Everything
    collected is a few counts. The scores are written while the aggregations
    read them, so the model runs once, also where executors are lost.
    """
    held = written(scored.select(label, p, *([count] if count else [])), "scores")
    if cutoff is None:
        cutoff = best_cutoff(cutoff_counts(held, label, p, count=count)).first()["best_cutoff"]
    wanted = [cutoff] if also is None else [cutoff, also]
    counts = {row["cutoff_no"]: row for row in cutoff_counts(held, label, p, cutoffs=wanted, count=count).collect()}
    auc = roc_auc(held, label, p, count=count).first()["roc_auc"]

    def part(a: float, b: float) -> float:
        return a / b if b else 0.0

    def rates(row) -> dict[str, float]:
        tp, fp, fn = row["tp"], row["fp"], row["fn"]
        return {"precision": part(tp, tp + fp), "recall": part(tp, tp + fn), "f1": part(2 * tp, 2 * tp + fp + fn)}

    main = counts[0]
    out = {"cutoff": float(cutoff), **rates(main)}
    out["jaccard"] = part(main["tp"], main["tp"] + main["fp"] + main["fn"])
    out["auc_roc"] = float("nan") if auc is None else auc
    if also is not None:
        out |= {f"{k}_also": v for k, v in rates(counts[1]).items()}
    return out


def random_trials(n: int, seed: int = 42) -> list[Recipe]:
    """Seeded draws from the search space."""
    rng = random.Random(seed)
    drawn = []
    for _ in range(n):
        penalty = rng.choice(["l1", "l2", "elasticnet"])
        low, high = (math.log(v) for v in C_RANGE)
        strength = math.exp(rng.uniform(low, high))
        l1_ratio = rng.random() if penalty == "elasticnet" else 0.0
        strategy = rng.choice(["balanced", "custom"])
        weight = rng.uniform(*POSITIVE_WEIGHT_RANGE) if strategy == "custom" else 1.0
        drawn.append(Recipe(penalty, strength, l1_ratio, strategy, weight))
    return drawn


def search(folded: DataFrame, features: Sequence[str], recipes: Sequence[Recipe], *, folds: int = 5, label: str = TARGET, count: str | None = None) -> list[dict]:
    """Mean best-F1 over folds for each trial; ``folded`` has a ``fold`` column, and its rows stand for ``count`` equal ones each."""
    values = trials.search(folded, features, recipes, folds=folds, label=label, count=count)
    return [{"trial": i, "cv_f1": v, **asdict(t)} for i, (t, v) in enumerate(zip(recipes, values))]


def best_trial(results: Sequence[dict]) -> dict:
    """First trial with the highest score, and whether it lies in the first half."""
    best = max(results, key=lambda r: (r["cv_f1"], -r["trial"]))
    return {**best, "converged_early": best["trial"] < len(results) * 0.5}


def gap_class(cv_f1: float, test_f1: float) -> str:
    gap = cv_f1 - test_f1
    if abs(gap) < MINIMAL_GAP:
        return "minimal"
    return "optimistic" if gap > OPTIMISTIC_GAP else "small"


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    """Load a pipeline and refuse one that yields no probabilities."""
    model = PipelineModel.load(path)
    if not model.stages[-1].hasParam("probabilityCol"):
        raise TypeError("the loaded model yields no probabilities")
    return model
