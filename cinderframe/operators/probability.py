"""Ranking metrics, calibration losses and cutoff sweeps on scored rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderframe.functions.columns import ratio
from cinderframe.functions.joins import join_metadata
from cinderframe.functions.ranking import running_sums
from cinderframe.session import written

# The 16 cutoffs 0.10 to 0.85, as the doubles a stepped range yields.
CUTOFFS = tuple(0.1 + i * 0.05 for i in range(16))
EPSILON = 2.220446049250313e-16


BUCKETS = 256


def _leveled(counts: DataFrame, value: str, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Distinct values with a bucket by quantiles of the distinct values, whatever their distribution.

    No bucket holds much more than one part in 256 of a key's values. Counts and
    quantiles are written once, so that every later step sees the same buckets.
    """
    counts = written(counts, "value-counts")
    shares = [k / BUCKETS for k in range(1, BUCKETS)]
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(value, shares, 10_000).alias("__cuts"))
    cuts = written(cuts, "quantiles")
    placed = join_metadata(counts, cuts, list(keys)) if keys else counts.crossJoin(F.broadcast(cuts))  # one row of 255 numbers
    return placed.withColumn("__bucket", F.size(F.filter("__cuts", lambda x: x <= F.col(value)))).drop("__cuts"), ["__bucket", value]


def _classes(label: str, count: str | None) -> list[Column]:
    """Sums of positives and negatives; a row stands for ``count`` equal ones."""
    y, n = F.col(label).cast("bigint"), F.col(count).cast("bigint") if count else F.lit(1).cast("bigint")
    return [F.sum(y * n).alias("pos"), F.sum((1 - y) * n).alias("neg")]


def _score_counts(df: DataFrame, label: str, score: str, keys: Sequence[str], count: str | None = None) -> tuple[DataFrame, list[str]]:
    """Positives and negatives per distinct score, with the level columns of the score."""
    counts = df.groupBy(*keys, F.col(score).alias("__score")).agg(*_classes(label, count))
    return _leveled(counts, "__score", keys)


def roc_auc(df: DataFrame, label: str, score: str, keys: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """Exact, tie-aware ROC AUC of scores in [0, 1]; null if one class is absent. A row stands for ``count`` equal ones."""
    counts, levels = _score_counts(df, label, score, keys, count)
    ranked = running_sums(counts, keys, levels, ["neg"])
    wins = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ranked.groupBy(*keys).agg(
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        (wins / F.when(pairs > 0, pairs)).alias("roc_auc"),
    )


def feature_auc(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Exact ROC AUC of each feature on its own, whatever its range."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    y = F.col(label).cast("bigint")
    long = df.select(y.alias("y"), F.explode(pairs).alias("p")).select("y", "p.*")
    counts = long.groupBy("feature", "value").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    placed, levels = _leveled(counts, "value", ["feature"])
    ranked = running_sums(placed, ["feature"], levels, ["neg"])
    wins = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2))
    pairs_total = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ranked.groupBy("feature").agg((wins / F.when(pairs_total > 0, pairs_total)).alias("roc_auc"))


def average_precision(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Step-wise average precision over distinct scores, highest first."""
    counts, levels = _score_counts(df, label, score, keys)
    ranked = running_sums(counts, keys, levels, ["pos", "neg"], descending=True)
    hits = F.col("pos_before") + F.col("pos")
    precision = hits / (hits + F.col("neg_before") + F.col("neg"))
    total = F.sum("pos").cast("double")
    return ranked.groupBy(*keys).agg(
        ratio(F.sum(F.col("pos") * precision), total).alias("average_precision")
    )


def proper_losses(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Brier score, log loss (p clipped to machine epsilon) and mean p."""
    y, p = F.col(label).cast("double"), F.col(score)
    safe = F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1.0 - EPSILON))
    loss = -(y * F.log(safe) + (1 - y) * F.log(1 - safe))
    return df.groupBy(*keys).agg(
        F.avg((p - y) * (p - y)).alias("brier"), F.avg(loss).alias("log_loss"), F.avg(p).alias("mean_p")
    )


def cutoff_counts(
    df: DataFrame, label: str, score: str, keys: Sequence[str] = (), cutoffs: Sequence[float] = CUTOFFS, count: str | None = None
) -> DataFrame:
    """TP, FP, FN, TN at every cutoff from one pass; a row stands for ``count`` equal ones.

    Each row falls into one of ``len(cutoffs) + 1`` buckets; counts at a cutoff
    are sums over the buckets at or above it, so rows are never multiplied.
    """
    reached = sum((F.col(score) >= F.lit(t)).cast("int") for t in cutoffs)
    buckets = df.groupBy(*keys, reached.alias("__b")).agg(*_classes(label, count))
    grid = F.array(*[F.struct(F.lit(i).alias("cutoff_no"), F.lit(t).alias("cutoff")) for i, t in enumerate(cutoffs)])
    above = F.col("__b") > F.col("cutoff_no")
    return (
        buckets.select(*keys, "__b", "pos", "neg", F.explode(grid).alias("g"))
        .select(*keys, "__b", "pos", "neg", "g.*")
        .groupBy(*keys, "cutoff_no", "cutoff")
        .agg(
            F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"),
            F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
            F.sum(F.when(~above, F.col("pos")).otherwise(0)).alias("fn"),
            F.sum(F.when(~above, F.col("neg")).otherwise(0)).alias("tn"),
        )
    )


def f1_of_counts() -> Column:
    return ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))


def best_cutoff(sweep: DataFrame, keys: Sequence[str] = (), fallback: float = 0.5) -> DataFrame:
    """First cutoff with the highest F1; ``fallback`` where every F1 is 0."""
    order = F.struct(f1_of_counts(), -F.col("cutoff_no"))
    best = sweep.groupBy(*keys).agg(F.max_by(F.struct("cutoff", f1_of_counts().alias("f1")), order).alias("b"))
    return best.select(
        *keys,
        F.when(F.col("b.f1") > 0, F.col("b.cutoff")).otherwise(F.lit(fallback)).alias("best_cutoff"),
        F.col("b.f1").alias("best_f1"),
    )


def best_trials(results: DataFrame, keys: Sequence[str], trial: str, value: str) -> DataFrame:
    """First trial with the highest value, and whether it lies in the first half of the search."""
    best = results.groupBy(*keys).agg(
        F.max_by(F.struct(trial, value), F.struct(F.col(value), -F.col(trial))).alias("b"),
        F.count(F.lit(1)).alias("trials"),
    )
    return best.select(
        *keys,
        F.col(f"b.{trial}").alias("best_trial"),
        F.col(f"b.{value}").alias("best_value"),
        "trials",
        (F.col(f"b.{trial}") < F.col("trials") * 0.5).alias("converged_early"),
    )


def gate(p: Column, threshold: float) -> Column:
    """Keep ``p`` at or above the threshold, else 0; a threshold of 0 is off."""
    return F.when(p >= F.lit(threshold), p).otherwise(F.lit(0.0)) if threshold > 0 else p


def hard_prediction(p: Column, threshold: float) -> Column:
    return (p >= F.lit(threshold)).cast("int")


def linear_probability(rows: DataFrame, ids: Sequence[str], coefficients: DataFrame) -> DataFrame:
    """Score rows with a table ``model, feature, mean, scale, coef, intercept``.

    The table has one row per model and feature, so it is small whatever the
    rows: it becomes one scalar (an array of models, each a map of features) and
    the rows are neither joined nor unpivoted.
    """
    terms = F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "scale", "coef"))))
    per_model = coefficients.groupBy("model").agg(terms.alias("terms"), F.max("intercept").alias("intercept"))
    models = per_model.agg(F.collect_list(F.struct("model", "terms", "intercept"))).scalar()
    scored = rows.withColumn("__models", models).withColumn("__m", F.explode("__models"))
    z = F.col("__m.intercept")
    for name in (c for c in rows.columns if c not in ids):
        term = F.col("__m.terms")[name]
        centred = (F.col(name).cast("double") - term["mean"]) / F.when(term["scale"] != 0, term["scale"]).otherwise(1.0)
        z = z + F.coalesce(term["coef"] * centred, F.lit(0.0))
    return scored.select(*ids, F.col("__m.model").alias("model"), (1 / (1 + F.exp(-z))).alias("p"))


def foreign_probability(load_model, features: Sequence[str]) -> Column:
    """Score with any object that has ``predict_proba``, by Arrow batches.

    ``load_model`` runs once per task and returns the fitted object.
    """

    @F.pandas_udf("double")
    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        model = load_model()
        if not callable(getattr(model, "predict_proba", None)):
            raise TypeError("the model must provide predict_proba")
        for batch in batches:
            yield pd.Series(model.predict_proba(batch[list(features)].to_numpy())[:, 1])

    return predict(F.struct(*[F.col(f).cast("double").alias(f) for f in features]))
