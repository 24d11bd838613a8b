"""Confusion counts, map scores over many domains and runs, and their summaries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderframe.functions.columns import ratio

# Target levels of the report.
RECALL_TARGET = 0.80
F1_TARGET = 0.80

METRICS = ("precision", "recall", "f1", "jaccard")


@dataclass(frozen=True)
class Case:
    """One truth mask on one domain, named by its labels."""

    labels: dict[str, str]
    truth: Column
    mask: Column


def confusion(df: DataFrame, pred: Column, truth: Column, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count_if(pred & truth).alias("tp"),
        F.count_if(pred & ~truth).alias("fp"),
        F.count_if(~pred & truth).alias("fn"),
        F.count_if(~pred & ~truth).alias("tn"),
    )


def with_metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and Jaccard of ``tp, fp, fn``; 0.0 on a zero denominator."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = F.col("precision"), F.col("recall")
    return (
        counts.withColumns(
            {
                "precision": ratio(tp, tp + fp),
                "recall": ratio(tp, tp + fn),
                "jaccard": ratio(tp, tp + fp + fn),
                "truth": tp + fn,
                "predicted": tp + fp,
            }
        )
        .withColumn("f1", ratio(2 * p * r, p + r))
    )


def accuracy() -> Column:
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return ratio(F.col("tp") + F.col("tn"), total)


def hard_auc() -> Column:
    """AUC of 0/1 predictions: the mean of recall and specificity."""
    return (ratio(F.col("tp"), F.col("tp") + F.col("fn")) + ratio(F.col("tn"), F.col("tn") + F.col("fp"))) / 2


def with_targets(scores: DataFrame, recall: float = RECALL_TARGET, f1: float = F1_TARGET) -> DataFrame:
    return scores.withColumns({"recall_pass": F.col("recall") >= recall, "f1_pass": F.col("f1") >= f1})


def _per_case(df: DataFrame, keys: Sequence[str], cases: Sequence[Case], counters: dict) -> DataFrame:
    """One aggregation for all cases, then one row per key and case.

    Rows are not multiplied by the cases: each case is a set of conditional
    counts, and only the aggregated row is exploded.
    """
    aggregates = [
        counter(case).alias(f"{name}_{i}") for i, case in enumerate(cases) for name, counter in counters.items()
    ]
    wide = df.groupBy(*keys).agg(*aggregates)
    rows = F.array(
        *[
            F.struct(
                *[F.lit(v).alias(k) for k, v in case.labels.items()],
                *[F.col(f"{name}_{i}").alias(name) for name in counters],
            )
            for i, case in enumerate(cases)
        ]
    )
    return wide.select(*keys, F.explode(rows).alias("case")).select(*keys, "case.*")


SIZES = {"cells": lambda case: F.count_if(case.mask), "positives": lambda case: F.count_if(case.mask & case.truth)}


def domain_totals(cells: DataFrame, cases: Sequence[Case], keys: Sequence[str] = ()) -> DataFrame:
    """Cells and positives of each truth and domain."""
    return _per_case(cells, keys, cases, SIZES)


def domain_inventory(cells: DataFrame, cases: Sequence[Case], building: Column, valid: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Cells, positives, buildings and invalid cells of each truth and domain, from one aggregation."""
    counters = {
        **SIZES,
        "building_cells": lambda case: F.count_if(case.mask & building),
        "invalid_cells": lambda case: F.count_if(case.mask & ~valid),
        "invalid_building_cells": lambda case: F.count_if(case.mask & building & ~valid),
        "positives_off_buildings": lambda case: F.count_if(case.mask & case.truth & ~building),
    }
    return _per_case(cells, keys, cases, counters)


def score_cases(df: DataFrame, pred: Column, cases: Sequence[Case], keys: Sequence[str]) -> DataFrame:
    """Confusion counts of rows that already hold prediction, truth and domains."""
    counters = {
        "tp": lambda case: F.count_if(case.mask & case.truth & pred),
        "fp": lambda case: F.count_if(case.mask & ~case.truth & pred),
        "fn": lambda case: F.count_if(case.mask & case.truth & ~pred),
        "tn": lambda case: F.count_if(case.mask & ~case.truth & ~pred),
    }
    return _per_case(df, keys, cases, counters)


def score_runs(reached: DataFrame, cells: DataFrame, runs: DataFrame, cases: Sequence[Case], keys: Sequence[str]) -> DataFrame:
    """Confusion counts of many runs against many truths and domains.

    Only reached cells are joined to the cell table; false and true negatives
    follow from the domain totals, so a run that burned little costs little.
    ``runs`` lists every key that must appear, also those that reached nothing.
    """
    labels = list(cases[0].labels)
    counters = {
        "tp": lambda case: F.count_if(case.mask & case.truth),
        "predicted": lambda case: F.count_if(case.mask),
    }
    joined = reached.select(*keys, "r", "c").join(cells, ["r", "c"])
    hits = _per_case(joined, keys, cases, counters)
    # One row per case: the number of cases is fixed by the caller.
    totals = F.broadcast(domain_totals(cells, cases))
    names = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in case.labels.items()]) for case in cases])
    expected = runs.select(*keys).distinct().select(*keys, F.explode(names).alias("case")).select(*keys, "case.*")
    out = expected.join(hits, [*keys, *labels], "left").join(totals, labels).na.fill(0, ["tp", "predicted"])
    fp = F.col("predicted") - F.col("tp")
    return out.select(
        *keys,
        *labels,
        "tp",
        fp.alias("fp"),
        (F.col("positives") - F.col("tp")).alias("fn"),
        (F.col("cells") - F.col("positives") - fp).alias("tn"),
    )


def across_seeds(scores: DataFrame, keys: Sequence[str], seed: str, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Mean, sample SD (0.0 for one seed), min, max and the per-seed list of each metric.

    ``scores`` has one row per run; the list is the report's per-seed column.
    """
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    long = scores.select(*keys, seed, F.explode(pairs).alias("p")).select(*keys, seed, "p.*")
    listed = F.array_sort(F.collect_list(F.struct(seed, "value")))
    return long.groupBy(*keys, "metric").agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.count_if(F.col("value") >= RECALL_TARGET).alias("passing"),
        F.transform(listed, lambda s: s["value"]).alias("per_seed"),
    )


def sensitivity_band(scores: DataFrame, keys: Sequence[str], variant: str, metrics: Sequence[str]) -> DataFrame:
    """Mean metric per perturbed truth, then its range over the variants."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    long = scores.select(*keys, variant, F.explode(pairs).alias("p")).select(*keys, variant, "p.*")
    means = long.groupBy(*keys, variant, "metric").agg(F.avg("value").alias("value"))
    return means.groupBy(*keys, "metric").agg(F.min("value").alias("low"), F.max("value").alias("high"))


def paired_differences(scores: DataFrame, config: str, a: str, b: str, keys: Sequence[str], seed: str, metric: str) -> DataFrame:
    """Per-seed differences ``b - a``: mean, wins of ``b`` and number of pairs."""
    on = [*keys, seed]
    left = scores.filter(F.col(config) == a).select(*on, F.col(metric).alias("__a"))
    right = scores.filter(F.col(config) == b).select(*on, F.col(metric).alias("__b"))
    diff = F.col("__b") - F.col("__a")
    return left.join(right, on).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pairs"), F.avg(diff).alias("mean_diff"), F.count_if(diff > 0).alias("wins")
    )


def changed_cells(a: DataFrame, b: DataFrame, truth: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Cells shared by or unique to two burn masks, by truth class.

    ``a`` and ``b`` hold reached cells; ``truth`` maps ``r, c`` to a boolean.
    """
    cols = [*keys, "r", "c"]
    both = (
        a.select(*cols, F.lit(1).alias("in_a"), F.lit(0).alias("in_b"))
        .unionByName(b.select(*cols, F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))
        .groupBy(*cols)
        .agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    )
    return both.join(truth, ["r", "c"]).groupBy(*keys, "truth").agg(
        F.count_if(F.col("in_a") + F.col("in_b") == 2).alias("shared"),
        F.count_if(F.col("in_a") > F.col("in_b")).alias("only_a"),
        F.count_if(F.col("in_b") > F.col("in_a")).alias("only_b"),
    )
