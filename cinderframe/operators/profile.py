"""Summaries of layers, regions and training tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderframe.functions.grid import Grid
from cinderframe.functions.joins import join_metadata
from cinderframe.functions.ranking import running_sums
from cinderframe.session import written

# Plausible burned-area sizes, in cells, and hectares per square metre.
SMALL_BURN, LARGE_BURN = 300, 30_000
HECTARE_M2 = 10_000.0


def _long(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), name: str = "feature") -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*")


def value_counts(df: DataFrame, columns: Sequence[str], name: str = "feature") -> DataFrame:
    """How often each value occurs in each column."""
    return _long(df, columns, name=name).groupBy(name, "value").agg(F.count(F.lit(1)).alias("cells"))


def layer_summary(counts: DataFrame, sentinel: float = -9999.0) -> DataFrame:
    """Distinct values, nodata and non-finite counts, usable range per layer, from its value counts.

    Value counts come first (partial counts merge map-side), then one row per
    layer, so no distinct set is built in one task.
    """
    value, n = F.col("value"), F.col("cells")
    missing = value == F.lit(sentinel)
    non_finite = F.isnan(value) | value.isin(float("inf"), float("-inf"))
    usable = F.when(~missing & ~non_finite, value)
    return counts.groupBy("layer").agg(
        F.count(F.lit(1)).alias("distinct_values"),
        F.sum(F.when(missing, n).otherwise(0)).alias("nodata_cells"),
        F.sum(F.when(non_finite, n).otherwise(0)).alias("nonfinite_cells"),
        F.min(usable).alias("usable_min"),
        F.max(usable).alias("usable_max"),
    )


def class_balance(df: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    y = F.col(label).cast("bigint")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(y).alias("positives"), F.avg(y).alias("positive_rate")
    )


def environment_summary(env: DataFrame) -> DataFrame:
    """Burnable and building counts and the range of each risk."""
    ranges = [
        f(layer).alias(f"{layer}_{name}")
        for layer in ("slope_risk", "proximity_risk", "material_risk")
        for name, f in (("min", F.min), ("max", F.max))
    ]
    return env.agg(
        F.count_if(F.col("burnable")).alias("burnable_cells"),
        F.count_if(F.col("building_presence") == 1).alias("building_cells"),
        *ranges,
    )


def region_stats(mask: DataFrame, pixel: float, keys: Sequence[str] = ()) -> DataFrame:
    """Size, area, extent and centroid of a set of cells."""
    return mask.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cells"),
        (F.count(F.lit(1)) * F.lit(pixel * pixel) / F.lit(HECTARE_M2)).alias("hectares"),
        F.min("r").alias("r_min"),
        F.max("r").alias("r_max"),
        F.min("c").alias("c_min"),
        F.max("c").alias("c_max"),
        F.avg("r").alias("r_centroid"),
        F.avg("c").alias("c_centroid"),
    )


def padded_box(mask: DataFrame, grid: Grid, padding: int = 50) -> DataFrame:
    """Bounding box with padding, clipped to the grid; an empty mask gives the grid.

    Ends are exclusive slice ends: the last set index plus the padding.
    """

    def low(column: str) -> Column:
        return F.coalesce(F.greatest(F.min(column) - padding, F.lit(0)), F.lit(0))

    def high(column: str, size: int) -> Column:
        return F.coalesce(F.least(F.max(column) + padding, F.lit(size)), F.lit(size))

    return mask.agg(
        low("r").alias("r_start"),
        high("r", grid.height).alias("r_end"),
        low("c").alias("c_start"),
        high("c", grid.width).alias("c_end"),
    )


def audit_truth(truth: DataFrame, expected: Grid, value: str = "burned", keys: Sequence[str] = ()) -> DataFrame:
    """Issue rows ``check, level, found`` for a truth table."""
    v = F.col(value)
    stats = truth.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cells"),
        (F.max("r") + 1).alias("height"),
        (F.max("c") + 1).alias("width"),
        F.count_if(~v.isin(0, 1)).alias("other_values"),
        F.count_if(v == 1).alias("burned"),
    )

    def issue(when: Column, check: str, level: str, found: Column) -> Column:
        row = F.struct(F.lit(check).alias("check"), F.lit(level).alias("level"), found.cast("bigint").alias("found"))
        return F.when(when, row)

    wrong_size = (F.col("height") != expected.height) | (F.col("width") != expected.width)
    gaps = F.col("cells") != F.lit(expected.height) * F.lit(expected.width)
    burned = F.col("burned")
    issues = F.array_compact(
        F.array(
            issue(wrong_size, "size", "error", F.col("height") * F.col("width")),
            issue(gaps, "cells", "error", F.col("cells")),
            issue(F.col("other_values") > 0, "values", "error", F.col("other_values")),
            issue(burned == 0, "no burned cells", "warning", burned),
            issue((burned > 0) & (burned < SMALL_BURN), "small burn", "warning", burned),
            issue(burned > LARGE_BURN, "large burn", "warning", burned),
        )
    )
    return stats.select(*keys, F.explode(issues).alias("i")).select(*keys, "i.*")


def class_means(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Mean of each feature by class and the difference, from one aggregation."""
    y = F.col(label)
    means = [
        F.avg(F.when(y == k, F.col(f).cast("double"))).alias(f"{f}__{k}") for f in features for k in (0, 1)
    ]
    rows = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), F.col(f"{f}__0").alias("mean_0"), F.col(f"{f}__1").alias("mean_1"))
            for f in features
        ]
    )
    long = df.agg(*means).select(F.explode(rows).alias("m")).select("m.*")
    return long.withColumn("difference", F.col("mean_1") - F.col("mean_0"))


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Type, distinct values and nulls per column, by way of value counts."""
    types = dict(df.dtypes)
    texts = [
        F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("type"), F.col(c).cast("string").alias("value"))
        for c in columns
    ]
    long = df.select(F.explode(F.array(*texts)).alias("p")).select("p.*")
    counts = long.groupBy("column", "type", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("column", "type").agg(
        F.count("value").alias("distinct_values"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"),
    )


def positives_per_chunk(
    df: DataFrame, label: str, levels: Sequence[str], tail: Sequence[str], chunk: int = 1_000_000
) -> DataFrame:
    """Positives in consecutive blocks of ``chunk`` rows in key order.

    Rows are counted by ``levels`` and the counts placed in the order. A bucket that lies in one block adds its counts;
    only the rows of buckets that the end of a block cuts, one bucket an end at most, are ranked. ``df`` is read
    twice and should be a written table; the counts and their places are written.
    """
    levels = list(levels)
    sums = [F.count(F.lit(1)).alias("rows"), F.sum(F.col(label).cast("bigint")).alias("positives")]
    counts = written(df.groupBy(*levels).agg(*sums), "chunk-counts")
    placed = written(running_sums(counts, [], levels, ["rows"]), "chunk-places")

    def block(before: Column) -> Column:
        return F.floor(before / F.lit(chunk)).cast("bigint")

    first, last = block(F.col("rows_before")), block(F.col("rows_before") + F.col("rows") - 1)
    whole = placed.filter(first == last).select(first.alias("chunk"), "rows", "positives")
    cut = join_metadata(df.select(*levels, *tail, label), placed.filter(first < last).select(*levels, "rows_before"), levels)
    own = F.row_number().over(Window.partitionBy(*levels).orderBy(*tail)) - 1
    ranked = cut.withColumn("chunk", block(F.col("rows_before") + own)).groupBy("chunk").agg(*sums)
    return whole.unionByName(ranked).groupBy("chunk").agg(F.sum("rows").alias("rows"), F.sum("positives").alias("positives"))


def exact_percentile(df: DataFrame, value: str, fraction: float, keys: Sequence[str], levels: dict[str, Column]) -> DataFrame:
    """Linearly interpolated percentile from value counts and running sums."""
    counts = df.groupBy(*keys, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    ranked = running_sums(counts.withColumns(levels), keys, [*levels, "__v"], ["__n"], totals=True)
    position = (F.col("__n_total") - 1) * F.lit(fraction)
    last = F.col("__n_before") + F.col("__n") - 1  # 0-based position of the value's last copy
    return ranked.groupBy(*keys).agg(
        F.min(F.when(last >= F.floor(position), F.col("__v"))).alias("__low"),
        F.min(F.when(last >= F.ceil(position), F.col("__v"))).alias("__high"),
        F.max(position - F.floor(position)).alias("__w"),
    ).select(*keys, (F.col("__low") + (F.col("__high") - F.col("__low")) * F.col("__w")).alias("percentile"))

