"""Aligned layer stacks."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderframe.functions.grid import Grid


def check_grids(grids: Mapping[str, Grid]) -> Grid:
    """The common grid, or an error that names the first layer that differs."""
    names = list(grids)
    first = grids[names[0]]
    for name in names[1:]:
        for part in ("height", "width", "crs", "xmin", "ymax", "pixel"):
            if getattr(grids[name], part) != getattr(first, part):
                raise ValueError(f"layer {name!r} lies on another grid than {names[0]!r}: {part} is {getattr(grids[name], part)}, not {getattr(first, part)}")
    return first


def stack_layers(layers: Mapping[str, DataFrame], *, strict: bool = True) -> DataFrame:
    """One row per cell with a column per layer, from tables ``r, c, value``.

    The layers are unioned and folded by cell, which shuffles every layer once.
    Chained outer joins would shuffle the growing result again per layer. A cell
    that a layer lacks or repeats fails the job, or is kept with
    ``layers_present`` when ``strict`` is off.
    """
    names = list(layers)
    tagged = [
        df.select("r", "c", F.lit(i).alias("layer"), F.col("value").cast("double").alias("value"))
        for i, df in enumerate(layers.values())
    ]
    value = [F.max(F.when(F.col("layer") == i, F.col("value"))).alias(n) for i, n in enumerate(names)]
    seen = [F.count_if(F.col("layer") == i).alias(f"__n{i}") for i in range(len(names))]
    stacked = reduce(DataFrame.unionByName, tagged).groupBy("r", "c").agg(*value, *seen)
    present = reduce(lambda a, b: a + b, [(F.col(f"__n{i}") == 1).cast("int") for i in range(len(names))])
    stacked = stacked.withColumn("layers_present", present)
    if strict:
        error = F.raise_error(F.concat_ws(" ", F.lit("layers do not all have one value at cell"), F.col("r"), F.col("c")))
        whole = F.when(F.col("layers_present") == len(names), F.col("layers_present")).otherwise(error.cast("int"))
        stacked = stacked.withColumn("layers_present", whole)
    return stacked.select("r", "c", *names, "layers_present")


def read_layers(spark, paths: Mapping[str, str], grids: Mapping[str, Grid] | None = None, *, strict: bool = True) -> DataFrame:
    if grids:
        check_grids(grids)
    return stack_layers({name: spark.read.parquet(path) for name, path in paths.items()}, strict=strict)
