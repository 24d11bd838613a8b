"""Scenario grids of wind speeds, directions and repeated runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scenario_grid(
    spark: SparkSession, speeds: Sequence[float], directions: Sequence[float], runs: int, first_seed: int = 42
) -> DataFrame:
    """Every speed, direction and run, numbered in that order; the seed follows the number."""
    total = len(speeds) * len(directions) * runs
    n = F.col("id").cast("int")

    def pick(values: Sequence[float], i: Column) -> Column:
        return F.get(F.array(*[F.lit(float(v)) for v in values]), i.cast("int"))

    return spark.range(total).select(
        n.alias("scenario_id"),
        pick(speeds, F.floor(n / (len(directions) * runs))).alias("speed_kmh"),
        pick(directions, F.floor(n / runs) % len(directions)).alias("direction_deg"),
        (n % runs).alias("run"),
        (n + first_seed).alias("seed"),
    )


def nearest_scenario_wind(hours: DataFrame, speeds: Sequence[float], directions: Sequence[float]) -> DataFrame:
    """Observed hours per scenario wind: speed rounded up to a grid speed, nearest direction."""
    step, sector = speeds[0], 360.0 / len(directions)
    slot = F.least(F.floor(F.col("speed_kmh") / step), F.lit(len(speeds) - 1))
    turn = F.floor(F.pmod(F.col("dir_deg") + sector / 2, F.lit(360.0)) / sector)
    return hours.groupBy(
        ((slot + 1) * F.lit(step)).alias("speed_kmh"), (turn * F.lit(sector)).alias("direction_deg")
    ).agg(F.count(F.lit(1)).alias("observed_hours"))
