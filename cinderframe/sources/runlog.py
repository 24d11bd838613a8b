"""Run logs and run inventories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = (
    "stop_step int, stop_reason string, max_timesteps int, "
    "snapshots array<struct<requested_step:int, actual_step:int, active_cells:bigint, "
    "reached_cells:bigint, status:string>>"
)


def build_run_logs(progress: DataFrame, max_timesteps: int, key: str = "run_id", later: Sequence[int] = ()) -> DataFrame:
    """One nested record per run from its per-step progress (one entry per step).

    ``later`` are steps requested whether or not the run got there; one past the stop
    gets an entry with the last recorded step as its actual step.
    """
    entry = F.struct(
        F.col("step").alias("requested_step"), F.col("step").alias("actual_step"), "active_cells", "reached_cells", "status"
    )
    logs = progress.groupBy(key).agg(
        F.max("step").alias("stop_step"),
        F.max_by("active_cells", "step").alias("__active"),
        F.array_sort(F.collect_list(entry)).alias("__entries"),
    )
    asked = F.array(*[F.lit(s) for s in later]).cast("array<int>")
    last = F.element_at("__entries", -1)
    past = F.transform(
        F.filter(asked, lambda s: s > F.col("stop_step")),
        lambda s: F.struct(s.alias("requested_step"), *[last[n].alias(n) for n in ("actual_step", "active_cells", "reached_cells", "status")]),
    )
    logs = logs.withColumn("snapshots", F.concat("__entries", past) if later else F.col("__entries"))
    reason = F.when(F.col("__active") > 0, "max_timesteps").otherwise("inactive")
    return logs.select(key, "stop_step", reason.alias("stop_reason"), F.lit(max_timesteps).alias("max_timesteps"), "snapshots")


def write_run_logs(logs: DataFrame, path: str, key: str = "run_id") -> str:
    """One JSON document per run, in a folder of its own."""
    logs.repartition(key).write.mode("overwrite").partitionBy(key).json(path)
    return path


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """Nested logs to one row per run and snapshot."""
    logs = spark.read.schema(f"{LOG_SCHEMA}, run_id int").json(path, multiLine=True)
    return logs.select("run_id", "stop_step", "stop_reason", "max_timesteps", F.explode("snapshots").alias("s")).select(
        "run_id", "stop_step", "stop_reason", "max_timesteps", "s.*"
    )


def expected_runs(configs: DataFrame, config: str, seeds: Sequence[int]) -> DataFrame:
    """Every config with every seed."""
    return configs.select(config).distinct().select(config, F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))


def missing_runs(expected: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    return expected.join(present.select(*keys), list(keys), "left_anti")


def run_name(config: str, seed: str, base_seed: int = 42):
    """The base seed's run carries the config's name, the others a suffix."""
    return F.when(F.col(seed) == base_seed, F.col(config)).otherwise(
        F.concat(F.col(config), F.lit("_s"), F.col(seed).cast("string"))
    )
