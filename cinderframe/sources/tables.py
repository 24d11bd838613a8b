"""Training tables, role folders, snapshots and result files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGET = "ignited"


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Input must contain the columns {missing}")
    return df


def read_training_csv(spark: SparkSession, path: str, schema: T.StructType, target: str = TARGET) -> DataFrame:
    """CSV with a header and a declared schema (no inference pass)."""
    if target not in schema.fieldNames():
        raise ValueError(f"Input must contain the target column {target!r}")
    return spark.read.schema(schema).option("enforceSchema", "false").csv(path, header=True)


def write_training(df: DataFrame, path: str, *, partition_by: Sequence[str] = (), fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Write rows with their keys; overwriting replaces only the partitions that are present.

    CSV is compressed: as text a row takes some seven times its bytes. A task reads such a file whole, so ``df`` should
    have tasks that follow its rows.
    """
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("compression", "gzip")
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.save(path)
    return path


def read_role(spark: SparkSession, path: str, role: str) -> DataFrame:
    """Rows of one role; the others' folders are pruned and never opened."""
    return spark.read.parquet(path).filter(F.col("role") == role)


def write_snapshots(snapshots: DataFrame, path: str, *, mode: str = "overwrite") -> str:
    """Snapshots partitioned by run and step, sorted by cell within a file.

    A run and step may hold most of the rows, so rows are spread by a row block
    too. A window on ``r`` and ``c`` then skips row groups by their min and max.
    """
    block = F.floor(F.col("r") / F.lit(256))
    spread = snapshots.repartition("run_id", "step", block).sortWithinPartitions("run_id", "step", "r", "c")
    spread.write.mode(mode).partitionBy("run_id", "step").option("partitionOverwriteMode", "dynamic").parquet(path)
    return path


def read_snapshots(spark: SparkSession, path: str, runs: Sequence[int] | None = None, steps: Sequence[int] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if runs is not None:
        df = df.filter(F.col("run_id").isin(*runs))
    return df.filter(F.col("step").isin(*steps)) if steps is not None else df


def write_results(df: DataFrame, path: str) -> tuple[str, str]:
    """Metric rows as JSON and as CSV."""
    df.write.mode("overwrite").json(f"{path}/json")
    df.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    return f"{path}/json", f"{path}/csv"


def union_scenarios(frames: Sequence[DataFrame | None], schema: T.StructType, spark: SparkSession) -> DataFrame:
    """Union of scenario frames by name; failed ones (None) are skipped.

    With no frame left the result is empty and keeps the schema.
    """
    good = [f for f in frames if f is not None]
    out = spark.createDataFrame([], schema)
    for frame in good:
        out = out.unionByName(frame.select(*schema.fieldNames()))
    return out
