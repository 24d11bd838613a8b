"""Joins with small sides, broadcast only behind a check of their size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderframe.functions.columns import struct_array

MAX_BROADCAST_ROWS = 100_000


def fits_broadcast(small: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """Count at most ``max_rows + 1`` rows of a metadata table."""
    return small.limit(max_rows + 1).count() <= max_rows


def join_metadata(
    rows: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", max_rows: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """Join rows to a per-run or per-config table.

    Such keys are few and skewed, so a shuffle on them would put a third of all
    rows into one task. The small side is broadcast if a count proves it small;
    beyond that a plain join remains, whose hot partitions AQE splits.
    """
    side = F.broadcast(small) if fits_broadcast(small, max_rows) else small
    return rows.join(side, list(on), how)


def co_located(rows: DataFrame, others: DataFrame, on: Sequence[str], how: str = "inner", *, tasks: int | None = None) -> DataFrame:
    """Join two large tables in ``tasks`` tasks, both dealt by all of ``on``.

    A join sorts a task's share of both sides. Spark's own shuffle for it has as many partitions as the session
    says, however large the tables are; a number that follows them keeps that share. Without ``tasks`` it is a plain join.
    """
    if tasks:
        rows, others = rows.repartition(tasks, *on), others.repartition(tasks, *on)
    return rows.join(others, list(on), how)


def inline_table(spark, fields: Sequence[str], rows: Sequence[Sequence]) -> DataFrame:
    """A small table of literals whose size the planner knows."""
    return spark.range(1).select(F.explode(struct_array(fields, rows)).alias("t")).select("t.*")
