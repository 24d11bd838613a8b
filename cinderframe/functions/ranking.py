"""Exact ranks and running sums that never put one group into one task.

A plain ``row_number() over (partition by g order by x)`` sorts a whole group in
one task. Here the order is split into nested levels (a coarse bucket, a finer
bucket, then the value). Counts per bucket are pre-aggregated map-side, only
those bounded totals see an ordered window over the group, and the rows see a
window over their own bucket. All levels are deterministic functions of the
row, so a lost executor recomputes the same buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    levels: Sequence[str],
    measures: Sequence[str],
    *,
    descending: bool = False,
    totals: bool = False,
    suffix: str = "_before",
) -> DataFrame:
    """Add, per measure, its sum over the rows that come before in the group.

    ``levels`` are columns in lexicographic order; each is a monotone
    refinement of the one before it. Rows must be unique on ``keys + levels``.
    With ``totals`` the group's sum is added as ``<measure>_total``; it comes
    from the coarsest buckets, so it costs no other pass.
    """
    keys, levels = list(keys), list(levels)
    bucket, last = keys + levels[:-1], levels[-1]
    order = F.col(last).desc() if descending else F.col(last).asc()
    window = Window.partitionBy(*bucket).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    own = {m + suffix: F.coalesce(F.sum(m).over(window), zero) for m in measures}
    if len(levels) == 1:
        if totals:
            own |= {m + "_total": F.sum(m).over(Window.partitionBy(*keys)) for m in measures}
        return df.withColumns(own)
    off = f"__off{len(levels)}"
    buckets = df.groupBy(*bucket).agg(*[F.sum(m).alias(m) for m in measures])
    offsets = running_sums(buckets, keys, levels[:-1], measures, descending=descending, totals=totals, suffix=off)
    out = df.withColumns(own).join(offsets.drop(*measures), bucket)
    return out.withColumns({m + suffix: F.col(m + suffix) + F.col(m + off) for m in measures}).drop(
        *[m + off for m in measures]
    )


def ordinal(
    df: DataFrame,
    keys: Sequence[str],
    levels: Sequence[str],
    tail: Sequence[str | Column],
    *,
    name: str = "rank",
    total: str | None = None,
    counted: DataFrame | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Exact ``row_number`` (from 1) per ``keys``, ordered by ``levels`` and then ``tail``.

    ``total`` names a column for the size of the row's group. ``counted`` are the same rows before a
    shuffle that ``df`` has behind it, to count the buckets from. If that shuffle dealt them by all of ``keys`` and
    ``levels`` to ``tasks`` tasks, the join with the buckets' places keeps them there.
    """
    bucket = [*keys, *levels]
    counts = (df if counted is None else counted).groupBy(*bucket).agg(F.count(F.lit(1)).alias("__n"))
    offsets = running_sums(counts, keys, levels, ["__n"], totals=total is not None).drop("__n")
    if total:
        offsets = offsets.withColumnRenamed("__n_total", total)
    if tasks:
        offsets = offsets.repartition(tasks, *bucket)
    window = Window.partitionBy(*bucket).orderBy(*tail)
    ranked = df.withColumn("__own", F.row_number().over(window)).join(offsets, bucket)
    return ranked.withColumn(name, F.col("__own") + F.col("__n_before")).drop("__own", "__n_before")


def hash_levels(hash_column: str, digits: Sequence[int] = (2, 4)) -> dict[str, Column]:
    """Level columns for an order by an md5 hex string: prefixes of growing length."""
    return {f"__h{d}": F.substring(hash_column, 1, d) for d in digits}


def hash_ordinal(
    df: DataFrame,
    keys: Sequence[str],
    hash_column: str,
    tie: Sequence[str],
    *,
    name: str = "rank",
    total: str | None = None,
    digits: Sequence[int] = (2, 4),
) -> DataFrame:
    """Exact rank per ``keys`` in hash order, ties by ``tie``."""
    levels = hash_levels(hash_column, digits)
    rows = df.withColumns(levels)
    return ordinal(rows, keys, list(levels), [hash_column, *tie], name=name, total=total).drop(*levels)


def unit_levels(value: str, bits: Sequence[int] = (10, 20)) -> dict[str, Column]:
    """Level columns for a value in [0, 1]; scaling by a power of two is exact."""
    return {f"__u{b}": F.floor(F.col(value) * F.lit(float(1 << b))) for b in bits}


def integer_levels(value: str, shifts: Sequence[int] = (20, 10)) -> dict[str, Column]:
    """Level columns for a non-negative whole number."""
    return {f"__s{s}": F.shiftright(F.col(value), s) for s in shifts}
