"""Co-registration, domain restriction, excluded cells and mask algebra."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_window(r0: int, c0: int, height: int, width: int) -> Column:
    return F.col("r").between(r0, r0 + height - 1) & F.col("c").between(c0, c0 + width - 1)


def domain_flags(crop: Column) -> dict[str, Column]:
    """Scoring domains over cells with ``buildings_raw`` and ``burnable``.

    ``buildings`` uses value > 0; ``spec`` uses value == 10 on valid crop cells.
    """
    buildings = F.col("buildings_raw") > 0
    return {
        "whole": F.lit(True),
        "buildings": buildings,
        "crop_buildings": crop & buildings,
        "spec": crop & F.col("burnable") & (F.col("buildings_raw") == 10),
    }


def domain_rows(cells: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Long table ``domain, r, c``."""
    named = F.array(*[F.when(flag, F.lit(name)) for name, flag in flags.items()])
    return cells.select(F.explode(F.array_compact(named)).alias("domain"), "r", "c")


def restrict_each(rows: DataFrame, domains: DataFrame) -> DataFrame:
    """Rows once per domain they lie in, from one pass; ``domain, r, c`` is unique."""
    return rows.join(domains.select("domain", "r", "c"), ["r", "c"])


def coregister(pred: DataFrame, truth: DataFrame, *, strict: bool = True) -> DataFrame:
    """Pair prediction and truth on ``(r, c)``.

    With ``strict`` an unmatched cell on either side fails the job; otherwise
    ``side`` tells which side had it.
    """
    left = pred.withColumn("__p", F.lit(True))
    right = truth.withColumn("__t", F.lit(True))
    joined = left.join(right, ["r", "c"], "full_outer")
    side = F.when(F.col("__t").isNull(), "pred").when(F.col("__p").isNull(), "truth").otherwise("both")
    joined = joined.withColumn("side", side).drop("__p", "__t")
    if not strict:
        return joined
    error = F.raise_error(F.concat_ws(" ", F.lit("shape mismatch at cell"), F.col("r"), F.col("c")))
    return joined.withColumn("side", F.when(F.col("side") == "both", F.col("side")).otherwise(error.cast("string")))


def excluded(cells: DataFrame, domain: DataFrame) -> DataFrame:
    """Cells that a domain leaves out."""
    return cells.join(domain.select("r", "c"), ["r", "c"], "left_anti")


def disagreement(a: DataFrame, b: DataFrame, names: dict[str, str], mask: str) -> DataFrame:
    """Cells compared and, per mask of ``a``, cells where it differs from ``mask`` of ``b``; a missing cell differs.

    ``names`` maps masks of ``a`` to result columns; all are compared in one join.
    """
    left = a.select("r", "c", *[F.col(n).alias(f"__{n}") for n in names])
    joined = left.join(b.select("r", "c", F.col(mask).alias("__mask")), ["r", "c"], "full_outer")
    differ = [F.count_if(~F.col(f"__{n}").eqNullSafe(F.col("__mask"))).alias(out) for n, out in names.items()]
    return joined.agg(F.count(F.lit(1)).alias("cells"), *differ)


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("r", "c").intersect(b.select("r", "c"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("r", "c").exceptAll(b.select("r", "c"))


def coefficient_changes(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Coefficients side by side with their absolute difference."""
    joined = old.select(*keys, F.col("coef").alias("old_coef")).join(
        new.select(*keys, F.col("coef").alias("new_coef")), list(keys), "full_outer"
    )
    return joined.withColumn("abs_diff", F.abs(F.col("old_coef") - F.col("new_coef")))
