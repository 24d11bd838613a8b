"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell states of a snapshot.
NON_BURNABLE, NOT_YET_BURNING, IGNITED, BLAZING, EXTINGUISHED = 1, 2, 3, 4, 5
REACHED_STATES = (IGNITED, BLAZING, EXTINGUISHED)
ACTIVE_STATES = (IGNITED, BLAZING)

TRUTH_RULES = {
    "nonzero": lambda v: v != 0,
    "positive": lambda v: v > 0,
    "one": lambda v: v == 1,
}


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator``, and 0.0 where the denominator is 0."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(
        numerator.cast("double") / F.when(denominator != 0, denominator).cast("double")
    )


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))


def is_reached(state: str | Column = "state") -> Column:
    return col(state).isin(*REACHED_STATES)


def is_active(state: str | Column = "state") -> Column:
    return col(state).isin(*ACTIVE_STATES)


def is_truth(value: str | Column, rule: str = "positive") -> Column:
    """Truth mask under one of the rules ``nonzero``, ``positive`` or ``one``."""
    return TRUTH_RULES[rule](col(value))


def outcome(pred: Column, truth: Column) -> Column:
    """TN / TP / FP / FN of one cell."""
    return (
        F.when(pred & truth, "TP").when(pred & ~truth, "FP").when(~pred & truth, "FN").otherwise("TN")
    )


def flat_index(width: int, r: str | Column = "r", c: str | Column = "c") -> Column:
    return col(r).cast("bigint") * F.lit(width).cast("bigint") + col(c)


def row_of(index: str | Column, width: int) -> Column:
    return F.floor(col(index) / F.lit(width)).cast("int")


def col_of(index: str | Column, width: int) -> Column:
    return F.pmod(col(index), F.lit(width)).cast("int")


def squared_distance(r0, c0, r: str | Column = "r", c: str | Column = "c") -> Column:
    """Squared distance in cells, as a whole number."""
    r0 = F.lit(r0) if isinstance(r0, int) else r0
    c0 = F.lit(c0) if isinstance(c0, int) else c0
    dr = (col(r) - r0).cast("bigint")
    dc = (col(c) - c0).cast("bigint")
    return dr * dr + dc * dc


def hash_key(seed, *parts: str | Column) -> Column:
    """md5 hex of the seed and the row's keys: a draw that any engine repeats."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", seed.cast("string"), *[col(p).cast("string") for p in parts]))


def hash_unit(seed, *parts: str | Column) -> Column:
    """The first 32 bits of :func:`hash_key` as a number in [0, 1)."""
    head = F.conv(F.substring(hash_key(seed, *parts), 1, 8), 16, 10).cast("bigint")
    return head.cast("double") / F.lit(4294967296.0)


def struct_array(fields: Sequence[str], rows: Sequence[Sequence]) -> Column:
    """A literal array of structs, for small fixed tables that are exploded."""
    return F.array(*[F.struct(*[F.lit(v).alias(f) for f, v in zip(fields, row)]) for row in rows])
