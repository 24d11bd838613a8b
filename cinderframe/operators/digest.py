"""Order-defined fingerprints of sparse masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderframe.functions.columns import flat_index
from cinderframe.functions.grid import Grid

BLOCK = 4096


def mask_digest(mask: DataFrame, grid: Grid, keys: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """sha256 of the set cells in row-major order, folded in blocks.

    A block of ``block`` consecutive cell indexes is digested from its set
    offsets, then ``block`` digests at a time are digested, at least once and
    until one is left.
    No group holds more than ``block`` entries, whatever the grid's size. The
    shape is part of the last digest. Rows must be unique per key and cell.
    """
    keys = list(keys)
    index = mask.select(*keys, flat_index(grid.width).alias("i"))
    current = index.select(
        *keys, F.floor(F.col("i") / F.lit(block)).alias("b"), F.pmod("i", F.lit(block)).alias("o"), F.lit(1).cast("bigint").alias("n")
    )
    current = current.groupBy(*keys, "b").agg(
        F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("o")), lambda o: o.cast("string"))), 256).alias("d"),
        F.sum("n").alias("n"),
    )
    blocks = -(-grid.height * grid.width // block)
    while True:
        item = F.struct(F.pmod("b", F.lit(block)).alias("o"), F.col("d"))
        text = F.transform(
            F.array_sort(F.collect_list(item)), lambda s: F.concat(s["o"].cast("string"), F.lit(":"), s["d"])
        )
        current = current.groupBy(*keys, F.floor(F.col("b") / F.lit(block)).alias("b")).agg(
            F.sha2(F.concat_ws(",", text), 256).alias("d"), F.sum("n").alias("n")
        )
        blocks = -(-blocks // block)
        if blocks == 1:
            break
    shape = f"{grid.height}x{grid.width}|bool|"
    return current.select(*keys, F.col("n").alias("cells"), F.sha2(F.concat(F.lit(shape), F.col("d")), 256).alias("sha256"))
