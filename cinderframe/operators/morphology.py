"""Dilation and erosion by L1 balls, from the distance transform of square tiles.

A set cell goes to the tiles within reach of it, four at most where tiles are wider than twice the
reach, whatever the size of the ball. Inside a tile the L1 distance to the nearest set and unset cell is found by a pass along the
rows and a pass along the columns, so the cost is that of the tile's cells and does not grow with the ball.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderframe.functions.grid import Grid
from cinderframe.functions.shipping import by_value

by_value(__name__)

TILE = 128


def l1_distance(seeds: np.ndarray) -> np.ndarray:
    """Distance of every cell of an array to the nearest true one; more than any distance inside if there is none."""
    out = np.where(seeds, 0, 2 * sum(seeds.shape))
    for axis in (1, 0):
        at = np.arange(seeds.shape[axis])
        at = at if axis else at[:, None]
        before = np.minimum.accumulate(out - at, axis) + at
        after = np.flip(np.minimum.accumulate(np.flip(out + at, axis), axis), axis) - at
        out = np.minimum(before, after)
    return out


def _measured(n: int, side: int, height: int, width: int, n_keys: int):
    """Cells of one tile within ``n`` of a set cell: their distance to the nearest set and unset cell, up to ``n`` + 1."""

    def run(key, table):
        import pyarrow as pa

        top, left = key[n_keys].as_py() * side, key[n_keys + 1].as_py() * side
        mask = np.zeros((side + 2 * n, side + 2 * n), bool)
        mask[table.column("r").to_numpy() - top + n, table.column("c").to_numpy() - left + n] = True
        core = (slice(n, n + min(side, height - top)), slice(n, n + min(side, width - left)))
        to_set, to_unset = l1_distance(mask)[core], l1_distance(~mask)[core]
        r, c = np.nonzero(to_set <= n)
        columns = [pa.array([key[k].as_py()] * len(r), table.schema.field(k).type) for k in range(n_keys)]
        columns += [pa.array(x.astype(np.int32)) for x in (r + top, c + left, to_set[r, c], np.minimum(to_unset[r, c], n + 1))]
        return pa.table(columns, [*table.schema.names[:n_keys], "r", "c", "to_set", "to_unset"])

    return run


def distances(mask: DataFrame, n: int, grid: Grid, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, r, c, to_set, to_unset`` of cells within L1 distance ``n`` of a set cell, clipped to the grid.

    ``to_unset`` stops at ``n`` + 1; off the grid counts as unset. One shuffle; a tile is bounded, so none is hot.
    """
    keys, side = list(keys), max(TILE, n)
    near = lambda name, size: F.explode(
        F.sequence(F.greatest(F.floor((F.col(name) - n) / side), F.lit(0)).cast("int"), F.least(F.floor((F.col(name) + n) / side), F.lit((size - 1) // side)).cast("int"))
    )
    sent = mask.select(*keys, "r", "c", near("r", grid.height).alias("__i")).select(*keys, "r", "c", "__i", near("c", grid.width).alias("__j"))
    integers = [T.StructField(x, T.IntegerType()) for x in ("r", "c", "to_set", "to_unset")]
    schema = T.StructType([*(mask.schema[k] for k in keys), *integers])
    return sent.groupBy(*keys, "__i", "__j").applyInArrow(_measured(n, side, grid.height, grid.width, len(keys)), schema)


def dilate(mask: DataFrame, n: int, grid: Grid, keys: Sequence[str] = ()) -> DataFrame:
    """Cells within L1 distance ``n`` of a set cell, clipped to the grid."""
    return distances(mask, n, grid, keys).select(*keys, "r", "c")


def erode(mask: DataFrame, n: int, grid: Grid, keys: Sequence[str] = ()) -> DataFrame:
    """Set cells whose whole ball of radius ``n`` is set; off the grid counts as unset."""
    return distances(mask, n, grid, keys).filter(F.col("to_unset") > n).select(*keys, "r", "c")


def variant_flags(mask: DataFrame, max_n: int, grid: Grid, keys: Sequence[str] = ()) -> DataFrame:
    """All erosions and dilations up to ``max_n`` from one measurement.

    The result has one row per cell of the largest dilation and one flag per variant.
    """
    flags = {"original": F.col("to_set") == 0}
    for n in range(1, max_n + 1):
        flags[f"erode_{n}"] = F.col("to_unset") > n
        flags[f"dilate_{n}"] = F.col("to_set") <= n
    return distances(mask, max_n, grid, keys).select(*keys, "r", "c", *[v.alias(k) for k, v in flags.items()])


def variant_names(max_n: int) -> list[str]:
    return ["original"] + [f"{kind}_{n}" for n in range(1, max_n + 1) for kind in ("erode", "dilate")]
