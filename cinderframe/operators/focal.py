"""Wind kernels and 8-neighbour scores, scattered from blazing cells only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderframe.functions.columns import BLAZING, clip, struct_array
from cinderframe.functions.grid import Grid
from cinderframe.functions.joins import join_metadata
from cinderframe.operators.cells import base_probability

# Strength of the wind's pull, the speed (km/h) it is measured in, and the least weight of a neighbour.
WIND_WEIGHT, SPEED_UNIT, LEAST_WEIGHT = 0.20, 10.0, 0.05

TILE = 32
NEIGHBOURS = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr, dc) != (0, 0)]


def kernel_array(speed_kmh: Column, direction_deg: Column, wind_weight: float = WIND_WEIGHT) -> Column:
    """Eight ``(dr, dc, weight)`` structs for a wind that blows FROM ``direction_deg``.

    ``weight`` belongs to the neighbour at ``(r + dr, c + dc)``: fire travels
    from it to the centre, so an upwind neighbour weighs more than 1.
    """
    blow = F.radians(F.pmod(direction_deg + F.lit(180.0), F.lit(360.0)))
    blow_r, blow_c = -F.cos(blow), F.sin(blow)
    pull = F.lit(wind_weight) * (speed_kmh / F.lit(SPEED_UNIT))

    def weigh(offset: Column) -> Column:
        dr, dc = offset["dr"], offset["dc"]
        length = F.sqrt((dr * dr + dc * dc).cast("double"))
        alignment = (-dr / length) * blow_r + (-dc / length) * blow_c
        weight = F.greatest(F.lit(1.0) + pull * alignment, F.lit(LEAST_WEIGHT))
        return F.struct(dr.alias("dr"), dc.alias("dc"), weight.alias("weight"))

    return F.transform(struct_array(["dr", "dc"], NEIGHBOURS), weigh)


def kernel_total(kernel: Column) -> Column:
    return F.aggregate(kernel, F.lit(0.0), lambda acc, k: acc + k["weight"])


def with_kernel(winds: DataFrame, wind_weight: float = 0.20) -> DataFrame:
    """Add ``kernel`` and ``kernel_sum`` to rows with ``speed_kmh`` and ``direction_deg``."""
    return winds.withColumn(
        "kernel", kernel_array(F.col("speed_kmh"), F.col("direction_deg"), wind_weight)
    ).withColumn("kernel_sum", kernel_total(F.col("kernel")))


def kernel_table(winds: DataFrame, keys: Sequence[str], wind_weight: float = 0.20) -> DataFrame:
    """One row per wind and neighbour offset."""
    return (
        with_kernel(winds, wind_weight)
        .select(*keys, "kernel_sum", F.explode("kernel").alias("k"))
        .select(*keys, "k.dr", "k.dc", "k.weight", "kernel_sum")
    )


def to_tiles(sources: DataFrame, keys: Sequence[str], tile: int = TILE, tasks: int | None = None) -> DataFrame:
    """Spread source rows by square tile; rows at a tile's rim also go to the next tile.

    A tile is bounded by ``tile * tile`` cells, so no partition can be hot, and
    all that a target needs is in its own tile: this is the only shuffle of a
    neighbourhood, of the sources themselves and not of their 8 messages each.
    A task holds a sum per target of its sources, several times their bytes in the shuffle: ``tasks``, which
    should follow the number of sources, bounds that; without it Spark sizes tasks by the bytes alone.
    """

    def near(axis: str) -> Column:
        cell = F.col(axis)
        return F.array_distinct(F.array(*[F.floor((cell + d) / F.lit(tile)).cast("int") for d in (-1, 0, 1)]))

    placed = sources.withColumn("tile_r", F.explode(near("r"))).withColumn("tile_c", F.explode(near("c")))
    return placed.repartition(*([tasks] if tasks else []), *keys, "tile_r", "tile_c")


def scatter(tiled: DataFrame, kernel: Column, carry: Sequence[str], grid: Grid | None = None, tile: int = TILE) -> DataFrame:
    """Send every tiled source row to its targets in the tile, off-grid ones dropped."""
    keep = [*carry, "tile_r", "tile_c"]
    spread = tiled.select(*keep, "r", "c", F.explode(kernel).alias("k")).select(
        *keep,
        (F.col("r") - F.col("k.dr")).alias("r"),
        (F.col("c") - F.col("k.dc")).alias("c"),
        F.col("k.weight").alias("weight"),
    )
    own = (F.floor(F.col("r") / F.lit(tile)) == F.col("tile_r")) & (F.floor(F.col("c") / F.lit(tile)) == F.col("tile_c"))
    return spread.filter(own & grid.contains(F.col("r"), F.col("c")) if grid else own)


def neighbour_counts(
    snapshots: DataFrame,
    grid: Grid | None = None,
    keys: Sequence[str] = ("run_id", "step"),
    state: int = BLAZING,
    *,
    tasks: int | None = None,
) -> DataFrame:
    """Number of blazing neighbours, for cells that have at least one; ``tasks`` as in :func:`to_tiles`."""
    ones = struct_array(["dr", "dc", "weight"], [(dr, dc, 1.0) for dr, dc in NEIGHBOURS])
    blazing = snapshots.filter(F.col("state") == state).select(*keys, "r", "c")
    targets = scatter(to_tiles(blazing, keys, tasks=tasks), ones, keys, grid)
    counts = targets.groupBy(*keys, "tile_r", "tile_c", "r", "c").agg(F.count(F.lit(1)).alias("neighbor_burning_count"))
    return counts.drop("tile_r", "tile_c")


def neighbour_scores(
    snapshots: DataFrame,
    winds: DataFrame,
    grid: Grid | None = None,
    *,
    keys: Sequence[str] = ("run_id", "step"),
    wind_key: str = "run_id",
    wind_weight: float = 0.20,
    tasks: int | None = None,
) -> DataFrame:
    """Blazing-neighbour count and normalised wind-weighted score per target cell.

    The work is 8 x blazing rows, whatever the size of the grid. The tiles'
    partitioning also serves the ``groupBy``, which therefore shuffles nothing.
    ``tasks`` as in :func:`to_tiles`.
    """
    winds = with_kernel(winds, wind_weight).select(wind_key, "kernel", "kernel_sum")
    blazing = snapshots.filter(F.col("state") == BLAZING).select(*keys, "r", "c")
    tiled = join_metadata(to_tiles(blazing, keys, tasks=tasks), winds, [wind_key])
    targets = scatter(tiled, F.col("kernel"), [*keys, "kernel_sum"], grid)
    return (
        targets.groupBy(*keys, "tile_r", "tile_c", "r", "c")
        .agg(
            F.count(F.lit(1)).alias("neighbor_burning_count"),
            F.sum("weight").alias("wind_score"),
            F.max("kernel_sum").alias("kernel_sum"),
        )
        .drop("tile_r", "tile_c")
        .withColumn("wind_weighted_score", F.col("wind_score") / F.col("kernel_sum"))
    )


def densify(cells: DataFrame, scores: DataFrame, on: Sequence[str] = ("r", "c")) -> DataFrame:
    """Every cell with its scores, 0 where no neighbour blazes."""
    return cells.join(scores, list(on), "left").na.fill(
        {"neighbor_burning_count": 0, "wind_score": 0.0, "wind_weighted_score": 0.0}
    )


def rule_probability(weights: dict[str, float] | None = None) -> Column:
    """Rule-based ignition probability from risks and the normalised score."""
    base = base_probability(weights) if weights else base_probability()
    return clip(base * F.col("wind_weighted_score"), 0.0, 1.0)
