"""Feature rows of the learning schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderframe.functions.joins import co_located, join_metadata
from cinderframe.operators.cells import composite_flammability

# The ten base features, in order.
SCHEMA_B = (
    "slope_risk",
    "proximity_risk",
    "building_presence",
    "material_risk",
    "wind_speed",
    "wind_sin",
    "wind_cos",
    "neighbor_burning_count",
    "composite_flammability",
    "wind_weighted_score",
)
SCHEMA_9 = tuple(f for f in SCHEMA_B if f != "wind_weighted_score")
SCHEMA_C = SCHEMA_B[:4] + ("material_class",) + SCHEMA_B[4:]
SCHEMA_A = tuple(f for f in SCHEMA_C if f != "wind_weighted_score")
SCHEMAS = {"A": SCHEMA_A, "B": SCHEMA_B, "C": SCHEMA_C, "9": SCHEMA_9}

# Names of the interaction features and their factors.
INTERACTIONS = {
    "slope_x_neighbors": ("slope_risk", "neighbor_burning_count"),
    "wind_x_neighbors": ("wind_speed", "neighbor_burning_count"),
    "slope_x_building": ("slope_risk", "building_presence"),
    "slope_x_wind": ("slope_risk", "wind_speed"),
    "proximity_x_building": ("proximity_risk", "building_presence"),
    "proximity_x_neighbors": ("proximity_risk", "neighbor_burning_count"),
    "neighbors_squared": ("neighbor_burning_count", "neighbor_burning_count"),
}


def static_features(schema: str) -> list[str]:
    """Features of a schema that a cell has at every step."""
    return ["slope_risk", "proximity_risk", "building_presence", "material_risk", *(["material_class"] if "material_class" in SCHEMAS[schema] else [])]


def encode_wind(winds: DataFrame) -> DataFrame:
    """Wind speed and the sine and cosine of its bearing, one row per run."""
    bearing = F.radians("direction_deg")
    return winds.withColumns(
        {"wind_speed": F.col("speed_kmh"), "wind_sin": F.sin(bearing), "wind_cos": F.cos(bearing)}
    )


def assemble(
    rows: DataFrame,
    env: DataFrame | None,
    winds: DataFrame,
    schema: str = "B",
    keep: Sequence[str] = ("run_id", "step", "r", "c"),
    *,
    tasks: int | None = None,
) -> DataFrame:
    """Join dynamic rows with static cell risks and the run's wind.

    Without ``env`` the rows have the risks of their cell already. An absent wind score counts as 0, as for cells without blazing neighbours. ``tasks``, which should follow the
    number of rows, bounds what a task of the join with the cells sorts.
    """
    wind = encode_wind(winds).select("run_id", "wind_speed", "wind_sin", "wind_cos")
    placed = rows if env is None else co_located(rows, env.select("r", "c", *static_features(schema)), ["r", "c"], tasks=tasks)
    joined = join_metadata(placed, wind, ["run_id"])
    if "wind_weighted_score" not in rows.columns:
        joined = joined.withColumn("wind_weighted_score", F.lit(0.0))
    joined = joined.withColumns(
        {
            "composite_flammability": composite_flammability(),
            "wind_weighted_score": F.coalesce(F.col("wind_weighted_score"), F.lit(0.0)),
        }
    )
    extra = [c for c in ("ignited",) if c in rows.columns]
    return joined.select(*keep, *[F.col(f).cast("double").alias(f) for f in SCHEMAS[schema]], *extra)


def feature_vectors(rows: DataFrame, schema: str, keep: Sequence[str] = ("run_id", "step", "r", "c")) -> DataFrame:
    """``keep`` and ``feature_values``, the features of a schema as one array in its order.

    The contract is checked twice: the columns besides ``keep`` must be the schema's, in order, before
    anything runs; and a row with an absent or non-finite value fails the job with its key.
    """
    names = [c for c in rows.columns if c not in keep]
    if names != list(SCHEMAS[schema]):
        raise ValueError(f"schema {schema} wants {list(SCHEMAS[schema])}, got {names}")
    values = F.array(*[F.col(f).cast("double") for f in names])
    good = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    key = F.concat_ws(", ", *[F.col(k).cast("string") for k in keep])
    message = F.concat(F.lit(f"schema {schema}: absent or non-finite feature at "), key)
    return rows.select(*keep, F.when(good, values).otherwise(F.raise_error(message).cast("array<double>")).alias("feature_values"))


def add_interactions(rows: DataFrame) -> DataFrame:
    return rows.withColumns({name: F.col(a) * F.col(b) for name, (a, b) in INTERACTIONS.items()})


def project(rows: DataFrame, drop: Sequence[str] = (), target: str = "ignited") -> DataFrame:
    """Drop the target and the named columns; absent names are ignored."""
    return rows.drop(*drop, target)
