"""Cell-level masks, risk layers, crops and indexes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderframe.functions.columns import clip, flat_index
from cinderframe.functions.grid import Grid

LAYERS = ("slope_raw", "proximity_raw", "buildings_raw", "materials_raw")

# Risk of material classes 0 to 5.
MATERIAL_LEGEND = (0.0, 0.95, 0.80, 0.48, 0.30, 0.15)

# Weights of the rule-based ignition probability.
BASE_WEIGHTS = {"base": 0.12, "slope": 0.20, "building": 0.10, "proximity": 0.20, "material": 0.35}


def with_masks(cells: DataFrame, sentinel: float = -9999.0) -> DataFrame:
    """Add ``nodata_any``, ``ocean``, ``nodata`` (either) and ``burnable``."""
    missing = F.col("slope_raw") == -9999.0
    zero = F.lit(True)
    for layer in LAYERS:
        missing = missing | (F.col(layer) == F.lit(float(sentinel)))
        zero = zero & (F.col(layer) == 0.0)
    return cells.withColumns(
        {"nodata_any": missing, "ocean": zero, "nodata": missing | zero, "burnable": ~(missing | zero)}
    )


def with_risks(masked: DataFrame) -> DataFrame:
    """Scale raw layers to risks; all but building presence are 0 on nodata."""
    slope = F.when(F.col("slope_raw").between(0, 10), F.col("slope_raw")).otherwise(0.0)

    def unless_nodata(value: Column) -> Column:
        return F.when(F.col("nodata"), F.lit(0.0)).otherwise(value / 10.0)

    return masked.withColumns(
        {
            "slope_risk": unless_nodata(slope),
            "proximity_risk": unless_nodata(F.col("proximity_raw")),
            "building_presence": (F.col("buildings_raw") == 10.0).cast("int"),
            "material_risk": unless_nodata(F.col("materials_raw")),
        }
    )


def environment(cells: DataFrame, sentinel: float = -9999.0) -> DataFrame:
    return with_risks(with_masks(cells, sentinel))


def legend_risk(material_class: str | Column, legend: Sequence[float] = MATERIAL_LEGEND) -> Column:
    """Risk of a class by position in the legend, null outside it."""
    value = F.col(material_class) if isinstance(material_class, str) else material_class
    return F.get(F.array(*[F.lit(float(v)) for v in legend]), value.cast("int"))


def valid_class(raw: str | Column, classes: int = len(MATERIAL_LEGEND), atol: float = 1e-6, rtol: float = 1e-5) -> Column:
    """True where the value is finite and within tolerance of a known class."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    nearest = F.rint(raw)
    finite = ~F.isnan(raw) & (F.abs(raw) != F.lit(float("inf")))
    close = F.abs(raw - nearest) <= F.lit(atol) + F.lit(rtol) * F.abs(nearest)
    return F.coalesce(finite & close & nearest.between(0, classes - 1), F.lit(False))


def class_offenders(cells: DataFrame, raw: str, n: int = 10) -> DataFrame:
    """The first ``n`` distinct invalid class values and how often each occurs."""
    bad = cells.filter(~valid_class(raw))
    return bad.groupBy(F.col(raw).alias("value")).agg(F.count(F.lit(1)).alias("cells")).orderBy("value").limit(n)


def first_distinct(df: DataFrame, value: str, n: int = 10) -> DataFrame:
    """The first ``n`` distinct values in order; the limit is the report's size."""
    return df.select(value).distinct().orderBy(value).limit(n)


def require_class(raw: str, classes: int = len(MATERIAL_LEGEND)) -> Column:
    """The class as a whole number; a bad value fails the job with its text."""
    return F.when(valid_class(raw, classes), F.rint(F.col(raw)).cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("invalid material class: "), F.col(raw).cast("string"))).cast("int")
    )


def override_class_zero(env: DataFrame, material_class: str = "material_class") -> DataFrame:
    """Class 0 means no building, and no building means no material risk."""
    building = F.when(F.col(material_class) == 0, 0).otherwise(F.col("building_presence"))
    return env.withColumn("building_presence", building.cast("int")).withColumn(
        "material_risk", F.when(F.col("building_presence") > 0, legend_risk(material_class)).otherwise(0.0)
    )


def crop(cells: DataFrame, grid: Grid, r0: int, c0: int, height: int, width: int) -> DataFrame:
    """Cells of a window, re-indexed to it, with their map coordinates.

    The filter is a plain range on ``r`` and ``c``, so it reaches a Parquet scan.
    """
    inside = (F.col("r") >= r0) & (F.col("r") < r0 + height) & (F.col("c") >= c0) & (F.col("c") < c0 + width)
    window = grid.crop(r0, c0, height, width)
    local = cells.filter(inside).withColumns({"r": F.col("r") - r0, "c": F.col("c") - c0})
    return local.withColumns({"x": window.x_centre(F.col("c")), "y": window.y_centre(F.col("r"))})


def composite_flammability() -> Column:
    return F.col("building_presence").cast("double") * F.col("material_risk")


def base_probability(weights: dict[str, float] = BASE_WEIGHTS) -> Column:
    total = (
        F.lit(weights["base"])
        + F.lit(weights["slope"]) * F.col("slope_risk")
        + F.lit(weights["building"]) * F.col("building_presence")
        + F.lit(weights["proximity"]) * F.col("proximity_risk")
        + F.lit(weights["material"]) * F.col("material_risk")
    )
    return clip(total, 0.0, 1.0)


def burnable_index(env: DataFrame, width: int) -> DataFrame:
    """Burnable rows with their flat row-major index."""
    return env.filter("burnable").withColumn("cell_index", flat_index(width))
