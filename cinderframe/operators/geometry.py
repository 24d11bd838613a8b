"""Points, circles and polygons on the grid.

Shapes are turned into candidate cells by exploding their own rows and columns,
so the work follows the area of the shapes and any join to cells is an equi-join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderframe.functions.columns import squared_distance
from cinderframe.functions.grid import Grid


def locate(points: DataFrame, grid: Grid) -> DataFrame:
    """Cell, cell centre and status of map points.

    ``status`` is ``inside``, ``outside`` or ``drift`` (the two conversion
    formulas disagree); rejects are rows, not errors.
    """
    r, c = grid.row(F.col("y")), grid.col(F.col("x"))
    drift = (r != grid.row_affine(F.col("y"))) | (c != grid.col_affine(F.col("x")))
    status = F.when(drift, "drift").when(grid.contains(r, c), "inside").otherwise("outside")
    return points.withColumns({"r": r, "c": c, "status": status}).withColumns(
        {"x_centre": grid.x_centre(F.col("c")), "y_centre": grid.y_centre(F.col("r"))}
    )


def check_ignitions(points: DataFrame, env: DataFrame) -> DataFrame:
    """Accept or reject points with ``r`` and ``c``, one reason per point."""
    known = env.select("r", "c", "burnable")
    reason = (
        F.when(F.col("burnable").isNull(), "out of bounds")
        .when(~F.col("burnable"), "non-burnable")
        .otherwise("accepted")
    )
    return points.join(known, ["r", "c"], "left").withColumn("reason", reason).drop("burnable")


def circle_cells(
    centres: DataFrame, key: str, radii_m: Sequence[float], pixel: float, grid: Grid | None = None
) -> DataFrame:
    """Cells within each radius of each centre ``(r0, c0)``.

    A centre becomes rows of its largest circle, the rows are spread over the
    cluster, and only then become cells, so one huge circle is many tasks.
    """
    limits = sorted((float(r), (float(r) / pixel) ** 2) for r in radii_m)
    reach = int(max(radii_m) // pixel) + 1
    rows = centres.select(key, "r0", "c0", F.explode(F.sequence(F.col("r0") - reach, F.col("r0") + reach)).alias("r"))
    if grid:
        rows = rows.filter(F.col("r").between(0, grid.height - 1))
    rows = rows.repartition(F.col(key), F.col("r"))
    cells = rows.select("*", F.explode(F.sequence(F.col("c0") - reach, F.col("c0") + reach)).alias("c"))
    if grid:
        cells = cells.filter(F.col("c").between(0, grid.width - 1))
    cells = cells.withColumn("dist2", squared_distance(F.col("r0"), F.col("c0")))
    radii = F.array(*[F.struct(F.lit(r).alias("radius_m"), F.lit(d).alias("limit2")) for r, d in limits])
    inside = F.filter(radii, lambda s: F.col("dist2") <= s["limit2"])
    return cells.select(key, "r", "c", "dist2", F.explode(inside).alias("circle")).select(
        key, F.col("circle.radius_m").alias("radius_m"), "r", "c", "dist2"
    )


def polygon_edges(vertices: DataFrame) -> DataFrame:
    """Edges of every ring, joined by ``seq``, plus the edge that closes the ring."""
    ring = ["poly_id", "ring_id"]
    following = vertices.select(*ring, (F.col("seq") - 1).alias("seq"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    edges = vertices.join(following, [*ring, "seq"]).select("poly_id", F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")
    ends = vertices.groupBy(*ring).agg(
        F.max_by("x", "seq").alias("x1"),
        F.max_by("y", "seq").alias("y1"),
        F.min_by("x", "seq").alias("x2"),
        F.min_by("y", "seq").alias("y2"),
    )
    closing = ends.filter("x1 <> x2 or y1 <> y2").select("poly_id", "x1", "y1", "x2", "y2")
    return edges.unionByName(closing)


def rasterize(vertices: DataFrame, grid: Grid) -> DataFrame:
    """Cells whose centre lies inside a polygon, holes cut out, per ``poly_id``.

    Even-odd rule by scan line: each edge yields one crossing per grid row it
    spans, the sorted crossings of a row pair up into spans, a span becomes cells.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    first = F.greatest(grid.row(high) - 1, F.lit(0))
    last = F.least(grid.row(low) + 1, F.lit(grid.height - 1))
    spanning = polygon_edges(vertices).filter(F.col("y1") != F.col("y2")).withColumns({"__a": first, "__b": last})
    rows = spanning.filter("__a <= __b").withColumn("r", F.explode(F.sequence("__a", "__b")))
    y = grid.y_centre(F.col("r"))
    crossing = F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    crossings = rows.filter((y >= low) & (y < high)).select("poly_id", "r", crossing.alias("x"))
    window = Window.partitionBy("poly_id", "r").orderBy("x")
    spans = crossings.select(
        "poly_id", "r", "x", F.lead("x").over(window).alias("x_end"), F.row_number().over(window).alias("n")
    ).filter("n % 2 = 1")
    c_first = F.greatest(grid.col(F.col("x")) - 1, F.lit(0))
    c_last = F.least(grid.col(F.col("x_end")) + 1, F.lit(grid.width - 1))
    cells = spans.withColumns({"__a": c_first, "__b": c_last}).filter("__a <= __b")
    cells = cells.withColumn("c", F.explode(F.sequence("__a", "__b")))
    x = grid.x_centre(F.col("c"))
    return cells.filter((x >= F.col("x")) & (x < F.col("x_end"))).select("poly_id", "r", "c")


def burn_polygons(vertices: DataFrame, grid: Grid) -> DataFrame:
    """Union of all polygons: each burned cell once."""
    return rasterize(vertices, grid).select("r", "c").distinct()
