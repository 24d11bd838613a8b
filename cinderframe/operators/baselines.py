"""Simple predictions that a model must beat, and burn geometry around an ignition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderframe.functions.columns import squared_distance
from cinderframe.functions.ranking import integer_levels, running_sums


def circle_scores(cells: DataFrame, r0: int, c0: int, radii_m: Sequence[float], pixel: float, truths: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Confusion counts of circles of many radii, per area ``(truth, mask)``.

    Each cell is assigned to the smallest circle that holds it; a circle's
    counts are sums over the rings inside it, so cells are not multiplied.
    """
    limits = [(float(r), (float(r) / pixel) ** 2) for r in sorted(radii_m)]
    d2 = squared_distance(r0, c0)
    outside = sum((d2 > F.lit(limit)).cast("int") for _, limit in limits)
    aggregates = []
    for name, (truth, mask) in truths.items():
        aggregates += [F.count_if(truth & mask).alias(f"{name}__pos"), F.count_if(~truth & mask).alias(f"{name}__neg")]
    rings = cells.groupBy(outside.alias("ring")).agg(*aggregates)
    areas = F.array(
        *[F.struct(F.lit(n).alias("area"), F.col(f"{n}__pos").alias("pos"), F.col(f"{n}__neg").alias("neg")) for n in truths]
    )
    circles = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(r).alias("radius_m")) for i, (r, _) in enumerate(limits)])
    rows = rings.select("ring", F.explode(areas).alias("a")).select("ring", "a.*", F.explode(circles).alias("k"))
    inside = F.col("ring") <= F.col("k.no")

    def total(column: str, when: Column) -> Column:
        return F.sum(F.when(when, F.col(column)).otherwise(0))

    return rows.groupBy(F.col("k.radius_m").alias("radius_m"), "area").agg(
        total("pos", inside).alias("tp"),
        total("neg", inside).alias("fp"),
        total("pos", ~inside).alias("fn"),
        total("neg", ~inside).alias("tn"),
    )


SIZE_BLOCK = 4096


def equal_area_scores(cells: DataFrame, truth: Column, sizes: DataFrame, key: str, r0: int, c0: int) -> DataFrame:
    """``key, n_cells, dist2, tp, fp`` of the circle that holds as many cells as each prediction.

    ``sizes`` has ``key`` and ``n_cells``. Cells are counted per squared distance, with
    running sums over distances. A distance covers a span of circle sizes; spans and
    wanted sizes meet by equal blocks of sizes, so no run is paired with every distance.
    Of the last distance the circle takes the first cells in ``(r, c)`` order, and only
    that rim is ranked.
    """
    placed = cells.select("r", "c", truth.alias("__y"), squared_distance(r0, c0).alias("dist2"))
    counts = placed.groupBy("dist2").agg(F.count(F.lit(1)).alias("n"), F.count_if("__y").alias("pos"))
    levels = integer_levels("dist2")
    ranked = running_sums(counts.withColumns(levels), [], [*levels, "dist2"], ["n", "pos"])
    block = lambda size: F.floor(size / F.lit(SIZE_BLOCK))
    spans = ranked.select("dist2", "n", "n_before", "pos_before", F.explode(F.sequence(block(F.col("n_before") + 1), block(F.col("n_before") + F.col("n")))).alias("__block"))
    wanted = sizes.select(key, "n_cells", block(F.col("n_cells")).alias("__block"))
    hit = (F.col("n_before") < F.col("n_cells")) & (F.col("n_before") + F.col("n") >= F.col("n_cells"))
    circles = wanted.join(spans, "__block").filter(hit).select(key, "n_cells", "dist2", "n_before", "pos_before")
    place = F.row_number().over(Window.partitionBy(key).orderBy("r", "c"))
    rim = placed.join(circles, "dist2").withColumn("__place", place).filter(F.col("__place") <= F.col("n_cells") - F.col("n_before"))
    return rim.groupBy(key, "n_cells", "dist2").agg((F.first("pos_before") + F.count_if("__y")).alias("tp")).withColumn("fp", F.col("n_cells") - F.col("tp"))


def bearing(r0: int, c0: int, r: Column, c: Column) -> Column:
    """Compass bearing in degrees from ``(r0, c0)``; rows grow southward."""
    return F.pmod(F.degrees(F.atan2(c - F.lit(float(c0)), F.lit(float(r0)) - r)), F.lit(360.0))


def centroid_bearing(reached: DataFrame, r0: int, c0: int, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Burn centroid, its offset from the ignition and its bearing."""
    centre = reached.groupBy(*keys).agg(F.avg("r").alias("r_centroid"), F.avg("c").alias("c_centroid"))
    return centre.withColumn("bearing_deg", bearing(r0, c0, F.col("r_centroid"), F.col("c_centroid")))
