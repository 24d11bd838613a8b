"""Grid geometry."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Top-left corner, pixel size and shape of a north-up grid."""

    xmin: float
    ymax: float
    pixel: float
    height: int
    width: int
    crs: str | None = None

    def contains(self, r: Column, c: Column) -> Column:
        return (r >= 0) & (r < self.height) & (c >= 0) & (c < self.width)

    def crop(self, r0: int, c0: int, height: int, width: int) -> Grid:
        """The window's own geometry, with the origin moved to its corner."""
        return replace(
            self,
            xmin=self.xmin + c0 * self.pixel,
            ymax=self.ymax - r0 * self.pixel,
            height=height,
            width=width,
        )

    def row(self, y: Column) -> Column:
        return F.floor((F.lit(self.ymax) - y) / F.lit(self.pixel)).cast("int")

    def col(self, x: Column) -> Column:
        return F.floor((x - F.lit(self.xmin)) / F.lit(self.pixel)).cast("int")

    def row_affine(self, y: Column) -> Column:
        """Row by the inverse affine transform, used as a drift check."""
        return F.floor(F.lit(self.ymax / self.pixel) - y * F.lit(1.0 / self.pixel)).cast("int")

    def col_affine(self, x: Column) -> Column:
        return F.floor(x * F.lit(1.0 / self.pixel) - F.lit(self.xmin / self.pixel)).cast("int")

    def x_centre(self, c: Column) -> Column:
        return F.lit(self.xmin) + (c + F.lit(0.5)) * F.lit(self.pixel)

    def y_centre(self, r: Column) -> Column:
        return F.lit(self.ymax) - (r + F.lit(0.5)) * F.lit(self.pixel)
