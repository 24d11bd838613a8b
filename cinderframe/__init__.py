"""Grid-cell analytics on Spark DataFrames.

A cell is a row, a raster layer is a column, a run and a step are keys, a
kernel is an offset array and a score is a ``groupBy``.
"""

__version__ = "0.1.0"
