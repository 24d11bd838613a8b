"""Helpers of the operators: scratch tables, payload rows, gapless ranks, Arrow text chunks."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderframe.session import written

CHUNK_BYTES = 1 << 20


def by_value(module_name: str) -> None:
    """Ship the functions of a module inside the tasks, so that executors need no copy of the library."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


by_value(__name__)


def batch_bytes(spark: SparkSession, size: int = 16 << 20) -> None:
    """Bound the bytes of one Arrow batch, so that many long texts never meet in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def fitting(table: DataFrame, most: int = 2_000_000) -> DataFrame:
    """A written table of a few numbers per row, marked for broadcast if it has at most ``most`` rows.

    Beyond that a plain join remains.
    """
    return F.broadcast(table) if table.count() <= most else table


def gapless(df: DataFrame, keys: list[str], order: list[str], out: str, bucket: Column, rows_from: DataFrame | None = None) -> DataFrame:
    """Add ``out``: 0, 1, 2, ... within ``keys``, without a window over a whole key.

    ``bucket`` splits every key into many small ordered buckets. Bucket counts become
    offsets, and ``row_number`` runs inside one bucket only. ``df`` is read twice and
    should be a written table. The numbering follows (bucket, ``order``).
    """
    split = df.withColumn("__bucket", bucket)
    counts = split.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = (Window.partitionBy(*keys) if keys else Window).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order)
    ranked = split.withColumn("__rank", F.row_number().over(inside))
    return (
        ranked.join(offsets, [*keys, "__bucket"])
        .withColumn(out, (F.col("__base") + F.col("__rank") - 1).cast("long"))
        .drop("__bucket", "__base", "__rank")
    )


def strings(array):
    """UTF-8 bytes and offsets of an Arrow string array without copying; nulls read as empty."""
    import pyarrow as pa

    if array.null_count:
        array = array.fill_null("")
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64) if len(array) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def text_chunks(array, most: int = CHUNK_BYTES):
    """Runs of whole texts of about ``most`` bytes: (first, last, bytes, bounds in the bytes)."""
    data, at = strings(array)
    first, n = 0, len(array)
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        last = min(last, n)
        yield first, last, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def floats(array) -> tuple[np.ndarray, np.ndarray]:
    """Flat double values and offsets of an Arrow list of numbers."""
    at = array.offsets.to_numpy().astype(np.int64)
    return array.values.to_numpy(zero_copy_only=False).astype(np.float64), at


def grouped(batches, keys: int):
    """Runs of rows with equal first ``keys`` columns from batches sorted by them, as record batches.

    Holds one batch and one run at a time; callers bound the rows of a run.
    """
    import pyarrow as pa

    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        joined = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        new = np.zeros(joined.num_rows, bool)
        for k in range(keys):
            values = joined.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= values[1:] != values[:-1]
        cuts = np.concatenate([[0], np.flatnonzero(new)])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield joined.slice(a, b - a)
        held = [joined.slice(int(cuts[-1]))]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def usable(vector: str, *others: str) -> Column:
    """True for vectors that are not null or zero and hold no null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0)
    for other in others:
        whole = whole & F.col(other).isNotNull()
    return F.coalesce(whole, F.lit(False))
