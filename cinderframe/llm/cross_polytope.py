"""Nearest neighbours by inner product with cross-polytope hashing and multiprobe tables.

Vectors are divided by the largest norm and get one more coordinate that makes them unit
vectors; queries get 0 there, so nearness on the sphere is the order of inner products.
Each table applies three rounds of random signs and a fast Hadamard transform, and
hashes to the nearest signed axis. A query probes the axes nearest to it in every
table; candidates are reranked by their exact inner products on original vectors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderframe.llm.shared import batch_bytes, by_value, floats, grouped, usable, written

by_value(__name__)

TABLES, PROBED, BLOCK = 4, 0.25, 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row; the width is a power of two."""
    rows, n = x.shape
    h = 1
    while h < n:
        x = x.reshape(rows, n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(rows, n)
        h *= 2
    return x / np.sqrt(n)


def rotations(vectors: np.ndarray, tables: int = TABLES, seed: int = 5):
    """The pseudo-rotated vectors of each table."""
    n = 1 << max(vectors.shape[1] - 1, 1).bit_length()
    padded = np.zeros((len(vectors), n))
    padded[:, : vectors.shape[1]] = vectors
    for table in range(tables):
        rng, x = np.random.default_rng([seed, table, n]), padded
        for _ in range(3):
            x = hadamard(x * rng.choice([-1.0, 1.0], n))
        yield x


def _buckets(largest: float, query: bool, tables: int, probed: float):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            values, at = floats(batch.column(1))
            rows_out, buckets = [], []
            for n in np.unique(np.diff(at)):
                rows = np.flatnonzero(np.diff(at) == n)
                x = values[at[rows][:, None] + np.arange(n)]
                if query:
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    unit = np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))])
                else:
                    inside = x / largest
                    unit = np.hstack([inside, np.sqrt(np.maximum(0.0, 1 - np.einsum("ij,ij->i", inside, inside)))[:, None]])
                for table, y in enumerate(rotations(unit, tables)):
                    axes = np.hstack([y, -y])
                    most = max(1, int(axes.shape[1] * probed)) if query else 1
                    near = np.argpartition(-axes, most - 1, axis=1)[:, :most]
                    rows_out.append(np.repeat(rows, most))
                    buckets.append((near + ((table << 32) + (int(n) << 40))).ravel())
            if rows_out:
                rows = np.concatenate(rows_out)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(buckets).astype(np.int64)), batch.column(0).take(pa.array(rows))], ["bucket", "id"])

    return run


def best_of(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int):
    """(query, row, score) of each query's best ``k`` rows by inner product, ties to the smaller id; ``own`` pairs are left out.

    The product of both blocks, on scaled vectors, picks rows up to its rounding error; their exact products decide.
    """
    scale = max(np.abs(queries).max(), 1e-300), max(np.abs(rows).max(), 1e-300)
    a, b = queries / scale[0], rows / scale[1]
    close = a @ b.T
    close[own] = -np.inf
    error = 1e-12 * np.linalg.norm(a, axis=1, keepdims=True) * np.linalg.norm(b, axis=1).max()
    least = np.partition(close, -k, axis=1)[:, -k][:, None] if k < close.shape[1] else np.full((len(close), 1), -np.inf)
    q, v = np.nonzero((close >= least - error) & (close > -np.inf))
    score = np.einsum("ij,ij->i", queries[q], rows[v])
    order = np.lexsort((ids[v], -score, q))
    q, v, score = q[order], v[order], score[order]
    first = np.searchsorted(q, np.arange(len(queries)))
    keep = np.arange(len(q)) - first[q] < k
    return q[keep], v[keep], score[keep]


def _nearest(k: int):
    def run(batches):
        import pyarrow as pa

        for part in grouped(batches, 3):
            asks, ids = part.column(3).to_numpy(zero_copy_only=False), part.column(4).to_numpy()
            values, at = floats(part.column(5))
            names = part.column(6).to_numpy()
            vectors = values[at[0] : at[-1]].reshape(len(ids), -1)
            rows, who = np.flatnonzero(~asks), np.flatnonzero(asks)
            if not len(rows) or not len(who):
                continue
            q, v, score = best_of(vectors[who], vectors[rows], names[rows], ids[who][:, None] == ids[rows][None], k)
            yield pa.RecordBatch.from_arrays([pa.array(ids[who[q]]), pa.array(ids[rows[v]]), pa.array(names[rows[v]]), pa.array(score)], ["asker", "id", "vec_id", "score"])

    return run


def _compare(asked: DataFrame, indexed: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Best ``k`` of each query in each bucket; buckets are cut into blocks of about 1,024 on both sides."""

    def blocked(entries: DataFrame, name: str):
        counts = entries.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
        return entries, counts

    asked, ask_blocks = blocked(asked, "ask_blocks")
    indexed, row_blocks = blocked(indexed, "row_blocks")
    both = ask_blocks.join(row_blocks, "bucket")
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = asked.join(both, "bucket").select("bucket", mine("ask_blocks").alias("i"), every("row_blocks").alias("j"), F.lit(True).alias("asks"), "id")
    rows = indexed.join(both, "bucket").select("bucket", every("ask_blocks").alias("i"), mine("row_blocks").alias("j"), F.lit(False).alias("asks"), "id")
    wide = asks.union(rows).join(vectors, "id").select("bucket", "i", "j", "asks", "id", "vector", "name")
    dealt = wide.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return dealt.mapInArrow(_nearest(k), "asker long, id long, vec_id long, score double")


def search(
    vectors: DataFrame, is_query, k: int = 20, tables: int = TABLES, probed: float = PROBED, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row that satisfies ``is_query``.

    ``is_query`` is a condition on the input's columns. All rows but the query's own are
    candidates; fewer than ``k`` are all returned. Scores are exact inner products; ties
    go to the smaller id. Vectors that are null, zero, or hold null or non-finite
    components, and null ids, take no part; vectors of another length are no candidates.
    Every row with a repeated id is a candidate, for the others of its id too, and asks for itself. An empty table gives no rows.

    Every row is indexed in every table. A query reads the nearest ``probed`` share of axes of
    each table. Queries that found fewer than ``k`` are compared with all rows, in blocks.
    """
    spark = vectors.sparkSession
    batch_bytes(spark)
    kept = vectors.select(F.col(f"`{id_col}`").cast("long").alias("name"), F.col(f"`{vector_col}`").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = written(kept.filter(usable("vector", "name")).withColumn("id", F.monotonically_increasing_id()), "search-rows")
    doubled = rows.select("id", F.col("vector").cast("array<double>").alias("vector"), "asks")
    most = F.array_max(F.transform("vector", F.abs))
    norm = most * F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + (x / most) * (x / most)))
    largest = doubled.agg(F.max(norm).alias("m")).head()["m"] or 1.0
    indexed = written(doubled.select("id", "vector").mapInArrow(_buckets(largest, False, tables, probed), "bucket long, id long"), "index")
    asked = doubled.filter("asks").select("id", "vector").mapInArrow(_buckets(largest, True, tables, probed), "bucket long, id long")
    asked = written(asked, "probes")
    plain = rows.select("id", "vector", "name")
    found = written(_compare(asked, indexed, plain, k), "found")
    counts = found.groupBy("asker").agg(F.countDistinct("id").alias("n")).filter(F.col("n") >= k).select(F.col("asker").alias("id"))
    length = F.size("vector").cast("long").alias("bucket")
    short = written(rows.filter("asks").join(counts, "id", "left_anti").select(length, "id"), "short")
    if not short.isEmpty():
        found = found.union(_compare(short, rows.select(length, "id"), plain, k))
    once = found.repartition("asker").groupBy("asker", "id").agg(F.max("vec_id").alias("vec_id"), F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id", "id"))
    best = once.withColumn("rank", place.cast("int")).filter(F.col("rank") <= k)
    names = rows.filter("asks").select(F.col("id").alias("asker"), F.col("name").alias("query_id"))
    return best.join(names, "asker").select("query_id", "rank", "vec_id", "score")
