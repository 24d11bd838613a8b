"""Embedding near duplicates: p-stable hashing in Euclidean space, then exact cosines.

On normalised vectors a cosine is a distance. A table's key is the floor of 16 random
Gaussian projections, shifted and divided by a bucket width; vectors at the threshold
0.93 share one of the 96 tables with probability 0.9995, orthogonal ones one table with 1e-5.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderframe.llm.components import connected_components
from cinderframe.llm.shared import batch_bytes, by_value, floats, grouped, usable, written
from cinderframe.llm.words import U, mix, numbers

by_value(__name__)

TABLES, PROJECTIONS, WIDTH, BLOCK = 96, 16, 2.0, 1024
PAIRS = 1 << 15  # pairs whose tables are compared at once


def table_keys(vectors: np.ndarray, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH) -> np.ndarray:
    """One 64-bit key per vector and table."""
    rng = np.random.default_rng(vectors.shape[1])
    directions = rng.standard_normal((vectors.shape[1], tables * projections))
    shifts = rng.random(tables * projections)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    cells = np.floor(unit @ directions / width + shifts).astype(np.int64).view(U)
    keys = np.broadcast_to(numbers(tables, 404), (len(vectors), tables)).copy()
    for k in range(projections):
        keys = mix(keys ^ cells[:, k::projections])
    return keys


def _hashed(batches):
    import pyarrow as pa

    for batch in batches:
        values, at = floats(batch.column(3))
        label = batch.column(1).to_numpy()
        keys = np.empty((batch.num_rows, TABLES), U)
        for n in np.unique(np.diff(at)):
            rows = np.flatnonzero(np.diff(at) == n)
            keys[rows] = mix(table_keys(values[at[rows][:, None] + np.arange(n)]) ^ mix(label[rows].astype(U) * U(3) + U(n)[None])[:, None])
        ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * TABLES)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(keys.ravel().view(np.int64)))], ["rep", "label", "copies", "vector", "keys"])


def _links(threshold: float):
    def links_of(run):
        """Links of one pair of blocks that no earlier table shows: counts for members, and a spanning forest."""
        table, left, right = run.column(1)[0].as_py(), run.column(2)[0].as_py(), run.column(3)[0].as_py()
        block, rep = run.column(4).to_numpy(), run.column(5).to_numpy()
        copies, label = run.column(6).to_numpy(), run.column(7).to_numpy()
        values, at = floats(run.column(8))
        keys, key_at = run.column(9).values.to_numpy(), run.column(9).offsets.to_numpy()
        vectors = values[at[0] : at[-1]].reshape(len(rep), -1)
        keys = keys[key_at[0] : key_at[-1]].reshape(len(rep), -1)
        norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        close = (vectors @ vectors.T) / np.outer(norms, norms) >= threshold
        a, b = np.nonzero(np.triu(close, 1) if left == right else close & (block == left)[:, None] & (block == right)[None])
        cuts = range(0, len(a), PAIRS)
        first = np.concatenate([(keys[a[k : k + PAIRS]] == keys[b[k : k + PAIRS]]).argmax(axis=1) == table for k in cuts] or [np.zeros(0, bool)])
        first &= (label[a] == label[b]) & (rep[a] != rep[b])
        a, b = a[first], b[first]
        count = np.bincount(a, copies[b], len(rep)) + np.bincount(b, copies[a], len(rep))
        lowest = rep.copy()
        while True:
            before = lowest.copy()
            np.minimum.at(lowest, a, lowest[b])
            np.minimum.at(lowest, b, lowest[a])
            if (before == lowest).all():
                break
        some = np.flatnonzero(count)
        return rep[some], count[some].astype(np.int64), lowest[some]

    def run(batches):
        import pyarrow as pa

        found, held = [], 0
        for part in grouped(batches, 4):
            if part.num_rows > 1:
                found.append(links_of(part))
                held += len(found[-1][0])
            if held > 50_000 or len(found) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["rep", "links", "lowest"])
                found, held = [], 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["rep", "links", "lowest"])

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) per vector; only vectors of equal, non-null labels link.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a
    null label, link with nothing. Vectors of different lengths never link. Rows with a null
    id are their own component with a null ``component_id`` and are kept. Repeated rows count as other vectors,
    also where they share an id; unlike vectors of one id link each for itself.

    Equal vectors of a label become one representative with a count. Vectors travel only
    to buckets that hold several representatives, in blocks of about 1,024, and a pair of
    blocks is one bounded matrix product. A pair counts in the first table in which it
    meets, so no list of pairs exists; each product returns counts and a spanning forest.
    """
    spark = vectors.sparkSession
    batch_bytes(spark)
    source = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("vector"), F.col(f"`{label_col}`").cast("long").alias("label"))
    marked = source.withColumns({"ok": usable("vector", "label", "id"), "h1": F.xxhash64("vector"), "h2": F.hash("vector")})
    copies = marked.filter("ok").groupBy("label", "h1", "h2").agg(F.min("id").alias("smallest"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    # A node is a vector, not an id, which unlike vectors may share.
    reps = written(copies.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    doubles = reps.select("rep", "label", "copies", F.col("vector").cast("array<double>").alias("vector"))
    hashed = written(doubles.mapInArrow(_hashed, "rep long, label long, copies long, vector array<double>, keys array<bigint>").withColumn("vector", F.col("vector").cast("array<float>") if dict(vectors.dtypes)[vector_col] == "array<float>" else F.col("vector")), "hashed")
    entries = hashed.select("rep", F.posexplode("keys").alias("table", "key"))
    full = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = entries.join(full, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    sides = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sides = sides.select("key", "table", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "rep")
    wide = sides.join(hashed, "rep").select("key", "table", "left", "right", "block", "rep", "copies", "label", "vector", "keys")
    dealt = wide.repartition("key", "table", "left", "right").sortWithinPartitions("key", "table", "left", "right")
    links = written(dealt.mapInArrow(_links(threshold), "rep long, links long, lowest long"), "vector-links")
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = connected_components(links, "rep", "lowest").select(F.col("node").alias("rep"), F.col("component").alias("group"))
    named = groups.join(reps.select("rep", "smallest"), "rep")
    component = named.groupBy("group").agg(F.min("smallest").alias("component"))
    groups = named.join(component, "group").select("rep", "component")
    found = reps.select("label", "h1", "h2", "rep", "smallest", "copies").join(counts, "rep", "left").join(groups, "rep", "left")
    found = found.select(
        F.col("label").alias("f_label"), F.col("h1").alias("f1"), F.col("h2").alias("f2"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "smallest").alias("component")
    )
    joined = marked.join(found, marked["ok"] & (marked["label"] == found["f_label"]) & (marked["h1"] == found["f1"]) & (marked["h2"] == found["f2"]), "left")
    component = F.coalesce("component", "id")
    return joined.select(
        F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    )
