"""Near duplicates of texts by min-max hashing of word shingles, links confirmed on full sets.

Every hash function ("permutation") of a document's shingles yields two signature
values, its minimum and its maximum, so 50 evaluations give 100 values; both agree
with probability equal to the Jaccard similarity. Bands of 5 values make 20 bucket keys:
a pair at 0.85 misses all of them with probability 1e-5.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderframe.llm.components import connected_components
from cinderframe.llm.shared import batch_bytes, by_value, fitting, text_chunks, written
from cinderframe.llm.words import U, WordHasher, mix, numbers, shingles, space_separated

by_value(__name__)

PERMUTATIONS, BAND_ROWS, WORDS = 50, 5, 5
BLOCK = 512


def signature(sets: list[np.ndarray], permutations: int = PERMUTATIONS) -> np.ndarray:
    """Minimum and maximum of every permutation over each non-empty set: (sets, 2 * permutations)."""
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    values, hashed = np.concatenate(sets), np.empty(sum(map(len, sets)), U)
    factors, offsets = numbers(permutations, 101) | U(1), numbers(permutations, 202)
    out = np.empty((len(sets), 2 * permutations), U)
    for k in range(permutations):
        np.multiply(values ^ offsets[k], factors[k], out=hashed)
        out[:, 2 * k] = np.minimum.reduceat(hashed, starts)
        out[:, 2 * k + 1] = np.maximum.reduceat(hashed, starts)
    return out


def band_keys(values: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """One 64-bit key per band of ``rows`` consecutive signature values."""
    bands = values.shape[1] // rows
    keys = np.broadcast_to(numbers(bands, 303), (len(values), bands)).copy()
    for r in range(rows):
        keys = mix(keys ^ values[:, r : bands * rows : rows])
    return keys


def digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of every set and two 64-bit sums over it; zeros for an empty one."""
    size = np.array([len(s) for s in sets], np.int64)
    low, high = np.zeros(len(sets), U), np.zeros(len(sets), U)
    full = [s for s in sets if len(s)]
    if full:
        at, joined = np.cumsum([0, *(len(s) for s in full[:-1])]), np.concatenate(full)
        low[size > 0] = np.add.reduceat(joined, at)
        high[size > 0] = np.add.reduceat(mix(joined ^ U(0x5851F42D4C957F2D)), at)
    return size, low, high


def _sketches(words: int):
    def run(batches):
        import pyarrow as pa

        hasher = WordHasher(space_separated())
        for batch in batches:
            sizes, low, high, keys, counts = [], [], [], [], []
            for _, _, data, bounds in text_chunks(batch.column(1)):
                _, _, hashes, first = hasher.words(data, bounds)
                sets = shingles(hashes, first, words)
                size, a, b = digests(sets)
                full = [s for s in sets if len(s)]
                if full:
                    keys.append(band_keys(signature(full)))
                sizes.append(size), low.append(a), high.append(b)
                counts.append(np.where(size > 0, 2 * PERMUTATIONS // BAND_ROWS, 0))
            flat = np.concatenate([k.ravel() for k in keys] or [np.zeros(0, U)]).view(np.int64)
            at = np.concatenate([[0], np.cumsum(np.concatenate(counts or [np.zeros(0, np.int64)]))]).astype(np.int32)
            column = lambda x: pa.array(np.concatenate(x or [np.zeros(0, np.int64)]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), column(sizes), column(low), column(high), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))],
                ["id", "n_shingles", "d1", "d2", "bands"],
            )

    return run


def _sets(words: int):
    def run(batches):
        import pyarrow as pa

        hasher = WordHasher(space_separated())
        for batch in batches:
            ids = batch.column(0)
            for first, last, data, bounds in text_chunks(batch.column(1)):
                _, _, hashes, at = hasher.words(data, bounds)
                sets = shingles(hashes, at, words)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64)
                size, low, high = digests(sets)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, last - first), pa.array(size), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    ["rep", "n_shingles", "d1", "d2", "grams"],
                )

    return run


def near_duplicates(docs: DataFrame, similar: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, n_shingles, component_id, kept) per document.

    Texts whose sets of ``words``-word shingles share at least ``similar`` (a fraction) of
    their union are linked; ``component_id`` is the smallest id reachable and ``kept`` marks it.
    A text without words, or null, has no shingles and links with nothing. Rows with a null
    id are their own component with a null ``component_id`` and are kept. Repeated rows get equal
    results; unlike texts of one id link each for itself. Other columns are ignored; an empty table gives no rows.

    Documents with equal sets become one representative first, by a 128-bit digest, so
    groups of copies cost one row. Pairs of a bucket are not listed: members meet two
    pivots first, which joins most groups; then every other pair is settled in blocks,
    where only pairs of different components whose exact bounds allow a link leave the join.
    """
    spark = docs.sparkSession
    batch_bytes(spark)
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sketches = written(source.mapInArrow(_sketches(words), "id long, n_shingles long, d1 long, d2 long, bands array<bigint>"), "sketches")
    distinct = sketches.filter("n_shingles > 0 and id is not null").groupBy("d1", "d2", "n_shingles").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"))
    # A node is a set, not an id, of which unlike texts may be repeated rows.
    reps = written(distinct.withColumn("node", F.monotonically_increasing_id()), "representatives")
    labels = _components(source, reps, similar, words).join(reps.select("node", "rep"), "node")
    smallest = labels.groupBy("label").agg(F.min("rep").alias("component"))
    groups = labels.join(smallest, "label").select("node", "component")
    found = reps.select("d1", "d2", "n_shingles", "rep", "node").join(groups, "node", "left")
    found = found.select(F.col("d1").alias("f1"), F.col("d2").alias("f2"), F.coalesce("component", "rep").alias("component"))
    whole = sketches.select("id", "n_shingles", "d1", "d2")
    joined = whole.join(found, (whole["d1"] == found["f1"]) & (whole["d2"] == found["f2"]) & (whole["n_shingles"] > 0) & whole["id"].isNotNull(), "left")
    component = F.coalesce("component", "id")
    return joined.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _components(source: DataFrame, reps: DataFrame, similar: tuple[int, int], words: int) -> DataFrame:
    """(node, label) of representatives that share a bucket; equal labels are one component.

    ``shared`` is the number of a set's shingles that open members of other components have. It
    bounds every intersection with those, so a member whose other shingles are too many is finished at
    once, and a pair is compared only if both bounds allow a link. All such tests are exact.
    """
    part, whole = similar
    keyed = reps.select("node", "n_shingles", F.posexplode("bands").alias("band", "key"))
    several = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    size = F.col("n_shingles")
    members = written(keyed.join(several, "key").select("key", "band", "node", size.alias("size"), size.alias("shared"), F.col("node").alias("label")), "members")
    bucketed = members.select("node").distinct().join(reps.select("node", "rep", "n_shingles", "d1", "d2"), "node")
    bucketed = written(bucketed, "bucketed")
    wanted = written(bucketed.select(F.col("rep").alias("id")).distinct(), "wanted")
    rows = source.join(fitting(wanted), "id", "left_semi").mapInArrow(_sets(words), "rep long, n_shingles long, d1 long, d2 long, grams array<bigint>")
    sets = written(rows.join(fitting(bucketed), ["rep", "n_shingles", "d1", "d2"]).select(F.col("node").alias("id"), "grams"), "sets")
    # One row per set: counts of its shingles bound what it can share.
    again = written(sets.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id"), "repeated")
    if not again.isEmpty():
        once = sets.join(fitting(again), "id", "left_anti")
        sets = written(once.unionByName(sets.join(fitting(again), "id", "left_semi").groupBy("id").agg(F.first("grams").alias("grams"))), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Pairs whose full sets are similar enough, as links between their labels."""
        pairs = written(pairs.select("a", "b", "a_label", "b_label").distinct(), "pairs")
        heads = written(pairs.select(F.col("a").alias("id")).distinct(), "heads")
        with_b = sets.withColumnsRenamed({"id": "b", "grams": "b_grams"}).join(fitting(pairs), "b")
        with_a = sets.join(fitting(heads), "id", "left_semi").withColumnsRenamed({"id": "a", "grams": "a_grams"})
        both = with_b.join(with_a, "a")
        common = F.size(F.array_intersect("a_grams", "b_grams"))
        union = F.size("a_grams") + F.size("b_grams") - common
        return both.filter(common * whole >= union * part).select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))

    def paired(left: DataFrame, right: DataFrame, on: list[str], *more: str) -> DataFrame:
        """Pairs with different labels whose bounds allow a link."""
        a = left.select(*on, *[F.col(c).alias(f"a_{c}") for c in ("size", "shared", "label")], F.col("node").alias("a"), *[f"a_{c}" for c in more])
        b = right.select(*on, *[F.col(c).alias(f"b_{c}") for c in ("size", "shared", "label")], F.col("node").alias("b"), *[f"b_{c}" for c in more])
        most = F.least("a_shared", "b_shared")
        return a.join(b, on).filter((F.col("a_label") != F.col("b_label")) & (most * whole >= (F.col("a_size") + F.col("b_size") - most) * part))

    def bounded(open_members: DataFrame) -> DataFrame:
        """Members with ``shared`` counted anew; those that no set of their bucket can match are left out."""
        left = written(open_members.select(F.col("node").alias("id"), "label").distinct(), "open")
        grams = sets.join(fitting(left), "id").select("id", "label", F.explode("grams").alias("gram"))
        owned = grams.groupBy("gram").agg(F.min("label").alias("first"), F.max("label").alias("last")).filter("first = last").select("gram")
        private = grams.join(owned, "gram").groupBy(F.col("id").alias("node")).agg(F.count(F.lit(1)).alias("private"))
        least = open_members.groupBy("key").agg(F.min("size").alias("least"))
        known = open_members.join(private, "node", "left").join(least, "key")
        shared = F.col("size") - F.coalesce("private", F.lit(0))
        known = known.withColumn("shared", shared)
        possible = F.col("shared") * (whole + part) >= (F.col("size") + F.greatest(F.col("least"), F.ceil(F.col("size") * part / whole))) * part
        return known.filter(possible).select("key", "band", "node", "size", "shared", "label")

    def pivoted(open_members: DataFrame, order: Column) -> DataFrame:
        """The first member of every bucket by ``order`` against all others."""
        pick = F.min_by(F.struct("node", "size", "shared", "label"), order)
        pivots = open_members.groupBy("key").agg(pick.alias("p")).select("key", "p.*")
        return paired(pivots, open_members, ["key"])

    def blocked(open_members: DataFrame) -> DataFrame:
        """Every pair in the first bucket that it shares, in blocks of about ``BLOCK`` members on either side."""
        open_members = open_members.join(reps.select("node", "bands"), "node")
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        placed = open_members.withColumns({"block": F.pmod(F.xxhash64("node"), blocks).cast("int"), "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
        sides = placed.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
        a, b = (sides.filter(f"block = {side}").withColumnRenamed("bands", f"{name}_bands") for side, name in (("low", "a"), ("high", "b")))
        met = F.array_position(F.zip_with("a_bands", "b_bands", lambda x, y: x == y), True) - 1
        pairs = paired(a, b, ["key", "band", "low", "high"], "bands")
        return pairs.filter("low < high or a < b").filter(met == F.col("band"))

    def still_open(members: DataFrame) -> DataFrame:
        """Members of buckets that are not one component yet, with the bucket's size."""
        facts = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("first"), F.max("label").alias("last"))
        return written(members.join(facts.filter("first != last").select("key", "n"), "key"), "members")

    state = members.select("node", "label").distinct()
    # The first node, then the member with the largest shared part: most groups become one component.
    steps = (
        lambda m: pivoted(m, F.struct("node")),
        lambda m: pivoted(m, F.struct((F.col("size") - F.col("shared")) / F.col("size"), F.col("node"))),
        blocked,
    )
    for turn, step in enumerate(steps):
        members = still_open(bounded(members) if turn else members)
        if members.isEmpty():
            break
        merged = written(connected_components(confirmed(step(members))), "merged")
        moved = merged.select(F.col("node").alias("label"), "component")
        relabel = lambda df: df.join(moved, "label", "left").withColumn("label", F.coalesce("component", "label")).drop("component")  # noqa: B023, E731
        members = relabel(members).select("key", "band", "node", "size", "shared", "label")
        state = written(relabel(state).select("node", "label"), "labels")
    return state
