"""Deterministic samples, splits and folds by keyed hash.

``rand()`` changes when a task is retried or the data is repartitioned; an md5
of the seed and the row's keys does not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderframe.functions.columns import hash_key, hash_unit
from cinderframe.functions.joins import join_metadata
from cinderframe.functions.ranking import hash_levels, ordinal
from cinderframe.session import written


PREFIX = 4
#: Up to this many rows per key, Spark limits a window before its shuffle; groups in which tasks merge.
MERGED_ROWS, MERGES = 1000, 64


def hash_cuts(rows: DataFrame, keys: Sequence[str], order: Sequence[str], wanted: Column) -> DataFrame:
    """Per ``keys``, the ``wanted``-th row in the order ``order``, as a struct ``cut``.

    ``order`` starts with a hex hash. Rows are counted by hash prefix (65,536 totals per
    key), the prefix in which the cut falls is found, and only its rows are ranked; no
    row is shuffled otherwise. The prefix and the cut, a row per key each, are written, so the rows are read
    twice here and once by the caller. ``wanted`` may use ``total``, the rows of the key. A key
    with fewer rows gets its last row; one that wants none is absent.
    """
    keys, order = list(keys), list(order)
    prefix = F.substring(order[0], 1, PREFIX)
    counts = rows.groupBy(*keys, prefix.alias("__prefix")).agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("__n").over(whole.orderBy("__prefix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = counts.withColumns({"__before": before, "total": F.sum("__n").over(whole)})
    need = F.least(wanted, F.col("total")).cast("bigint")
    hit = sums.withColumn("__need", need).filter("__before < __need and __need <= __before + __n")
    hit = written(hit.select(*keys, "__prefix", (F.col("__need") - F.col("__before")).alias("__need")), "hash-prefixes")
    inside = join_metadata(rows.withColumn("__prefix", prefix), hit, [*keys, "__prefix"])
    place = F.row_number().over((Window.partitionBy(*keys) if keys else Window.partitionBy("__prefix")).orderBy(*order))
    return written(inside.withColumn("__place", place).filter("__place = __need").select(*keys, F.struct(*order).alias("cut")), "hash-cuts")


def smallest(rows: DataFrame, keys: Sequence[str], order: Sequence[str], k: int, name: str) -> DataFrame:
    """The first ``k`` rows per ``keys`` in the order ``order``, numbered from 1 in ``name``: one scan for a bounded ``k``.

    Every task keeps its own first ``k`` rows of a key before the shuffle (Spark pushes the
    limit below a window's exchange), tasks merge in ``MERGES`` groups, and the groups merge again, so
    no task gets more than ``k`` rows from each task of one group, however hot a key is.
    """
    salted = rows.withColumn("__merge", F.spark_partition_id() % MERGES)
    first = F.row_number().over(Window.partitionBy(*keys, "__merge").orderBy(*order))
    merged = salted.withColumn(name, first).filter(F.col(name) <= k).drop("__merge")
    return merged.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)


def sample_cells(eligible: DataFrame, group: str, k: int) -> DataFrame:
    """``k`` cells per group without replacement, fewer where there are fewer.

    ``eligible`` has a row per group and eligible cell. Small samples are merged from every
    task's own (one scan); for larger ones rows up to the group's cut are
    kept before anything is shuffled, so only the sample itself is sorted, for any ``k``.
    """
    draw = eligible.select(group, "r", "c", hash_key(F.col(group), "r", "c").alias("__h"))
    if k <= MERGED_ROWS:
        return smallest(draw, [group], ["__h", "r", "c"], k, "pick").drop("__h")
    cuts = hash_cuts(draw, [group], ["__h", "r", "c"], F.lit(k))
    kept = join_metadata(draw, cuts, [group]).filter(F.struct("__h", "r", "c") <= F.col("cut"))
    window = Window.partitionBy(group).orderBy("__h", "r", "c")
    return kept.withColumn("pick", F.row_number().over(window)).drop("__h", "cut")


def require_sample(groups: DataFrame, sample: DataFrame, group: str, k: int) -> DataFrame:
    """Fail the job if any group got fewer than ``k`` cells. ``sample`` is read twice and should be a written table."""
    got = sample.groupBy(group).agg(F.count(F.lit(1)).alias("__got"))
    message = F.concat(F.lit(f"not enough eligible cells: requested {k}, group "), F.col(group).cast("string"))
    checked = groups.select(group).join(got, group, "left").select(
        group, F.when(F.coalesce(F.col("__got"), F.lit(0)) >= k, True).otherwise(F.raise_error(message).cast("boolean")).alias("__ok")
    )
    return sample.join(checked, group).filter("__ok").drop("__ok")


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """One row per class. Labels are 0/1, so this is at most two rows."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("class_rows"))


def _ranked(df: DataFrame, label: str, seed: int, ids: Sequence[str | Column], tasks: int | None = None) -> DataFrame:
    """Add the rank in hash order within the class and the size of the class.

    Rows are shuffled with a prefix of their hash alone (65,536 totals per class); the hash itself, which no compression shrinks, is
    drawn again behind the shuffle. A task sorts its share of the rows: ``tasks``, which should follow their number, bounds
    that; they are dealt by class and prefix, so that the join with the buckets' places does not deal them again.
    """
    levels = hash_levels("__hash", (PREFIX,))
    placed = df.withColumns({name: F.substring(hash_key(seed, *ids), 1, int(name[3:])) for name in levels})
    dealt = placed.repartition(*([tasks] if tasks else []), label, *levels).withColumn("__hash", hash_key(seed, *ids))
    return ordinal(dealt, [label], list(levels), ["__hash", *ids], name="__rank", total="__size", counted=placed, tasks=tasks).drop("__hash", *levels)


def stratified_split(df: DataFrame, label: str, ids: Sequence[str], *, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``part`` (train or test) with the same share of each class.

    A row compares itself with the cut of its class, so no row is shuffled. ``df`` is
    read twice here and by every read of the result, and should be a written table.
    """
    hashed = df.withColumn("__hash", hash_key(seed, *ids))
    cuts = hash_cuts(hashed.select(label, "__hash", *ids), [label], ["__hash", *ids], F.round(F.col("total") * F.lit(test)))
    in_test = F.coalesce(F.struct("__hash", *ids) <= F.col("cut"), F.lit(False))
    placed = join_metadata(hashed, cuts, [label], "left")
    return placed.withColumn("part", F.when(in_test, "test").otherwise("train")).drop("__hash", "cut").select(*df.columns, "part")


def stratified_folds(df: DataFrame, label: str, ids: Sequence[str | Column], *, k: int = 5, seed: int = 42, tasks: int | None = None) -> DataFrame:
    """Add ``fold`` 0..k-1, balanced within each class. ``tasks``, which should follow the rows, bounds what a task sorts.

    ``ids`` are columns or are computed from columns. The rows are shuffled whole: give few and narrow columns where there are many.
    """
    fold = ((F.col("__rank") - 1) % k).cast("int")
    return _ranked(df, label, seed, ids, tasks).withColumn("fold", fold).drop("__rank", "__size")


def under_sample(df: DataFrame, label: str, ids: Sequence[str], *, ratio: int = 10, seed: int = 42) -> DataFrame:
    """All positives and at most ``ratio`` negatives for each: the smallest hashes, by one cut."""
    hashed = df.withColumn("__hash", hash_key(seed, *ids))
    wanted = df.filter(F.col(label) == 1).agg(F.count(F.lit(1)) * ratio).scalar()
    negatives = hashed.filter(F.col(label) == 0).select("__hash", *ids)
    cuts = hash_cuts(negatives.withColumn("__wanted", wanted), ["__wanted"], ["__hash", *ids], F.col("__wanted"))
    cut = cuts.agg(F.max("cut")).scalar()
    keep = (F.col(label) == 1) | F.coalesce((F.col(label) == 0) & (F.struct("__hash", *ids) <= cut), F.lit(False))
    return hashed.filter(keep).drop("__hash")


def random_mask(cells: DataFrame, truth: Column, *, seed: int = 42) -> DataFrame:
    """Add ``pred``: true with the truth's positive rate, by keyed draw."""
    rate = cells.agg(F.avg(truth.cast("int"))).scalar()
    return cells.withColumn("pred", hash_unit(seed, "r", "c") < rate)


def class_weights(df: DataFrame, label: str, positive_weight: float = 1.0) -> DataFrame:
    """Weight per strategy and class, from one count: ``balanced`` is n / (2 n_k), ``custom`` weighs positives, ``none`` is 1."""
    counts = class_counts(df, label).withColumn("__n", F.sum("class_rows").over(Window.partitionBy(F.lit(0))))  # two rows
    weights = {
        "balanced": F.col("__n") / (2 * F.col("class_rows")),
        "custom": F.when(F.col(label) == 1, F.lit(float(positive_weight))).otherwise(1.0),
        "none": F.lit(1.0),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("strategy"), w.cast("double").alias("weight")) for n, w in weights.items()])
    return counts.select(label, "class_rows", F.explode(rows).alias("w")).select(label, "class_rows", "w.*")
