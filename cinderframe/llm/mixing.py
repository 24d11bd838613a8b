"""Mixing sources to target weights by Poisson replication. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderframe.functions.joins import join_metadata
from cinderframe.llm.shared import gapless, written

#: A rate above this is drawn as a sum of equal parts, each with its own hash.
PART = 32.0
#: Counts of one part beyond this have a probability below 1e-16.
MOST = 110
#: Steps of a binary search among 127 places.
STRIDES = (64, 32, 16, 8, 4, 2, 1)
#: Tables of more sources, about 1 KB each, are not broadcast.
SOURCES = 20_000
BUCKET_DIGITS = 3


def unit(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an md5 over ``parts``."""
    head = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return F.conv(head, 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None, alpha: float, source_col: str, text_col: str, volume: float) -> DataFrame:
    """(source, rate): how often a document of each source is repeated on average.

    A source's share of the mix is its target weight over all weights; without weights
    it is its size to the power ``alpha``. Sizes are UTF-8 bytes plus one per document;
    the mix holds ``volume`` times the bytes of the input. A source with no
    weight gets rate 0.
    """
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 1
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(size).cast("double").alias("size"))
    if weights is None:
        weight = F.pow("size", F.lit(alpha))
    else:
        weight = F.lit(0.0)
        for source, value in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(float(value))).otherwise(weight)
    each = written(sizes.withColumn("weight", weight), "source-sizes")
    totals = each.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight")).head()
    scale = volume * (totals["all_size"] or 0.0) / (totals["all_weight"] or 1.0)
    return each.select("source", (F.lit(scale) * F.col("weight") / F.col("size")).alias("rate"))


def cumulative(rates: DataFrame) -> DataFrame:
    """Add ``parts`` and ``upto``: P(count <= k) of a part's Poisson distribution for k = 0, 1, ..., then 2 up to 127 places."""
    mean = F.col("rate") / F.col("parts")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + p)).alias("c"))

    table = F.aggregate(F.sequence(F.lit(1), F.lit(MOST - 1)), start, step, lambda s: s["c"])
    padded = F.concat(table, F.array_repeat(F.lit(2.0), 2 * STRIDES[0] - 1 - MOST))
    return rates.withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")).withColumn("upto", padded)


def draws(rate: Column, parts: Column, upto: Column, seed: str, *keys: Column) -> Column:
    """Invert the Poisson distribution with mean ``rate`` at a number hashed from seed and keys: seven steps of a binary search in ``upto``."""

    def one(part: Column) -> Column:
        u = unit(F.lit(seed), *keys, part.cast("string"))
        strides = F.array(*[F.lit(n) for n in STRIDES])
        return F.aggregate(strides, F.lit(0), lambda k, n: k + F.when(F.get(upto, k + n - 1) <= u, n).otherwise(0))

    return F.when(rate <= 0, F.lit(0)).otherwise(F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda n, part: n + one(part)))


def replicate(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    alpha: float = 0.5,
    volume: float = 1.0,
    seed: str = "mix",
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """(row, copy, order_key): each input row, as a struct, as often as its draw says.

    ``order_key`` is an md5 over seed, id and copy; sorting by it is the global shuffle.
    Documents whose draw is 0 are absent, as the target weights demand. Equal ids of
    one source draw alike. A null id hashes as the empty text, null sources are one
    source of their own, a null text has size 1, and an empty table gives no rows.
    """
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    facts = base.select(F.coalesce(F.col(f"row.`{source_col}`").cast("string"), F.lit("\0null")).alias("source"), F.col(f"row.`{text_col}`").alias("text"))
    named = {("\0null" if k is None else k): v for k, v in weights.items()} if weights is not None else None
    table = written(cumulative(rates(facts, named, alpha, "source", "text", volume)), "source-draws")
    key = F.coalesce(F.col(f"row.`{id_col}`").cast("string"), F.lit(""))
    keyed = base.select("row", key.alias("key"), F.coalesce(F.col(f"row.`{source_col}`").cast("string"), F.lit("\0null")).alias("source"))
    drawn = draws(F.col("rate"), F.col("parts"), F.col("upto"), seed, F.col("key"))
    counted = join_metadata(keyed, table, ["source"], max_rows=SOURCES).withColumn("times", drawn)
    copies = counted.filter("times > 0").select("row", "key", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("copy"))
    return copies.select("row", "copy", F.md5(F.concat_ws("|", F.lit(seed), "key", F.col("copy").cast("string"), F.lit("order"))).alias("order_key"))


def positions(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Number the copies 0, 1, 2, ... in shuffled order; ``columns`` of the row are carried along.

    The first hex digits of the order key are 4,096 ordered buckets of equal expected size.
    """
    narrow = written(mixed.select(*[F.col(f"row.`{c}`").alias(c) for c in columns], "copy", "order_key"), "mixed")
    return gapless(narrow, [], ["order_key", *columns, "copy"], "position", F.substring("order_key", 1, BUCKET_DIGITS))
