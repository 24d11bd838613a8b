"""Connected components as joins and groupings; links stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderframe.llm.shared import written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has a link to another node; component is the smallest node.

    Alternates large-star and small-star steps (Kiveris et al., 2014): every node links
    its larger neighbours, then its smaller ones, to the smallest. Rounds grow with the
    logarithm of the longest chain. Minima are pre-aggregated before the shuffle; the
    joins back are plain, so a hub's hot partition is split by adaptive execution. Each
    round is a written table. Empty input gives an empty result; nulls never link.
    """
    pairs = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u != v")
    edges = written(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while not _stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "links")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = written(small.select("e.u", "e.v").filter("u != v").distinct(), "links")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node that points anywhere points to one node that points nowhere."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select(F.col("v"), F.lit(0), F.lit(1)))
    seen = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    bad = seen.agg(F.max(F.when((F.col("out") > 1) | ((F.col("out") == 1) & (F.col("into") == 1)), 1).otherwise(0)).alias("bad")).head()
    return not bad["bad"]
