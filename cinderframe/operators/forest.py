"""Random forests by histograms over a binned, counted table.

Rows with equal features are counted once, features are binned, and equal bins are counted once
more. A tree's bootstrap sample is a Poisson count per row, drawn from a hash of the row's bins and the
tree, so it needs no copy of the data and does not depend on the partitioning. Large nodes of all trees are
split together, level by level, from histograms summed in Spark; a node with few distinct rows is dealt to one task,
which grows the rest of it. Counts are whole numbers, so every sum is exact in any order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderframe.functions.joins import join_metadata
from cinderframe.functions.shipping import by_value
from cinderframe.session import written

by_value(__name__)

BINS = 32
LOCAL_ROWS = 20_000
NODES = "tree int, node bigint, depth int, feature int, bin int, n0 bigint, n1 bigint"
U = np.uint64


@dataclass(frozen=True)
class Growth:
    """Sizes of a forest; ``weights`` are those of the negative and of the positive class, one pair for all trees or a pair per tree."""

    trees: int = 200
    depth: int = 15
    tried: int = 3  # features tried per node, of those that vary in it
    weights: tuple = ((1.0, 1.0),)
    bootstrap: bool = True
    seed: int = 42

    def weights_of(self, tree: int) -> tuple[float, float]:
        return self.weights[tree % len(self.weights)]


@dataclass(frozen=True)
class Forest:
    """A written table of nodes and the bin edges of the features.

    Node 1 is the root, and 2i and 2i + 1 are the children of i; rows whose bin is at most ``bin``, so whose
    value is at most the edge of that number, go to 2i. ``feature`` is null in leaves. ``n0`` and ``n1`` count
    the tree's sample in the node.
    """

    nodes: DataFrame
    edges: list[np.ndarray]
    features: list[str]
    growth: Growth


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> U(11)).astype(np.float64) * 2.0**-53


def row_hash(bins: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bins), U)
    for k in range(bins.shape[1]):
        out = mixed(out * U(31) + bins[:, k].astype(U) + U(1))
    return out


SMALL_MEAN = 64


def poisson_tables() -> list[np.ndarray]:
    """Distribution functions for means 1, 2, ... ``SMALL_MEAN``."""
    out = []
    for mean in range(1, SMALL_MEAN + 1):
        k = np.arange(mean + 12 * int(np.sqrt(mean)) + 20)
        log_p = -mean + k * np.log(mean) - np.concatenate([[0.0], np.cumsum(np.log(k[1:]))])
        out.append(np.cumsum(np.exp(log_p)))
    return out


def poisson(counts: np.ndarray, hashes: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """One Poisson draw per count, by inversion; above ``SMALL_MEAN`` the rounded normal of equal mean and variance."""
    out, u = np.zeros(len(counts), np.int64), unit(hashes)
    for n in np.unique(counts[(counts > 0) & (counts <= SMALL_MEAN)]).tolist():
        mine = counts == n
        out[mine] = np.searchsorted(tables[n - 1], u[mine], "right")
    large = counts > SMALL_MEAN
    if large.any():
        n = counts[large].astype(np.float64)
        angle = unit(mixed(hashes[large] + U(1)))
        normal = np.sqrt(-2 * np.log(1 - u[large])) * np.cos(2 * np.pi * angle)
        out[large] = np.maximum(np.rint(n + np.sqrt(n) * normal), 0)
    return out


def drawn(growth: Growth, tree: int, counts: np.ndarray, hashes: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """Counts of both classes, (rows, 2), in the bootstrap sample of a tree."""
    if not growth.bootstrap:
        return counts
    keys = [mixed(hashes ^ mixed(np.full(len(hashes), growth.seed * 1_000_003 + 2 * tree + c, U))) for c in (0, 1)]
    return np.stack([poisson(counts[:, c], keys[c], tables) for c in (0, 1)], 1)


def feature_order(growth: Growth, tree: int, nodes: np.ndarray, n: int) -> np.ndarray:
    """The order in which every node tries the features, by hash: (nodes, n)."""
    own = mixed(nodes.astype(U) ^ mixed(np.array([growth.seed * 7_919 + tree], U)))
    return np.argsort(mixed(np.arange(n, dtype=U) + U(1) + own[:, None]), axis=1, kind="stable")


def best_splits(growth: Growth, tree: int, nodes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, bin) of the lowest weighted Gini impurity per node from (nodes, features, bins, 2) counts; feature -1 for none.

    A node looks at the first ``tried`` features of its order that vary in it; as in the usual forests, constant ones do
    not count. The first of equal ones wins.
    """
    w0, w1 = growth.weights_of(tree)
    left = np.cumsum(counts, 2)[:, :, :-1]
    right = left[:, :, -1:] + counts[:, :, -1:] - left
    valid = left.any(3) & right.any(3)
    impurity = np.zeros(valid.shape)
    for side in (left, right):
        a, b = side[..., 0] * w0, side[..., 1] * w1
        whole = a + b
        impurity += whole - (a * a + b * b) / np.where(whole > 0, whole, 1.0)
    impurity[~valid] = np.inf
    cut = impurity.argmin(2)
    lowest = np.take_along_axis(impurity, cut[:, :, None], 2)[:, :, 0]
    order = feature_order(growth, tree, nodes, counts.shape[1])
    varied = np.take_along_axis(valid.any(2), order, 1)
    value = np.where(varied & (np.cumsum(varied, 1) <= growth.tried), np.take_along_axis(lowest, order, 1), np.inf)
    feature, best = np.full(len(nodes), -1), np.full(len(nodes), np.inf)
    for k in range(order.shape[1]):
        better = value[:, k] < best - 1e-9
        feature[better], best[better] = order[better, k], value[better, k]
    return feature, np.where(feature >= 0, cut[np.arange(len(nodes)), np.maximum(feature, 0)], -1)


AT_ONCE = 1024  # nodes whose histograms are held together


def grow_here(growth: Growth, tree: int, node: int, bins: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Columns node, feature, bin (-1 in leaves), n0 and n1 of ``node`` and all below it, from the rows that are in it."""
    out, width = [], bins.shape[1]
    nodes, of_row = np.array([node]), np.zeros(len(bins), np.int64)
    depth = node.bit_length() - 1
    while len(nodes):
        n = np.stack([np.bincount(of_row, counts[:, c], len(nodes)) for c in (0, 1)], 1).astype(np.int64)
        feature, cut = np.full(len(nodes), -1), np.full(len(nodes), -1)
        open_nodes = np.flatnonzero(n.all(1)) if depth < growth.depth else np.zeros(0, np.int64)
        place = np.full(len(nodes), -1)
        place[open_nodes] = np.arange(len(open_nodes))
        by_place = place[of_row]
        for first in range(0, len(open_nodes), AT_ONCE):
            mine = open_nodes[first : first + AT_ONCE]
            rows = np.flatnonzero((by_place >= first) & (by_place < first + AT_ONCE))
            flat = (((by_place[rows, None] - first) * width + np.arange(width)) * BINS + bins[rows]).ravel()
            held = [np.bincount(flat, np.repeat(counts[rows, c], width), len(mine) * width * BINS) for c in (0, 1)]
            feature[mine], cut[mine] = best_splits(growth, tree, nodes[mine], np.stack(held, 1).reshape(len(mine), width, BINS, 2))
        out.append(np.stack([nodes, feature, cut, n[:, 0], n[:, 1]], 1))
        split = np.flatnonzero(feature >= 0)
        place = np.full(len(nodes), -1)
        place[split] = np.arange(len(split))
        inner = place[of_row] >= 0
        bins, counts, of_row = bins[inner], counts[inner], of_row[inner]
        right = bins[np.arange(len(bins)), feature[of_row]] > cut[of_row]
        of_row = 2 * place[of_row] + right
        nodes = (2 * nodes[split][:, None] + np.arange(2)).ravel()
        depth += 1
    return list(np.concatenate(out).T)


def descend(splits: dict[int, tuple[int, int]], bins: np.ndarray) -> np.ndarray:
    """The node that every row reaches below the root by the splits known so far."""
    node = np.ones(len(bins), np.int64)
    active = np.arange(len(bins))
    while len(active):
        at = node[active]
        following = np.zeros(len(active), np.int64)
        for value in np.unique(at).tolist():
            if value in splits:
                feature, cut = splits[value]
                mine = at == value
                following[mine] = 2 * value + (bins[active[mine], feature] > cut)
        active, following = active[following > 0], following[following > 0]
        node[active] = following
    return node


def _rows(batch) -> tuple[np.ndarray, np.ndarray]:
    width = len(batch.column(0)[0])
    bins = batch.column(0).flatten().to_numpy().reshape(-1, width)
    return bins, np.stack([batch.column(k).to_numpy() for k in (1, 2)], 1)


def _histograms(growth: Growth, known: list[dict], large: set[tuple[int, int]]):
    """Histograms of the large nodes over a task's rows, and how many distinct rows are in them."""

    def run(batches):
        import pyarrow as pa

        tables, sums = poisson_tables(), {}
        trees = sorted({t for t, _ in large})
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, counts = _rows(batch)
            hashes = row_hash(bins)
            width = bins.shape[1]
            for tree in trees:
                sample = drawn(growth, tree, counts, hashes, tables)
                node = descend(known[tree], bins)
                for value in np.unique(node).tolist():
                    if (tree, value) not in large:
                        continue
                    mine = (node == value) & sample.any(1)
                    flat = (np.arange(width) * BINS + bins[mine]).ravel()
                    parts = [np.bincount(flat, np.repeat(sample[mine, c], width), width * BINS) for c in (0, 1)]
                    held = sums.setdefault((tree, value), [np.zeros(width * BINS * 2), 0])
                    held[0] += np.stack(parts, 1).ravel()
                    held[1] += int(mine.sum())
        for (tree, node), (histogram, rows) in sums.items():
            values = pa.array(histogram.astype(np.int64))
            lists = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([node]), pa.array([rows]), lists], ["tree", "node", "rows", "histogram"])

    return run


def _split_large(growth: Growth, width: int):
    """The best split of every node from its summed histogram; input has a row per node and task, sorted by node."""

    def run(batches):
        import pyarrow as pa

        at, rows, total = None, 0, None

        def done():
            tree, node = at
            counts = total.reshape(width, BINS, 2)
            n0, n1 = counts[0].sum(0).tolist()
            split = None
            if n0 and n1:
                feature, cut = best_splits(growth, tree, np.array([node]), counts[None].astype(np.float64))
                split = (int(feature[0]), int(cut[0])) if feature[0] >= 0 else None
            left = counts[split[0], : split[1] + 1].sum(0).tolist() if split else (None, None)
            row = (tree, node, node.bit_length() - 1, *(split or (None, None)), n0, n1, rows, *left)
            return pa.RecordBatch.from_pylist([dict(zip(names, row))], schema)

        names = ["tree", "node", "depth", "feature", "bin", "n0", "n1", "rows", "left0", "left1"]
        schema = pa.schema([(n, pa.int32() if n in ("tree", "depth", "feature", "bin") else pa.int64()) for n in names])
        for batch in batches:
            for k in range(batch.num_rows):
                key = (batch.column(0)[k].as_py(), batch.column(1)[k].as_py())
                part = batch.column(3)[k].values.to_numpy()
                if key != at:
                    if at is not None:
                        yield done()
                    at, rows, total = key, 0, np.zeros(len(part), np.int64)
                total += part
                rows += batch.column(2)[k].as_py()
        if at is not None:
            yield done()

    return run


def _deal(growth: Growth, known: list[dict], leaves: list[set]):
    """Rows of every tree's sample, with the unfinished node that each is in."""

    def run(batches):
        import pyarrow as pa

        tables = poisson_tables()
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, counts = _rows(batch)
            hashes = row_hash(bins)
            for tree in range(growth.trees):
                sample, node = drawn(growth, tree, counts, hashes, tables), descend(known[tree], bins)
                mine = sample.any(1)
                if leaves[tree]:
                    mine &= ~np.isin(node, list(leaves[tree]))
                kept = bins[mine]
                ends = pa.array(np.arange(len(kept) + 1, dtype=np.int32) * bins.shape[1])
                lists = pa.ListArray.from_arrays(ends, pa.array(kept.ravel().astype(np.int8)))
                columns = [pa.array(np.full(len(kept), tree, np.int32)), pa.array(node[mine]), lists, *(pa.array(sample[mine, c]) for c in (0, 1))]
                yield pa.RecordBatch.from_arrays(columns, ["tree", "node", "bins", "n0", "n1"])

    return run


def _grow(growth: Growth):
    def run(key, table):
        import pyarrow as pa

        tree, node = (k.as_py() for k in key)
        table = table.combine_chunks()
        bins = table.column("bins").combine_chunks().flatten().to_numpy().astype(np.int64).reshape(table.num_rows, -1)
        counts = np.stack([table.column(c).to_numpy() for c in ("n0", "n1")], 1)
        found, feature, cut, n0, n1 = grow_here(growth, tree, node, bins, counts)
        depth = np.floor(np.log2(found)).astype(np.int32)
        leaf = feature < 0
        columns = [np.full(len(found), tree, np.int32), found, depth, feature.astype(np.int32), cut.astype(np.int32), n0, n1]
        names = ["tree", "node", "depth", "feature", "bin", "n0", "n1"]
        return pa.table([pa.array(c, mask=leaf if n in ("feature", "bin") else None) for n, c in zip(names, columns)], names)

    return run


def bin_edges(rows: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Up to ``bins - 1`` edges per feature: all distinct values but the largest, or quantiles of them where they are more."""
    pairs = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f).cast("double").alias("value")) for i, f in enumerate(features)])
    distinct = rows.select(F.explode(pairs).alias("p")).select("p.*").distinct()
    shares = [k / bins for k in range(1, bins + 1)]
    cuts = distinct.groupBy("feature").agg(F.percentile_approx("value", shares, 10_000).alias("cuts"))
    found = {row["feature"]: np.unique(row["cuts"])[:-1] for row in cuts.collect()}  # one short row per feature
    return [found[i] for i in range(len(features))]


def _binned(edges: list[np.ndarray]):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            width = len(edges)
            bins = np.stack([np.searchsorted(e, batch.column(k).to_numpy(), "left") for k, e in enumerate(edges)], 1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bins) + 1, dtype=np.int32) * width), pa.array(bins.ravel().astype(np.int8)))
            yield pa.RecordBatch.from_arrays([lists, *batch.columns[width:]], ["bins", *batch.schema.names[width:]])

    return run


def _sample_sizes(growth: Growth):
    def run(batches):
        import pyarrow as pa

        tables, sums = poisson_tables(), np.zeros((growth.trees, 2), np.int64)
        for batch in batches:
            if batch.num_rows:
                bins, counts = _rows(batch)
                hashes = row_hash(bins)
                sums += np.stack([drawn(growth, tree, counts, hashes, tables).sum(0) for tree in range(growth.trees)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(growth.trees, dtype=np.int32)), pa.array(sums[:, 0].copy()), pa.array(sums[:, 1].copy())], ["tree", "n0", "n1"])

    return run


def balanced(growth: Growth, rows: DataFrame) -> Growth:
    """Weights n / (2 n_k) of every tree's own sample."""
    sizes = rows.mapInArrow(_sample_sizes(growth), "tree int, n0 long, n1 long").groupBy("tree").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    found = {r["tree"]: (r["n0"], r["n1"]) for r in sizes.collect()}  # a row per tree
    weights = [tuple((n0 + n1) / (2 * max(n, 1)) for n in (n0, n1)) for n0, n1 in (found.get(t, (0, 0)) for t in range(growth.trees))]
    return replace(growth, weights=tuple(weights))


def grow(df: DataFrame, features: Sequence[str], label: str, growth: Growth, balance: bool = True, local_rows: int = LOCAL_ROWS) -> Forest:
    """Fit a forest on rows of finite features and labels 0 and 1.

    Nodes of more than ``local_rows`` distinct rows are split by histograms, of all trees in the same
    passes; the driver holds the splits alone. With ``balance``, classes weigh alike in every tree's sample. The others are grown in one task each. The result is the same for
    any ``local_rows`` and partitioning.
    """
    spark, features, width = df.sparkSession, list(features), len(features)
    y = F.col(label).cast("long")
    values = [F.col(f).cast("double").alias(f) for f in features]
    counted = written(df.groupBy(*values).agg(F.sum(1 - y).alias("n0"), F.sum(y).alias("n1")), "forest-counted")
    edges = bin_edges(counted, features)
    binned = counted.mapInArrow(_binned(edges), "bins array<tinyint>, n0 long, n1 long")
    rows = written(binned.groupBy("bins").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "forest-rows")
    distinct = rows.count()
    growth = balanced(growth, rows) if balance else growth
    known: list[dict] = [{} for _ in range(growth.trees)]
    leaves: list[set] = [set() for _ in range(growth.trees)]
    top: list[tuple] = []
    large = {(t, 1) for t in range(growth.trees)} if distinct > local_rows and growth.depth else set()
    while large:
        parts = rows.mapInArrow(_histograms(growth, known, large), "tree int, node long, rows long, histogram array<bigint>")
        dealt = parts.repartition("tree", "node").sortWithinPartitions("tree", "node")
        found = dealt.mapInArrow(_split_large(growth, width), NODES + ", rows long, left0 long, left1 long").collect()  # one short row per large node
        large = set()
        for r in found:
            tree, node = r["tree"], r["node"]
            top.append(tuple(r)[:7])
            if r["feature"] is None:
                leaves[tree].add(node)
                continue
            known[tree][node] = (r["feature"], r["bin"])
            if r["depth"] + 1 == growth.depth:
                right = (r["n0"] - r["left0"], r["n1"] - r["left1"])
                for child, n in ((2 * node, (r["left0"], r["left1"])), (2 * node + 1, right)):
                    top.append((tree, child, growth.depth, None, None, *n))
                    leaves[tree].add(child)
            elif r["rows"] > local_rows:  # a child may be as large; the next pass measures it
                large |= {(tree, 2 * node), (tree, 2 * node + 1)}
    sent = rows.mapInArrow(_deal(growth, known, leaves), "tree int, node long, bins array<tinyint>, n0 long, n1 long")
    below = sent.groupBy("tree", "node").applyInArrow(_grow(growth), NODES)
    if top:
        below = below.unionByName(spark.createDataFrame(top, NODES))
    return Forest(written(below, "forest-nodes"), edges, features, growth)


def _score(forest: Forest, shared):
    edges, width = forest.edges, len(forest.features)

    def run(batches):
        import pyarrow as pa

        trees = shared.value
        for batch in batches:
            bins = np.stack([np.searchsorted(e, batch.column(k).to_numpy(), "left") for k, e in enumerate(edges)], 1)
            total = np.zeros(len(bins))
            for node, feature, cut, share in trees:
                at = np.zeros(len(bins), np.int64)
                active = np.arange(len(bins))
                while len(active):
                    split = feature[at[active]]
                    active, split = active[split >= 0], split[split >= 0]
                    where = at[active]
                    child = 2 * node[where] + (bins[active, split] > cut[where])
                    at[active] = np.searchsorted(node, child)
                total += share[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(total / len(trees))], [*batch.schema.names[:width], "p"])

    return run


def tree_arrays(forest: Forest) -> list[tuple]:
    """Per tree: node numbers in order, feature (-1 in leaves), bin and the positive class's weighted share.

    At most ``trees * 2^(depth + 1)`` nodes, whatever the rows.
    """
    table = forest.nodes.orderBy("tree", "node").toArrow()
    column = lambda name, empty: table.column(name).fill_null(empty).to_numpy()
    tree, node, feature, cut = column("tree", 0), column("node", 0), column("feature", -1), column("bin", 0)
    weights = np.array([forest.growth.weights_of(t) for t in range(forest.growth.trees)])[tree]
    n0, n1 = column("n0", 0) * weights[:, 0], column("n1", 0) * weights[:, 1]
    share = n1 / np.maximum(n0 + n1, 1e-300)
    cuts = np.searchsorted(tree, np.arange(forest.growth.trees + 1))
    return [(node[a:b], feature[a:b], cut[a:b], share[a:b]) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]


def predict(forest: Forest, df: DataFrame, p: str = "p") -> DataFrame:
    """Add the mean over trees of the positive class's weighted share in the leaf; each distinct row is scored once."""
    shared = df.sparkSession.sparkContext.broadcast(tree_arrays(forest))
    names = forest.features
    keys = [f"__{i}" for i in range(len(names))]
    distinct = df.select(*[F.col(f).cast("double").alias(k) for k, f in zip(keys, names)]).distinct()
    schema = ", ".join(f"{k} double" for k in keys) + ", p double"
    scored = written(distinct.mapInArrow(_score(forest, shared), schema).withColumnRenamed("p", p), "forest-scores")
    keyed = df.withColumns({k: F.col(f).cast("double") for k, f in zip(keys, names)})
    return join_metadata(keyed, scored, keys).drop(*keys)


def importances(forest: Forest) -> DataFrame:
    """Share of every feature in the weighted impurity that splits remove, mean over trees, as ``feature, importance``."""
    spark, growth = forest.nodes.sparkSession, forest.growth
    weights = F.array(*[F.array(*[F.lit(w) for w in growth.weights_of(t)]) for t in range(growth.trees)])
    weighed = forest.nodes.withColumn("w", F.get(weights, F.col("tree")))
    a, b = F.col("n0") * F.col("w")[0], F.col("n1") * F.col("w")[1]
    nodes = weighed.withColumn("impurity", (a + b) - (a * a + b * b) / (a + b))
    child = nodes.select("tree", F.floor(F.col("node") / 2).alias("node"), F.col("impurity").alias("below"))
    below = child.groupBy("tree", "node").agg(F.sum("below").alias("below"))
    gains = nodes.filter("feature is not null").join(below, ["tree", "node"]).select("tree", "feature", (F.col("impurity") - F.col("below")).alias("gain"))
    whole = gains.groupBy("tree").agg(F.sum("gain").alias("whole"))
    shares = gains.join(whole, "tree").groupBy("feature").agg((F.sum(F.col("gain") / F.col("whole")) / growth.trees).alias("importance"))
    names = spark.range(1).select(F.posexplode(F.array(*[F.lit(f) for f in forest.features])).alias("feature", "name"))
    return names.join(shares, "feature", "left").select(F.col("name").alias("feature"), F.coalesce("importance", F.lit(0.0)).alias("importance"))
