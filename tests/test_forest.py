"""The histogram forest against plain trees, its own two ways of growing, and scores that SQL recomputes from its nodes."""

import duckdb
import numpy as np
import pytest

from cinderframe.operators import forest, learning
from cinderframe.operators.forest import Growth


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = np.stack([rng.integers(0, 6, 900), rng.integers(0, 3, 900), np.round(rng.normal(size=900), 1), np.ones(900)], 1)
    y = (x[:, 0] + 2 * x[:, 1] + x[:, 2] + rng.normal(size=900) > 6).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(v)) for r, v in zip(x, y)], "a double, b double, c double, d double, y int").repartition(5)
    return df, x, y


def plain_tree(x, y, edges, weights, depth, node=1):
    """Every feature and every edge tried in every node."""
    n0, n1 = int((y == 0).sum()), int((y == 1).sum())
    here = node.bit_length() - 1
    best = None
    if here < depth and n0 and n1:
        for f in range(x.shape[1]):
            for cut in range(len(edges[f])):
                left = x[:, f] <= edges[f][cut]
                if left.all() or not left.any():
                    continue
                value = 0.0
                for side in (left, ~left):
                    a, b = weights[0] * (y[side] == 0).sum(), weights[1] * (y[side] == 1).sum()
                    value += a + b - (a * a + b * b) / (a + b)
                if best is None or value < best - 1e-9:
                    best = value
    return n0, n1, best


def removed(nodes, weights):
    out = {}
    for node, (f, cut, n0, n1) in nodes.items():
        if f is not None:
            parts = [nodes[2 * node + k][2:] for k in (0, 1)]
            out[node] = sum(a * weights[0] + b * weights[1] - ((a * weights[0]) ** 2 + (b * weights[1]) ** 2) / (a * weights[0] + b * weights[1]) for a, b in parts)
    return out


def nodes_of(fitted, tree=0):
    return {r["node"]: (r["feature"], r["bin"], r["n0"], r["n1"]) for r in fitted.nodes.filter(f"tree = {tree}").collect()}


def test_one_tree_without_sampling_is_a_plain_tree(rows):
    df, x, y = rows
    weights = (1.0, 3.0)
    fitted = forest.grow(df, ["a", "b", "c", "d"], "y", Growth(1, 6, 4, (weights,), bootstrap=False), balance=False)
    nodes = nodes_of(fitted)
    lowest = removed(nodes, weights)
    stack = [(1, np.arange(len(y)))]
    while stack:
        node, mine = stack.pop()
        f, cut, n0, n1 = nodes[node]
        want = plain_tree(x[mine], y[mine], fitted.edges, weights, 6, node)
        assert (n0, n1) == want[:2] and (f is None) == (want[2] is None)
        if f is not None:
            assert lowest[node] == pytest.approx(want[2])
            left = x[mine, f] <= fitted.edges[f][cut]
            stack += [(2 * node, mine[left]), (2 * node + 1, mine[~left])]


def test_same_forest_from_histograms_in_one_task_and_from_other_partitions(rows):
    df, _, _ = rows
    growth = Growth(7, 5, 2)
    runs = [forest.grow(d, ["a", "b", "c", "d"], "y", growth, local_rows=n) for d, n in ((df, 20_000), (df, 0), (df.repartition(2), 60))]
    tables = [sorted(map(tuple, f.nodes.collect()), key=str) for f in runs]
    assert tables[0] == tables[1] == tables[2] and len({r[0] for r in tables[0]}) == 7


def test_poisson_draws():
    tables = forest.poisson_tables()
    hashes = forest.mixed(np.arange(20_000, dtype=np.uint64))
    for mean in (1, 5, 64, 65, 4000):
        draws = forest.poisson(np.full(20_000, mean), hashes, tables)
        assert draws.mean() == pytest.approx(mean, rel=0.03) and draws.var() == pytest.approx(mean, rel=0.05)
    assert forest.poisson(np.zeros(5, int), hashes[:5], tables).tolist() == [0] * 5


def walk_in_sql(con):
    return con.execute("""
        with recursive walk as (
          select id, tree, 1::bigint node from rows cross join (select distinct tree from nodes)
          union all
          select walk.id, walk.tree, 2 * walk.node + case when v.value <= e.value then 0 else 1 end
          from walk join nodes n using (tree, node) join long v on v.id = walk.id and v.feature = n.feature join edges e on e.feature = n.feature and e.bin = n.bin)
        select id, avg(n1 * w1 / (n0 * w0 + n1 * w1)) p from walk join nodes n using (tree, node) join weights using (tree) where n.feature is null group by id""").fetchall()


def test_duckdb_walks_the_nodes_to_the_same_scores(rows, spark):
    df, x, y = rows
    fitted = forest.grow(df, ["a", "b", "c", "d"], "y", Growth(9, 6, 2))
    got = forest.predict(fitted, df.select("a", "b", "c", "d", "y")).toPandas()
    con = duckdb.connect()
    nodes, long = fitted.nodes.toPandas(), got.reset_index(names="id").melt("id", ["a", "b", "c", "d"], "name")
    long["feature"] = long["name"].map({"a": 0, "b": 1, "c": 2, "d": 3})
    con.execute("create table nodes as select * from nodes")
    con.execute("create table long as select id, feature, value from long")
    con.execute("create table rows as select distinct id from long")
    con.execute("create table edges (feature int, bin int, value double)")
    con.executemany("insert into edges values (?, ?, ?)", [(f, k, float(v)) for f, e in enumerate(fitted.edges) for k, v in enumerate(e)])
    con.execute("create table weights (tree int, w0 double, w1 double)")
    con.executemany("insert into weights values (?, ?, ?)", [(t, *fitted.growth.weights_of(t)) for t in range(9)])
    walked = dict(walk_in_sql(con))
    assert len(walked) == 900 and np.allclose([walked[i] for i in range(900)], got["p"], atol=1e-12)
    # Every inner node's sample is the sum of its children's, and depth is bounded.
    off = con.execute("""select count(*) from nodes a join (select tree, node // 2 node, sum(n0) n0, sum(n1) n1, count(*) n from nodes where node > 1 group by 1, 2) b
        using (tree, node) where a.n0 <> b.n0 or a.n1 <> b.n1 or b.n <> 2 or a.depth >= 6""").fetchone()[0]
    assert off == 0
    assert learning.roc_auc(spark.createDataFrame(got[["y", "p"]]), "y", "p").first()["roc_auc"] > 0.9
    shares = {r["feature"]: r["importance"] for r in forest.importances(fitted).collect()}
    assert sum(shares.values()) == pytest.approx(1) and shares["d"] == 0 and min(shares["a"], shares["b"]) > 0.1


def test_one_class_and_single_row(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0)], "a double, y int")
    fitted = forest.grow(df, ["a"], "y", Growth(3, 4, 1))
    assert {r["p"] for r in forest.predict(fitted, df).collect()} == {0.0}
