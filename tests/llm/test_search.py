import numpy as np
import pytest
from cinderframe.llm import cross_polytope
from cinderframe.llm.queries import QUERIES
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, bucket int, score string"


def exact(ids, x, query, k):
    score = np.round(x @ x[query], 12)
    order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[query]]
    return order[:k]


def test_recall_on_the_whole_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    got = {}
    for r in QUERIES["op6_cross_polytope_search"](spark, sf_dir).collect():
        got.setdefault(r["query_id"], []).append(r)
    assert set(got) == {i for i in ids if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in found] == sorted((-r["score"], r["vec_id"]) for r in found)
        at = int(np.flatnonzero(ids == q)[0])
        for r in found:
            assert r["score"] == pytest.approx(float(x[at] @ x[int(np.flatnonzero(ids == r["vec_id"])[0])]), abs=1e-12)
        hits += len({r["vec_id"] for r in found} & set(ids[exact(ids, x, at, 20)].tolist()))
    assert hits / (20 * len(got)) >= 0.95


@pytest.mark.parametrize("scale", [1.0, 1e-7, 1e-150, 1e150])
def test_norms_ties_and_unusable_rows(spark, scale):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((700, 12)) * rng.uniform(0.1, 3, (700, 1)) * scale
    x[50:80] = x[10]
    rows = [(i, v.tolist(), 1, "s") for i, v in enumerate(x)]
    rows += [(700, None, 1, "s"), (720, [0.0] * 12, 1, "s"), (740, [float("nan")] * 12, 1, "s"), (760, [None] * 12, 1, "s"), (None, x[0].tolist(), 1, "s")]
    found = {}
    for r in cross_polytope.search(spark.createDataFrame(rows, SCHEMA.replace("float", "double")), F.col("vec_id") % 20 == 0, k=20).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(found) == set(range(0, 700, 20))
    ids, hits = np.arange(700), 0
    for q, ranks in found.items():
        score = (x / scale) @ (x[q] / scale)
        want = [i for i in np.lexsort((ids, -np.round(score, 12))) if i != q][:20]
        assert sorted(ranks) == list(range(1, 21))
        assert all(s == pytest.approx(float(x[v] @ x[q]), rel=1e-9, abs=1e-12 * scale * scale) for v, s in ranks.values())
        assert list(ranks.values()) and [ranks[k][0] for k in sorted(ranks)] == [v for v, _ in sorted(ranks.values(), key=lambda t: (-t[1], t[0]))]
        hits += len({v for v, _ in ranks.values()} & set(want))
    assert hits / (20 * len(found)) >= 0.9


def test_every_row_of_a_repeated_id_is_a_candidate(spark):
    rows = [(0, [1.0, 0.0], 1, "s"), (0, [2.0, 0.0], 1, "s"), (1, [3.0, 1.0], 1, "s"), (1, [4.0, 0.0], 1, "s"), (2, [0.0, 1.0], 1, "s")]
    got = cross_polytope.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0, k=20).collect()
    first = [(1, 1, 4.0), (2, 1, 3.0), (3, 0, 2.0), (4, 2, 0.0)]
    second = [(1, 1, 8.0), (2, 1, 6.0), (3, 0, 2.0), (4, 2, 0.0)]
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(first + second)


def test_few_rows_are_all_found(spark):
    rows = [(i, [float(i == 0), float(i), 1.0], 1, "s") for i in range(7)]
    found = cross_polytope.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0, k=20).collect()
    assert sorted(r["vec_id"] for r in found) == [1, 2, 3, 4, 5, 6]
    assert cross_polytope.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0).collect() == []
    assert cross_polytope.search(spark.createDataFrame(rows[:1], SCHEMA), F.col("vec_id") == 0).collect() == []


def test_hadamard_is_orthonormal():
    assert np.allclose(cross_polytope.hadamard(np.eye(16)) @ cross_polytope.hadamard(np.eye(16)).T, np.eye(16))
