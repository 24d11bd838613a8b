from collections import Counter

import corpus_pipeline as pipeline
import duckdb
import pytest
from cinderframe.llm.queries import ORACLES, QUERIES
from oracle import compare, duck
from test_lines_shards_mixing import deduped
from test_near_duplicates import brute

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), duck(sf_dir), ORACLES[name]) == []


def test_names():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))
    assert [name for name, _ in pipeline.STAGES] == ["quality", "line_dedup", "minhash_dedup", "mixing", "packing"]


def test_stages(spark, sf_dir):
    """Each stage against a plain version on its own input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    steps = dict(pipeline.STAGES)
    good = pipeline.written(steps["quality"](spark, docs, sf_dir), "quality")
    assert good.columns == DOCUMENTS
    labels = dict(duckdb.sql(f"select doc_id, quality from '{sf_dir}/labels.parquet'").fetchall())
    kept = {r["doc_id"] for r in good.collect()}
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)
    assert sum(i not in kept for i, q in labels.items() if q == 0) >= 0.8 * (len(labels) - len(clean))

    before = {r["doc_id"]: r["text"] for r in good.collect()}
    lined = pipeline.written(steps["line_dedup"](spark, good, sf_dir), "lines")
    after = {r["doc_id"]: r for r in lined.collect()}
    want = dict(zip(before, deduped(list(before.values()), 10, 1)))
    assert lined.columns == DOCUMENTS and {i: r["text"] for i, r in after.items()} == {i: w[2] for i, w in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())

    single = pipeline.written(steps["minhash_dedup"](spark, lined, sf_dir), "minhash")
    _, component = brute({i: r["text"] for i, r in after.items()}, 4, 5)
    assert single.columns == DOCUMENTS and {r["doc_id"] for r in single.collect()} == {i for i, c in component.items() if i == c}

    mixed = pipeline.written(steps["mixing"](spark, single, sf_dir), "mixing")
    assert mixed.columns == DOCUMENTS and {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in single.collect()}

    packed = steps["packing"](spark, mixed, sf_dir).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in mixed.collect())
    assert max(Counter({s: sum(r["length"] for r in packed if r["sequence_id"] == s) for s in {r["sequence_id"] for r in packed}}).values()) <= 2048


def test_near_duplicates_without_or_with_repeated_ids(spark):
    one, other, third = (" ".join(f"{k}{i}" for i in range(100)) for k in "abc")
    rows = [(None, one), (None, one), (3, one), (3, one), (3, one + " x"), (9, one), (3, other), (7, third), (7, third), (8, ""), (8, ""), (8, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = dict(pipeline.STAGES)["minhash_dedup"](spark, docs, "")
    assert got.columns == DOCUMENTS
    found = Counter((r["doc_id"], (r["text"] or "")[:2]) for r in got.collect())
    assert found == Counter({(None, "a0"): 2, (3, "a0"): 1, (3, "b0"): 1, (7, "c0"): 1, (8, ""): 1, (6, ""): 1})


def test_run(spark, sf_dir):
    assert pipeline.run(spark, sf_dir).count() > 0
