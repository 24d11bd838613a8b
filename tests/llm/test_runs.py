import hashlib
import zlib

import numpy as np
import pytest
from cinderframe.llm import suffix_runs
from cinderframe.llm.queries import QUERIES
from helpers import AWKWARD, documents
from hypothesis import given, settings
from hypothesis import strategies as st


def plain_runs(ids, repeats=2):
    """Maximal stretches of every period, kept where no smaller period fits."""
    n, found = len(ids), {}
    for q in range(1, n // repeats + 1):
        a = 0
        while a + q < n:
            b = a
            while b + q < n and ids[b] == ids[b + q]:
                b += 1
            if b - a + q >= repeats * q and b > a:
                found.setdefault((a, b + q - a), q)
            a = max(b, a + 1)
    return sorted((a, q, length) for (a, length), q in found.items())


words = st.one_of(
    st.lists(st.integers(0, 2), max_size=60),
    st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=6), st.integers(1, 9), st.lists(st.integers(0, 3), max_size=8)).map(lambda t: t[2] + t[0] * t[1] + t[2]),
)


@settings(max_examples=300, deadline=None)
@given(words)
def test_all_runs_against_every_period(ids):
    assert [tuple(r) for r in suffix_runs.all_runs(np.array(ids, np.int64)).tolist()] == plain_runs(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(words, max_size=4).map(lambda parts: [x for p in parts for x in p]), st.sampled_from([(6, 4), (4, 3), (10, 5)]))
def test_long_runs_are_all_inside_the_stretches(ids, limits):
    least, repeats = limits
    want = [r for r in plain_runs(ids, repeats) if r[2] >= max(least, repeats * r[1])]
    assert [tuple(r) for r in suffix_runs.long_runs(np.array(ids, np.int64), least, repeats).tolist()] == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=2, max_size=40))
def test_common_extensions(ids):
    tree = suffix_runs.Extensions([*(x + 1 for x in ids), 0], 4)
    suffixes = [[*ids[i:], -1] for i in range(len(ids) + 1)]
    assert sorted(range(len(ids) + 1), key=lambda i: suffixes[i]) == np.argsort(tree.rank).tolist()
    a, b = np.array([(i, j) for i in range(len(ids) + 1) for j in range(len(ids) + 1) if i != j]).T

    def common(x, y):
        return next((k for k, (s, t) in enumerate(zip(x, y)) if s != t), min(len(x), len(y)))

    assert tree.common(a, b).tolist() == [common(suffixes[i], suffixes[j]) for i, j in zip(a.tolist(), b.tolist())]


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    names = {}
    ids = [names.setdefault(w, len(names)) for w in words]
    runs = sorted((a, length, q) for a, q, length in plain_runs(ids, 4) if length >= max(6, 4 * q))
    runs.sort(key=lambda r: (r[0], r[2]))
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    lines = "".join(f"{a},{length},{q}\n" for a, length, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_on_awkward_texts(spark, tmp_path):
    cycles = ["a b c " * 12 + "d", "x " * 6, "x " * 5, "p q r s " * 3 + "p q r", "p q r s " * 4, " ".join(f"w{i % 50}" for i in range(500)), "u u u u u u v v v v v v u u u u u u v v v v v v " * 5]
    docs = documents(spark, [*AWKWARD, *cycles, *(f"w{i} " * 3 + "a b " * i for i in range(60))])
    more = docs.selectExpr("cast(null as long) doc_id", *docs.columns[1:]).unionByName(docs).unionByName(docs.limit(20))
    more.write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op11_suffix_tree_runs"](spark, str(tmp_path))
    got = sorted(map(tuple, out.collect()), key=str)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert got == sorted((plain_row(r["doc_id"], r["text"]) for r in more.collect()), key=str)
    assert sum(r[1] for r in got) > 50


def test_query_on_the_table(spark, sf_dir):
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op11_suffix_tree_runs"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = [r for r in rows if len((r["text"] or "").split()) < 700]
    assert rows and all(got[r["doc_id"]] == plain_row(r["doc_id"], r["text"]) for r in rows)


def test_empty_table(spark):
    docs = documents(spark, ["a"]).filter("false")
    assert suffix_runs.periodic_runs(docs).collect() == []
    with pytest.raises(ValueError):
        suffix_runs.periodic_runs(docs, repeats=2)
