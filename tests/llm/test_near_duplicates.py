import re
from itertools import combinations

import numpy as np
import pytest
from cinderframe.llm import components, minhash, pstable, words
from cinderframe.llm.queries import QUERIES
from helpers import AWKWARD, documents
from hypothesis import given, settings
from hypothesis import strategies as st

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    parts = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(parts[i : i + 5]) for i in range(len(parts) - 4)} if len(parts) >= 5 else {tuple(parts)} - {()}


def roots(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def brute(texts, part, whole):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and whole * len(sets[a] & sets[b]) >= part * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, roots(sets, links)


def check(rows, texts, part, whole):
    sizes, component = brute(texts, part, whole)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows} == {i: (sizes[i], component[i], component[i] == i) for i in texts}


def test_awkward_texts(spark):
    texts = dict(enumerate(AWKWARD))
    check(minhash.near_duplicates(documents(spark, AWKWARD), (85, 100)).collect(), texts, 85, 100)


def test_whole_table_against_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check(QUERIES["op1_minhash_dedup"](spark, sf_dir).collect(), texts, 85, 100)


def test_large_group_with_chains(spark):
    """Copies with 0 to 12 changed words: some link, some only by way of others, some not at all."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for k in range(160):
        one = list(base)
        for at in rng.choice(150, rng.integers(0, 13), replace=False):
            one[at] = f"x{k}-{at}"
        texts.append(" ".join(one))
    texts += texts[:20] + [" ".join(base)] * 30
    check(minhash.near_duplicates(documents(spark, texts), (85, 100)).collect(), dict(enumerate(texts)), 85, 100)


def test_empty_null_ids_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = minhash.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (7, "a b c d e f")], schema)).collect()
    got = sorted((r["doc_id"] is None, r["doc_id"], r["component_id"], r["kept"]) for r in rows)
    assert got == [(False, 3, 3, True), (False, 3, 3, True), (False, 7, 3, False), (True, None, None, True)]


def changed(base, spots, mark):
    return " ".join(f"{mark}{i}" if i in spots else w for i, w in enumerate(base))


def test_repeated_rows_of_near_texts(spark, monkeypatch):
    """One pair links at 92/108; many unlinked texts of smaller ids share its buckets. The bounds count every set once."""
    tables = {}
    plain = minhash.written
    monkeypatch.setattr(minhash, "written", lambda df, name: tables.setdefault(name, []).append(plain(df, name)) or tables[name][-1])
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(104)]
    texts = {k: changed(base, rng.choice([10, 25, 40, 55, 70, 85], 2, replace=False).tolist(), f"x{k}-") for k in range(80)}
    texts |= {100: changed(base, (2, 97), "a"), 101: changed(base, (2, 97), "b")}
    sizes, component = brute(texts, 85, 100)
    assert component[101] == 100
    rows = list(texts.items()) + [(i, texts[i]) for i in (100, 101) for _ in range(2)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), (85, 100)).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(i, sizes[i], component[i]) for i in texts}
    assert len(got) == len(rows)
    assert tables["sets"][-1].groupBy("id").count().filter("count > 1").count() == 0


def test_unlike_texts_of_one_id(spark):
    one, other = ([f"{k}{i}" for i in range(104)] for k in "wv")
    rows = [(2, changed(other, (50,), "z")), (5, " ".join(one)), (5, " ".join(other)), (9, changed(one, (50,), "z"))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), (85, 100)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(2, 2), (5, 2), (5, 5), (9, 5)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB \n\té漢", max_size=12), min_size=1, max_size=6))
def test_words_of_chunks(texts):
    raw = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, raw)])
    _, _, hashes, first = words.WordHasher(words.space_separated()).words(np.frombuffer(b"".join(raw), np.uint8), bounds)
    plain = [[w.translate(LOWER) for w in re.findall(r"[^\x20\x09-\x0D]+", t)] for t in texts]
    assert np.diff(first).tolist() == [len(p) for p in plain]
    flat = [w for p in plain for w in p]
    assert len({(w, h) for w, h in zip(flat, hashes.tolist())}) == len(set(flat)) == len(set(hashes.tolist()))


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    shared, a, b = (words.numbers(n, s) for n, s in ((800, 1), (100, 2), (100, 3)))
    agree = []
    for _ in range(20):
        salt = np.uint64(rng.integers(1 << 62))
        one, two = (np.unique(words.mix(np.concatenate([shared, x]) ^ salt)) for x in (a, b))
        left, right = minhash.signature([one, two])
        agree.append((left == right).mean())
    assert np.mean(agree) == pytest.approx(0.8, abs=0.02)


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 60)] + [(500, 400), (400, 500), (7, 7)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == roots(nodes, links)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, copies long, rep string")


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for label in (0, 1):
        for _ in range(6):
            centre = rng.standard_normal(16)
            for _ in range(25):
                v = centre + rng.standard_normal(16) * rng.choice([0.05, 0.25, 0.35])
                rows.append((len(rows), v.astype(np.float32).tolist(), label, 1, "x"))
    rows += [(len(rows) + k, rows[3][1], 0, 1, "x") for k in range(40)]
    n = len(rows)
    odd = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, []]
    rows += [(n + k, v, 0, 1, "x") for k, v in enumerate(odd)]
    rows += [(n + 10, rows[3][1], None, 1, "x"), (n + 11, rows[3][1][:8], 0, 1, "x"), (None, rows[3][1], 0, 1, "x")]
    x = np.array([r[1] for r in rows[:n]], np.float64)
    labels = np.array([r[2] for r in rows[:n]])
    norms = np.linalg.norm(x, axis=1)
    close = (x @ x.T / np.outer(norms, norms) >= 0.93) & (labels[:, None] == labels)
    np.fill_diagonal(close, False)
    component = roots(range(n), zip(*np.nonzero(close)))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in pstable.near_vectors(vectors(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert {i: got[i] for i in range(n)} == {i: (close[i].sum(), component[i], component[i] == i) for i in range(n)}
    assert all(got[i] == (0, i, True) for i in [*range(n, n + 6), n + 10, n + 11])
    assert got[None] == (0, None, True)


def test_no_vectors(spark):
    assert pstable.near_vectors(vectors(spark, [])).collect() == []


def test_repeated_ids_of_vectors_count_once(spark):
    schema = "vec_id long, embedding array<float>, label int"
    alike = [(5, [1.0, 0.0], 1), (5, [1.0, 0.01], 1), (7, [1.0, 0.02], 1)]
    got = sorted(map(tuple, pstable.near_vectors(spark.createDataFrame(alike, schema)).select("vec_id", "n_links", "component_id", "kept").collect()))
    assert got == [(5, 2, 5, True), (5, 2, 5, True), (7, 2, 5, False)]
    unlike = [(5, [1.0, 0.0], 1), (6, [1.0, 0.01], 1), (7, [1.0, 0.02], 1), (5, [0.0, 1.0], 1), (3, [0.01, 1.0], 1)]
    got = sorted(map(tuple, pstable.near_vectors(spark.createDataFrame(unlike, schema)).select("vec_id", "n_links", "component_id", "kept").collect()))
    assert got == [(3, 1, 3, True), (5, 1, 3, False), (5, 2, 5, True), (6, 2, 5, False), (7, 2, 5, False)]
