import hashlib

import numpy as np
import pytest
from cinderframe.llm import countmin
from cinderframe.llm.queries import QUERIES
from helpers import AWKWARD, documents


def plain(rows, size):
    """Kept words per row; rows in order of id (nulls last), equal rows are one document."""
    docs = sorted({(r[0] is None, r[0] or 0, countmin_hash(r[2]), r[1] or "") for r in rows})
    first, gone = {}, {}
    for key in docs:
        words = key[3].encode().split()
        marks = set()
        for i in range(len(words) - size + 1):
            if first.setdefault(tuple(words[i : i + size]), (key, i)) != (key, i):
                marks.update(range(i, i + size))
        gone[key] = marks
    out = []
    for r in rows:
        words = (r[1] or "").encode().split()
        marks = gone[(r[0] is None, r[0] or 0, countmin_hash(r[2]), r[1] or "")]
        kept = b" ".join(w for i, w in enumerate(words) if i not in marks)
        out.append((r[0], len(words), len(marks), kept.decode()))
    return out


def countmin_hash(value):
    return value


def rows_of(docs):
    return [(r["doc_id"], r["text"], r["h"]) for r in docs.selectExpr("doc_id", "text", "xxhash64(text) h").collect()]


def texts_with_passages(seed):
    rng = np.random.default_rng(seed)
    passages = [[f"p{k}_{i}" for i in range(rng.integers(15, 70))] for k in range(6)]
    texts = []
    for _ in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5, rng.integers(0, 40))]
        for k in rng.integers(0, 6, rng.integers(0, 4)).tolist():
            cut = int(rng.integers(0, 4))
            words += passages[k][cut:] + [f"u{x}" for x in rng.integers(0, 2, rng.integers(0, 30))]
        texts.append(" ".join(words))
    return texts + texts[:7] + ["z " * 90, "x y " * 40 + "end", "Passage " * 25]


@pytest.mark.parametrize("size", [8, 20])
def test_against_plain_windows(spark, size):
    docs = documents(spark, [*AWKWARD, *texts_with_passages(size)])
    nulls = docs.selectExpr("cast(null as long) doc_id", *docs.columns[1:]).limit(40)
    unlike = docs.selectExpr("doc_id + 3 doc_id", *docs.columns[1:])
    docs = docs.unionByName(nulls).unionByName(unlike).unionByName(docs.limit(30)).repartition(7)
    got = [tuple(r) for r in countmin.remove_repeats(docs, size).select("doc_id", "n_words", "n_removed", "kept").collect()]
    want = plain(rows_of(docs), size)
    assert sum(r[2] for r in want) > 500
    assert sorted(got, key=str) == sorted(want, key=str)


def test_removed_spans_cover_what_is_gone(spark):
    docs = documents(spark, texts_with_passages(3))
    for r in countmin.remove_repeats(docs, 20).join(docs.select("doc_id", "text"), "doc_id").collect():
        words = r["text"].split()
        gone = {i for s in r["removed"] for i in range(s["start"], s["stop"])}
        assert len(gone) == r["n_removed"] and r["kept"] == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_narrow_sketch_loses_nothing(spark, monkeypatch):
    docs = documents(spark, texts_with_passages(5)).repartition(5)
    want = sorted(map(tuple, countmin.remove_repeats(docs, 20).select("doc_id", "kept").collect()))
    monkeypatch.setattr(countmin, "sketch_bits", lambda texts: 21)
    monkeypatch.setattr(countmin, "MOST_BITS", 19)
    assert sorted(map(tuple, countmin.remove_repeats(docs, 20).select("doc_id", "kept").collect())) == want
    monkeypatch.setattr(countmin, "is_hot", lambda anchors, bits, repeated: anchors % np.uint64(2) == 0)
    assert sorted(map(tuple, countmin.remove_repeats(docs, 20).select("doc_id", "kept").collect())) == want
    monkeypatch.setattr(countmin, "estimated_repeated", lambda anchors, bits, repeated: np.ones(len(anchors), bool))
    assert sorted(map(tuple, countmin.remove_repeats(docs, 20).select("doc_id", "kept").collect())) == want


def test_sketch_overestimates(spark):
    docs = documents(spark, texts_with_passages(9)).repartition(4)
    repeated = countmin.sketch(docs.select("text"), 20, 19)
    windows = countmin.Windows(20)
    seen, anchors = set(), {}
    for r in docs.collect():
        data = np.frombuffer(r["text"].encode(), np.uint8)
        _, _, hashes, first = windows.words(data, np.array([0, len(data)]))
        _, _, whole, place, grams = windows.of(hashes, first)
        for w, g in zip(whole.tolist(), grams[place].tolist()):
            if w in seen:
                anchors[w] = g
            seen.add(w)
    found = countmin.estimated_repeated(np.array(list(anchors.values()), np.uint64), 19, repeated)
    assert len(anchors) > 100 and found.all()


def test_query_on_the_table(spark, sf_dir):
    got = sorted(map(tuple, QUERIES["op13_countmin_substrings"](spark, sf_dir).collect()))
    want = plain(rows_of(spark.read.parquet(f"{sf_dir}/documents.parquet")), 20)
    assert got == sorted((a, n, g, hashlib.sha256(kept.encode()).hexdigest()) for a, n, g, kept in want)


def test_empty_table(spark):
    docs = documents(spark, ["a"]).filter("false")
    assert countmin.remove_repeats(docs).collect() == []
    assert countmin.remove_repeats(documents(spark, [None, "", "one"])).filter("n_removed > 0").collect() == []
    with pytest.raises(ValueError):
        countmin.remove_repeats(docs, size=50)
