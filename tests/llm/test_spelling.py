import re
import zlib
from collections import Counter

import pytest
from cinderframe.llm import spelling
from cinderframe.llm.queries import QUERIES
from helpers import AWKWARD, documents
from hypothesis import given, settings
from hypothesis import strategies as st


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def plain_vocabulary(rows, one_in=97):
    total = Counter()
    for doc_id, text in rows:
        for word in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in word)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if one_in and h % one_in == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            total[word] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def plain_variants(words, times=2):
    shapes = {}
    for w in words:
        for i in range(len(w)):
            shapes.setdefault(w[:i] + "*" + w[i + 1 :], set()).add(w)
            shapes.setdefault(w[:i] + w[i + 1 :], set()).add(w)
        shapes.setdefault(w, set()).add(w)
    near = {w: set() for w in words}
    for group in shapes.values():
        for a in group:
            near[a].update(b for b in group if one_edit(a, b))
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def rows(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()))


def test_query_on_the_table(spark, sf_dir):
    out = QUERIES["op12_reduced_alphabet_variants"](spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = plain_variants(plain_vocabulary([tuple(r) for r in docs]))
    assert out.columns == COLUMNS
    assert sum(r[1] is not None for r in want) > 20
    assert rows(out) == want


def test_chains_ties_and_awkward_texts(spark):
    chain = ["aaaaaaaa"[:k] + "bbbbbbbb"[k:] for k in range(9)]
    texts = [*AWKWARD, *AWKWARD, *AWKWARD, "ÀÉÎõü×÷ÿ Àéîõü " * 4, "Straße STRASSE strase " * 5, "tied1 " + "ticed tiled " * 7 + "tided " * 3]
    texts += [f"{w} " * (3 << k) for k, w in enumerate(chain)] + [("y" * 3000 + " " + "y" * 2999 + "z ") * 3 + ("y" * 3000 + " ") * 9]
    docs = documents(spark, texts)
    docs = docs.unionByName(docs.selectExpr("cast(null as long) doc_id", *docs.columns[1:])).unionByName(docs.limit(20))
    plain = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for one_in in (0, 7):
        words = spelling.vocabulary(docs, one_in=one_in)
        want = plain_vocabulary(plain, one_in)
        assert {r["word"]: r["n"] for r in words.collect()} == want
        got = rows(spelling.variants(words))
        assert got == plain_variants(want)
        if not one_in:
            assert {r[2] for r in got if r[0] in chain} == {chain[-1]}


words_of_few_letters = st.dictionaries(st.text("abßé", min_size=1, max_size=6), st.integers(1, 40), min_size=1, max_size=40)


@settings(max_examples=8, deadline=None)
@given(words_of_few_letters, st.integers(1, 8))
def test_every_alphabet_finds_all_pairs(spark, words, symbols):
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows(spelling.variants(df, symbols=symbols)) == plain_variants(words)


def test_empty(spark):
    words = spelling.vocabulary(documents(spark, [None, "", "one two"]))
    assert words.collect() == [] and spelling.variants(words).collect() == []
    with pytest.raises(ValueError):
        spelling.variants(words, times=1)
