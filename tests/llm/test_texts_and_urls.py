import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from cinderframe.llm import crf, licenses, url_tree, words
from cinderframe.llm.queries import QUERIES, URL_RULES, held_out, quality_model
from helpers import AWKWARD, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def brute_marginals(model, scores):
    """P(good) of every line by summing over all label sequences."""
    n = len(scores)
    total, good = 0.0, np.zeros(n)
    for code in range(1 << n):
        y = [code >> i & 1 for i in range(n)]
        value = np.exp(sum(s for s, k in zip(scores, y) if k) + sum(model.transition[a, b] for a, b in zip(y, y[1:])))
        total += value
        good += value * np.array(y)
    return good / total, np.log(total)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(-4, 4), min_size=1, max_size=6), st.lists(st.floats(-2, 2), min_size=4, max_size=4))
def test_forward_backward(scores, transition):
    model = crf.Crf(np.zeros(1), np.array(transition).reshape(2, 2))
    padded = np.zeros((2, 7))
    padded[0, : len(scores)] = scores
    padded[1, :1] = scores[:1]
    good, _, log_norm = model.marginals(padded, np.array([len(scores), 1]))
    want, norm = brute_marginals(model, scores)
    alone, norm_alone = brute_marginals(model, scores[:1])
    assert np.allclose(good[0, : len(scores)], want) and np.allclose(good[1, 0], alone)
    assert log_norm == pytest.approx(norm + norm_alone)


def test_features_split_lines_as_python_does():
    texts = [t or "" for t in AWKWARD] + ["a\n", "\n", "x\n\ny"]
    raw = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, raw)])
    features, size, first = crf.line_features(words.WordHasher(words.space_separated()), np.frombuffer(b"".join(raw), np.uint8), bounds)
    plain = [x.encode() for t in texts for x in t.split("\n")]
    assert size.tolist() == [len(x) for x in plain]
    assert np.diff(np.append(first, len(size))).tolist() == [len(t.split("\n")) for t in texts]
    upper = [sum(65 <= b < 91 for b in x) / max(len(x), 1) for x in plain]
    assert np.allclose(features[:, 1], upper)
    repeats = [(len(x.split()) - len({w.lower() for w in x.split()})) / max(len(x.split()), 1) for x in plain]
    assert np.allclose(features[:, len(crf.CLASSES)], repeats)


def test_held_out_quality(spark):
    rows = QUERIES["op3_line_crf"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    pairs = rows.join(labels, "doc_id").filter("held_out").select("score", "predicted", "quality").collect()
    good, bad = ([r["score"] for r in pairs if r["quality"] == k] for k in (1, 0))
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert auc >= 0.97 and np.mean([r["predicted"] == r["quality"] for r in pairs]) >= 0.93
    assert rows.count() == 1000 and rows.filter("score < 0 or score > 1 or score is null").count() == 0


def test_scores_of_awkward_texts_do_not_depend_on_batches(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = quality_model(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    table = documents(spark, AWKWARD).withColumn("score", F.lit("old"))
    one, many = (sorted(crf.score(t, model).select("doc_id", "score", "key").collect()) for t in (table.coalesce(1), table.repartition(9)))
    assert [r["doc_id"] for r in one] == list(range(len(AWKWARD)))
    assert np.allclose([r["score"] for r in one], [r["score"] for r in many]) and all(0 <= r["score"] <= 1 for r in one)
    assert crf.score(documents(spark, []), model).collect() == []


def test_labels_of_one_kind_or_none(spark):
    docs = documents(spark, ["good text here", None])
    for labels in ([], [(0, 1)], [(0, None), (None, 1)]):
        model = crf.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert all(0 <= r["score"] <= 1 for r in crf.score(docs, model).collect())


URLS = ["http://A.Example.net/en/1?x#y", "x://example.com/de/", "x://example.com/de", "http://h", "nothing", None, "", "a://b://c/d", "http://q.org/fr/#z", "http://q.org/FR/", "http://net", "http://net/", "http://xnet/a", "http://h?p/q", "HTTP://h\n/é/ü"]


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def plain_rule(host, path):
    best = (None, None)
    for verdict, rule in sorted(URL_RULES, key=lambda r: len(r[1])):
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            best = (rule, verdict)
    return best


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(URLS)], "page_id long, url string, host string, bad int")
    labels = spark.createDataFrame([(0, 0), (None, 1)], "page_id long, bad int")
    rows = {r["page_id"]: r for r in url_tree.judge(pages, labels, URL_RULES).collect()}
    for i, url in enumerate(URLS):
        host, path = plain_url(url)
        rule, verdict = plain_rule(host, path)
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == (host, path, rule)
        assert rows[i]["verdict"] == (verdict or "allow")
    assert url_tree.judge(pages.filter("false"), labels, URL_RULES).collect() == []


def test_whole_page_table(spark, sf_dir):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = QUERIES["op2_url_templates"](spark, sf_dir).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(urls)
    for r in rows:
        host, path = plain_url(urls[r["page_id"]])
        rule, verdict = plain_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["purity"] >= 0.5 else "allow"))


def plain_chance(n, b, m, c):
    """Fisher's two-sided p-value in whole numbers: the smaller tail, doubled."""
    ways = {k: math.comb(n, k) * math.comb(m, b + c - k) for k in range(n + 1) if 0 <= b + c - k <= m}
    above = b * (n + m) >= n * (b + c)
    tail = sum(w for k, w in ways.items() if (k >= b if above else k <= b))
    return min(1.0, float(2 * Fraction(tail, sum(ways.values()))))


def plain_templates(pages, support=8, alpha=0.05):
    """The tree of templates, node by node."""
    common = Counter((h, k, s) for _, h, path, _ in pages for k, s in enumerate(plain_shape(path)))
    ways = {i: (h, [s if s == "" or s.startswith("{n}") or common[h, k, s] >= support else "{*}" for k, s in enumerate(plain_shape(path))]) for i, h, path, _ in pages}
    kids = defaultdict(lambda: defaultdict(lambda: [0, 0]))
    for i, _, _, bad in pages:
        if bad is not None:
            host, tokens = ways[i]
            for k, token in enumerate(tokens):
                own = kids[host, *tokens[:k]][token]
                own[0] += 1
                own[1] += bad
    labels = {}
    for parent, seen in kids.items():
        n, b = (sum(v[x] for v in seen.values()) for x in (0, 1))
        if len(seen) < 2 or not 0 < b < n:
            continue
        apart = [t for t, v in seen.items() if plain_chance(*v, n - v[0], b - v[1]) * len(seen) < alpha]
        groups = [[t] for t in sorted(apart, key=lambda t: Fraction(seen[t][1], seen[t][0]))]
        while len(groups) > 1:
            sums = [[sum(seen[t][x] for t in g) for x in (0, 1)] for g in groups]
            alike = [plain_chance(*x, *y) for x, y in zip(sums, sums[1:])]
            best = max(range(len(alike)), key=alike.__getitem__)
            if alike[best] < alpha:
                break
            groups[best : best + 2] = [groups[best] + groups[best + 1]]
        for g in groups:
            for t in g:
                labels[*parent, t] = t if len(g) == 1 else "{%s+%d}" % (min(g), len(g) - 1)
    out = {}
    for i, (host, tokens) in ways.items():
        met = [k for k in range(len(tokens)) if (host, *tokens[: k + 1]) in labels]
        out[i] = "/{**}" if tokens else ""
        if met:
            k = met[-1]
            out[i] = "/" + "/".join([*tokens[:k], labels[host, *tokens[: k + 1]], *(["{**}"] if len(tokens) > k + 1 else [])])
    return out


def plain_shape(path):
    return [re.sub("^[0-9]+", "{n}", s) if re.fullmatch(r"[0-9]+(\.[a-z]+)?", s) else s for s in path.split("/")[1:]]


def plain_purity(groups, most=20.0):
    """Shares of (n, b) groups, smoothed by as many pages of the mean as the groups' spread allows."""
    n, b = sum(g[0] for g in groups), sum(g[1] for g in groups)
    base = b / n
    spread = sum((y - x * base) ** 2 for x, y in groups) / (base * (1 - base))
    within = (spread - n) / sum(x * (x - 1) for x, _ in groups)
    prior = 1 / min(max(within, 1 / (most + 1)), 0.5) - 1
    return [(y + prior * base) / (x + prior) for x, y in groups]


def random_site(rng, rows, sections):
    pages = []
    for i in range(rows):
        name = rng.choice(list(sections))
        bad = int(rng.random() < sections[name])
        tail = f"/{rng.integers(10**6)}" + rng.choice(["", ".html", "/a/b/c/d/e", "/"])
        pages.append((i, f"h{i % 2}", f"/{name}{tail}" if rng.random() < 0.9 else f"/odd{i}{tail}", bad if rng.random() < 0.6 else None))
    return pages


def test_exact_chances_of_branches():
    rng = np.random.default_rng(9)
    for _ in range(300):
        n, m = (int(x) for x in rng.integers(1, 60, 2))
        b, c = int(rng.integers(0, n + 1)), int(rng.integers(0, m + 1))
        assert url_tree.difference(n, b, m, c) == pytest.approx(plain_chance(n, b, m, c), rel=1e-9)
    assert url_tree.difference(10**6, 10**5, 10**6, 10**5) == 1.0
    assert url_tree.difference(10**6, 10**6, 10**6, 0) == 0.0


def test_templates_against_a_plain_tree(spark):
    sections = {"shop": 0.1, "blog": 0.1, "spam": 0.9, "pills": 0.9, "mixed": 0.45}
    pages = random_site(np.random.default_rng(4), 1500, sections) + [(2000, None, None, 1), (2001, "h0", "", 0), (2001, "h0", "/", None), (2002, "one", "/x/y", 1)]
    table = spark.createDataFrame(pages, "page_id long, host string, path string, bad int")
    placed = url_tree.templates(table)
    got = Counter((r["id"], r["host"], r["path"], r["template"]) for r in placed.collect())
    known = [(k, h or "", p or "", b) for k, (_, h, p, b) in enumerate(pages)]
    want = plain_templates(known)
    assert got == Counter((pages[k][0], h, p, want[k]) for k, h, p, _ in known)
    assert "/{pills+1}/{**}" in want.values()
    groups = defaultdict(lambda: [0, 0])
    for k, h, _, b in known:
        groups[h, want[k]][0] += b is not None
        groups[h, want[k]][1] += b or 0
    shares = dict(zip(groups, plain_purity(list(groups.values()))))
    rows = url_tree.purity(placed).collect()
    assert {(r["host"], r["template"]): r["labelled"] for r in rows} == {g: n for g, (n, _) in groups.items()}
    for r in rows:
        assert r["purity"] == pytest.approx(shares[r["host"], r["template"]])


def test_rejected_pages_are_bad_where_labels_were_held_out(spark):
    """Labels of even rows teach; of odd rows that templates reject nearly all are bad, and no bad section is missed. Labels that do not depend on the path reject nothing."""
    rng = np.random.default_rng(11)
    sections = {f"s{k}": 0.95 if k % 4 == 0 else 0.08 for k in range(20)}
    pages = [p for p in random_site(rng, 3000, sections) if p[3] is not None]
    table = spark.createDataFrame([(i, f"http://{h}{p}", b) for i, h, p, b in pages], "page_id long, url string, bad int")
    got = {r["page_id"]: r["verdict"] for r in url_tree.judge(table.drop("bad"), table.filter("page_id % 4 < 2").drop("url"), []).collect()}
    assert np.mean([b for i, *_, b in pages if i % 4 >= 2 and got[i] == "block"]) > 0.9
    worst = {s for s, share in sections.items() if share > 0.5}
    assert {i for i, v in got.items() if v == "block"} == {i for i, _, path, _ in pages if path.split("/")[1] in worst}
    mixed = spark.createDataFrame([(i, int(x)) for (i, *_), x in zip(pages, rng.random(len(pages)) < 0.2)], "page_id long, bad int")
    assert {r["verdict"] for r in url_tree.judge(table.drop("bad"), mixed, []).collect()} == {"allow"}


def test_deep_paths(spark):
    """A branch below 300 segments; the number of jobs does not follow the depth."""
    deep = "/".join(f"s{k}" for k in range(300))
    rows = [(i, "h", f"/{deep}/{'bad' if i % 2 else 'good'}/{i}", i % 2) for i in range(40)]
    got = url_tree.templates(spark.createDataFrame(rows, "page_id long, host string, path string, bad int")).collect()
    assert {(r["bad"], r["template"]) for r in got} == {(0, f"/{deep}/good/{{**}}"), (1, f"/{deep}/bad/{{**}}")}


def test_rare_and_deep_branches_are_judged_alike_on_hosts_of_any_size(spark):
    """A bad section of 1.5% of a large host, and one below the fourth segment; the same on a small host."""
    rows = [("large", "/news/x", 0)] * 3940 + [("large", "/spam/x", 1)] * 60
    rows += [("large", f"/rare{k}/x", 0) for k in range(10) for _ in range(60)]
    rows += [("small", "/news/x", 0)] * 100 + [("small", "/spam/x", 1)] * 60
    rows += [("deep", "/a/b/c/d/e/good/x", 0)] * 60 + [("deep", "/a/b/c/d/e/bad/x", 1)] * 60
    rows = [(i, f"http://{h}{p}{i}", bad) for i, (h, p, bad) in enumerate(rows)]
    table = spark.createDataFrame(rows, "page_id long, url string, bad int")
    got = url_tree.judge(table.drop("bad"), table.drop("url"), []).collect()
    assert {r["page_id"] for r in got if r["verdict"] == "block"} == {i for i, _, bad in rows if bad}
    assert len(got) == len(rows)
    assert {r["template"] for r in got if r["host"] == "deep"} == {"/a/b/c/d/e/good/{**}", "/a/b/c/d/e/bad/{**}"}


def plain_licenses(text, least):
    """Every template that a text holds, at its best place, by trying all units and windows."""

    def words(x):
        return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), x))

    text, found = text or "", set()
    units = [[text], re.split(r"\n[ \t\r\x0b\x0c]*\n", text), text.split("\n")]
    spans = [(rank, w, sum(len(words(v)) for v in parts[:k])) for rank, parts in enumerate(units) for k, w in enumerate(map(words, parts))]
    for name, body in licenses.TEMPLATES.items():
        t, all_words = words(body), words(text)
        grams, best = set(zip(t, t[1:])), None
        windows = [(3, all_words[k : k + len(t)], k) for k in range(len(all_words) - len(t) + 1)] if grams & set(zip(all_words, all_words[1:])) else []
        for rank, w, start in spans + windows:
            own = set(zip(w, w[1:]))
            dice = 2.0 * len(own & grams) / (len(own) + len(grams))
            if dice >= least and (best is None or (-dice, rank, start) < best[:3]):
                best = (-dice, rank, start, len(w))
        if best:
            found.add((name, -best[0], licenses.UNITS[best[1]], best[2], best[3]))
    return found or {(None,) * 5}


def test_licences_against_brute_force(spark):
    mit, bsd, gpl = (licenses.TEMPLATES[n] for n in ("MIT", "BSD-2-Clause", "GPL-3.0-or-later header"))
    half = mit.split(" ")
    texts = [*AWKWARD, mit.upper(), "Intro.\n\n" + mit.replace(" ", "\n") + "\n \t\nrest", "x\n" + bsd + "\ny", " ".join(half[: len(half) // 2]),
             "a\nReleased under the  MIT license\nb", "Released under the", mit + " " + bsd, "licensed under cc by nc 4 0\n\n\nreleased under the mit license", " ".join(half[3:]) + " é",
             mit + "\n\n" + gpl, "Copyright 2024 Foo. Released under the MIT License.", "import x\n# " + gpl.replace("the ", "\n# ") + "\nint main() {}\n" * 40,
             "Released under the MIT License. " * 300, " ".join(half[:40] + ["other"] * 60 + half[40:])]
    got = {}
    for r in licenses.scan(documents(spark, texts)).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    for i, text in enumerate(texts):
        assert len(got[i]) == len(set(got[i])) and set(got[i]) == plain_licenses(text, 0.8), text[:80]
    names = [{m[0] for m in got[i]} for i in range(len(texts))]
    assert names[len(AWKWARD) + 9] >= {"MIT", "GPL-3.0-or-later header"} and names[len(AWKWARD) + 10] == {"MIT notice"}
    assert licenses.scan(documents(spark, [])).collect() == []


def test_many_windows_are_compared_in_parts(spark, monkeypatch):
    monkeypatch.setattr(licenses, "WINDOWS", 7)
    words = np.random.default_rng(2).integers(0, 6, 400).astype(np.uint64)
    grams = licenses.bigram_hashes(words)
    for width in (3, 8, 20):
        template = np.unique(grams[100 : 99 + width])
        own = np.flatnonzero(np.isin(grams, template))
        sets = [set(grams[s : s + width - 1].tolist()) for s in range(401 - width)]
        dice = [2.0 * len(g & set(template.tolist())) / (len(g) + len(template)) for g in sets]
        top = int(np.argmax(dice))
        assert licenses.best_window(grams, own, width, 0, 400, len(template), 0.8) == (dice[top], top)


def test_sample_of_lines_is_bounded_whatever_repeats(spark):
    """An id of 3,000 rows counts once; many lines stop the sample; a null id is held out of nothing."""
    rows = [(1, f"text {i}") for i in range(3000)] + [(k, "a\n" * 99 + "a") for k in range(2, 60)] + [(None, "x"), (60, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(k, k % 2) for k in range(61)] + [(1, 0), (1, 1), (None, 1)], "doc_id long, quality int")
    take = lambda **bounds: crf.training_sample(docs, labels, **{"sample": 4000, "most_bytes": 65536, "most_lines": 10**6, **bounds}, id_col="doc_id", text_col="text", label_col="quality").collect()
    assert len(take()) == 60 and len(take(sample=7)) == 7
    few = take(most_lines=1000)
    assert 9 <= len(few) <= 12 and sum(r["text"].count("\n") + 1 for r in few) <= 1000
    assert sorted(map(tuple, take())) == sorted(map(tuple, take()))
    assert [r["h"] for r in docs.filter("doc_id is null").select(held_out().alias("h")).collect()] == [False]
