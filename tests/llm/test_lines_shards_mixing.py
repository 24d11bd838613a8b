import hashlib
import math
import zlib
from collections import Counter

import pytest
from cinderframe.llm import lines, minimax, mixing
from cinderframe.llm.queries import QUERIES
from helpers import AWKWARD, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def deduped(texts, min_docs, min_chars):
    keys = [[x.strip(SPACE).translate(LOWER) for x in (t or "").split("\n")] for t in texts]
    found = Counter(k for own in keys for k in set(own) if len(k) >= min_chars)
    out = []
    for t, own in zip(texts, keys):
        kept = [x for x, k in zip((t or "").split("\n"), own) if found[k] < min_docs]
        out.append((len(own), len(own) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("min_docs,min_chars", [(2, 1), (3, 3), (1, 1)])
def test_line_dedup_brute_force(spark, min_docs, min_chars):
    texts = [*AWKWARD, "É\nmenu\n Menu \x0b\nbody 1", "MENU\t\né\nbody 2", "menu", "menu\n", "a\nA\r\n\nb", None]
    rows = lines.dedup_lines(documents(spark, texts), min_docs, min_chars).select("row.doc_id", "row.key", "n_lines", "n_dropped", "kept").collect()
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept"]) for r in rows}
    assert got == dict(enumerate(deduped(texts, min_docs, min_chars)))
    assert {r["key"] for r in rows} == {"k"}


def test_line_dedup_of_repeated_rows_and_empty_table(spark):
    schema = "doc_id long, text string"
    rows = lines.dedup_lines(spark.createDataFrame([(1, "x\ny")] * 2 + [(None, "y\nz")], schema), 3).collect()
    assert sorted((r["row"]["doc_id"] or 0, r["n_dropped"], r["kept"]) for r in rows) == [(0, 1, "z"), (1, 1, "x"), (1, 1, "x")]
    assert lines.dedup_lines(spark.createDataFrame([], schema)).collect() == []


def minimax_of(sizes, shards):
    """Smallest capacity of any contiguous partition, by dynamic programming."""
    best = [0, *[float("inf")] * len(sizes)]
    sums = [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    for _ in range(shards):
        best = [0, *[min(max(best[i], sums[j] - sums[i]) for i in range(j + 1)) for j in range(1, len(sums))]]
    return best[-1]


def check_shards(rows, texts, shards):
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    place, slots, sizes, groups = {}, {}, Counter(), Counter()
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        assert 0 <= r["shard"] < shards
        assert place.setdefault(texts[r["doc_id"]], r["shard"]) == r["shard"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        sizes[r["shard"]] += r["size"]
        text = texts[r["doc_id"]]
        groups["" if text is None else hashlib.md5(text.encode()).hexdigest()] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    own, total = [], sum(groups.values())
    for digest, size in sorted(groups.items(), key=lambda g: (-g[1], g[0])):
        left = shards - len(own)
        if left <= 1 or size * left < total:
            break
        own.append(digest)
        total -= size
    rest = [groups[d] for d in sorted(groups) if d not in own]
    assert max([sizes[k] for k in range(len(own), shards)], default=0) == minimax_of(rest, shards - len(own))


def test_shards_of_awkward_texts(spark):
    texts = [*AWKWARD, *["same"] * 40, *[f"t{i}" * (i % 7 + 1) for i in range(60)], None]
    check_shards(minimax.shard(documents(spark, texts), 5).collect(), texts, 5)
    assert minimax.shard(documents(spark, []), 5).collect() == []
    check_shards(minimax.shard(documents(spark, ["a", "b"]), 5).collect(), ["a", "b"], 5)


def test_shards_of_the_whole_table(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check_shards(QUERIES["op5_minimax_shards"](spark, sf_dir).collect(), [texts[i] for i in range(len(texts))], 24)


@pytest.mark.parametrize("digits", [1, 2])
def test_cuts_are_found_from_coarse_blocks(spark, digits):
    """Blocks of many groups must be refined until the capacity is exact."""
    sizes = {hashlib.md5(str(i).encode()).hexdigest(): (i * 37) % 90 + 1 for i in range(700)}
    groups = spark.createDataFrame(list(sizes.items()), "digest string, size long").cache()
    for shards in (1, 3, 7):
        capacity, begins = minimax.partition(groups, shards, digits)
        ordered = [sizes[d] for d in sorted(sizes)]
        assert capacity == minimax_of(ordered, shards) and len(begins) == shards - 1
        filled = Counter(sum(d >= b for b in begins) for d in sizes for _ in range(sizes[d]))
        assert max(filled.values()) == capacity and min(filled.values()) > sum(ordered) / shards - 200


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=25), st.integers(1, 6))
def test_ladder_of_single_groups(sizes, shards):
    ladder = minimax.Ladder([minimax.Block(f"{i:03d}", s, 1) for i, s in enumerate(sizes)])
    capacity = ladder.smallest(shards, False)
    assert capacity == ladder.smallest(shards, True) == minimax_of(sizes, shards)


def test_mix_reaches_target_weights(spark):
    texts = ["abcdefghi"] * 6000
    sources = ["big"] * 4000 + ["small"] * 1000 + ["none"] * 500 + [None] * 500
    docs = documents(spark, texts, sources).cache()
    weights = {"big": 1.0, "small": 2.0, None: 1.0}
    rows = mixing.replicate(docs, weights, seed="t").select("row.source", "row.doc_id", "row.key", "copy", "order_key").collect()
    counts = Counter(r["source"] for r in rows)
    assert set(counts) == {"big", "small", None}
    for source, share in (("big", 0.25), ("small", 0.5), (None, 0.25)):
        assert counts[source] / 6000 == pytest.approx(share, abs=0.03)
    times = Counter(r["doc_id"] for r in rows if r["source"] == "small")
    spread = Counter(times[i] for i in range(4000, 5000))
    assert spread[3] / 1000 == pytest.approx(0.224, abs=0.05) and spread[0] / 1000 == pytest.approx(0.05, abs=0.03)
    again = mixing.replicate(docs.repartition(7), weights, seed="t").select("order_key").collect()
    assert sorted(r["order_key"] for r in again) == sorted(r["order_key"] for r in rows)
    ordered = [r["source"] for r in sorted(rows, key=lambda r: r["order_key"])]
    assert Counter(ordered[: len(rows) // 4])["small"] / (len(rows) // 4) == pytest.approx(0.5, abs=0.05)


def test_large_rates_and_positions(spark):
    docs = documents(spark, ["x"] * 30 + [None], ["rare"] * 30 + ["other"])
    rows = mixing.replicate(docs, {"rare": 99.0, "other": 1.0}, volume=200.0)
    placed = mixing.positions(rows, ["doc_id"]).collect()
    assert sorted(r["position"] for r in placed) == list(range(len(placed)))
    assert [r["order_key"] for r in sorted(placed, key=lambda r: r["position"])] == sorted(r["order_key"] for r in placed)
    each = Counter(r["doc_id"] for r in placed)
    assert sum(each[i] for i in range(30)) / 30 == pytest.approx(200 * 61 * 0.99 / 60, rel=0.06)
    assert mixing.positions(mixing.replicate(documents(spark, [])), ["doc_id"]).collect() == []


@pytest.mark.parametrize("rate", [0.0, 0.3, 5.0, 31.9, 70.0])
def test_draws_have_the_poisson_mean_and_variance(spark, rate):
    table = mixing.cumulative(spark.range(4000).select("id", F.lit(rate).alias("rate")))
    u = [mixing.unit(F.lit("s"), F.col("id").cast("string"), F.lit(str(k))) for k in range(1, 4)]
    n = mixing.written(table.select("parts", mixing.draws(F.col("rate"), F.col("parts"), F.col("upto"), "s", F.col("id").cast("string")).alias("n"), F.array(*u).alias("u")), "draws")
    for r in n.collect():
        count, mean = 0, rate / r["parts"]
        for x in r["u"][: r["parts"]] if rate else []:
            p = c = math.exp(-mean)
            k = 0
            while x >= c:
                k, p = k + 1, p * mean / (k + 1)
                c += p
            count += k
        assert r["n"] == count
    facts = n.agg(F.avg("n").alias("mean"), F.var_pop("n").alias("var")).head()
    assert facts["mean"] == pytest.approx(rate, abs=4 * (rate / 4000) ** 0.5 + 1e-9)
    assert facts["var"] == pytest.approx(rate, rel=0.15, abs=1e-9)
