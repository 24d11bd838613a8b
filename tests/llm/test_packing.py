import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from cinderframe.llm import packing
from cinderframe.llm.queries import pack_documents
from helpers import AWKWARD, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))


def check_packing(rows, texts, tokenizer, capacity):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        at = 0
        for r in pieces:
            assert r["start"] == at and (r["length"] == capacity or r["piece"] == 0)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_round_trip_of_awkward_texts(spark, tokenizer):
    texts = [*AWKWARD, "a <|endoftext|> b", "<|endoftext|>", "don't  stop\r\n\r\n 123 45"]
    rows = pack_documents(documents(spark, texts)).collect()
    check_packing(rows, texts, tokenizer, 2048)


def test_round_trip_of_documents(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = pack_documents(docs).collect()
    used = check_packing(rows, [texts[i] for i in range(len(texts))], tokenizer, 2048)
    assert used <= -(-sum(r["length"] for r in rows) // 2048) + 1


def test_empty_table(spark):
    assert pack_documents(documents(spark, [])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=60))
def test_plan_places_everything_once(lengths):
    histogram = Counter(lengths)
    bins, seen = {}, Counter()
    for n, low, high, each, base, offset in packing.plan(histogram, 40):
        assert low == seen[n]
        seen[n] = high
        for rank in range(low, high):
            k = rank - low
            bins.setdefault(base + k // each, []).append((offset + k % each * n, n))
    assert seen == histogram
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 40


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), st.integers(0, 60))
def test_fullest_is_the_best_subset(available, room):
    sums = {0}
    for n, c in available.items():
        sums = {s + n * k for s in sums for k in range(c + 1)}
    chosen = packing.fullest(available, room)
    assert all(c <= available[n] for n, c in chosen.items())
    assert sum(n * c for n, c in chosen.items()) == max(s for s in sums if s <= room)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_fast_encoder_equals_the_json_tokenizer(text):
    path = public_tokenizers.path
    encoder = CACHE.setdefault("fast", packing._encoder(str(path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)) if "fast" not in CACHE else CACHE["fast"]
    exact = CACHE["exact"] if "exact" in CACHE else CACHE.setdefault("exact", Tokenizer.from_file(str(path("byte_bpe_50k.json"))))
    assert encoder.encode(text, allowed_special={packing.END}) == exact.encode(text, add_special_tokens=False).ids


CACHE = {}
