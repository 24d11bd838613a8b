"""Spelling variants of a vocabulary: one-edit neighbours by way of a reduced alphabet.

Letters are hashed to a few symbols. One edit of a word is at most one edit of its reduced
word, so the one-edit neighbourhoods of reduced words, joined with the reduced vocabulary, hold all pairs of near
words; each candidate pair is verified on the words themselves. Neighbourhoods come from rolling hashes,
so a word of n letters costs n times the number of symbols, however long it is.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderframe.llm.shared import batch_bytes, by_value, strings, text_chunks, written
from cinderframe.llm.words import BASE, INVERSE, U, mix, powers

by_value(__name__)

# The characters of words.
LETTERS = "[A-Za-zÀ-ÿ]+"
SYMBOLS = 8
FLUSH = 400_000
SLICE = 1 << 16  # bytes of words whose neighbourhoods are made at once


def _count(one_in: int):
    """Partial counts of a task's words, sent on whenever ``FLUSH`` words are held."""
    find = re.compile(LETTERS).findall

    def run(batches):
        import pyarrow as pa

        total: dict[str, int] = {}

        def sent():
            batch = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return batch

        for batch in batches:
            data, at = strings(batch.column(1))
            for doc_id, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                seed = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode())) if one_in else 0
                for word, n in Counter(find(data[a:b].tobytes().lower().decode("utf-8", "replace"))).items():
                    if one_in:
                        h = zlib.crc32(word.encode(), seed)
                        if h % one_in == 0:
                            cut = h % len(word)
                            word = word[:cut] + word[cut + 1 :]
                    total[word] = total.get(word, 0) + n
                if len(total) > FLUSH:
                    yield sent()
        if total:
            yield sent()

    return run


def vocabulary(docs: DataFrame, min_chars: int = 5, min_count: int = 3, one_in: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of at least ``min_chars`` letters met at least ``min_count`` times, A-Z in lower case.

    Words are maximal runs of ASCII and Latin-1 letters of whole texts; null texts have none. With ``one_in``, a word of
    a document loses one letter where ``one_in`` divides the crc32 of ``<id>:<word>`` (a null id is empty there). Tasks send
    partial counts, so a frequent word costs a few rows per task.
    """
    batch_bytes(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    counted = source.mapInArrow(_count(one_in), "word string, n long").filter(F.char_length("word") >= min_chars)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def reduced(words: list[str], symbols: int):
    """(symbol of every letter, from 1; first letter of every word; hash of every reduced word before mixing; prefix sums; powers)."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    size = np.array([len(w) for w in words], np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    symbol = (points % symbols + 1).astype(U)
    at = np.arange(len(points)) - np.repeat(first[:-1], size)
    longest = int(size.max()) + 1
    up = powers(longest, BASE)[at]
    sums = np.zeros(len(points) + 1, U)
    np.cumsum(symbol * up, out=sums[1:])
    return symbol, first, size, up, sums


def code(sums: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix(sums ^ mix(size.astype(U)))


def _codes(symbols: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b, _, _ in text_chunks(batch.column(0), SLICE):
                part = batch.slice(a, b - a)
                _, first, size, _, sums = reduced(part.column(0).to_pylist(), symbols)
                codes = code(sums[first[1:]] - sums[first[:-1]], size)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(codes.view(np.int64))], ["word", "n", "code"])

    return run


def _neighbourhoods(symbols: int):
    """The one-edit neighbourhood of every reduced word, itself included.

    A pair of unlike reduced words is listed once: insertions as the deletions of the longer word,
    replacements from the word with the smaller symbol.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b, _, _ in text_chunks(batch.column(1), SLICE):
                part = batch.slice(a, b - a)
                words, own = part.column(1).to_pylist(), part.column(0).to_numpy()
                symbol, first, size, up, sums = reduced(words, symbols)
                word = np.repeat(np.arange(len(words)), size)
                whole = (sums[first[1:]] - sums[first[:-1]])[word]
                before, after = sums[:-1] - sums[first[:-1]][word], sums[first[1:]][word] - sums[1:]
                keys, owners = [own], [own]
                new = np.ones(len(symbol), bool)  # deletions inside a stretch of equal symbols are alike
                new[1:] = symbol[1:] != symbol[:-1]
                new[first[:-1]] = True
                shorter = before + after * U(INVERSE)
                keys.append(code(shorter[new], size[word[new]] - 1).view(np.int64)), owners.append(own[word[new]])
                for other in range(2, symbols + 1):
                    mine = symbol < other
                    changed = whole[mine] + (U(other) - symbol[mine]) * up[mine]
                    keys.append(code(changed, size[word[mine]]).view(np.int64)), owners.append(own[word[mine]])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(owners)), pa.array(np.concatenate(keys))], ["code", "other"])

    return run


def near_pairs(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(a, a_n, b, b_n): pairs of words that differ by exactly one inserted, deleted or replaced code point, each once.

    ``words`` is (word, n) without repeats. The neighbourhoods of unlike reduced words meet the
    reduced vocabulary, both without repeats; words meet only inside such pairs of classes, under the verifying condition.
    """
    spark = words.sparkSession
    batch_bytes(spark)
    coded = written(words.mapInArrow(_codes(symbols), "word string, n long, code long"), "reduced-words")
    classes = coded.groupBy("code").agg(F.min("word").alias("word"))
    around = classes.mapInArrow(_neighbourhoods(symbols), "code long, other long")
    met = written(around.join(coded.select(F.col("code").alias("other")).distinct(), "other").select("code", "other"), "near-classes")
    a = coded.select("code", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = coded.select(F.col("code").alias("other"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    left = met.join(a, "code")
    one_edit = (F.abs(F.char_length("a") - F.char_length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1)
    once = (F.col("code") != F.col("other")) | (F.col("a") < F.col("b"))
    return left.join(b, "other").filter(once & one_edit).select("a", "a_n", "b", "b_n")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) for every row of (word, form): the last word when forms are followed; forms never lead in circles.

    Pointers double, so a chain of length n takes log2(n) joins. A word's count at least halves its form's, so
    n is below the logarithm of the largest count.
    """
    found = written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = found.select(F.col("word").alias("at"), F.col("root").alias("next"))
        joined = found.join(ahead, F.col("root") == F.col("at"), "left")
        found = written(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if found.filter("moved").isEmpty():
            return found.select("word", "root")
        found = found.select("word", "root")


def variants(words: DataFrame, times: float = 2, symbols: int = SYMBOLS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per word of (word, n).

    ``form`` is the near word (one edit away) with the largest n, the first in code-point order of equal ones, if that n is at least
    ``times`` (more than 1) the word's own; else null. ``root`` is where forms lead, the word itself if nowhere.
    ``n_near`` counts near words. An empty vocabulary gives no rows.
    """
    if times <= 1:
        raise ValueError("times must be above 1")
    words = written(words.select("word", "n"), "vocabulary")
    pairs = near_pairs(words, symbols)
    both = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    sides = pairs.select(F.explode(both).alias("p")).select("p.*")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near")))
    near = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    form_n = -F.col("best.minus")
    chosen = form_n >= F.col("n") * times
    whole = words.join(near, "word", "left").select(
        "word",
        F.when(chosen, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(chosen, form_n).alias("form_n"),
    )
    whole = written(whole, "forms")
    led = roots(whole.filter("form is not null").select("word", "form"))
    return whole.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
