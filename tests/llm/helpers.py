"""Small document tables with the awkward cases every operator must take."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, id string, label int, n_shingles long, key string"


def documents(spark, texts, sources=None):
    """Documents 0, 1, ... with extra columns whose names clash with the operators' own."""
    sources = sources or [f"s{i % 3}" for i in range(len(texts))]
    rows = [(i, t, "en", s, None if t is None else len(t), "r", "x", 1, 7, "k") for i, (t, s) in enumerate(zip(texts, sources))]
    return spark.createDataFrame(rows, SCHEMA)


AWKWARD = [
    None,
    "",
    " \t\n",
    "one",
    "one two three four five six seven",
    "One TWO three  four\nfive six seven",
    "\n\n\n",
    "é ü 漢字   x y",
    "word " * 5000,
    "a\nb\na\nb\n",
    "one two three four five six seven",
    "x" * 20000,
]
