"""Line dedup: lines found in many documents lose all their copies. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderframe.llm.shared import written

# White space that is stripped, and the letters that are lower-cased.
STRIPPED = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.btrim(line, F.lit(STRIPPED))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; ``lower`` does the same, and faster, where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop every line whose key is found in at least ``min_docs`` documents.

    Returns the input's columns as ``row`` (a struct), with ``n_lines``, ``n_dropped``
    and ``kept`` (the remaining lines joined by line feeds). A null or empty text is one
    empty line; keys shorter than ``min_chars`` code points are never dropped. A document
    is a row: repeated rows count one by one and get equal results, null ids are fine, an
    empty table gives no rows, and other columns of any name pass through in ``row``.

    Keys are 64-bit hashes, written once: each document sends one hash per distinct line,
    counts are pre-aggregated, and only positions of dropped lines travel back. Texts are
    shuffled once, by document. Against 10^11 other lines and 10^7 frequent ones, the
    expected number of lines that share a frequent line's hash by chance is below 0.1.
    """
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    trimmed = F.transform(F.split(lower_ascii(text), "\n", -1), line_key)
    keyed = written(
        base.select(
            F.col(f"row.`{id_col}`").alias("id"),
            F.xxhash64(f"row.`{text_col}`").alias("text_hash"),
            F.transform(trimmed, lambda x: F.when(F.char_length(x) >= min_chars, F.xxhash64(x))).alias("keys"),
        ),
        "line-keys",
    )
    frequent = (
        keyed.select(F.explode(F.array_distinct(F.array_compact("keys"))).alias("key"))
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_docs)
        .select("key")
    )
    dropped = (
        keyed.select("id", "text_hash", F.posexplode("keys").alias("at", "key"))
        .join(frequent, "key")
        .groupBy("id", "text_hash")
        .agg(F.collect_set("at").alias("gone"))
    )
    left = base.withColumns({"l_id": F.col(f"row.`{id_col}`"), "l_hash": F.xxhash64(f"row.`{text_col}`")})
    joined = left.join(dropped, left["l_id"].eqNullSafe(dropped["id"]) & (left["l_hash"] == dropped["text_hash"]), "left")
    every = joined.select("row", F.split(text, "\n", -1).alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.transform(stay, lambda i: F.get("lines", i))
    return every.select(
        "row",
        F.size("lines").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_dropped"),
        F.array_join(kept, "\n").alias("kept"),
    )
