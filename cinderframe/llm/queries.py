"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderframe.llm import countmin, cross_polytope, crf, licenses, lines, minimax, minhash, mixing, packing, pstable, spelling, suffix_runs, url_tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_minhash_dedup")
def op1(spark, sf_dir):
    """Components of documents at a shingle similarity of 0.85 or more."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), similar=(85, 100))


# The rules of the filter, as (verdict, rule).
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@query("op2_url_templates")
def op2(spark, sf_dir):
    """Verdict on every page's url.

    A page shows the document that its path's last number names; that document's labels,
    where it has any, are the page's.
    """
    pages = table(spark, sf_dir, "pages")
    number = F.regexp_extract(url_tree.url_path(F.col("url")), r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    shown = pages.select("page_id", F.when(number != "", number.cast("long")).alias("doc_id")).filter("doc_id is not null")
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    labels = shown.join(table(spark, sf_dir, "labels").select("doc_id", bad.alias("bad")), "doc_id").select("page_id", "bad")
    return url_tree.judge(pages, labels, URL_RULES)


def held_out():
    """True for documents whose labels no model may learn from; false for a null id, which no label names."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def quality_model(docs: DataFrame, labels: DataFrame) -> crf.Crf:
    """The line model, trained on labels outside the held-out quarter."""
    return crf.fit(docs, labels.filter(~held_out()), label_col="quality")


@query("op3_line_crf")
def op3(spark, sf_dir):
    """Quality score of every document from line marginals."""
    docs = table(spark, sf_dir, "documents")
    scored = crf.score(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op4_pstable_dedup")
def op4(spark, sf_dir):
    """Links and components of vectors of one label at a cosine of 0.93 or more."""
    return pstable.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


@query("op5_minimax_shards")
def op5(spark, sf_dir):
    """24 shards near equal in bytes; equal texts stay together."""
    return minimax.shard(table(spark, sf_dir, "documents"), 24)


@query("op6_cross_polytope_search")
def op6(spark, sf_dir):
    """The 20 rows with the largest inner product found for every twentieth vector."""
    return cross_polytope.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query("op7_bin_slack_packing")
def op7(spark, sf_dir):
    """Token pieces of all documents in sequences of 2,048."""
    return pack_documents(table(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame) -> DataFrame:
    path = public_tokenizers.path
    return packing.pack(docs, str(path("byte_bpe_50k.json")), str(path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


@query(
    "op8_poisson_mixing",
    r"""
    WITH s AS (SELECT source, CAST(sum(coalesce(strlen(text), 0) + 1) AS DOUBLE) AS size FROM documents GROUP BY source),
    r AS (SELECT source, (SELECT sum(size) FROM s) / (SELECT sum(pow(size, 0.5)) FROM s) * pow(size, 0.5) / size AS rate FROM s),
    u AS (
      SELECT doc_id, r.source, rate, greatest(ceil(rate / 32.0), 1) AS parts FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source
    ),
    p AS (
      SELECT doc_id, source, rate / parts AS mean,
             CAST(CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || part), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS x
      FROM (SELECT *, unnest(range(1, CAST(parts AS BIGINT) + 1)) AS part FROM u)
    ),
    k AS (
      SELECT doc_id, source, n, mean, x,
             sum(CASE WHEN n = 0 THEN exp(-mean) ELSE exp(-mean + n * ln(mean) - lgamma(n + 1)) END)
               OVER (PARTITION BY doc_id, x ORDER BY n) AS c
      FROM (SELECT *, unnest(range(0, 110)) AS n FROM p)
    ),
    t AS (SELECT doc_id, source, count(*) FILTER (WHERE x >= c) AS times FROM k GROUP BY doc_id, source),
    e AS (SELECT doc_id, source, CAST(unnest(range(0, times)) AS INTEGER) AS copy FROM t)
    SELECT doc_id, source, copy,
           row_number() OVER (ORDER BY md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || copy || '|order'), doc_id, source, copy) - 1 AS position
    FROM e
    """,
)
def op8(spark, sf_dir):
    """Documents repeated so that each source's bytes follow the root of its size, in shuffled order."""
    mixed = mixing.replicate(table(spark, sf_dir, "documents"), alpha=0.5)
    return mixing.positions(mixed, ["doc_id", "source"]).select("doc_id", "source", "copy", "position")


@query(
    "op9_line_dedup",
    r"""
    WITH l AS (
      SELECT rid, doc_id, p, lines[p] AS line,
             lower_ascii AS key
      FROM (
        SELECT rid, doc_id, lines, unnest(range(1, len(lines) + 1)) AS p
        FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
      ), LATERAL (SELECT translate(trim(lines[p], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii)
    ),
    f AS (SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10)
    SELECT doc_id, count(*) AS n_lines,
           count(*) FILTER (WHERE f.key IS NOT NULL) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
    FROM l LEFT JOIN f USING (key) GROUP BY rid, doc_id
    """,
)
def op9(spark, sf_dir):
    """Lines of documents that are found in at least ten documents are dropped."""
    out = lines.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def _license_oracle() -> str:
    quoted = ", ".join("('" + n.replace("'", "''") + "', '" + t.replace("'", "''") + "')" for n, t in licenses.TEMPLATES.items())
    words = (
        "list_filter(string_split_regex(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+'), lambda w: w <> '')"
    )
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
    WITH t AS (SELECT name, w, {grams} AS g FROM (SELECT name, {words.format(x="body")} AS w FROM (VALUES {quoted}) v(name, body))),
    docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
    units AS (
      SELECT rid, 0 AS rank, [text] AS bodies FROM docs
      UNION ALL SELECT rid, 1, string_split_regex(text, '\\n[ \\t\\r\\x0b\\x0c]*\\n') FROM docs
      UNION ALL SELECT rid, 2, string_split(text, chr(10)) FROM docs
    ),
    parts AS (
      SELECT rid, rank, p, {words.format(x="bodies[p]")} AS w
      FROM (SELECT *, unnest(range(1, len(bodies) + 1)) AS p FROM units WHERE bodies[1] IS NOT NULL)
    ),
    u AS MATERIALIZED (
      SELECT *, {grams} AS g, coalesce(sum(len(w)) OVER (PARTITION BY rid, rank ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM parts
    ),
    near AS MATERIALIZED (
      SELECT rid, name, u.w, t.g AS tg, len(t.w) AS width FROM u JOIN t ON rank = 0 AND len(u.w) >= len(t.w)
      WHERE len(list_intersect(u.g, t.g)) >= len(t.g) * 0.6
    ),
    windows AS (
      SELECT rid, name, tg, s - 1 AS start, width, list_slice(w, s, s + width - 1) AS w
      FROM (SELECT *, unnest(range(1, len(w) - width + 2)) AS s FROM near)
    ),
    m AS (
      SELECT rid, rank, name, start, len(w) AS n_words, g, tg FROM (
        SELECT rid, rank, name, start, u.w, u.g, t.g AS tg
        FROM u JOIN t ON len(u.g) * 0.8 <= 1.2 * len(t.g) AND len(t.g) * 0.8 <= 1.2 * len(u.g) WHERE len(u.g) > 0)
      UNION ALL SELECT rid, 3, name, start, width, {grams}, tg FROM windows
    ),
    d AS (SELECT rid, rank, name, start, n_words, 2.0::DOUBLE * len(list_intersect(g, tg)) / (len(g) + len(tg)) AS dice FROM m),
    b AS (SELECT * FROM d WHERE dice >= 0.8 QUALIFY row_number() OVER (PARTITION BY rid, name ORDER BY dice DESC, rank, start) = 1)
    SELECT doc_id, name AS license, dice, ['text', 'paragraph', 'line', 'window'][rank + 1] AS unit,
           CAST(start AS BIGINT) AS start, CAST(n_words AS BIGINT) AS n_words
    FROM docs LEFT JOIN b USING (rid)
    """


@query("op10_license_scan", _license_oracle())
def op10(spark, sf_dir):
    """Every licence notice in documents, as a whole, by paragraph, by line and by window, with its place."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text``; in the documents that the checksum of their id names, the words from one on repeat."""
    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    start = F.col("g") % n
    period = 1 + F.floor((n - F.col("start")) / (3 + F.col("g") % 8))
    repeated = F.transform("words", lambda w, i: F.when(i < F.col("start"), w).otherwise(
        F.get("words", (F.col("start") + (i - F.col("start")) % F.col("period")).cast("int"))))
    chosen = docs.select("doc_id", "text", checksum.alias("h")).withColumn("planted", F.coalesce(F.col("h") % 10 == 0, F.lit(False)))
    split = chosen.withColumn("words", F.when(F.col("planted") & F.col("text").isNotNull(), words)).withColumn("g", g)
    placed = split.withColumn("start", F.when(n > 0, start)).withColumn("period", F.when(n > 0, period))
    return placed.select("doc_id", F.when(n > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


@query("op11_suffix_tree_runs")
def op11(spark, sf_dir):
    """Periodic runs of words of every document, and digests of them and of the text without their repeats."""
    found = suffix_runs.periodic_runs(planted_runs(table(spark, sf_dir, "documents")), least=6, repeats=4)
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    ranked = F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    first = F.array_min(ranked)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        first.alias("top"),
    ).select(
        "doc_id", "n_runs", "top.start", "top.length", "top.period",
        F.expr("(1000 * top.length) div top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


@query("op12_reduced_alphabet_variants")
def op12(spark, sf_dir):
    """Words of all documents with the frequent word that each is a spelling of."""
    words = spelling.vocabulary(table(spark, sf_dir, "documents"), min_chars=5, min_count=3, one_in=97)
    return spelling.variants(words, times=2)


@query("op13_countmin_substrings")
def op13(spark, sf_dir):
    """Documents without the words of 20-word windows that start earlier elsewhere."""
    out = countmin.remove_repeats(table(spark, sf_dir, "documents"), size=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
