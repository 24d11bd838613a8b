"""The training-data pipeline: ``run`` applies STAGES to the documents in order.

Each stage reads what its predecessor kept and returns the columns of documents; the
last one returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderframe.llm import crf, lines, minhash, mixing, queries
from cinderframe.llm.shared import written


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten or more documents go; documents stay, also when nothing is left of them."""
    out = lines.dedup_lines(docs, min_docs=10, min_chars=1)
    columns = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("text", "n_chars")]
    text = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("row.text")).alias("text")
    return out.select(*columns, text, F.char_length(text).cast("long").alias("n_chars")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id.

    Every row is compared for itself, also where an id is repeated: copies and near copies of one id
    come down to one row, unlike texts of one id all stay. Rows without words link with nothing;
    one of each id stays. Rows with a null id link with nothing and all stay.
    """
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "minhash-rows")
    known = rows.filter("doc_id is not null")
    groups = minhash.near_duplicates(known.select("__row", "text"), id_col="__row").select("__row", "n_shingles", "component_id")
    group = [F.when(F.col("n_shingles") > 0, F.col("component_id")), F.when(F.col("n_shingles") == 0, F.col("doc_id"))]
    first = F.min_by("__row", F.struct("doc_id", "__row")).alias("__row")
    kept = known.select("__row", "doc_id").join(groups, "__row").groupBy(*group).agg(first).select("__row")
    single = known.join(kept, "__row", "left_semi").unionByName(rows.filter("doc_id is null"))
    return single.select(*docs.columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model finds more likely bad than good go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = crf.score(docs, queries.quality_model(docs, labels), out="__score")
    return scored.filter("__score >= 0.5").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat by Poisson draws so that sources follow the root of their size.

    A hash of document and copy deals the copies to partitions and orders them there: the global shuffle.
    """
    mixed = mixing.replicate(docs, alpha=0.5)
    return mixed.repartition("order_key").sortWithinPartitions("order_key").select("row.*").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every remaining copy in sequences of 2,048."""
    return queries.pack_documents(docs)


STAGES = [
    ("quality", drop_low_quality),
    ("line_dedup", drop_common_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Stages of the pipeline train, hash and pack outside SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every stage's result is a written table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
