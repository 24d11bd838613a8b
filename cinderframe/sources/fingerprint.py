"""File fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderframe.functions.shipping import by_value

by_value(__name__)

CHUNK = 1 << 20


def _stream_digests(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
    from pyarrow import fs

    for batch in batches:
        digests = []
        for path in batch["path"]:
            system, inner = fs.FileSystem.from_uri(path)
            digest = hashlib.sha256()
            with system.open_input_stream(inner) as stream:
                while chunk := stream.read(CHUNK):
                    digest.update(chunk)
            digests.append(digest.hexdigest())
        yield batch.assign(sha256=digests)


def fingerprint_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, length, sha256`` of every file; tasks stream the bytes in 1 MB chunks."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length").mapInPandas(_stream_digests, "path string, length bigint, sha256 string")


BLOCK = 64 << 20
FAN = 1024


def _block_digests(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
    from pyarrow import fs

    for batch in batches:
        digests = []
        for path, offset, left in zip(batch["path"], batch["offset"], batch["size"]):
            system, inner = fs.FileSystem.from_uri(path)
            digest = hashlib.sha256()
            with system.open_input_file(inner) as file:
                file.seek(offset)
                while left and (chunk := file.read(min(CHUNK, left))):
                    digest.update(chunk)
                    left -= len(chunk)
            digests.append(digest.hexdigest())
        yield batch.assign(sha256=digests)


def block_manifest(spark: SparkSession, path: str, pattern: str = "*", block: int = BLOCK) -> DataFrame:
    """``path, length, block, offset, size, sha256``: a digest per block of ``block`` bytes of every file.

    Only names and lengths are listed first; blocks are then dealt over all tasks, so one huge file is
    read by many of them. Spark's reader does not list empty files.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    number = F.ceil(F.col("length") / block).cast("long")
    blocks = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), number - 1)).alias("block"))
    placed = blocks.withColumn("offset", F.col("block") * block).withColumn("size", F.least(F.lit(block).cast("long"), F.col("length") - F.col("offset")))
    tasks = max(spark.sparkContext.defaultParallelism, 1) * 4
    dealt = placed.repartition(tasks, "path", "block")
    return dealt.mapInPandas(_block_digests, "path string, length bigint, block bigint, offset bigint, size bigint, sha256 string")


def file_roots(manifest: DataFrame, fan: int = FAN) -> DataFrame:
    """``path, length, blocks, sha256`` per file: the root of a tree of digests over its blocks.

    A parent is the sha256 of its children's digests, written in hex one after the other, ``fan`` at most. A file of one block has
    that block's digest, which is the sha256 of the file. ``manifest`` should be a written table.
    """
    level = manifest.select("path", "length", "block", "sha256")
    most = manifest.agg(F.max("block")).first()[0]
    blocks = manifest.groupBy("path").agg(F.count(F.lit(1)).alias("blocks"))
    while most:
        children = F.sort_array(F.collect_list(F.struct("block", "sha256")))
        parents = level.groupBy("path", "length", F.floor(F.col("block") / fan).alias("block")).agg(children.alias("children"))
        joined = F.array_join(F.transform("children", lambda c: c["sha256"]), "")
        # An only child stands for itself, so small files keep their plain digest.
        level = parents.select("path", "length", "block", F.when(F.size("children") == 1, F.col("children")[0]["sha256"]).otherwise(F.sha2(joined, 256)).alias("sha256"))
        most //= fan
    return level.join(blocks, "path").select("path", "length", "blocks", "sha256")


def changed_blocks(found: DataFrame, recorded: DataFrame, name: Column | None = None) -> DataFrame:
    """``file, block, change`` for blocks that differ from a recorded manifest (``file, block, sha256``): changed, missing or added."""
    name = F.element_at(F.split("path", "/"), -1) if name is None else name
    now = found.select(name.alias("file"), "block", F.col("sha256").alias("now"))
    both = now.join(recorded.select("file", "block", "sha256"), ["file", "block"], "full_outer")
    change = F.when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "added").when(F.col("now") != F.col("sha256"), "changed")
    return both.withColumn("change", change).filter("change is not null").select("file", "block", "change")


def check_fingerprints(found: DataFrame, expected: DataFrame, name: Column | None = None) -> DataFrame:
    """Expected files with their digest on disk: ``match``, ``differs`` or ``missing``.

    ``name`` makes a file's name of its path; without it, that is the last part.
    """
    name = F.element_at(F.split("path", "/"), -1) if name is None else name
    named = found.select(name.alias("file"), "length", "sha256")
    status = (
        F.when(F.col("sha256").isNull(), "missing")
        .when(F.col("sha256") == F.col("expected_sha256"), "match")
        .otherwise("differs")
    )
    return expected.join(named, "file", "left").withColumn("status", status)
