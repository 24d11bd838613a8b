"""Sharding by minimax contiguous partition of ordered atomic groups. DataFrame functions only.

Groups of equal texts are ordered by digest. The smallest feasible shard capacity is
found by binary search with a greedy check, as over a plain list of group sizes, but
the list stays in Spark: the driver sees totals of at most 65,536 contiguous blocks,
and finer totals only of the few blocks in which a cut may fall. Bounds on every cut
(all groups of a block together, or split anywhere) tell when the answer is exact.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderframe.llm.shared import gapless, written

FIRST_DIGITS, MORE_DIGITS, ALL_DIGITS = 4, 2, 32


@dataclass(frozen=True)
class Block:
    """Contiguous groups whose digests begin with ``prefix``."""

    prefix: str
    size: int
    groups: int


class Ladder:
    """Block totals in digest order, with bounds on greedy cuts."""

    def __init__(self, blocks: list[Block]):
        self.blocks = sorted(blocks, key=lambda b: b.prefix)
        self.ends = [0]
        for block in self.blocks:
            self.ends.append(self.ends[-1] + block.size)
        self.total = self.ends[-1]

    def floor(self, x: int) -> int:
        """Largest known boundary up to ``x``."""
        return self.ends[bisect_right(self.ends, x) - 1]

    def ceil(self, x: int) -> int:
        return self.ends[bisect_left(self.ends, max(x, 0))]

    def split(self, x: int) -> bool:
        """Whether ``x`` lies inside a block of several groups, where a boundary may hide."""
        i = bisect_right(self.ends, x) - 1
        return i < len(self.blocks) and self.ends[i] < x and self.blocks[i].groups > 1

    def cuts(self, capacity: int, shards: int, hopeful: bool) -> list[int]:
        """Greedy cuts from the left; ``hopeful`` lets a cut fall anywhere inside a block of several groups."""
        at, out = 0, []
        for _ in range(shards):
            reach = min(at + capacity, self.total)
            at = reach if hopeful and self.split(reach) else self.floor(reach)
            out.append(at)
        return out

    def cuts_back(self, capacity: int, shards: int, hopeful: bool) -> list[int]:
        """Greedy cuts from the right, listed from the left: the earliest places a cut may have."""
        at, out = self.total, []
        for _ in range(shards):
            reach = max(at - capacity, 0)
            at = reach if hopeful and self.split(reach) else self.ceil(reach)
            out.append(at)
        return out[::-1]

    def smallest(self, shards: int, hopeful: bool) -> int:
        """Smallest capacity whose greedy cuts reach the end."""
        low, high = max([-(-self.total // shards), *(b.size for b in self.blocks if b.groups == 1)], default=0), self.total
        low = min(low, high)
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, shards, hopeful)[-1] == self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def inside(self, spans: list[tuple[int, int]]) -> list[Block]:
        """Blocks of several groups that overlap a span in which a cut is not settled."""
        found = {}
        for low, high in spans:
            if low >= high:
                continue
            i = max(bisect_right(self.ends, low) - 1, 0)
            while i < len(self.blocks) and self.ends[i] < high:
                if self.blocks[i].groups > 1:
                    found[i] = self.blocks[i]
                i += 1
        return list(found.values())


def _totals(groups: DataFrame, digits: int, within: list[Block] | None = None) -> list[Block]:
    """Totals by digest prefix: at most 65,536 rows, or 256 for each block of ``within``."""
    if within:
        groups = groups.filter(F.substring("digest", 1, len(within[0].prefix)).isin([b.prefix for b in within]))
    rows = groups.groupBy(F.substring("digest", 1, digits).alias("p")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
    return [Block(r["p"], int(r["s"]), int(r["n"])) for r in rows.collect()]


def partition(groups: DataFrame, shards: int, digits: int = FIRST_DIGITS) -> tuple[int, list[str]]:
    """(smallest capacity, digest prefixes at which shards 1, 2, ... begin) for ``groups`` (digest, size).

    No shard exceeds the smallest capacity any contiguous partition can have. Where that
    leaves freedom, cuts lie next to equal shares. Groups are atomic; fewer groups than
    shards leave shards empty.
    """
    blocks = _totals(groups, digits)
    while True:
        ladder = Ladder(blocks)
        low, high = ladder.smallest(shards, True), ladder.smallest(shards, False)
        spans = list(zip(ladder.cuts(low, shards, False), ladder.cuts(high, shards, True)))
        if low == high:
            spans += list(zip(ladder.cuts_back(high, shards, True), ladder.cuts_back(high, shards, False)))
        open_blocks = ladder.inside(spans)
        if not open_blocks:
            break
        width = min(len(b.prefix) for b in open_blocks)
        chosen = [b for b in open_blocks if len(b.prefix) == width]
        gone = {b.prefix for b in chosen}
        blocks = [b for b in ladder.blocks if b.prefix not in gone] + _totals(groups, min(width + MORE_DIGITS, ALL_DIGITS), chosen)
    earliest = ladder.cuts_back(high, shards, False)
    at, begins = 0, []
    for i in range(1, shards):
        share = ladder.total * i // shards
        below, above = ladder.floor(share), ladder.ceil(share)
        near = below if share - below <= above - share else above
        at = max(earliest[i], at, min(near, ladder.floor(at + high)))
        place = bisect_left(ladder.ends, at)
        begins.append(ladder.blocks[place].prefix if place < len(ladder.blocks) else "~")
    return high, begins


def giants(groups: DataFrame, shards: int) -> list[str]:
    """Digests of groups that fill a shard of their own: as large as an equal share of what is left.

    Fewer than ``shards`` groups can be so large, so as many of the largest rows are enough.
    """
    total = groups.agg(F.sum("size").alias("s")).head()["s"] or 0
    out, left = [], shards
    for row in groups.orderBy(F.desc("size"), "digest").limit(shards).collect():
        if left <= 1 or row["size"] * left < total:
            break
        out.append(row["digest"])
        total, left = total - row["size"], left - 1
    return out


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 200_000) -> DataFrame:
    """Place every document in one of ``shards`` shards near equal in bytes.

    Returns (id, size, text_crc32, law, shard, slot, grown_shard). A document weighs its
    UTF-8 bytes plus 8; a null text has no bytes, the checksum 0, and forms the first group.
    Equal texts are one atomic group and share a shard. A group as large as an equal
    share gets its own shard; the others are cut by :func:`partition`. Slots number a
    shard's documents from 0 without gaps; repeated rows each get one. An empty table gives no rows.
    """
    text = F.col(f"`{text_col}`")
    rows = written(
        docs.select(
            F.col(f"`{id_col}`").alias(id_col),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.md5(text.cast("binary")), F.lit("")).alias("digest"),
        ),
        "shard-rows",
    )
    groups = written(rows.groupBy("digest").agg(F.sum("size").alias("size")), "shard-groups")
    own = giants(groups, shards)
    rest = groups.filter(~F.col("digest").isin(own)) if own else groups
    _, begins = partition(rest, shards - len(own))
    place = F.lit(len(own))
    for begin in begins:
        place = place + (F.col("digest") >= begin).cast("int")
    for k, digest in enumerate(own):
        place = F.when(F.col("digest") == digest, k).otherwise(place)
    placed = rows.select(id_col, "size", "text_crc32", place.cast("int").alias("shard"))
    buckets = max(64, -(-rows.count() // (shards * rows_per_bucket)))
    slotted = gapless(placed, ["shard"], [id_col, "text_crc32", "size"], "slot", F.pmod(F.xxhash64(id_col), F.lit(buckets)))
    return slotted.select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
