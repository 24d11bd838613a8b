"""Packing by minimum bin slack over the histogram of piece lengths.

Lengths are whole numbers up to the capacity, so counts per length say all a packer
needs, whatever the number of documents. A bin starts with the longest length left;
a subset-sum over a bit set of the available lengths finds its fullest completion. The
combination is used as often as its lengths last and then removed. What results are
ranges: the items of length l with ranks from..to lie in these bins at this
offset. Every piece then finds its place from its rank among pieces of its length.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderframe.llm.shared import batch_bytes, by_value, gapless, written

by_value(__name__)

CAPACITY = 2048
END = "<|endoftext|>"


def fullest(available: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum up to ``room``.

    Bit x of ``reach`` says that some multiset has the sum x; counts are split into
    powers of two. Longer lengths come first, so that short ones stay for later bins.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((n for n in available if n <= room), reverse=True):
        left, chunk = min(available[length], room // length), 1
        while left and not reach >> room & 1:
            take = min(chunk, left)
            steps.append((length, take, reach))
            reach = (reach | reach << take * length) & mask
            left, chunk = left - take, chunk * 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= take * length
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Ranges (length, first rank, end rank, items per bin, first bin, offset of the first item)."""
    left = {n: c for n, c in histogram.items() if c > 0}
    used, ranges, bins = dict.fromkeys(left, 0), [], 0
    while left:
        longest = max(left)
        rest = {**left, longest: left[longest] - 1}
        chosen = fullest({n: c for n, c in rest.items() if c}, capacity - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[n] // c for n, c in chosen.items())
        offset = 0
        for n, c in sorted(chosen.items(), reverse=True):
            ranges.append((n, used[n], used[n] + times * c, c, bins, offset))
            used[n] += times * c
            offset += n * c
            left[n] -= times * c
            if not left[n]:
                del left[n]
        bins += times
    return ranges


def _encoder(ranks_file: str, pattern: str):
    """The byte-level vocabulary as a fast encoder; its ids equal those of the JSON form."""
    import tiktoken

    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={END: len(ranks)})


def _pieces(json_file: str, ranks_file: str, pattern: str, capacity: int):
    def run(batches):
        import pyarrow as pa

        encoder, exact = _encoder(ranks_file, pattern), []

        def encode(text: str) -> np.ndarray:
            try:
                return np.asarray(encoder.encode_to_numpy(text, allowed_special={END}), np.uint32)
            except BaseException as error:  # the fast regex engine gives up on some very long runs of one kind of character
                if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
                from tokenizers import Tokenizer

                if not exact:
                    exact.append(Tokenizer.from_file(json_file))
                return np.asarray(exact[0].encode(text, add_special_tokens=False).ids, np.uint32)

        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(0)).astype("<u4")
                first = len(ids) % capacity or min(capacity, len(ids))
                at = 0
                for k, end in enumerate(range(first, len(ids) + 1, capacity)):
                    rows.append(row), piece.append(k), start.append(at), length.append(end - at)
                    crc.append(zlib.crc32(ids[at:end].tobytes()))
                    at = end
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def _placed(ranges: list[tuple[int, int, int, int, int, int]], capacity: int):
    table = np.array(sorted(ranges), np.int64).reshape(-1, 6)
    first_of = np.searchsorted(table[:, 0], np.arange(capacity + 2))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.empty(len(length), np.int64)
            for n in np.unique(length):
                mine, a = length == n, first_of[n]
                at[mine] = a + np.searchsorted(table[a : first_of[n + 1], 1], rank[mine], "right") - 1
            _, low, _, each, base, offset = table[at].T
            inside = rank - low
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(base + inside // each), pa.array(offset + inside % each * length)],
                ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(
    docs: DataFrame, json_file: str, ranks_file: str, pattern: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 100_000
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): all documents in sequences of ``capacity`` tokens.

    A document is its token ids and a closing 0; a null or empty text is the 0 alone.
    Documents over ``capacity`` are cut into full pieces behind a first piece that may be
    shorter. Pieces of one length are interchangeable, so ties need no rule. Repeated
    rows are packed one by one, null ids pass through, an empty table gives no rows,
    other columns are ignored. The driver sees one count per length.
    """
    spark = docs.sparkSession
    batch_bytes(spark)
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    cut = source.mapInArrow(_pieces(json_file, ranks_file, pattern, capacity), "id long, piece int, start long, length long, ids_crc32 long")
    pieces = written(cut, "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    buckets = max(64, -(-max(histogram.values(), default=0) // rows_per_bucket))
    ranked = gapless(pieces, ["length"], ["id", "piece", "ids_crc32"], "rank", F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)))
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", "rank")
    out = ranked.mapInArrow(_placed(plan(histogram, capacity), capacity), "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
