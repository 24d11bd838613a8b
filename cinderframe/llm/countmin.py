"""Removal of repeated word windows: a count-min sketch first, exact groups of what it lets through after.

Every window of ``size`` words is named by its anchor, the smallest hash of the ``GRAM``-word grams in it
(the first of equal ones). Equal windows have equal anchors at equal places, so an anchor is met at least as
often as each of its windows, and a count-min sketch of anchors overestimates window counts. Neighbouring
windows share anchors: the sketch takes about a seventh of the insertions that windows would need.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderframe.llm.shared import batch_bytes, by_value, strings, text_chunks
from cinderframe.llm.words import BASE, INVERSE, U, WordHasher, mix, numbers, powers, space_separated

by_value(__name__)

GRAM = 8
ROWS = 2  # rows of the sketch
BLOCK_BITS = 19
MOST_BITS = 29  # of a row as tasks hold it: 64 MB; wider rows are folded to it
HELD = 4 << 20  # bytes of whole texts in which a task settles windows by itself
HOT_LEAST, HOT_SHARE = 8, 4096  # an anchor is hot if a task meets it as often, and in such a part of all


def byte_values() -> np.ndarray:
    """A random value per byte; letters of either case differ."""
    return numbers(256, 31)


class Windows:
    """Windows and anchors of chunks of texts."""

    def __init__(self, size: int):
        self.size = size
        self.hasher = WordHasher(space_separated())
        self.hasher.codes = byte_values()

    def words(self, data: np.ndarray, bounds: np.ndarray):
        return self.hasher.words(data, bounds)

    def _grams(self, hashes: np.ndarray, size: int) -> np.ndarray:
        """Hash of ``size`` words from every place."""
        n = len(hashes) - size + 1
        if n <= 0:
            return np.zeros(0, U)
        up, down = powers(len(hashes), BASE), powers(len(hashes), INVERSE)
        sums = np.zeros(len(hashes) + 1, U)
        np.cumsum((hashes * U(2) + U(1)) * up, out=sums[1:])
        return mix((sums[size:] - sums[:-size]) * down[:n])

    def of(self, hashes: np.ndarray, first: np.ndarray):
        """(starts of whole windows, their texts, their hashes, places of their anchors, hashes of grams)."""
        grams = self._grams(hashes, min(GRAM, self.size))
        whole = self._grams(hashes, self.size)
        counts = np.maximum(np.diff(first) - self.size + 1, 0)
        text = np.repeat(np.arange(len(counts)), counts)
        starts = np.arange(counts.sum()) + np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        if not len(starts):
            return starts, text, whole[:0], starts, grams
        span = self.size - min(GRAM, self.size) + 1
        best, place = grams[: len(grams) - span + 1].copy(), np.arange(len(grams) - span + 1)
        for k in range(1, span):
            other = grams[k : len(grams) - span + 1 + k]
            better = other < best
            best[better] = other[better]
            place[better] = np.flatnonzero(better) + k
        return starts, text, whole[starts], place[starts], grams


def cells(anchors: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Cell of every anchor in a row of 2^bits cells."""
    return mix(anchors ^ numbers(ROWS, 404)[row]) >> U(64 - bits)


def _partition_sketch(size: int, bits: int):
    """One sketch per task, whose counters stop at two: per row and block, cells met once and more often.

    A further row of one block marks hot cells of the first row.
    """

    def run(batches):
        import pyarrow as pa

        windows, held, most = Windows(size), [[] for _ in range(ROWS)], 1 << 21

        def flush(row):
            found, n = np.unique(np.concatenate(held[row]), return_counts=True)
            held[row] = []
            block = (found >> U(BLOCK_BITS)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(block, prepend=-1))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(block)]):
                inside = (found[a:b] & U((1 << BLOCK_BITS) - 1)).astype(np.uint32)
                yield row, int(block[a]), inside.tobytes(), inside[n[a:b] > 1].tobytes()
            if not row:
                hot = found[n >= max(HOT_LEAST, n.sum() // HOT_SHARE)] >> U(bits - BLOCK_BITS)
                yield ROWS, 0, b"", np.unique(hot).astype(np.uint32).tobytes()

        def batch_of(rows):
            row, block, once, more = map(list, zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(block, pa.int64()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], ["row", "block", "once", "more"])

        for batch in batches:
            for _, _, data, bounds in text_chunks(batch.column(0)):
                _, _, hashes, first = windows.words(data, bounds)
                _, _, _, place, grams = windows.of(hashes, first)
                anchors = grams[np.unique(place)]
                for row in range(ROWS):
                    held[row].append(cells(anchors, row, bits))
                if sum(map(len, held[0])) > most:
                    yield batch_of([r for row in range(ROWS) for r in flush(row)])
        if any(len(c) for c in held[0]):
            yield batch_of([r for row in range(ROWS) for r in flush(row)])

    return run


def _merge(batches):
    """Bits of cells that all partitions together met at least twice; input sorted by row, fold and block, folds laid over each other."""
    import pyarrow as pa

    width, at = 1 << BLOCK_BITS, (None, None, None)
    once, more, laid = np.zeros(width, bool), np.zeros(width, bool), np.zeros(width, bool)

    def done():
        packed = [np.packbits(laid | more, bitorder="little").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int64()), pa.array(packed, pa.binary())], ["row", "fold", "repeated"])

    for batch in batches:
        for row, fold, block, a, b in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if (row, fold, block) != at:
                if (row, fold) == at[:2]:
                    laid |= more
                else:
                    if at[0] is not None:
                        yield done()
                    laid[:] = False
                at = (row, fold, block)
                once[:] = more[:] = False
            mine = np.frombuffer(a, np.uint32)
            more[mine[once[mine]]] = True
            more[np.frombuffer(b, np.uint32)] = True
            once[mine] = True
    if at[0] is not None:
        yield done()


def sketch(texts: DataFrame, size: int, bits: int) -> list[np.ndarray]:
    """Packed bits of cells counted at least twice, one array per row, at most 2^MOST_BITS bits each; last the hot cells.

    Partition sketches are sparse and meet by block, so nothing grows with the table but their shuffle. The driver
    gets the merged bits alone. A row wider than 2^MOST_BITS is folded to it after its cells are counted: such bits overestimate as well.
    """
    folded = min(bits, MOST_BITS)
    parts = texts.mapInArrow(_partition_sketch(size, bits), "row int, block long, once binary, more binary")
    keyed = parts.select("row", F.pmod("block", F.lit(1 << max(folded - BLOCK_BITS, 0))).alias("fold"), "block", "once", "more")
    dealt = keyed.repartition("row", "fold").sortWithinPartitions("row", "fold", "block")
    step = (1 << BLOCK_BITS) // 8
    out = [*(np.zeros(max((1 << folded) // 8, step), np.uint8) for _ in range(ROWS)), np.zeros(step, np.uint8)]
    for found in dealt.mapInArrow(_merge, "row int, fold long, repeated binary").toLocalIterator():
        out[found["row"]][found["fold"] * step : (found["fold"] + 1) * step] = np.frombuffer(found["repeated"], np.uint8)
    return out


def estimated_repeated(anchors: np.ndarray, bits: int, repeated: list[np.ndarray]) -> np.ndarray:
    """True where every row of the sketch counts at least two."""
    out = np.ones(len(anchors), bool)
    for row in range(ROWS):
        cell = cells(anchors, row, bits)
        if bits > MOST_BITS:
            cell = cell & U((1 << MOST_BITS) - 1)
        out &= (repeated[row][cell >> U(3)] >> (cell & U(7)).astype(np.uint8)) & 1 == 1
    return out


def is_hot(anchors: np.ndarray, bits: int, repeated: list[np.ndarray]) -> np.ndarray:
    cell = cells(anchors, 0, bits) >> U(bits - BLOCK_BITS)
    return (repeated[ROWS][cell >> U(3)] >> (cell & U(7)).astype(np.uint8)) & 1 == 1


FIELDS = ["key", "id", "text_hash", "start", "asked", "gone", "windows"]
SENT = "key long, id long, text_hash long, start int, asked int, gone int, windows array<bigint>"


def _second_pass(size: int, bits: int, shared):
    """Windows that the sketch lets through, a row per anchor; those met before among the task's own texts are settled at once.

    Bit k of ``asked`` and ``gone`` stands for the window at ``start`` + k; ``windows`` are the hashes of the asked ones.
    Equal windows have equal keys: the anchor's hash, or for hot anchors one of anchor and window. Rows that ask nothing go by text.
    """

    def run(batches):
        import pyarrow as pa

        windows, repeated = Windows(size), shared.value
        for batch in batches:
            ids, no_id = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            text_hash = batch.column(1).to_numpy()
            for a, b, data, bounds in text_chunks(batch.column(2), HELD):
                _, _, hashes, first = windows.words(data, bounds)
                starts, text, whole, place, grams = windows.of(hashes, first)
                # Repeated rows are one document: the first of them speaks.
                document = np.stack([no_id[a:b].astype(np.int64), ids[a:b], text_hash[a:b]], 1)
                _, speaks, rank = np.unique(document, axis=0, return_index=True, return_inverse=True)
                rank = rank.ravel()
                spoken = np.zeros(b - a, bool)
                spoken[speaks] = True
                keep = estimated_repeated(grams[place], bits, repeated) & spoken[text] if len(starts) else np.zeros(0, bool)
                if not keep.any():
                    continue
                starts, text, whole, place = starts[keep], text[keep], whole[keep], place[keep]
                at = starts - first[text]
                order = np.lexsort((at, rank[text], whole, grams[place]))
                w, g = whole[order], grams[place[order]]
                later = np.zeros(len(order), bool)
                later[order[1:]] = (w[1:] == w[:-1]) & (g[1:] == g[:-1])
                hot = is_hot(grams[place], bits, repeated)
                # Rows are stretches of windows with one anchor; for asked windows of hot anchors, single windows.
                alone = hot & ~later
                new = (np.diff(text, prepend=-1) != 0) | (np.diff(place, prepend=-1) != 0)
                stretch = np.cumsum(new) - 1
                base = at[new][stretch]
                bit = np.left_shift(1, at - base)
                mine = np.flatnonzero(new)
                asked = np.add.reduceat(np.where(later | alone, 0, bit), mine)
                gone = np.add.reduceat(np.where(later, bit, 0), mine)
                row, anchor = a + text[mine], grams[place[mine]]
                by_text = mix(text_hash[row].view(U) + np.arange(len(row)).astype(U))
                some = (asked | gone) != 0
                n = np.add.reduceat((~later & ~alone).astype(np.int64), mine)
                single = np.flatnonzero(alone)
                row = np.concatenate([row[some], a + text[single]])
                key = np.concatenate([np.where(asked != 0, anchor, by_text)[some], mix(grams[place[single]] ^ mix(whole[single]))])
                ends = np.cumsum(np.concatenate([[0], n[some], np.ones(len(single), np.int64)]))
                flat = np.concatenate([whole[~later & ~alone], whole[single]])
                start = np.concatenate([at[mine][some], at[single]])
                asked = np.concatenate([asked[some], np.ones(len(single), np.int64)])
                gone = np.concatenate([gone[some], np.zeros(len(single), np.int64)])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(ids[row], mask=no_id[row]), pa.array(text_hash[row]), *(pa.array(x.astype(np.int32)) for x in (start, asked, gone)), lists], FIELDS
                )

    return run


def _settle(batches):
    """Rows sorted by key: windows that are not the first of their group, as bits per row, with those settled before."""
    import pyarrow as pa

    def settled(rows):
        key, text_hash, start, asked, gone = (rows.column(k).to_numpy() for k in (0, 2, 3, 4, 5))
        ids, no_id = rows.column(1).fill_null(0).to_numpy(), rows.column(1).is_null().to_numpy(zero_copy_only=False)
        row, offset = np.nonzero((asked[:, None] >> np.arange(31)) & 1)
        window = rows.column(6).flatten().to_numpy()
        at = start[row] + offset
        fields = (at, text_hash[row], ids[row], no_id[row])
        order = np.lexsort((*fields, window, key[row]))
        new = np.ones(len(order), bool)
        for x in (window, key[row]):
            new[1:] &= x[order][1:] == x[order][:-1]
        new[1:] = ~new[1:]
        first = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order
        late = np.zeros(len(order), bool)
        for x in fields:
            late |= x[order] != x[first]
        mask = gone.astype(np.int64)
        np.bitwise_or.at(mask, row[order][late], np.left_shift(1, offset[order][late]))
        keep = mask != 0
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[keep], mask=no_id[keep]), pa.array(text_hash[keep]), pa.array(start[keep]), pa.array(mask[keep].astype(np.int32))], ["id", "text_hash", "start", "mask"]
        )

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None and held.num_rows:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        key = batch.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1], "left"))
        if cut:
            yield settled(batch.slice(0, cut))
        held = batch.slice(cut)
    if held is not None and held.num_rows:
        yield settled(held)


def _remove(size: int):
    """Join the words that no removed window covers."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, at = strings(batch.column(1))
            found = batch.column(2).to_pylist()
            n_words, n_removed, texts, spans = [], [], [], []
            for a, b, marks in zip(at[:-1].tolist(), at[1:].tolist(), found):
                words = data[a:b].tobytes().split()
                gone = np.zeros(len(words), bool)
                if marks:
                    start, mask = np.array([(m["start"], m["mask"]) for m in marks], np.int64).T
                    bits = (mask[:, None] >> np.arange(32)) & 1
                    change = np.zeros(len(words) + 1, np.int64)
                    heads = (start[:, None] + np.arange(32))[bits == 1]
                    np.add.at(change, heads, 1)
                    np.add.at(change, heads + size, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                edges = np.diff(gone.astype(np.int8), prepend=0, append=0)
                spans.append([{"start": x, "stop": y} for x, y in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist())])
                n_words.append(len(gone)), n_removed.append(int(gone.sum()))
                texts.append(b" ".join(words))
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, span), pa.array(texts, pa.binary()).cast(pa.string())],
                ["id", "n_words", "n_removed", "removed", "kept"],
            )

    return run


def sketch_bits(texts: DataFrame) -> int:
    """Bits of a row's width: at least eight cells per anchor, by the bytes of all texts (an anchor takes 40 or more)."""
    size = texts.agg(F.sum(F.octet_length("text").cast("long")).alias("size")).first()["size"] or 0
    return max(BLOCK_BITS, int(np.ceil(np.log2(max(size / 40 * 8, 1)))))


def remove_repeats(docs: DataFrame, size: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, removed, kept): every text without the words of windows that start earlier elsewhere.

    A window is ``size`` (8 to 38) words in a row of one text, split at ASCII white space, compared as they are. A
    word goes if a window that covers it has the same words as one with a smaller id, or further
    left in the same text. Windows are judged on the input. ``removed`` are spans of word numbers, ``kept`` are the
    other words joined by one space.

    A null text has no words; a text with fewer than ``size`` words stays. Null ids come after all others. Unlike
    texts of one id follow each other by a hash; repeated rows (equal id and text) are one document: they get equal results
    and do not remove each other. Other columns are ignored; an empty table gives no rows.

    The first pass counts anchors in one sketch per partition; the merged bits are broadcast (128 MB at most). The second
    pass takes the windows whose anchor it lets through; a task settles those it met before
    by itself, so a window costs one row per task however often it occurs, and the rest are
    grouped exactly by anchor and a second 64-bit hash of all words. Anchors of many unlike windows are dealt by window. None is lost: the sketch only overestimates.
    """
    if not GRAM <= size < GRAM + 31:
        raise ValueError("size must be 8 to 38")
    spark = docs.sparkSession
    batch_bytes(spark)
    text = F.col(f"`{text_col}`")
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    bits = sketch_bits(source)
    shared = spark.sparkContext.broadcast(sketch(source.select("text"), size, bits))
    sent = source.mapInArrow(_second_pass(size, bits, shared), SENT)
    marks = sent.repartition("key").sortWithinPartitions("key").mapInArrow(_settle, "id long, text_hash long, start int, mask int")
    by_text = marks.groupBy("id", "text_hash").agg(F.collect_set(F.struct("start", "mask")).alias("marks"))
    by_text = by_text.select(F.col("id").alias("m_id"), F.col("text_hash").alias("m_hash"), "marks")
    joined = source.join(by_text, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("text_hash") == F.col("m_hash")), "left")
    out = joined.select("id", "text", "marks").mapInArrow(_remove(size), "id long, n_words long, n_removed long, removed array<struct<start:bigint,stop:bigint>>, kept string")
    return out.withColumnRenamed("id", id_col)
