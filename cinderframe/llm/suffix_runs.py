"""Periodic runs of words: suffix trees give longest common extensions, Lyndon roots give candidates.

Every run with at least two periods has a root that is the longest Lyndon word at its start, in
the order of the words or in the reversed order. So a sequence of n words has at most 2n candidates
(start, period); each is extended to both sides by one common-extension query in the tree of the sequence
and one in the tree of its reversal. Both trees are Ukkonen's; a query is a range minimum over
the Euler tour, answered from a sparse table in constant time.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderframe.llm.shared import batch_bytes, by_value, strings

by_value(__name__)

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def suffix_tree(symbols: list[int], size: int):
    """Ukkonen's tree of ``symbols``, whose last one is unique: (edge starts, edge ends, leaves by suffix, child by node * size + symbol)."""
    n = len(symbols)
    start, stop, link, leaves = [0], [0], [0], []
    child: dict[int, int] = {}
    node = edge = length = open_suffixes = 0
    for i, symbol in enumerate(symbols):
        open_suffixes += 1
        pending = 0
        while open_suffixes:
            if not length:
                edge = i
            key = node * size + symbols[edge]
            below = child.get(key)
            if below is None:
                leaves.append(len(start))
                child[key] = len(start)
                start.append(i), stop.append(n), link.append(0)
                if pending:
                    link[pending] = node
                pending = node
            else:
                first = start[below]
                span = min(stop[below], i + 1) - first
                if length >= span:
                    edge, length, node = edge + span, length - span, below
                    continue
                if symbols[first + length] == symbol:
                    length += 1
                    if pending:
                        link[pending] = node
                    break
                split = len(start)
                child[key] = split
                start.append(first), stop.append(first + length), link.append(0)
                child[split * size + symbol] = split + 1
                leaves.append(split + 1)
                start.append(i), stop.append(n), link.append(0)
                start[below] = first + length
                child[split * size + symbols[first + length]] = below
                if pending:
                    link[pending] = split
                pending = split
            open_suffixes -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - open_suffixes + 1
    return start, stop, leaves, child


class Extensions:
    """Longest common extensions of suffixes of a sequence, and their order."""

    def __init__(self, symbols: list[int], size: int):
        start, stop, leaves, child = suffix_tree(symbols, size)
        keys = np.fromiter(child.keys(), np.int64, len(child))
        order = np.argsort(keys)
        kids = np.fromiter(child.values(), np.int64, len(child))[order].tolist()
        first = np.searchsorted(keys[order] // size, np.arange(len(start) + 1)).tolist()
        suffix_of = dict(zip(leaves, range(len(leaves))))
        # Euler tour from left to right: leaves in order, and between two of them the depth where the tour turns.
        by_order, turns = [], []
        stack = [(k, 0, 0) for k in reversed(kids[first[0] : first[1]])]  # node, depth of its parent, depth of the turn before it
        while stack:
            node, depth, turn = stack.pop()
            a, b = first[node], first[node + 1]
            if a == b:
                by_order.append(suffix_of[node])
                turns.append(turn)
            else:
                depth += stop[node] - start[node]
                for k in range(b - 1, a, -1):
                    stack.append((kids[k], depth, depth))
                stack.append((kids[a], depth, turn))
        self.rank = np.empty(len(by_order), np.int64)
        self.rank[by_order] = np.arange(len(by_order))
        self.table = [np.array(turns, np.int32)]
        width = 1
        while 2 * width <= len(turns):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2
        self.levels = np.zeros(len(turns) + 1, np.int64)
        for level in range(1, len(self.table)):
            self.levels[1 << level :] = level

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at ``a`` and at ``b`` (all unequal)."""
        low, high = self.rank[a], self.rank[b]
        low, high = np.minimum(low, high) + 1, np.maximum(low, high) + 1
        level = self.levels[high - low]
        out = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            mine = level == k
            out[mine] = np.minimum(self.table[k][low[mine]], self.table[k][high[mine] - (1 << k)])
        return out


def next_smaller(values: list[int]) -> np.ndarray:
    """Index of the next smaller value to the right; the length where there is none."""
    out, stack = [len(values)] * len(values), []
    for i, value in enumerate(values):
        while stack and values[stack[-1]] > value:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out, np.int64)


def all_runs(ids: np.ndarray) -> np.ndarray:
    """Every run of a sequence with at least two periods: sorted rows (start, period, length)."""
    n = len(ids)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    _, ids = np.unique(ids, return_inverse=True)
    size = int(ids.max()) + 2
    forward = Extensions([*(ids + 1).tolist(), 0], size)
    backward = Extensions([*(ids[::-1] + 1).tolist(), 0], size)
    rank = forward.rank.tolist()
    at = np.arange(n + 1)
    found = []
    for order in (rank, [-r for r in rank]):
        period = (next_smaller(order) - at)[:n]
        start = np.flatnonzero((period <= n // 2) & (at[:n] + period < n))
        period = period[start]
        right = forward.common(start, start + period)
        left = np.zeros(len(start), np.int64)
        inner = start > 0
        left[inner] = backward.common(n - start[inner], n - start[inner] - period[inner])
        whole = left + period + right
        keep = whole >= 2 * period
        found.append(np.stack([start - left, period, whole], 1)[keep])
    return np.unique(np.concatenate(found), axis=0)


def candidate_stretches(ids: np.ndarray, repeats: int) -> list[tuple[int, int]]:
    """Disjoint stretches of words outside which no run of ``repeats`` periods (at least 3) can reach.

    In a run of period q, from its second period on, every three words in a row were met at most q
    words before, at no fewer than (repeats - 1) * q - 2 places in a row. So where places in a row are s,
    only recurrences within (s + 2) / (repeats - 1) count; this is repeated until nothing changes.
    """
    n = len(ids)
    if n < 4:
        return []
    width = int(ids.max()) + 1
    grams = (ids[:-2] * width + ids[1:-1]) * width + ids[2:]
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    back = np.full(n - 2, n, np.int64)
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    good = back <= n // (repeats - 1)
    while True:
        edges = np.diff(good.astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        if not len(starts):
            return []
        reach = (ends - starts + 2) // (repeats - 1)
        spread = np.zeros(n - 2, np.int64)
        spread[good] = np.repeat(reach, ends - starts)
        still = good & (back <= spread)
        if still.sum() == good.sum():
            break
        good = still
    stretches: list[tuple[int, int]] = []
    for a, b in zip(np.maximum(starts - reach, 0).tolist(), (ends + 2).tolist()):
        while stretches and a < stretches[-1][1]:
            before = stretches.pop()
            a, b = min(a, before[0]), max(b, before[1])
        stretches.append((a, b))
    return stretches


def long_runs(ids: np.ndarray, least: int, repeats: int) -> np.ndarray:
    """Runs of at least ``least`` words and ``repeats`` periods: rows (start, period, length) by start and period."""
    found = [np.zeros((0, 3), np.int64)]
    for a, b in candidate_stretches(ids, repeats):
        runs = all_runs(ids[a:b])
        found.append(runs[runs[:, 2] >= np.maximum(least, repeats * runs[:, 1])] + np.array([a, 0, 0]))
    return np.concatenate(found)


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """False for words that a run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 1], 1)
    np.add.at(change, runs[:, 0] + runs[:, 2], -1)
    return np.cumsum(change[:n]) == 0


def _scan(least: int, repeats: int):
    def run(batches):
        import pyarrow as pa

        kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            data, at = strings(batch.column(1))
            ends, runs, texts = [0], [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                words = data[a:b].tobytes().split()
                names: dict[bytes, int] = {}
                ids = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
                mine = long_runs(ids, least, repeats)
                if len(mine):
                    kept = kept_words(len(words), mine).tolist()
                    words = [w for w, k in zip(words, kept) if k]
                    runs.append(mine)
                ends.append(ends[-1] + len(mine))
                texts.append(b" ".join(words))
            flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
            items = pa.StructArray.from_arrays([pa.array(flat[:, k].copy()) for k in (0, 2, 1)], fields=list(kind))
            kept = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items), kept], ["id", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = 6, repeats: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, runs, collapsed) per document: its periodic runs of words, and its text with one period of each.

    Words are split at ASCII white space. A run is a stretch with smallest period q and at least
    ``least`` words (4 or more) and ``repeats`` periods (3 or more) that no neighbouring word extends. ``runs`` are (start, length,
    period) in words, by start, then period. ``collapsed`` are the words, joined by one space, that no
    run holds after its first period.

    A null, empty or blank text has no runs and an empty ``collapsed``; ids may be null or repeated, every
    row is its own; other columns are ignored; an empty table gives no rows. Nothing is shuffled. Trees
    are built over the stretches where a run can be (``candidate_stretches``, exact); memory is
    linear in the longest such stretch of one document, times log n for the sparse tables.
    """
    if repeats < 3 or least < 4:
        raise ValueError("repeats must be 3 or more, least 4 or more")
    batch_bytes(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = source.mapInArrow(_scan(least, repeats), f"id long, runs {RUNS}, collapsed string")
    return found.withColumnRenamed("id", id_col)
