"""Document quality from a linear-chain conditional random field over lines.

Every line is good (1) or bad (0). Emissions are linear in features of the line and of
its two neighbours; a 2 x 2 table of transitions joins adjacent lines. Labels exist per
document only, so in training all lines of a document carry its label. A score is the
length-weighted mean of the lines' forward-backward marginals.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderframe.llm.shared import batch_bytes, by_value, text_chunks, written
from cinderframe.llm.words import WordHasher, mix, space_separated

by_value(__name__)

#: Byte classes of the features, as (name, bytes).
CLASSES = (
    ("lower", b"abcdefghijklmnopqrstuvwxyz"),
    ("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("digit", b"0123456789"),
    ("stop", b".,;:?'\"()-"),
    ("bang", b"!"),
    ("symbol", b"#$%&*+/<=>@[\\]^_`{|}~"),
    ("other", bytes(range(128, 256))),
)
N_FEATURES = len(CLASSES) + 6


def line_features(hasher: WordHasher, data: np.ndarray, bounds: np.ndarray):
    """(features per line, bytes per line, index of each text's first line) of a chunk of whole texts."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([bounds[:-1], breaks + 1]), kind="stable")
    first = np.searchsorted(breaks, bounds[:-1]) + np.arange(len(bounds) - 1)
    ends = np.append(starts[1:], len(data))
    closed = np.searchsorted(breaks, ends - 1)
    at_break = (closed < len(breaks)) & (ends > starts)
    at_break[at_break] = breaks[closed[at_break]] == ends[at_break] - 1
    ends = ends - at_break
    size = (ends - starts).astype(np.float64)
    out = np.zeros((len(starts), N_FEATURES), np.float32)
    kinds = np.full(256, len(CLASSES), np.uint8)
    for k, (_, members) in enumerate(CLASSES):
        kinds[np.frombuffer(members, np.uint8)] = k
    kind, some = kinds[data], np.maximum(size, 1)
    for k in range(len(CLASSES)):
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(kind == k, out=total[1:])
        out[:, k] = (total[ends] - total[starts]) / some
    word_start, word_end, hashes, _ = hasher.words(data, bounds)
    a, b = np.searchsorted(word_start, starts), np.searchsorted(word_start, ends)
    words = (b - a).astype(np.float64)
    line_of = np.repeat(np.arange(len(starts)), b - a)
    repeated = np.zeros(len(starts))
    if len(hashes):
        keyed = mix(hashes ^ mix(line_of.astype(np.uint64)))
        _, where, count = np.unique(keyed, return_index=True, return_counts=True)
        repeated = np.bincount(line_of[where], weights=count - 1, minlength=len(starts))
    again = np.zeros(max(len(hashes), 1), np.int32)
    if len(hashes) > 1:
        again[1:] = (hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])
    runs = np.concatenate([[0], np.cumsum(again[: len(hashes)])])
    lengths = np.concatenate([[0], np.cumsum(word_end - word_start)])
    least = np.maximum(words, 1)
    k = len(CLASSES)
    out[:, k] = repeated / least
    out[:, k + 1] = (runs[b] - runs[a]) / least
    out[:, k + 2] = (lengths[b] - lengths[a]) / least / 10
    out[:, k + 3] = np.log1p(size) / 5
    out[:, k + 4] = np.log1p(words) / 4
    out[:, k + 5] = size == 0
    return out, size, first


def with_neighbours(features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Add the previous and the next line's features; beyond a text's ends they are 0."""
    n = len(features)
    last = np.append(first[1:], n) - 1
    before, after = np.zeros_like(features), np.zeros_like(features)
    before[1:], after[:-1] = features[:-1], features[1:]
    before[first], after[last] = 0, 0
    return np.hstack([features, before, after, np.ones((n, 1), features.dtype)])


@dataclass
class Crf:
    """Emission weights of the good state against the bad one, and log transition weights."""

    emission: np.ndarray
    transition: np.ndarray

    def marginals(self, score: np.ndarray, length: np.ndarray):
        """Forward-backward over padded chains (chains, lines): P(good), expected transitions, log normaliser."""
        chains, most = score.shape
        emit = np.stack([np.zeros_like(score), score], axis=2)
        peak = emit.max(axis=2, keepdims=True)
        emit = np.exp(emit - peak)
        move = np.exp(self.transition)
        alpha, scale = np.empty((chains, most, 2)), np.empty((chains, most))
        for t in range(most):
            a = emit[:, t] if t == 0 else (alpha[:, t - 1] @ move) * emit[:, t]
            scale[:, t] = a.sum(axis=1)
            alpha[:, t] = a / scale[:, t : t + 1]
        beta, pairs = np.ones((chains, 2)), np.zeros((2, 2))
        good = np.empty((chains, most))
        for t in range(most - 1, -1, -1):
            beta = np.where((t >= length - 1)[:, None], 1.0, beta)
            both = alpha[:, t] * beta
            good[:, t] = both[:, 1] / both.sum(axis=1)
            if t:
                ahead = emit[:, t] * beta / scale[:, t : t + 1]
                inside = (t < length)[:, None]
                pairs += (alpha[:, t - 1] * inside).T @ ahead * move
                beta = ahead @ move.T
        inside = np.arange(most) < length[:, None]
        return good, pairs, (np.log(scale) + peak[:, :, 0])[inside].sum()

    def score(self, features: np.ndarray, size: np.ndarray, first: np.ndarray, at_once: int = 512) -> np.ndarray:
        """Length-weighted mean marginal of each text; every line weighs its bytes plus one."""
        emitted = features @ self.emission
        count = np.append(first[1:], len(features)) - first
        out = np.empty(len(first))
        by_length = np.argsort(count, kind="stable")
        i = 0
        while i < len(by_length):
            j = min(i + at_once, len(by_length))
            while j - i > 1 and count[by_length[j - 1]] * (j - i) > 200_000:
                j = i + (j - i) // 2
            group = by_length[i:j]
            length = count[group]
            grid = np.arange(length.max())
            at = np.minimum(first[group][:, None] + grid, len(features) - 1)
            inside = grid < length[:, None]
            good, _, _ = self.marginals(np.where(inside, emitted[at], 0.0), length)
            weight = np.where(inside, size[at] + 1.0, 0.0)
            out[group] = (good * weight).sum(axis=1) / weight.sum(axis=1)
            i = j
        return np.clip(out, 0.0, 1.0)


def train(texts: list[tuple[np.ndarray, int]], window: int = 48, rounds: int = 250, ridge: float = 3e-4, step: float = 0.3) -> Crf:
    """Fit by full-batch Adam on the conditional log likelihood; long texts are cut into windows of lines.

    Without texts of both labels, every line leans to the only label, or to neither.
    """
    pieces = [(x[i : i + window], y) for x, y in texts for i in range(0, len(x), window)]
    width = 3 * N_FEATURES + 1
    labels = np.array([y for _, y in pieces])
    lines = np.array([len(x) for x, _ in pieces])
    good_lines = lines[labels == 1].sum() if len(pieces) else 0
    total = lines.sum() if len(pieces) else 0
    model = Crf(np.zeros(width), np.zeros((2, 2)))
    if not total or good_lines in (0, total):
        model.emission[-1] = 0.0 if not total else (10.0 if good_lines else -10.0)
        return model
    order = np.argsort(lines, kind="stable")
    groups = []
    for chunk in np.array_split(order, max(1, len(order) // 400)):
        most = lines[chunk].max()
        x = np.zeros((len(chunk), most, width))
        for r, i in enumerate(chunk):
            x[r, : lines[i]] = pieces[i][0]
        groups.append((x, lines[chunk], labels[chunk]))
    theta = np.zeros(width + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        model = Crf(theta[:width], theta[width:].reshape(2, 2))
        slope = np.zeros_like(theta)
        for x, length, label in groups:
            for value in (0, 1):
                mine = label == value
                if not mine.any():
                    continue
                good, pairs, _ = model.marginals(x[mine] @ model.emission, length[mine])
                inside = np.arange(x.shape[1]) < length[mine][:, None]
                slope[:width] += np.tensordot(np.where(inside, value - good, 0.0), x[mine], 2)
                seen = np.zeros((2, 2))
                seen[value, value] = (length[mine] - 1).sum()
                slope[width:] += (seen - pairs).ravel()
        slope = slope / total - ridge * theta
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta = theta + step * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Crf(theta[:width].copy(), theta[width:].reshape(2, 2).copy())


def _features(batches):
    hasher = WordHasher(space_separated())
    for batch in batches:
        cells = []
        for _, _, data, bounds in text_chunks(batch.column(1)):
            features, _, first = line_features(hasher, data, bounds)
            rows = with_neighbours(features, first)
            cells += [part.tobytes() for part in np.split(rows.astype(np.float32), first[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.binary())], ["label", "lines"])


def score_column(model: Crf, text: Column) -> Column:
    """The score of a text column, in Arrow batches."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = WordHasher(space_separated())
        for batch in texts:
            scores = [np.zeros(0)]
            for _, _, data, bounds in text_chunks(batch):
                features, size, first = line_features(hasher, data, bounds)
                scores.append(model.score(with_neighbours(features, first), size, first))
            yield pa.array(np.concatenate(scores))

    return F.arrow_udf(run, "double")(text)


def training_sample(docs: DataFrame, labels: DataFrame, sample: int, most_bytes: int, most_lines: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``label, text`` of at most ``sample`` ids and ``most_lines`` lines in all, a written table.

    Ids come in the order of their hashes, each with one label (the larger of several) and one text
    (that of the smallest hash), until the next would pass ``most_lines``.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).filter(F.octet_length("text") <= most_bytes)
    once = known.groupBy("id").agg(F.max("label").alias("label"))
    near = once.join(texts.select("id"), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(sample)
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first")
    rows = written(texts.join(F.broadcast(near), "id").groupBy("id", "label").agg(first).select("id", "label", "first.text"), "line-sample")
    lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    upto = F.sum("lines").over(Window.orderBy(F.xxhash64("id"), "id"))  # at most ``sample`` rows of two numbers
    fits = rows.select("id", lines.alias("lines")).withColumn("upto", upto).filter(F.col("upto") <= most_lines).select("id")
    return rows.join(F.broadcast(fits), "id").select("label", "text")


def fit(
    docs: DataFrame, labels: DataFrame, sample: int = 4000, most_bytes: int = 65_536, most_lines: int = 400_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> Crf:
    """Train on at most ``sample`` labelled ids, of texts up to ``most_bytes`` bytes, with ``most_lines`` lines in all.

    These bounds limit the training rows only, and so the driver's memory: a line is a fixed number
    of features, so 400,000 lines are at most about 100 MB. The sample is the same on every run; an id
    counts once, however many rows repeat it. Null labels or ids are left out.
    """
    batch_bytes(docs.sparkSession)
    picked = training_sample(docs, labels, sample, most_bytes, most_lines, id_col, text_col, label_col)
    rows = picked.mapInArrow(_features, "label int, lines binary").collect()
    width = 3 * N_FEATURES + 1
    return train(sorted(((np.frombuffer(r["lines"], np.float32).reshape(-1, width), r["label"]) for r in rows), key=lambda x: (x[1], x[0].shape, x[0].tobytes())))


def score(docs: DataFrame, model: Crf, text_col: str = "text", out: str = "score") -> DataFrame:
    """Every row with its score ``out``: whole texts, 0 bad to 1 good.

    A null or empty text is one empty line. Null and repeated ids are scored row by row; other
    columns pass through, and one that is already called ``out`` is replaced.
    """
    batch_bytes(docs.sparkSession)
    return docs.withColumn(out, score_column(model, F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
