"""Document quality from a linear-chain conditional random field over lines (operator 8).

Every line is good or bad. A line's features are those of itself and of both
neighbours: shares of character classes, word length, words that repeat the word
before, lines that repeat within the document. The field's marginals come from the
forward-backward recursion; a document's quality is the length-weighted mean of the
marginals of "good", mapped to a probability by a logistic curve.

Only documents are labelled. The lines of a good document start as good, those of a
bad one as bad; after a first fit the lines of bad documents that look good by
themselves are relabelled (never all of a document) and the field is fitted again.

The model is fitted on the driver from at most ``sample`` labelled documents (the
least hashes of doc_id) of at most ``longest`` characters, those of more than
``MAX_LINES`` lines as several chains; scoring covers every document and whole
texts. Ids, languages, sources and labels are never features.

Defined results: null and empty texts are one empty line; a null ``doc_id`` isn't
held out and never learnt from; of several labels for one id the least counts;
repeated rows get the same result each; other columns are left alone; with no
labels, or labels of one kind only, every score is that share of good ones (1.0
with none).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Words, buffers, chunks, sequence_names

#: Lines of a training chain.
MAX_LINES = 64
_CLASS = np.full(256, 9, np.int64)
_CLASS[0x61:0x7B] = 0
_CLASS[0x41:0x5B] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[[0x20, 0x09, 0x0D]] = 3
_CLASS[[ord(c) for c in ".,;:'\"-?()"]] = 4
_CLASS[ord("!")] = 5
_CLASS[ord("|")] = 6
_CLASS[[ord(c) for c in "#$%&*~^_=+<>@/\\{}[]`"]] = 7
_CLASS[0xC0:] = 8
_CLASS[0x80:0xC0] = 10
N_CLASSES = 11


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, bytes of each line, first line of each document)."""
    data, offsets = buffers(texts)
    breaks = np.flatnonzero(data == 0x0A) + 1
    begin = np.sort(np.concatenate([offsets[:-1], breaks[~np.isin(breaks, offsets[1:])]])) if len(texts) else np.zeros(0, np.int64)
    end = np.r_[begin[1:], len(data)].astype(np.int64)
    first = _first_lines(begin, offsets) if len(texts) else begin
    size = end - begin
    n = len(begin)
    line = np.repeat(np.arange(n), size)
    counts = np.bincount(line * N_CLASSES + _CLASS[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES).astype(np.float64) if n else np.zeros((0, N_CLASSES))
    words = Words(texts)
    at = np.searchsorted(begin, words.start, "right") - 1
    h = words.hashes(80_001)
    n_words = np.bincount(at, minlength=n)[:n].astype(float)
    again = np.zeros(n)
    if len(h) > 2:
        same = np.flatnonzero((h[1:] == h[:-1]) & (at[1:] == at[:-1])) + 1
        again = np.bincount(at[same], minlength=n)[:n].astype(float)
    whole = sequence_names(h, np.searchsorted(at, np.arange(n)), np.searchsorted(at, np.arange(n), "right"))[:, 0] if n else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(texts)), np.diff(np.r_[first, n]))
    by = np.lexsort((whole, doc))
    twin = np.r_[False, (whole[by][1:] == whole[by][:-1]) & (doc[by][1:] == doc[by][:-1])] if n else np.zeros(0, bool)
    twice = np.zeros(n)
    twice[by[twin]] = 1
    chars = np.maximum(size - counts[:, 10], 1)
    letters = counts[:, 0] + counts[:, 1] + counts[:, 8]
    x = np.column_stack([
        letters / chars, counts[:, 1] / np.maximum(letters, 1), counts[:, 2] / chars, counts[:, 4] / chars, counts[:, 5] / np.maximum(n_words, 1), counts[:, 6] / np.maximum(n_words, 1), counts[:, 7] / np.maximum(n_words, 1), counts[:, 9] / chars,
        letters / np.maximum(n_words, 1) / 10, again / np.maximum(n_words, 1), twice * (n_words > 0), np.log1p(n_words) / 5, n_words == 0,
    ])
    return x, np.maximum(size, 1).astype(float), first


def _first_lines(begin: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First line of each document where texts may be empty: equal starts belong to consecutive documents."""
    first = np.searchsorted(begin, offsets[:-1])
    same = np.r_[False, offsets[1:-1] == offsets[:-2]]
    run = np.arange(len(first)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(first))))
    return first + run


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Features of a line, of the line before and after, and a constant; zeros beyond a document's ends."""
    n = len(x)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first[first < n]] = 0
    last = np.r_[first[1:], n] - 1
    after[last[last >= 0]] = 0
    return np.column_stack([x, before, after, np.ones(n)])


def _padded(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, longest) matrix of per-line values, and where it is filled."""
    at = first[:, None] + np.arange(size.max() if len(size) else 0)
    filled = np.arange(at.shape[1]) < size[:, None]
    return values[np.where(filled, at, 0)] * filled, filled


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def forward_backward(score: np.ndarray, filled: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of chains with two states, of which state 1 has the line scores ``score`` and state 0 zero:
    P(state 1) of each line, the expected moves (2, 2) in all, the log partition of each chain."""
    d, t = score.shape
    emit = np.stack([np.zeros_like(score), score], axis=2)
    alpha, beta = np.zeros((t, d, 2)), np.zeros((t, d, 2))
    alpha[0] = emit[:, 0]
    for i in range(1, t):
        step = _logsum(alpha[i - 1][:, :, None] + move, 1) + emit[:, i]
        alpha[i] = np.where(filled[:, i, None], step, alpha[i - 1])
    for i in range(t - 2, -1, -1):
        step = _logsum(move + (emit[:, i + 1] + beta[i + 1])[:, None, :], 2)
        beta[i] = np.where(filled[:, i + 1, None], step, beta[i + 1])
    z = _logsum(alpha[-1], 1)
    p = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z).T
    moves = np.zeros((2, 2))
    if t > 1:
        both = alpha[:-1, :, :, None] + move + (emit.transpose(1, 0, 2)[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None]
        moves = (np.exp(both) * filled.T[1:, :, None, None]).sum(axis=(0, 1))
    return p, moves, z


class LineField:
    """The fitted field: weights of a line's features, scores of the four moves, and the curve for documents."""

    def __init__(self, weights: np.ndarray, move: np.ndarray, curve: tuple[float, float] = (1.0, 0.0), constant: float | None = None):
        self.weights, self.move, self.curve, self.constant = weights, move, curve, constant

    def marginals(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of each line, bytes of each line, first line of each document."""
        x, size, first = line_features(texts)
        score = with_neighbours(x, first) @ self.weights
        count = np.diff(np.r_[first, len(x)])
        out = np.zeros(len(x))
        order = np.argsort(count, kind="stable")
        begin = 0
        while begin < len(order):  # chains of like length together; a group's matrix stays small
            end = begin + 1
            while end < len(order) and count[order[end]] <= max(8, 2 * count[order[begin]]) and (end - begin + 1) * count[order[end]] <= 200_000:
                end += 1
            group = order[begin:end]
            padded, filled = _padded(score, first[group], count[group])
            p, _, _ = forward_backward(padded, filled, self.move)
            out[(first[group][:, None] + np.arange(p.shape[1]))[filled]] = p[filled]
            begin = end
        return out, size, first

    def mean_good(self, texts: pa.Array) -> np.ndarray:
        p, size, first = self.marginals(texts)
        return np.add.reduceat(p * size, first) / np.add.reduceat(size, first) if len(first) else np.zeros(0)

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-(self.curve[0] * self.mean_good(texts) + self.curve[1])))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 25) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hess, x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(texts: list[str | None], quality: np.ndarray, ridge: float = 1.0, steps: int = 100) -> LineField:
    quality = np.asarray(quality)
    if len(quality) == 0 or quality.min() == quality.max():
        return LineField(np.zeros(1), np.zeros((2, 2)), constant=float(quality.mean()) if len(quality) else 1.0)
    column = pa.array(texts, pa.string())
    x, size, first = line_features(column)
    count = np.diff(np.r_[first, len(x)])
    whole = with_neighbours(x, first)
    doc = np.repeat(np.arange(len(texts)), count)
    good = quality[doc].astype(float)
    even = np.where(good == 1, 0.5 / max(good.sum(), 1), 0.5 / max((1 - good).sum(), 1)) * len(good)
    p = 1 / (1 + np.exp(-np.clip(whole @ _logistic(whole, good, even, ridge), -30, 30)))
    worst = np.zeros(len(p), bool)
    worst[np.lexsort((p, doc))[first]] = True
    label = np.where((quality[doc] == 0) & (p > 0.5) & ~worst, 1.0, good)
    pieces = -(-count // MAX_LINES)  # longer documents are several chains
    begin = np.repeat(first, pieces) + MAX_LINES * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    lines = np.minimum(MAX_LINES, np.repeat(first + count, pieces) - begin)
    filled = np.arange(MAX_LINES) < lines[:, None]
    padded_x = whole[np.where(filled, begin[:, None] + np.arange(MAX_LINES), 0)]
    y, _ = _padded(label, begin, lines)
    y = np.pad(y, ((0, 0), (0, MAX_LINES - y.shape[1])))
    w, move = _logistic(whole, label, np.ones(len(label)), ridge), np.zeros((2, 2))
    pair = filled[:, 1:]
    seen = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & pair).sum() for b in (0, 1)] for a in (0, 1)], float)
    target = (padded_x * (y * filled)[:, :, None]).sum(axis=(0, 1))
    m1, m2 = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    total = filled.sum()
    for i in range(1, steps + 1):  # gradient ascent of the likelihood (Adam)
        p, moves, _ = forward_backward((padded_x @ w) * filled, filled, move)
        grad = np.r_[target - (padded_x * (p * filled)[:, :, None]).sum(axis=(0, 1)) - ridge * w, (seen - moves - ridge * move).ravel()] / total
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        step = 0.1 * (m1 / (1 - 0.9**i)) / (np.sqrt(m2 / (1 - 0.99**i)) + 1e-8)
        w, move = w + step[: len(w)], move + step[len(w) :].reshape(2, 2)
    field = LineField(w, move)
    mean = field.mean_good(column)
    a, b = _logistic(np.column_stack([mean, np.ones(len(mean))]), quality.astype(float), np.ones(len(mean)), 0.1)
    field.curve = (float(a), float(b))
    return field


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = 1500, longest: int = 20_000) -> LineField:
    """Fit on at most ``sample`` labelled documents that aren't held out, of ``longest`` characters at most."""
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = known.orderBy(F.xxhash64("doc_id", F.lit(8)), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= longest).join(F.broadcast(picked), "doc_id").orderBy("doc_id", "text").limit(2 * sample).toArrow()  # the broadcast has at most ``sample`` rows
    return fit(rows["text"].to_pylist(), np.asarray(rows["quality"]))


def score_documents(docs: DataFrame, field: LineField, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    shared = docs.sparkSession.sparkContext.broadcast(field)  # a few dozen numbers

    def run(batches):
        for table in chunks(batches, 1 << 20):
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), table["held_out"].combine_chunks(), pa.array(shared.value.score(table["text"]), pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 1500) -> DataFrame:
    return score_documents(docs, learn(docs, labels, sample), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 1500) -> DataFrame:
    """``docs``, all columns, without the documents scored under ``threshold``. Nothing is joined or shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, sample))

    def run(batches):
        for table in chunks(batches, 1 << 20):
            yield from table.filter(pa.array(shared.value.score(table["text"]) >= threshold)).to_batches()

    return docs.mapInArrow(run, docs.schema)
