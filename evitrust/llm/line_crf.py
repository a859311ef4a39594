"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its score depends on features of the line and of the lines beside it; a transition table
ties neighbouring labels. Lines learn the label of their document. The quality of a document is the mean of the lines'
forward-backward marginals, weighted by line length and calibrated on the learning rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from evitrust.llm.words import count_bytes, judged, lines_of, slices, words_of

TRAIN_DOCS = 4_000     # labelled rows to learn from, about
TRAIN_CHARS = 100_000  # longer texts are not used for learning
THRESHOLD = 0.3
STEPS, RATE, RIDGE = 400, 0.05, 1e-3
FEATURES = ("symbols", "capitals", "marks", "repeats", "words", "word_length", "digits", "blank")


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line and its two neighbours, text of each line, weight of each line)."""
    lines, owner = lines_of(texts)
    n = len(lines)
    words, of = words_of(lines)
    n_words = np.bincount(of, minlength=n)
    chars = np.asarray(pc.utf8_length(lines)).astype(np.float64)
    codes = np.asarray(words.dictionary_encode().indices)
    again = np.flatnonzero((codes[1:] == codes[:-1]) & (of[1:] == of[:-1])) + 1
    upper, lower = count_bytes(lines, bytes(range(65, 91))), count_bytes(lines, bytes(range(97, 123)))
    some = np.maximum(n_words, 1)
    own = np.stack([
        np.minimum(count_bytes(lines, b"#*$%&|<>@^~=_\\{}[]") / some, 3),
        upper / np.maximum(upper + lower, 1),
        np.minimum(count_bytes(lines, b"!?") / some, 3),
        np.bincount(of[again], minlength=n) / some,
        np.log1p(n_words) / 6,
        np.minimum(chars / some, 40) / 20,
        count_bytes(lines, b"0123456789") / np.maximum(chars, 1),
        (n_words == 0).astype(np.float64)], axis=1)
    none = np.zeros((1, own.shape[1]))
    first = np.r_[True, owner[1:] != owner[:-1]][:, None]
    last = np.r_[owner[1:] != owner[:-1], True][:, None]
    before = np.where(first, 0, np.concatenate([none, own[:-1]]))
    after = np.where(last, 0, np.concatenate([own[1:], none]))
    return np.concatenate([own, before, after, np.ones((n, 1))], axis=1), owner, chars + 1


def marginals(unary: np.ndarray, owner: np.ndarray, table: np.ndarray, pairs: bool = False):
    """P(good) of every line given its text; with ``pairs`` also the expected label pairs, summed over all texts.

    ``unary`` is the log odds of good for each line, ``table`` the log weights of (label, next label). All texts step
    together, the longest first, so a step works on arrays of the texts that reach so far.
    """
    n = len(unary)
    good = 1 / (1 + np.exp(-np.clip(unary, -30, 30)))
    local = np.stack([1 - good, good], axis=1)
    step = np.exp(table - table.max())
    sizes = np.bincount(owner)
    sizes = sizes[sizes > 0]
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = begin[order], sizes[order]
    active = [np.searchsorted(-sizes, -t, side="left") for t in range(sizes.max() if n else 0)]  # texts with over t lines
    forward, backward = np.empty((n, 2)), np.ones((n, 2))
    for t, k in enumerate(active):
        at = begin[:k] + t
        x = local[at] if t == 0 else local[at] * (forward[at - 1] @ step)
        forward[at] = x / x.sum(axis=1, keepdims=True)
    for t in range(len(active) - 2, -1, -1):
        at = begin[:active[t + 1]] + t
        x = (local[at + 1] * backward[at + 1]) @ step.T
        backward[at] = x / x.sum(axis=1, keepdims=True)
    joint = forward * backward
    p = joint[:, 1] / joint.sum(axis=1)
    if not pairs:
        return p
    at = np.flatnonzero(owner[1:] == owner[:-1])
    x = forward[at][:, :, None] * step[None] * (local[at + 1] * backward[at + 1])[:, None, :]
    return p, (x / x.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


@dataclass
class Model:
    weights: np.ndarray
    table: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def lines(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(P(good) of each line, its text, its weight)."""
        x, owner, weight = line_features(texts)
        return marginals(x @ self.weights, owner, self.table), owner, weight

    def calibrated(self, share: np.ndarray) -> np.ndarray:
        odds = np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1))
        return 1 / (1 + np.exp(-np.clip(self.slope * odds + self.offset, -30, 30)))


def _adam(gradient, start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for i in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9 ** i)) / (np.sqrt(v / (1 - 0.999 ** i)) + 1e-9)
    return x


def fit(x: np.ndarray, owner: np.ndarray, weight: np.ndarray, labels: np.ndarray, steps: int = STEPS,
        rate: float = RATE, ridge: float = RIDGE) -> Model:
    """Maximum likelihood with a ridge. ``owner`` numbers the texts of the lines from 0, ``labels`` has one for each."""
    y = labels[owner].astype(np.float64)
    inside = owner[1:] == owner[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][inside].astype(int), y[1:][inside].astype(int)), 1)
    k, n = x.shape[1], len(x)

    def gradient(theta):
        p, pairs = marginals(x @ theta[:k], owner, theta[k:].reshape(2, 2), pairs=True)
        return np.concatenate([x.T @ (p - y), (pairs - seen).ravel()]) / n + ridge * theta

    theta = _adam(gradient, np.zeros(k + 4), steps, rate)
    model = Model(theta[:k], theta[k:].reshape(2, 2))
    p = marginals(x @ model.weights, owner, model.table)
    share = np.bincount(owner, p * weight) / np.bincount(owner, weight)
    odds = np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1))

    def platt(ab):
        e = 1 / (1 + np.exp(-np.clip(ab[0] * odds + ab[1], -30, 30))) - labels
        return np.array([np.mean(e * odds), np.mean(e)]) + 1e-4 * ab
    model.slope, model.offset = map(float, _adam(platt, np.array([1.0, 0.0]), steps, rate))
    return model


def train(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "quality", id_col: str = "doc_id",
          text_col: str = "text", train_docs: int = TRAIN_DOCS) -> Model | None:
    """Learn from about ``train_docs`` labelled rows for which ``usable`` (of the label table) holds.

    They are taken by a hash of the id. Their number is bounded, so their ids are broadcast and their line features
    collected. None if fewer than two labels are found; null labels and null texts are not used.
    """
    known = labels.where(usable & F.col(label_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    share = min(1.0, train_docs / max(known.count(), 1))
    sample = known.where(F.pmod(F.xxhash64("_id", F.lit("quality")), F.lit(1_000_000)) <= int(share * 1_000_000))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).where(
        F.length("text") <= TRAIN_CHARS).join(F.broadcast(sample), "_id").select("_label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, owner, weight = line_features(batch.column(1))
            cut = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            rows = [(x[a:b].ravel(), weight[a:b]) for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), pa.list_(pa.float64())) for c in zip(*rows))],
                                             ["label", "x", "weight"])
    rows = texts.mapInArrow(run, "label int, x array<double>, weight array<double>").toArrow()
    label = np.asarray(rows.column("label"))
    if len(np.unique(label)) < 2:
        return None
    weights = [np.array(w) for w in rows.column("weight").to_pylist()]
    x = np.asarray(pc.list_flatten(rows.column("x"))).reshape(sum(map(len, weights)), -1)
    return fit(x, np.repeat(np.arange(len(label)), [len(w) for w in weights]), np.concatenate(weights), label)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text",
            threshold: float = THRESHOLD, keep_lines: bool = False, columns: bool = False) -> DataFrame:
    """Rows (id, score, predicted, n_lines, n_bad_lines[, line_scores]) of every whole text; with ``columns`` all
    columns stay.

    An empty or null text is one blank line and is scored like any other. Without a model every score is 0.5.
    Repeated rows are judged one by one. ``keep_lines`` adds P(good) of each line.
    """
    def judge(texts: pa.Array) -> list[pa.Array]:
        n = len(texts)
        if model:
            p, owner, weight = model.lines(texts)
            score = model.calibrated(np.bincount(owner, p * weight, minlength=n) / np.bincount(owner, weight, minlength=n))
        else:
            _, owner = lines_of(texts)
            p, score = np.full(len(owner), 0.5), np.full(n, 0.5)
        out = [pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(np.bincount(owner, minlength=n)),
               pa.array(np.bincount(owner, p < 0.5, minlength=n).astype(np.int64))]
        return out + [pa.array(np.split(p, np.searchsorted(owner, np.arange(1, n))), pa.list_(pa.float64()))] * keep_lines

    fields = "score double, predicted int, n_lines long, n_bad_lines long" + ", line_scores array<double>" * keep_lines
    return judged(docs, judge, fields, id_col, text_col, columns)
