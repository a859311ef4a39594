"""Language identification with interpolated Kneser-Ney character models, kept in sorted hash arrays.

A text is the sequence of its words, lower-cased, letters only, each between two boundary marks; histories end at the
boundary. The symbols of a word therefore score alike wherever it stands, and each distinct word of a batch is scored
once. The language of a text is the one whose model gives the lowest cross-entropy for each symbol.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from evitrust.llm.words import ODD, judged, mix, slices, words_of

ORDER = 5
TRAIN_DOCS = 2_500           # labelled rows for each language, about
TRAIN_CHARS = 200_000        # longer texts are not used for learning
CALIBRATION_SHARE = 5        # one in so many of them is kept for calibration
UNKNOWN = "und"


def _symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the distinct words with boundaries, the start of each, and (text, word) of every occurrence."""
    words, owner = words_of(texts)
    coded = words.dictionary_encode()
    kept = pc.utf8_lower(pc.replace_substring_regex(coded.dictionary, r"[^\p{L}\p{M}]+", ""))
    kept = kept.dictionary_encode()
    of = np.asarray(kept.indices)[np.asarray(coded.indices)] if len(words) else np.empty(0, np.int64)
    line = "\n" + "\n".join(kept.dictionary.to_pylist()) + "\n"
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.flatnonzero(points == 10)
    return points, bounds, owner, of


def _grams(points: np.ndarray, bounds: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, keys, valid) for n = 1 to order: the n-gram that ends at each symbol and does not reach over a boundary."""
    at = np.arange(len(points))
    since = at - np.concatenate([[0], np.maximum.accumulate(np.where(points == 10, at, 0))[:-1]])
    keys = np.zeros(len(points), np.uint64)
    for n in range(1, order + 1):
        keys[n - 1:] += (points[:len(points) - n + 1].astype(np.uint64) + np.uint64(1)) * np.uint64(pow(int(ODD), n - 1, 1 << 64))
        yield n, mix(keys ^ np.uint64(n << 56)), since >= max(n - 1, 1)


def _count(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """(lang, n, key, context, suffix, initial, count) of the n-grams of each batch."""
    for batch in slices(batches, "text"):
        for lang in pc.unique(batch.column(0)).to_pylist():
            points, bounds, _, of = _symbols(batch.filter(pc.equal(batch.column(0), lang)).column(1))
            times = np.zeros(len(points), np.int64)
            often = np.bincount(of, minlength=len(bounds) - 1)
            real = bounds[1:] - bounds[:-1] > 1
            times[1:] = np.repeat(np.where(real, often, 0), bounds[1:] - bounds[:-1])
            before = None
            initial = np.zeros(len(points), bool)
            for n, keys, valid in _grams(points, bounds, order):
                at = np.flatnonzero(valid & (times > 0))
                if n > 1:
                    initial[n - 1:] = points[:len(points) - n + 1] == 10
                    context, suffix = before[at - 1], before[at]
                else:
                    context = suffix = np.zeros(len(at), np.uint64)
                first = initial[at] if n > 1 else np.zeros(len(at), bool)
                distinct, where, inverse = np.unique(keys[at], return_index=True, return_inverse=True)
                total = np.bincount(inverse, times[at], minlength=len(distinct)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(distinct), pa.string()), pa.array(np.full(len(distinct), n, np.int32)),
                     pa.array(distinct.view(np.int64)), pa.array(context[where].view(np.int64)),
                     pa.array(suffix[where].view(np.int64)), pa.array(first[where]), pa.array(total)],
                    ["lang", "n", "key", "context", "suffix", "initial", "count"])
                before = keys


@dataclass
class Model:
    """Probabilities of all languages side by side: ``keys`` is sorted, its rows index ``alpha`` and ``gamma``."""

    languages: list[str]
    keys: np.ndarray      # hashes of n-grams of all orders
    alpha: np.ndarray     # (n-gram, language): discounted probability of the last symbol
    gamma: np.ndarray     # (n-gram, language): weight of the shorter history when the n-gram is the history
    empty: np.ndarray     # weight of the uniform distribution below the unigrams
    order: int
    alphabet: int
    mean: np.ndarray      # cross-entropy of known texts for each language
    spread: np.ndarray    # and its spread times the root of the number of symbols
    limit: float = np.inf  # largest calibrated distance from the mean
    temperature: float = 1.0

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each text under each language, and its number of symbols."""
        points, bounds, owner, of = _symbols(texts)
        n_langs = len(self.languages)
        p = np.full((len(points), n_langs), 1.0 / (self.alphabet + 1), np.float32)
        rows_before = np.full(len(points), -1)
        for n, keys, valid in _grams(points, bounds, self.order):
            rows = np.searchsorted(self.keys, keys).clip(0, len(self.keys) - 1)
            rows[(self.keys[rows] != keys)] = -1
            if n == 1:
                at = np.flatnonzero(valid)
                p[at] = p[at] * self.empty + np.where((rows[at] >= 0)[:, None], self.alpha[rows[at]], 0)
            else:
                history = np.concatenate([[-1], rows_before[:-1]])
                at = np.flatnonzero(valid & (history >= 0))
                p[at] = p[at] * self.gamma[history[at]] + np.where((rows[at] >= 0)[:, None], self.alpha[rows[at]], 0)
            rows_before = rows
        bits = -np.log2(p)
        sizes = bounds[1:] - bounds[:-1]
        by_word = np.add.reduceat(bits[1:], np.minimum(bounds[:-1], len(points) - 2), axis=0).astype(np.float64)
        real = sizes > 1
        by_word[~real] = 0
        symbols = np.where(real, sizes, 0)
        total = np.stack([np.bincount(owner, by_word[of, j], minlength=len(texts)) for j in range(n_langs)], axis=1) \
            if len(of) else np.zeros((len(texts), n_langs))
        return total, np.bincount(owner, symbols[of], minlength=len(texts)) if len(of) else np.zeros(len(texts))


def kneser_ney(counts, languages: list[str], order: int = ORDER) -> Model:
    """A model from rows (lang, n, key, context, suffix, initial, count), one for each language and n-gram.

    Shorter n-grams count the distinct symbols before them, except at the start of a word, where nothing stands
    before. One discount for each order, n1 / (n1 + 2 n2). The unigrams are mixed with the uniform distribution.
    """
    col = {c: counts.column(c).to_numpy(zero_copy_only=False) for c in ("n", "key", "context", "suffix", "initial", "count")}
    key, context, suffix = (col[c].view(np.uint64) if col[c].dtype == np.int64 else col[c] for c in ("key", "context", "suffix"))
    lang_of = np.array([languages.index(x) for x in counts.column("lang").to_pylist()], np.int64)
    keys = np.unique(key)
    alpha = np.zeros((len(keys), len(languages)), np.float32)
    gamma = np.ones((len(keys), len(languages)), np.float32)
    empty = np.ones(len(languages), np.float32)
    row = np.searchsorted(keys, key)
    alphabet = len(np.unique(key[col["n"] == 1]))
    for j in range(len(languages)):
        mine = lang_of == j
        effective = np.zeros(len(keys), np.float64)
        effective[row[mine]] = np.where((col["n"][mine] == order) | col["initial"][mine], col["count"][mine], 0)
        longer = mine & (col["n"] > 1)
        number = np.bincount(np.searchsorted(keys, suffix[longer]), minlength=len(keys))
        plain = mine & (col["n"] < order) & ~col["initial"]
        effective[row[plain]] = number[row[plain]]
        for n in range(1, order + 1):
            here = mine & (col["n"] == n)
            c = effective[row[here]]
            once, twice = np.sum(c == 1), np.sum(c == 2)
            d = once / (once + 2 * twice) if once and twice else 0.5
            if n == 1:
                total, types = c.sum(), np.sum(c > 0)
                alpha[row[here], j] = np.maximum(c - d, 0) / max(total, 1)
                empty[j] = d * types / total if total else 1
                continue
            of = np.searchsorted(keys, context[here])
            total, types = np.bincount(of, c, minlength=len(keys)), np.bincount(of, c > 0, minlength=len(keys))
            alpha[row[here], j] = np.maximum(c - d, 0) / total[of]
            seen = total > 0
            gamma[seen, j] = (d * types[seen] / total[seen])
    return Model(languages, keys, alpha, gamma, empty, order, alphabet, np.zeros(len(languages)), np.ones(len(languages)))


def calibrate(model: Model, bits: np.ndarray, symbols: np.ndarray, truth: np.ndarray, margin: float = 1.5) -> Model:
    """Set the confidence temperature and the rejection limit from texts of known language.

    The distance of a text is (cross-entropy - mean) * sqrt(symbols) / spread for its language; the limit is
    ``margin`` times the largest distance of a known text (at least 6), so texts like the known ones are not rejected.
    """
    use = symbols > 0
    bits, symbols, truth = bits[use], symbols[use], truth[use]
    if not len(bits):
        return model
    entropy = bits / symbols[:, None]
    far = 0.0
    for j in range(len(model.languages)):
        mine = truth == j
        if mine.any():
            h, w = entropy[mine, j], np.sqrt(symbols[mine])
            model.mean[j] = np.average(h, weights=symbols[mine])
            model.spread[j] = max(np.sqrt(np.mean(((h - model.mean[j]) * w) ** 2)), 0.1)
            far = max(far, np.max((h - model.mean[j]) * w / model.spread[j]))
    model.limit = max(6.0, margin * far)
    known = np.arange(len(truth))
    losses = {t: -np.mean(np.log(np.clip(_posterior(bits, t)[known, truth], 1e-12, 1))) for t in 2.0 ** np.arange(-2, 9)}
    model.temperature = min(losses, key=lambda t: (losses[t], t))
    return model


def _posterior(bits: np.ndarray, temperature: float) -> np.ndarray:
    x = -bits * np.log(2) / temperature
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def train(docs: DataFrame, usable: Column, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
          order: int = ORDER, train_docs: int = TRAIN_DOCS) -> Model | None:
    """Learn from rows where ``usable`` holds and the language is given; None if there is no such row with a word.

    About ``train_docs`` rows for each language are taken by a hash of the id; that bound and ``TRAIN_CHARS`` keep the
    model's size independent of the corpus. Only n-gram counts and scores of the calibration texts reach the driver.
    """
    known = docs.where(usable & F.col(lang_col).isNotNull() & (F.length(text_col) <= TRAIN_CHARS)).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, F.lit("language")).alias("h"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    million = 1_000_000
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(million, train_docs * million // n + 1))])
    sample = known.where(F.pmod("h", F.lit(million)) < share[F.col("lang")])
    part = F.pmod(F.xxhash64("h"), F.lit(CALIBRATION_SHARE))
    counts = (sample.where(part > 0).select("lang", "text")
              .mapInArrow(lambda b: _count(b, order), "lang string, n int, key long, context long, suffix long, initial boolean, count long")
              .groupBy("lang", "n", "key").agg(F.first("context").alias("context"), F.first("suffix").alias("suffix"),
                                               F.first("initial").alias("initial"), F.sum("count").alias("count")).toArrow())
    if not counts.num_rows:
        return None
    model = kneser_ney(counts.combine_chunks().to_batches()[0], languages, order)

    def run(batches):
        for batch in slices(batches, "text"):
            bits, symbols = model.score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([*bits], pa.list_(pa.float64())), pa.array(symbols.astype(np.int64))],
                                             ["lang", "bits", "symbols"])
    scored = sample.where(part == 0).select("lang", "text").mapInArrow(run, "lang string, bits array<double>, symbols long").collect()
    if not scored:
        return model
    return calibrate(model, np.array([r["bits"] for r in scored]), np.array([r["symbols"] for r in scored]),
                     np.array([languages.index(r["lang"]) for r in scored]))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text",
            columns: bool = False) -> DataFrame:
    """Rows (id, lang_pred, score, cross_entropy, rejected) of every whole text; with ``columns`` all columns stay.

    Null texts and texts without a letter get ``und``, score 0 and are rejected. Other texts get the language of
    lowest cross-entropy; they are rejected if that is farther above the language's usual value than ``limit`` allows.
    Ties go to the first language by name. Without a model everything is ``und``. Repeated rows are judged one by one.
    """
    def judge(texts: pa.Array) -> list[pa.Array]:
        n = len(texts)
        lang, score, entropy, rejected = np.full(n, UNKNOWN, object), np.zeros(n), np.full(n, np.nan), np.ones(n, bool)
        if model:
            bits, symbols = model.score(texts)
            has = np.flatnonzero(np.asarray(pc.match_substring_regex(texts, r"\p{L}")) & (symbols > 0))
            best = bits[has].argmin(axis=1)
            lang[has] = np.array(model.languages, object)[best]
            score[has] = _posterior(bits[has], model.temperature).max(axis=1, initial=0)
            entropy[has] = bits[has, best] / symbols[has]
            rejected[has] = (entropy[has] - model.mean[best]) * np.sqrt(symbols[has]) / model.spread[best] > model.limit
        return [pa.array(lang, pa.string()), pa.array(score), pa.array(entropy, from_pandas=True), pa.array(rejected)]

    return judged(docs, judge, "lang_pred string, score double, cross_entropy double, rejected boolean", id_col, text_col, columns)
