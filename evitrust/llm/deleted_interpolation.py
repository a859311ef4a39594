"""Language-model scores by deleted interpolation of word bigrams.

P(w | v) = l2 c(v, w) / c(v) + l1 c(w) / N + l0 / (V + 1). The weights l depend on how often the history v was seen (a
bucket for each power of two) and are learnt by expectation-maximisation on counts of held-out learning texts, against
counts from which these texts are deleted. Scores then use the counts of all learning texts.

Counts cover the whole corpus, so neither they nor a vocabulary fit on one machine. Texts are turned once into blocks of
token numbers. Each block sends its distinct words and bigrams (hash and counts) to buckets of hashes and gets the
corpus counts back in the same order; that is one row for each block and bucket and one number for each distinct key of
a block, not one row for each word. Keys are added up inside a block before they move, so no word is a hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from evitrust.llm.storage import written
from evitrust.llm.words import ODD, hash_strings, mix, slices, words_of

END = np.uint64(0x5851F42D4C957F)
KEY_BITS = np.uint64(56)     # two keys of a corpus of n words meet by chance with n / 2**56
BLOCK_BYTES = 12 << 20        # text of a block, about
BUCKET_KEYS = 1_000_000      # keys that meet in one task, about
BUCKETS = 25                 # of history frequency: unseen, 1, 2-3, 4-7, ...
STEPS_PER_OCTAVE = 8         # resolution of probability ratios in the learning statistics
ITERATIONS = 200
DEV_SHARE = 10               # one learning text in so many is held out for the weights


def _squeeze(values: np.ndarray) -> bytes:
    """Numbers with their first, second, ... bytes side by side, compressed: small numbers take little room."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T if len(values) else values
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _spread(data: bytes, kind) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.empty(0, kind)
    planes = np.frombuffer(pa.decompress(data[8:], n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _sorted_keys_out(keys: np.ndarray) -> bytes:
    """Sorted keys as steps of as many bytes as the largest step needs."""
    step = np.diff(keys, prepend=np.uint64(0))
    wide = max(1, -(-int(step[1:].max(initial=0)).bit_length() // 8))
    first = keys[:1].tobytes()
    return bytes([wide]) + first + step[1:].view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()


def _sorted_keys_in(data: bytes) -> np.ndarray:
    wide = data[0]
    if len(data) == 1:
        return np.empty(0, np.uint64)
    step = np.zeros(((len(data) - 9) // wide + 1, 8), np.uint8)
    step[0] = np.frombuffer(data, np.uint8, 8, 1)
    step[1:, :wide] = np.frombuffer(data, np.uint8, offset=9).reshape(-1, wide)
    return np.add.accumulate(step.view(np.uint64).ravel())


def token_blocks(docs: DataFrame, learns: Column, develops: Column, id_col: str, text_col: str) -> DataFrame:
    """Rows (block, ids, learn, dev, size, vocab, tokens, probe), each for a slice of texts.

    vocab holds the sorted hashes of the distinct tokens, tokens the place of every token in it; each text ends with the
    end token, which is also the history of the first word of the next one. probe holds, for the tokens of held-out
    texts only, the places of bigram, history and word among the block's keys. A-Z is lower-cased.
    """
    rows = docs.select(id_col, text_col, F.coalesce(learns, F.lit(False)).alias("_learn"),
                       F.coalesce(learns & develops, F.lit(False)).alias("_dev"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in slices(batches, text_col, BLOCK_BYTES):
            n = batch.num_rows
            words, owner = words_of(batch.column(1), lower=True)
            coded = words.dictionary_encode()
            hashes = np.r_[hash_strings(coded.dictionary) >> (np.uint64(64) - KEY_BITS), END]
            vocab, place = np.unique(hashes, return_inverse=True)
            tokens = np.full(len(words) + n, place[-1], np.int32)
            tokens[np.arange(len(words)) + owner] = place[np.asarray(coded.indices)]
            size = np.bincount(owner, minlength=n).astype(np.int32) + 1
            held = np.flatnonzero(np.repeat(np.asarray(batch.column(3)), size))
            before = np.r_[place[-1], tokens[:-1]]
            probe = np.concatenate([pairs_of(tokens, place[-1], vocab)[1][held], before[held], tokens[held]]).astype(np.int32)
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), a)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), one(batch.column(0)), one(batch.column(2)), one(batch.column(3)), one(pa.array(size)),
                 pa.array([_sorted_keys_out(vocab)], pa.binary()), pa.array([_squeeze(tokens)], pa.binary()),
                 pa.array([_squeeze(probe)], pa.binary())],
                ["block", "ids", "learn", "dev", "size", "vocab", "tokens", "probe"])
            block += 1

    return rows.mapInArrow(run, f"block long, ids array<{kind}>, learn array<boolean>, dev array<boolean>, size array<int>, "
                                "vocab binary, tokens binary, probe binary")


def pairs_of(tokens: np.ndarray, end: int, vocab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys of the distinct bigrams, place of each token's bigram in them)."""
    tokens = tokens.astype(np.int64)
    distinct, inverse = np.unique(np.r_[end, tokens[:-1]] * len(vocab) + tokens, return_inverse=True)
    keys = mix(vocab[distinct // len(vocab)] * ODD + mix(vocab[distinct % len(vocab)])) >> (np.uint64(64) - KEY_BITS)
    order = np.argsort(keys, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return keys[order], rank[inverse]


class Block:
    """The tokens of one block and the texts they belong to."""

    def __init__(self, row: dict):
        self.size = np.asarray(row["size"], np.int64)
        self.learn, self.dev = (np.repeat(np.asarray(row[c], bool), self.size) for c in ("learn", "dev"))
        self.owner = np.repeat(np.arange(len(self.size)), self.size)
        self.tokens = _spread(row["tokens"], np.int32).astype(np.int64)


def _keys(row: dict, buckets: tuple[int, int]) -> Iterator[tuple]:
    """(bucket, block, keys, learn counts, dev counts) of words and bigrams; buckets cut the range of keys."""
    block, vocab = Block(row), _sorted_keys_in(row["vocab"])
    end = int(np.searchsorted(vocab, END))
    pair_keys, pair = pairs_of(block.tokens, end, vocab)
    begin = 0
    for keys, at, n in ((vocab, block.tokens, buckets[0]), (pair_keys, pair, buckets[1])):
        learn, dev = (np.bincount(at[flag], minlength=len(keys)).astype(np.uint32) for flag in (block.learn, block.dev))
        edge = np.array([(i << int(KEY_BITS)) // n for i in range(1, n)], np.uint64)
        cut = np.r_[0, np.searchsorted(keys, edge), len(keys)]
        for i, (a, b) in enumerate(zip(cut, cut[1:])):
            yield begin + i, row["block"], _sorted_keys_out(keys[a:b]) if b > a else b"\x01", _squeeze(learn[a:b]), _squeeze(dev[a:b])
        begin += n


def _add_up(table: pa.Table) -> pa.Table:
    """The corpus counts of each block's keys of one bucket, in the order in which they came, and sums over the bucket."""
    parts = [_sorted_keys_in(x) for x in table.column("keys").to_pylist()]
    learn, dev = (np.concatenate([_spread(x, np.uint32) for x in table.column(c).to_pylist()]).astype(np.int64) for c in ("learn", "dev"))
    keys, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    learn, dev = (np.bincount(inverse, x, minlength=len(keys)).astype(np.uint64) for x in (learn, dev))
    cut = np.cumsum([len(p) for p in parts])[:-1]
    n = table.num_rows
    first = np.arange(n) == 0
    return pa.table({
        "block": table.column("block"), "bucket": table.column("bucket"),
        "learn": pa.array([_squeeze(x.astype(np.uint32)) for x in np.split(learn[inverse], cut)], pa.binary()),
        "dev": pa.array([_squeeze(x.astype(np.uint32)) for x in np.split(dev[inverse], cut)], pa.binary()),
        "total": pa.array(np.where(first, int(learn.sum()), 0)), "total_dev": pa.array(np.where(first, int(dev.sum()), 0)),
        "types": pa.array(np.where(first, int((learn > 0).sum()), 0)),
        "types_kept": pa.array(np.where(first, int((learn > dev).sum()), 0))})


def _replies(right: pa.Table, word_buckets: int, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Corpus counts of the bigrams and of the words of one block, in the order of its keys."""
    rows = sorted(right.select(["bucket", column]).to_pylist(), key=lambda r: r["bucket"])
    parts = [_spread(r[column], np.uint32) for r in rows]
    n = sum(r["bucket"] < word_buckets for r in rows)
    return np.concatenate(parts[n:]).astype(np.float64), np.concatenate(parts[:n]).astype(np.float64)


def bucket_of(history: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(history > 0, np.floor(np.log2(np.maximum(history, 1))) + 1, 0), BUCKETS - 1).astype(np.int64)


def _ratio(pair, history, word, total: float, types: float) -> tuple[np.ndarray, np.ndarray]:
    """Bigram and word probability over the uniform one."""
    return pair / np.maximum(history, 1) * (types + 1), word / max(total, 1) * (types + 1)


def learn_weights(statistics: list[tuple[int, float, float, float]], iterations: int = ITERATIONS) -> np.ndarray:
    """Weights (bucket, [bigram, word, uniform]) by expectation-maximisation.

    statistics: (bucket, bigram ratio, word ratio, weight). A bucket without statistics gets the weights of all buckets
    together; without any, words count most. No weight falls to zero but that of bigrams after unseen histories.
    """
    weights = np.tile([0.0, 0.9, 0.1], (BUCKETS, 1))
    if statistics:
        s = np.array(statistics, np.float64)
        ratios = np.stack([s[:, 1], s[:, 2], np.ones(len(s))], axis=1)

        def fit(rows):
            w = np.full(3, 1 / 3)
            x, n = ratios[rows], s[rows, 3]
            for _ in range(iterations):
                share = x * w
                w = (n[:, None] * share / share.sum(axis=1, keepdims=True)).sum(axis=0) + 1e-3
                w = w / w.sum()
            return w
        weights[:] = fit(np.ones(len(s), bool))
        for b in range(BUCKETS):
            if (s[:, 0] == b).any():
                weights[b] = fit(s[:, 0] == b)
    weights[0, 0] = 0
    return weights / weights.sum(axis=1, keepdims=True)


def score(docs: DataFrame, learns: Column, develops: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
          bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """Rows (id, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    Texts where ``learns`` holds give the counts; among them ``develops`` (by default one in ten by a hash of the id)
    marks those that the weights are learnt on. base_score is the add-0.1 score of the words, score the log10
    probability under the interpolated bigrams. Null and empty texts are one end token. Without learning texts every
    token has probability 1. Repeated rows are learnt and scored one by one; other columns are not used.
    """
    develops = F.pmod(F.xxhash64(id_col, F.lit("weights")), F.lit(DEV_SHARE)) == 0 if develops is None else develops
    blocks = written(token_blocks(docs, learns, develops, id_col, text_col))
    size = blocks.agg(F.sum(F.octet_length("vocab") / 4), F.sum(F.aggregate("size", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    buckets = tuple(1 + int((n or 0) // bucket_keys) for n in size)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = list(zip(*_keys(batch.slice(i, 1).to_pylist()[0], buckets)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int32(), pa.int64(), *[pa.binary()] * 3))],
                                                 ["bucket", "block", "keys", "learn", "dev"])

    sent = blocks.mapInArrow(send, "bucket int, block long, keys binary, learn binary, dev binary")
    replies = written(sent.groupBy("bucket").applyInArrow(
        _add_up, "block long, bucket int, learn binary, dev binary, total long, total_dev long, types long, types_kept long"))
    sums = replies.where(F.col("bucket") < buckets[0]).agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "total_dev", "types", "types_kept"))).first()
    total, total_dev, types, types_kept = (int(x) for x in sums)
    counts = replies.select("block", "bucket", "learn", "dev").groupBy("block")

    def measure(left: pa.Table, right: pa.Table) -> pa.Table:
        probe = _spread(left.column("probe")[0].as_py(), np.int32).reshape(3, -1)
        kept = [learn - dev for learn, dev in zip(_replies(right, buckets[0], "learn"), _replies(right, buckets[0], "dev"))]
        pair, history, word = kept[0][probe[0]], kept[1][probe[1]], kept[1][probe[2]]
        step = lambda r: np.where(r > 0, np.round(np.log2(np.maximum(r, 1e-30)) * STEPS_PER_OCTAVE), -9999).astype(np.int64)
        r2, r1 = map(step, _ratio(pair, history, word, total - total_dev, types_kept))
        rows, n = np.unique(np.stack([bucket_of(history), r2, r1], axis=1), axis=0, return_counts=True)
        return pa.table({"b": rows[:, 0], "r2": rows[:, 1], "r1": rows[:, 2], "n": n})

    grid = blocks.select("block", "probe").groupBy("block").cogroup(counts).applyInArrow(
        measure, "b long, r2 long, r1 long, n long").groupBy("b", "r2", "r1").agg(F.sum("n").alias("n")).orderBy(
        "b", "r2", "r1").collect()  # a grid of ratios, not of tokens
    real = lambda r: 0.0 if r == -9999 else 2.0 ** (r / STEPS_PER_OCTAVE)
    weights = learn_weights([(r["b"], real(r["r2"]), real(r["r1"]), r["n"]) for r in grid])
    if not total:
        weights[:] = (0, 0, 1)

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.drop_columns("ids").to_pylist()[0]
        block, vocab = Block(row), _sorted_keys_in(row["vocab"])
        end = int(np.searchsorted(vocab, END))
        bigram, one = _replies(right, buckets[0], "learn")
        pair, history, word = bigram[pairs_of(block.tokens, end, vocab)[1]], one[np.r_[end, block.tokens[:-1]]], one[block.tokens]
        r2, r1 = _ratio(pair, history, word, total, types)
        w = weights[bucket_of(history)]
        p = (w[:, 0] * r2 + w[:, 1] * r1 + w[:, 2]) / (types + 1)
        base = (word + 0.1) / (total + 0.1 * (types + 1))
        n = len(block.size)
        add = lambda x: np.bincount(block.owner, x, minlength=n)
        return pa.table([pa.concat_arrays(left.column("ids").chunks).flatten(), pa.array(block.size), pa.array(add(word > 0).astype(np.int64)), pa.array(np.full(n, total)),
                         pa.array(add(np.log10(base))), pa.array(add(np.log10(p)))],
                        names=[id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return blocks.drop("probe").groupBy("block").cogroup(counts).applyInArrow(
        judge, f"`{id_col}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
