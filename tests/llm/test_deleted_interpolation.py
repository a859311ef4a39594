import math
import re
from collections import Counter

import numpy as np
import pytest
from conftest_llm import ODD_TEXTS
from pyspark.sql import functions as F

from evitrust.llm import deleted_interpolation as di
from evitrust.llm.queries import op1_deleted_interpolation


def tokens_of(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def count(texts):
    words, pairs = Counter(), Counter()
    for t in texts:
        ts = tokens_of(t)
        words.update(ts)
        pairs.update(zip([None, *ts], ts))
    return words, pairs


def parts(words, pairs, v, w):
    n = sum(words.values())
    types = sum(c > 0 for c in words.values())
    b = 0 if not words[v] else min(int(math.log2(words[v])) + 1, di.BUCKETS - 1)
    return b, (pairs[v, w] / words[v] if words[v] else 0.0), words[w] / n if n else 0.0, 1 / (types + 1)


def brute(rows, learns, dev):
    words, pairs = count([t for i, t in rows if i in learns])
    kept_w, kept_p = count([t for i, t in rows if i in learns - dev])
    for w in words:
        kept_w[w] += 0
    held = []
    for i, t in rows:
        if i in learns & dev:
            ts = tokens_of(t)
            held += [parts(kept_w, kept_p, v, w) for v, w in zip([None, *ts], ts)]
    weights = di.learn_weights([(b, p2 / p0, p1 / p0, 1) for b, p2, p1, p0 in held])
    n, types = sum(words.values()), len(words)
    out = {}
    for i, t in rows:
        ts = tokens_of(t)
        base = sum(math.log10((words[w] + 0.1) / (n + 0.1 * (types + 1))) for w in ts)
        score = 0.0
        for v, w in zip([None, *ts], ts):
            b, *p = parts(words, pairs, v, w)
            score += math.log10(sum(x * y for x, y in zip(weights[b], p)))
        out[i] = (len(ts), sum(words[w] > 0 for w in ts), n, base, score)
    return out


@pytest.mark.parametrize("bucket_keys,partitions", [(10**6, 1), (40, 7)])
def test_matches_brute_force(table, documents, bucket_keys, partitions):
    texts = ODD_TEXTS + [r.text for r in documents.orderBy("doc_id").limit(50).collect()]
    rows = [*enumerate(texts)]
    learns, dev = {i for i in range(len(rows)) if i % 5}, {i for i in range(len(rows)) if i % 4 == 1}
    df = table(rows, extra=["score", "block", "learn", "n_tokens"]).repartition(partitions)
    got = {r.doc_id: r for r in di.score(df, F.col("doc_id") % 5 != 0, F.col("doc_id") % 4 == 1, bucket_keys=bucket_keys).collect()}
    want = brute(rows, learns, dev)
    assert set(got) == set(want)
    for i, (n, known, total, base, score) in want.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(score, rel=0.01, abs=0.05)  # ratios are rounded while weights are learnt


def test_weights_find_the_mixture():
    rng = np.random.default_rng(4)
    truth = np.array([0.6, 0.3, 0.1])
    rows = []
    for _ in range(4000):
        r = np.array([*rng.exponential(20, 2), 1.0])
        z = rng.choice(3, p=truth)
        r[z] *= 30
        rows.append((3, r[0], r[1], 1))
    w = di.learn_weights(rows)
    assert w.shape == (di.BUCKETS, 3) and w.sum(axis=1) == pytest.approx(1)
    assert w[3, 0] > w[3, 1] > w[3, 2] > 0 and w[0, 0] == 0
    assert di.learn_weights([])[5] == pytest.approx([0, 0.9, 0.1])


def test_one_word_texts_share_less_than_all_probability(table):
    words = ["a", "b", "c", "d", "new"]
    rows = [(i, f"{words[i % 4]} {words[i * 3 % 4]} b a") for i in range(40)] + [(100 + j, w) for j, w in enumerate(words)] + [(200, "a")]
    got = {r.doc_id: r.score for r in di.score(table(rows), F.col("doc_id") < 100).collect()}
    assert got[200] == pytest.approx(got[100])
    assert 0 < sum(10 ** got[100 + j] for j in range(5)) < 1 and got[104] < min(got[100 + j] for j in range(4))


def test_keys_survive_packing():
    rng = np.random.default_rng(5)
    for keys in ([], [7], [0, 2**64 - 1], rng.integers(0, 2**63, 1000)):
        keys = np.unique(np.array(keys, np.uint64))
        data = di._sorted_keys_out(keys) if len(keys) else b"\x01"
        assert (di._sorted_keys_in(data) == keys).all()


def test_null_ids_repeated_rows_no_learning_and_empty_table(table):
    df = table([(1, "a b"), (1, "a b"), (None, "a c"), (2, None)])
    got = di.score(df, F.col("doc_id") == 1).collect()
    assert len(got) == 4 and {r.train_tokens for r in got} == {6}
    none = di.score(df, F.lit(False)).collect()
    assert {(r.base_score, r.score, r.n_known) for r in none} == {(0.0, 0.0, 0)}
    assert di.score(table([]), F.lit(True)).count() == 0


def test_held_out_texts_score_better_than_the_base(spark, sf_dir):
    got = op1_deleted_interpolation(spark, sf_dir).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.95 * got[1]
