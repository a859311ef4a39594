import math
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from conftest_llm import ODD_TEXTS
from pyspark.sql import functions as F

from evitrust.llm import language_id as li
from evitrust.llm.queries import op4_language_id

ROWS = [(i, t, lang, "s", 1) for i, (t, lang) in enumerate(
    [("the cat sat on the mat, and the dog ran", "en"), ("a bird is in the tree with the owl", "en"),
     ("die Katze ist auf dem Dach und schläft", "de"), ("der Hund läuft durch die Straße nach Haus", "de")] * 10)]


def brute_model(rows, order):
    """Interpolated Kneser-Ney over words with plain dictionaries; gives log2 p of a word."""
    raw = [Counter() for _ in range(order + 1)]
    for text, times in rows.items():
        for word in text.split():
            word = "".join(c for c in word if c.isalpha()).lower()
            if word:
                s = "\n" + word + "\n"
                for i in range(1, len(s)):
                    for n in range(1, min(order, i + 1) + 1):
                        raw[n][s[i - n + 1:i + 1]] += times
    eff = [Counter() for _ in range(order + 1)]
    for n in range(1, order + 1):
        for g, c in raw[n].items():
            initial = n > 1 and g[0] == "\n"
            eff[n][g] = c if n == order or initial else sum(1 for h in raw[n + 1] if h[1:] == g)

    def p(g, alphabet):
        if not g:
            return 1 / (alphabet + 1)
        n = len(g)
        once, twice = (sum(c == k for c in eff[n].values()) for k in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.5
        same = {h: c for h, c in eff[n].items() if h[:-1] == g[:-1]}
        lower = p(g[1:], alphabet)
        if not same:
            return lower
        total = sum(same.values())
        return max(same.get(g, 0) - d, 0) / total + d * len(same) / total * lower
    return p, {g for g in raw[1]}


def test_matches_brute_force_model(spark, table):
    docs = table(ROWS)
    order = 3
    model = li.train(docs, F.lit(True), order=order, train_docs=10**6)
    used = docs.where(F.pmod(F.xxhash64(F.xxhash64("doc_id", F.lit("language"))), F.lit(li.CALIBRATION_SHARE)) > 0).collect()
    by_lang = defaultdict(Counter)
    for r in used:
        by_lang[r.lang][r.text] += 1
    brute = {k: brute_model(v, order) for k, v in by_lang.items()}
    alphabet = len(set.union(*(a for _, a in brute.values())))
    for text in ("the zebra ran", "Straße", "qx", "ein Hund, the dog!"):
        bits, symbols = model.score(pa.array([text]))
        for j, lang in enumerate(model.languages):
            want = n = 0
            for word in text.split():
                s = "\n" + "".join(c for c in word if c.isalpha()).lower() + "\n"
                for i in range(1, len(s)):
                    want -= math.log2(brute[lang][0](s[max(0, i - order + 1):i + 1], alphabet))
                    n += 1
            assert bits[0, j] == pytest.approx(want, rel=1e-4), (text, lang)
            assert symbols[0] == n


def test_odd_texts_and_folds(table):
    rows = ROWS + [(100 + i, t, None if i % 2 else "xx", "s", None) for i, t in enumerate(ODD_TEXTS)]
    docs = table(rows, extra=["score", "rejected", "symbols"])
    model = li.train(docs, F.col("doc_id") < 100)
    assert model.languages == ["de", "en"]
    got = {r.doc_id: r for r in li.predict(docs, model).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(ODD_TEXTS):
        r = got[100 + i]
        if not t or not any(c.isalpha() for c in t):
            assert (r.lang_pred, r.score, r.rejected, r.cross_entropy) == ("und", 0.0, True, None)
        else:
            assert r.lang_pred in ("de", "en") and 0 <= r.score <= 1
    assert all(got[r[0]].lang_pred == r[2] and not got[r[0]].rejected for r in ROWS)


def test_far_texts_are_rejected(documents):
    model = li.train(documents, F.lit(True))
    odd = documents.limit(20).select("doc_id", F.expr("repeat('zqxj wvkq ', 50)").alias("text"))
    assert {r.rejected for r in li.predict(odd, model).collect()} == {True}


def test_empty_tables(table):
    assert li.train(table([]), F.lit(True)) is None
    assert {r.lang_pred for r in li.predict(table(["some words"]), None).collect()} == {"und"}
    model = li.train(table(ROWS), F.lit(True))
    assert li.predict(table([]), model).count() == 0


def test_held_out_accuracy(spark, sf_dir, documents):
    got = op4_language_id(spark, sf_dir).join(documents, "doc_id").where("held_out").collect()
    right = sum(r.lang == r.lang_pred for r in got)
    assert right >= 0.97 * len(got) and sum(r.rejected for r in got) <= 0.01 * len(got)
