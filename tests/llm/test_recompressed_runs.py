import hashlib
import re
from fractions import Fraction
from zlib import crc32

import numpy as np
import pytest
from conftest_llm import ODD_TEXTS
from pyspark.sql import functions as F

from evitrust.llm import queries, recompressed_runs as rr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, min_words=24, repeats=3):
    out, seen = [], {}
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            n = j + q - i
            if n >= max(min_words, repeats * q) and (i, n) not in seen:
                seen[i, n] = q
                out.append((i, n, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def drawn(rng):
    """Words of a small alphabet with periodic stretches in them."""
    parts = []
    for _ in range(rng.integers(1, 5)):
        parts += [*rng.integers(0, rng.integers(1, 5), rng.integers(0, 30))]
        unit = [*rng.integers(0, 4, rng.integers(1, 14))]
        parts += (unit * 40)[:int(rng.integers(0, 90))]
    return [f"w{x}" for x in parts]


@pytest.mark.parametrize("min_words,repeats", [(24, 3), (2, 2), (6, 4)])
def test_runs_match_brute_force(min_words, repeats):
    rng = np.random.default_rng(3)
    texts = [drawn(rng) for _ in range(150)] + [["a"] * 500, [], ["a"], ["a", "b"] * 200, [f"x{i}" for i in range(400)]]
    codes = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
    got = rr.runs_of(np.array([codes[w] for t in texts for w in t]), np.array([len(t) for t in texts]), min_words, repeats)
    want = [(k, *r) for k, t in enumerate(texts) for r in brute_runs(t, min_words, repeats)]
    assert [tuple(map(int, r)) for r in got] == want and len(want) > 50


def test_extensions_match_plain_comparison():
    rng = np.random.default_rng(4)
    for _ in range(60):
        body = np.tile(rng.integers(0, 3, rng.integers(1, 20)), 30)[:int(rng.integers(2, 120))]
        body[rng.integers(0, len(body), 3)] = 1
        s = np.r_[97, body, 98]
        g = rr.Grammar(s)
        a, b = np.triu_indices(len(s), 1)
        for way in (1, -1):
            want = []
            for i, j in zip(a, b):
                n = 0
                while 0 <= i + way * n and j + way * n < len(s) and 0 <= j + way * n and s[i + way * n] == s[j + way * n]:
                    n += 1
                want.append(n)
            assert g.extend(a, b, way).tolist() == want


def test_levels_expand_to_the_text():
    s = np.r_[5, np.tile([0, 1, 1, 2], 50), 6]
    g = rr.Grammar(s)
    for at, first in enumerate(g.first):
        upper = g.symbols[at + 1]
        rules = {}
        for k in range(len(upper)):
            assert rules.setdefault(upper[k], tuple(g.symbols[at][first[k]:first[k + 1]])) == tuple(g.symbols[at][first[k]:first[k + 1]])
        assert len(set(rules.values())) == len(rules)


def test_collapse(spark, table, monkeypatch):
    monkeypatch.setattr(rr, "PLACES", 7)
    rng = np.random.default_rng(5)
    texts = ODD_TEXTS + [" ".join(drawn(rng)) for _ in range(40)] + ["la  la\n" * 30, "x " * 20000, "a b c\t" * 9]
    got = {r.doc_id: r for r in rr.collapse_runs(table(texts, extra=["runs", "collapsed", "n_words", "__text"])).collect()}
    for i, t in enumerate(texts):
        words = WORD.findall(t or "")
        runs = brute_runs(words) if len(words) < 5000 else [(0, len(words), 1)]
        assert [tuple(r) for r in got[i].runs] == runs and got[i].n_words == len(words)
        assert got[i].collapsed == brute_collapse(words, runs)
    assert rr.collapse_runs(table([])).count() == 0
    twice = rr.collapse_runs(table([(1, "a " * 30), (1, "a " * 30), (None, "a")]), columns=True)
    assert sorted((r.doc_id or -1, r.collapsed, r.lang) for r in twice.collect()) == [(-1, "a", "en"), (1, "a", "en"), (1, "a", "en")]


def expected_row(i, text):
    words = WORD.findall(text or "")
    h, n = crc32(str(i).encode()) if i is not None else 1, len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
    runs = brute_runs(words)
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (i, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
            sha("".join(f"{s},{l},{q}\n" for s, l, q in runs)), sha(brute_collapse(words, runs)))


def test_query_digests_match_brute_force(spark, tmp_path, table):
    rng = np.random.default_rng(6)
    texts = ODD_TEXTS + [" ".join(drawn(rng)) for _ in range(60)] + [" ".join(f"u{int(x)}" for x in rng.integers(0, 300, 200)) for _ in range(60)]
    rows = [*enumerate(texts), (None, "b " * 40)]
    table(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_recompressed_runs(spark, str(tmp_path)).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted((expected_row(*r) for r in rows), key=str)
    assert sum(r.n_runs > 0 for r in got) > 20
