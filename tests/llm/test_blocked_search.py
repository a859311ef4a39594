import math
import re
from collections import Counter

import numpy as np
import pytest
from conftest_llm import ODD_TEXTS

from evitrust.llm import blocked_search as bs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def expected(docs, items, k=10):
    found = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_all = sum(bool(c) for _, c in found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        rows = []
        for i, c in found:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_all if n_all else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in set(terms(text)) if c[t])
            if score > 0:
                rows.append((-score, -1 if i is None else i))
        out += [(item, r, i if i >= 0 else None, -s) for r, (s, i) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=str)


def got(spark, table, docs, items, **options):
    query = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, score long")
    return sorted(map(tuple, bs.search(table(docs, extra=["id", "n", "score", "item_id"]), query, **options).collect()), key=str)


def drawn(n, seed=5, words=60):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, int(rng.integers(1, 40))) % words) for _ in range(n)]


@pytest.mark.parametrize("block,slab,sample", [(32, 1_000_000, 32), (2, 150, 3), (1, 1, 1)])
def test_search_matches_brute_force(spark, table, monkeypatch, block, slab, sample):
    monkeypatch.setattr(bs, "BLOCK_DOCS", block)
    monkeypatch.setattr(bs, "SLAB_POSTINGS", slab)
    monkeypatch.setattr(bs, "SAMPLE", sample)
    texts = ODD_TEXTS + drawn(150) + ["w1 w2 w3"] * 15 + ["w4 " * 3000]
    docs = [*enumerate(texts), (7, "w1 w5"), (7, "w1 w5"), (None, "w1 w9"), (None, None)]
    items = [*enumerate(drawn(12, 6) + ["W1 w2-W3", "naïve CAFÉ テキスト", "", None, "nowhere"])] + [(3, "w1"), (None, "w2")]
    assert got(spark, table, docs, items) == expected(docs, items)


def test_queries_in_groups_and_other_k(spark, table, monkeypatch):
    monkeypatch.setattr(bs, "QUERY_BYTES", 60)
    docs, items = [*enumerate(drawn(60))], [*enumerate(drawn(6, 8))]
    assert got(spark, table, docs, items, k=3) == expected(docs, items, 3)


def test_nothing_to_search(spark, table):
    assert got(spark, table, [], [(1, "a")]) == []
    assert got(spark, table, [(1, "a")], []) == []
    assert got(spark, table, [(1, "..."), (2, None)], [(1, "a"), (2, None)]) == []


def test_blocks_are_skipped(spark, documents):
    """Bounds leave most blocks of the lists that are visited unread."""
    import os
    items = spark.read.parquet(os.path.join(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"), "benchmark.parquet"))
    seen = bs.search(documents, items, report=True).groupBy().sum().first()
    assert 0 < seen[1] < seen[0]


def test_summaries_bound_every_document():
    rng = np.random.default_rng(2)
    lengths = rng.integers(0, 9, 80)
    terms_ = np.concatenate([rng.permutation(12)[:n] for n in lengths])
    slab = bs.Slab(lengths, terms_, rng.integers(1, 99, lengths.sum()), 12)
    cells = slab.dense(np.arange(80), np.arange(12), 12)
    assert (slab.most == cells.max(axis=0)).all()
    order, begin = bs.blocks(cells, 3)
    assert sorted(order) == list(range(80)) and np.diff(np.r_[begin, 80]).max() <= bs.BLOCK_DOCS
    for a, b in zip(begin, np.r_[begin[1:], 80]):
        assert (cells[order[a:b]] <= np.maximum.reduceat(cells[order], begin, axis=0)[begin == a]).all()
