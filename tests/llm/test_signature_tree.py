import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import ODD_TEXTS

from evitrust.llm import graphs, signature_tree as tree


def brute_set(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, percent=75):
    sets = {i: brute_set(t) for i, t in rows}
    name = {i: i for i in sets}
    ids = sorted(sets)
    link = {i: [] for i in ids}
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                link[a].append(b)
                link[b].append(a)
    for i in ids:
        todo = [i]
        while todo:
            for j in link[todo.pop()]:
                if name[j] > name[i]:
                    name[j] = name[i]
                    todo.append(j)
    return [(i, len(sets[i]), name[i]) for i, _ in rows]


def near_copies(seed, bases, copies, words=60, edits=6):
    rnd = random.Random(seed)
    passage = " ".join(f"P{i}" for i in range(25))
    out = []
    for b in range(bases):
        base = [f"b{b}w{rnd.randrange(10**6)}" for _ in range(words)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rnd.randrange(edits)):
                text[rnd.randrange(words)] = f"e{rnd.randrange(10**6)}"
            if rnd.random() < 0.3:
                text.append(passage)
            out.append(" ".join(text).title() if rnd.random() < 0.1 else " ".join(text))
    rnd.shuffle(out)
    return out


def found(df, **more):
    return sorted(map(tuple, tree.similar_documents(df, **more).collect()), key=str)


@pytest.mark.parametrize("wide", [64, 3])
def test_components_match_brute_force(table, monkeypatch, wide):
    monkeypatch.setattr(tree, "WIDE", wide)
    monkeypatch.setattr(tree, "FANOUT", 2)
    rows = [*enumerate(ODD_TEXTS + ODD_TEXTS[3:] + near_copies(7, 8, 14) + near_copies(8, 1, 60, edits=12) + ["One two", "one TWO", "one two three"])]
    assert found(table(rows, extra=["n", "cls", "a", "token"])) == sorted(brute(rows), key=str)


def test_documents_match_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert found(documents) == sorted(brute(rows), key=str)


def test_other_threshold(table):
    rows = [*enumerate(near_copies(9, 4, 10))]
    assert found(table(rows), percent=50) == sorted(brute(rows, 50), key=str)


def test_null_ids_repeated_rows_and_empty_table(table):
    text = "one two three four five six seven"
    got = found(table([(5, text), (5, text), (None, text), (3, text + " eight"), (None, None), (9, "")]))
    assert got == sorted([(5, 3, 3), (5, 3, 3), (None, 3, 3), (3, 4, 3), (None, 0, None), (9, 0, 9)], key=str)
    assert found(table([])) == []


def test_tree_prunes_but_loses_nothing():
    rng = np.random.default_rng(1)
    m = 700
    n = rng.integers(20, 2000, m)
    bits = rng.integers(0, 2**63, (m, 4)).astype(np.uint64) & rng.integers(0, 2**63, (m, 4)).astype(np.uint64)
    lost = rng.integers(0, 3, m)
    t = tree.Tree(n, bits, lost)
    kept = set(zip(*(x.tolist() for x in t.leaf_pairs(75))))
    leaves = len(t.levels[0][1])
    assert len(kept) < leaves * (leaves + 1) // 2
    place = np.empty(m, int)
    place[t.order] = np.arange(m) // tree.WIDE
    i, j = np.triu_indices(m, 1)
    may = tree.possible(bits[i], bits[j], n[i], n[j], n[i], n[j], np.minimum(lost[i], lost[j]), 75)
    for a, b in zip(place[i[may]], place[j[may]]):
        assert (min(a, b), max(a, b)) in kept


def test_sets_of_short_texts():
    keys, cut = tree.token_sets(pa.array(["", "a b", "A  b", "a b c d e", "a b c d e f a b c d e", "b a"]))
    assert np.diff(cut).tolist() == [0, 1, 1, 1, 6, 1]
    assert keys[cut[1]] == keys[cut[2]] != keys[cut[5]]


def test_components_of_long_paths(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 201), (201, 200), (7, 7)]
    rnd.shuffle(edges)
    got = {r.node: r.component for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(50)}, 200: 200, 201: 200}
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0
