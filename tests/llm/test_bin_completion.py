import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest_llm import ODD_TEXTS
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from evitrust.llm import bin_completion as bc

PATH = public_tokenizers.path("byte_bpe_50k.json")
FULL = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*FULL.encode(text or "", add_special_tokens=False).ids, 0]


def fewest(items, capacity):
    best = [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= items[i]}.values():
            rooms[j] -= items[i]
            go(i + 1, rooms)
            rooms[j] += items[i]
        go(i + 1, rooms + [capacity - items[i]])
    items = sorted(items, reverse=True)
    go(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=9), st.integers(30, 45))
def test_search_finds_the_fewest(items, capacity):
    fillings = bc.bin_completion(Counter(items), capacity)
    assert sorted(x for f, m in fillings for x in f * m) == sorted(items)
    assert all(sum(f) <= capacity for f, _ in fillings)
    assert sum(m for _, m in fillings) == fewest(items, capacity)


def test_search_beats_best_fit():
    items = Counter({6: 1, 5: 1, 4: 1, 3: 2, 2: 2, 7: 0})
    assert sum(m for _, m in bc.bin_completion(items, 9)) <= sum(m for _, m in bc.best_fit(items, 9))


def check(rows, texts, capacity):
    pieces, bins = defaultdict(dict), defaultdict(list)
    for r in rows:
        assert r.piece not in pieces[r.doc_id]
        pieces[r.doc_id][r.piece] = r
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids = ids_of(t)
        mine = [pieces[i][k] for k in range(len(pieces[i]))]
        assert [p.start for p in mine] == [sum(p.length for p in mine[:k]) for k in range(len(mine))]
        assert sum(p.length for p in mine) == len(ids)
        assert len(mine) == -(-len(ids) // capacity) and all(p.length == capacity for p in mine[1:])
        for p in mine:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start:p.start + p.length], "<u4").tobytes())
    for places in bins.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= capacity
    return len(bins)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_pack_documents(table, documents, capacity):
    texts = ODD_TEXTS + [r.text for r in documents.limit(80).collect()] + ["same"] * 40 + ["<|endoftext|>"]
    rows = bc.pack_documents(table(texts, extra=["piece", "length", "_rank"]), PATH, capacity).collect()
    n = check(rows, texts, capacity)
    total = sum(r.length for r in rows)
    assert n <= 1.1 * total / capacity + 2
    assert all(np.frombuffer(r.ids, "<u4").size == r.length for r in rows)


def test_salted_ranks_repeated_rows_and_empty_table(spark, table):
    pieces = spark.createDataFrame([(1, 0, 5)] * 300 + [(2, 0, 3)] * 100, "doc_id long, piece int, length long")
    rows = bc.pack(pieces, 8, rows_per_salt=10).collect()
    assert len(rows) == 400 and len({(r.sequence_id, r.offset) for r in rows}) == 400
    assert len({r.sequence_id for r in rows}) == 300
    assert bc.pack_documents(table([]), PATH).count() == 0
    with pytest.raises(ValueError):
        bc.pack(pieces, 4)


def test_no_undominated_filling_is_lost():
    fillings, proved = bc.search(Counter([50, 49, 49, 31, 30, 26, 24, 21, 20]), 100)
    assert proved and sum(m for _, m in fillings) == 3


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=7), st.integers(20, 30))
def test_fillings_match_brute_force(items, capacity):
    counts, first = Counter(items), max(items)
    rest = counts - Counter([first])
    every = {()}
    for x in rest.elements():
        every |= {tuple(sorted((*f, x), reverse=True)) for f in every if sum(f) + x <= capacity - first}

    def better(f):
        """Fillings made from f by one free piece in the place of several pieces, of a smaller one or of room."""
        subsets = {()}
        for x in f:
            subsets |= {(*s, x) for s in subsets}
        return any((sum(s) < x or sum(s) == x and len(s) > 1) and sum(f) - sum(s) + x <= capacity - first
                   for s in subsets for x in rest - Counter(f))
    want = {(first, *f) for f in every if not better(f)}
    got = [*bc.completions(first, counts, capacity, capacity, lambda: True)]
    if got[0][1]:
        assert len(got) == 1 and got[0][0] in want
    else:
        assert len(got) == len(want) and {f for f, _ in got} == want
        assert [sum(f) for f, _ in got] == sorted((sum(f) for f in want), reverse=True)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=5, max_size=10), st.integers(12, 24))
def test_repeated_lengths_are_packed_in_the_fewest(items, capacity):
    fillings, proved = bc.search(Counter(items), capacity)
    assert proved and sum(m for _, m in fillings) == fewest(items, capacity)


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", " <|endoftext|> ", "<|endoftext|", "it's\n<|endoftext|>\n\n"])
def test_added_token_is_read_as_the_library_reads_it(text):
    assert [*bc.read_encoder(PATH)(text), 0] == ids_of(text)
