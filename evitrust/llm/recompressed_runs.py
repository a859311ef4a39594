"""Periodic runs of words, found with a run-length grammar made by recompression.

The words of a slab of texts, with a mark of its own before each text and behind the last, are the lowest level of the
grammar. Levels alternate: block compression turns every maximal row of one symbol into a symbol, pair compression turns
every neighbouring pair of a left and a right symbol into one, where symbols are left or right by a hash. Which symbols
are joined depends on their neighbours only, so equal stretches are parsed alike but at their ends, and the longest common
extension of two places is found by going up while symbols agree, and down again to where they differ, a few steps a level.

A run of period p and length max(min_words, repeats * p) or more agrees with itself p words on at so many places that one
of them stands on a grid of step max(min_words - p, (repeats - 1) * p). The grids of all periods have about n log n places,
of which those with two equal words are extended both ways. Of all periods of one stretch the smallest is its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from evitrust.llm.words import judged, mix, starts, words_of

MIN_WORDS = 24
REPEATS = 3
PLACES = 1 << 20              # grid places that are looked at together


def _named(keys: np.ndarray) -> np.ndarray:
    return pd.factorize(keys)[0].astype(np.int64)


class Grammar:
    """Levels of symbols. ``first[l]`` says where the children on level l of each symbol of level l + 1 begin, and
    ``blocks[l]`` whether these are repeats of one symbol. First and last symbol occur nowhere else."""

    def __init__(self, symbols: np.ndarray):
        self.symbols, self.first, self.parent, self.blocks = [_named(symbols)], [], [], []
        turn = 0
        while len(self.symbols[-1]) > self.symbols[-1].max(initial=-1) + 1:   # until no symbol occurs twice
            turn += 1
            s = self.symbols[-1]
            if turn % 2:
                begin = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
                size = np.diff(np.r_[begin, len(s)])
                keys = s[begin] * (size.max() + 1) + size
            else:
                left = (mix(np.arange(s.max() + 1, dtype=np.uint64) + np.uint64(turn) * np.uint64(1 << 32)) & np.uint64(1)).astype(bool)[s]
                pair, other = left[:-1] & ~left[1:], ~left[:-1] & left[1:]
                pair = pair if pair.sum() >= other.sum() else other
                begin = np.flatnonzero(np.r_[True, ~pair])
                second = np.minimum(begin + 1, len(s) - 1)
                keys = s[begin] * (s.max() + 2) + np.where(np.r_[pair, False][begin], s[second] + 1, 0)
            if len(begin) == len(s):
                continue
            self.first.append(np.r_[begin, len(s)])
            self.parent.append(np.repeat(np.arange(len(begin)), np.diff(self.first[-1])))
            self.blocks.append(bool(turn % 2))
            self.symbols.append(_named(keys))

    def extend(self, a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
        """How many symbols of the lowest level agree from different places a and b on, forwards (1) or backwards (-1)."""
        begin, a, b = a, a.copy(), b.copy()
        level, live, top = np.full(len(a), len(self.first)), np.arange(len(a)), len(self.first)
        for at in range(top):
            s, first, parent = self.symbols[at], self.first[at], self.parent[at]
            risen = []
            while len(live):
                same = s[a[live]] == s[b[live]]
                level[live[~same]] = at
                live = live[same]
                x, y = a[live], b[live]
                px, py = parent[x], parent[y]
                left = (first[px + 1] - x, first[py + 1] - y) if way > 0 else (x - first[px] + 1, y - first[py] + 1)
                full = (left[0] == first[px + 1] - first[px]) & (left[1] == first[py + 1] - first[py])  # at the edge of both parents
                risen.append(live[full])
                a[live[full]], b[live[full]] = px[full], py[full]
                step = np.minimum(*left)[~full] if self.blocks[at] else 1
                live = live[~full]
                a[live] += way * step
                b[live] += way * step
            live = np.concatenate(risen) if risen else live
        for at in range(int(level.max(initial=0)) - 1, -1, -1):
            here = np.flatnonzero(level > at)
            first, s = self.first[at], self.symbols[at]
            x, y = a[here], b[here]
            cx, cy = (first[x], first[y]) if way > 0 else (first[x + 1] - 1, first[y + 1] - 1)
            step = np.minimum(first[x + 1] - first[x], first[y + 1] - first[y]) if self.blocks[at] else 1
            step = way * step * (s[cx] == s[cy])
            a[here], b[here] = cx + step, cy + step
        return way * (a - begin)


def _grid(n_words: np.ndarray, begin: np.ndarray, min_words: int, repeats: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, periods) of all grids, part by part. n_words: of each text; begin: where its first word stands."""
    most = np.where(n_words >= min_words, n_words // repeats, 0)     # the longest period of each text
    text = np.repeat(np.arange(len(most)), most)
    if not len(text):
        return
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    step = np.maximum(min_words - period, (repeats - 1) * period)
    count = (n_words[text] - 1 - period) // step + 1
    upto = np.r_[0, np.cumsum(count)]
    at = 0
    while at < len(text):
        stop = max(at + 1, int(np.searchsorted(upto, upto[at] + PLACES, side="right")) - 1)
        rows = np.repeat(np.arange(at, stop), count[at:stop])
        number = np.arange(upto[at], upto[stop]) - upto[rows]
        yield begin[text[rows]] + number * step[rows], period[rows]
        at = stop


def runs_of(words: np.ndarray, n_words: np.ndarray, min_words: int = MIN_WORDS, repeats: int = REPEATS) -> np.ndarray:
    """Rows (text, start, length, period) in order of text, start and period. words: codes of the words of all texts."""
    ends = np.cumsum(n_words)
    marks = np.r_[ends - n_words, ends[-1:]]
    symbols = np.insert(words.astype(np.int64), marks, int(words.max(initial=-1)) + 1 + np.arange(len(marks)))
    begin = marks[:-1] + np.arange(len(n_words)) + 1
    found = []
    grammar = None
    for place, period in _grid(n_words, begin, min_words, repeats):
        hit = np.flatnonzero(symbols[place] == symbols[place + period])
        place, period = place[hit], period[hit]
        if len(hit):
            grammar = grammar or Grammar(symbols)
            after = grammar.extend(place, place + period, 1)
            before = grammar.extend(place - 1, place + period - 1, -1)
            length = after + before + period
            good = length >= np.maximum(min_words, repeats * period)
            found.append(np.stack([place - before, length, period], axis=1)[good])
    if not found:
        return np.empty((0, 4), np.int64)
    rows = np.unique(np.concatenate(found), axis=0)                  # by start, length, period
    rows = rows[np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]] if len(rows) else rows
    text = np.searchsorted(begin, rows[:, 0], side="right") - 1
    rows = np.c_[text, rows[:, 0] - begin[text], rows[:, 1:]]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def collapse_runs(docs: DataFrame, min_words: int = MIN_WORDS, repeats: int = REPEATS, id_col: str = "doc_id",
                  text_col: str = "text", columns: bool = False) -> DataFrame:
    """Each row with n_words, runs array<struct<start, length, period>> and collapsed, the text without repeated periods.

    A run is a stretch of words of smallest period q, at least max(min_words, repeats * q) words long, that no neighbour
    extends; start is the number of its first word, from 0. Runs stand in order of start, then period, and may overlap. A
    word behind the first q words of any run is dropped; the others are joined by single spaces. Null and empty texts, and
    texts of spaces, have no words, no runs and an empty collapsed text. Rows are judged one by one, so repeated rows give
    equal results. A text is worked on whole, so the memory of a task grows with the longest text. Other columns are left
    out, or with ``columns`` passed through, but for those the result replaces.
    """
    def judge(texts: pa.Array) -> list[pa.Array]:
        words, owner = words_of(texts)
        coded = words.dictionary_encode()
        edges = starts(owner, len(texts))
        rows = runs_of(np.asarray(coded.indices).astype(np.int64), np.diff(edges), min_words, repeats)
        gone = np.zeros(len(words) + 1, np.int64)
        base = edges[rows[:, 0]] + rows[:, 1]
        np.add.at(gone, base + rows[:, 3], 1)
        np.add.at(gone, base + rows[:, 2], -1)
        keep = np.cumsum(gone)[:-1] == 0
        upto = np.r_[0, np.cumsum(keep)][edges].astype(np.int32)
        kept = pa.ListArray.from_arrays(pa.array(upto), words.filter(pa.array(keep)))
        each = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in (1, 2, 3)], ["start", "length", "period"])
        return [pa.array(np.diff(edges)), pa.ListArray.from_arrays(pa.array(starts(rows[:, 0], len(texts)).astype(np.int32)), each),
                pc.binary_join(kept, " ")]

    return judged(docs, judge, "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string",
                  id_col, text_col, columns)
