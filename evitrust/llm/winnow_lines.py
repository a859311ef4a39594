"""Removal of repeated runs of lines, found by winnowing over line hashes.

Lines without a word do not count and always stay. A window starts at a line and takes lines until it holds
``min_words`` words. The smallest line hash of each window is a fingerprint, so any run of that many words that stands
in two places shares a fingerprint. Only windows whose fingerprint line stands in two places are looked up; each is
held against the first place with the same window, in order of (id, hash of text, line), and the match is extended
both ways. The lines of all matched runs but the first are deleted.

With ``every_place`` a run counts as repeated if it stands anywhere before, not only where its window stood first: then
there are also windows that end at a line and take lines backwards. A line in a repeated run is in a window from its
start that is repeated with it, or, behind that, at the end of a backward window that is; so the first place of each
window decides, with nothing to extend.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from evitrust.llm.storage import written
from evitrust.llm.words import ODD, hash_strings, lines_of, mix, slices, words_of

MIN_WORDS = 50
PLACE = "hash long, fingerprint long, at int, first int, last int"
WINDOW = PLACE + ", before array<long>, after array<long>"


def _lists(values: np.ndarray, begin: np.ndarray, count: np.ndarray, step: int) -> pa.Array:
    """One list for each row: ``count`` values from ``begin`` on, forwards or backwards."""
    ends = np.concatenate([[0], np.cumsum(count)])
    inner = np.arange(ends[-1]) - np.repeat(ends[:-1], count)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values[np.repeat(begin, count) + step * inner]))


def _counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and hash of each line with a word, and the number of words before each line and behind the last."""
    lines, owner = lines_of(texts)
    _, of = words_of(lines)
    n_words = np.bincount(of, minlength=len(lines))
    real = np.flatnonzero(n_words)
    return owner[real], hash_strings(lines.take(pa.array(real))), np.concatenate([[0], np.cumsum(n_words[real])])


def _forward(upto: np.ndarray, stop: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of the windows that start at a line."""
    last = np.searchsorted(upto[1:], upto[:-1] + min_words)   # where the window from each line is full
    s = np.flatnonzero(last < stop)
    return s, last[s]


def _hashes(h: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of all lines of each window, the smallest line hash and where it stands."""
    n = len(h)
    small, at = np.full(len(s), np.uint64(2**64 - 1)), s.copy()
    for k in range(int((e - s).max(initial=-1)) + 1):         # at most min_words steps
        here = np.minimum(s + k, e)
        less = h[here] <= small
        small, at = np.where(less, h[here], small), np.where(less, here, at)
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, ODD)]))
        back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(pow(int(ODD), -1, 2**64)))]))
        sums = np.concatenate([[np.uint64(0)], np.add.accumulate(h * power[:n])])
        whole = mix((sums[e + 1] - sums[s]) * back[s] ^ mix((e - s + 1).astype(np.uint64)))
    return whole, small, at


def places_of(texts: pa.Array, min_words: int) -> tuple[pa.StructArray, np.ndarray]:
    """The windows of each text that start at a line or end at one, each once, and the text they are in."""
    owner, h, upto = _counted(texts)
    begin, stop = np.searchsorted(owner, owner), np.searchsorted(owner, owner, side="right")
    s, e = _forward(upto, stop, min_words)
    first = np.searchsorted(upto, upto[1:] - min_words, side="right") - 1  # where the window to each line is full
    ends = np.flatnonzero(first >= begin)
    n = len(h) + 1
    s, e = np.divmod(np.unique(np.concatenate([s * n + e, first[ends] * n + ends])), n)
    whole, small, at = _hashes(h, s, e)
    columns = [whole.view(np.int64), small.view(np.int64), *((x - begin[s]).astype(np.int32) for x in (at, s, e))]
    return pa.StructArray.from_arrays([*map(pa.array, columns)], ["hash", "fingerprint", "at", "first", "last"]), owner[s]


def windows_of(texts: pa.Array, min_words: int) -> tuple[pa.StructArray, np.ndarray]:
    """The windows of each text and the text they are in; ``before`` and ``after`` are the hashes of the lines beside
    a window, nearest first, as long as they hold fewer than ``min_words`` words."""
    owner, h, upto = _counted(texts)
    begin = np.searchsorted(owner, owner)                     # first line of the own text
    stop = np.searchsorted(owner, owner, side="right")        # line behind its last one
    s, e = _forward(upto, stop, min_words)
    whole, small, at = _hashes(h, s, e)
    right = np.minimum(np.searchsorted(upto[1:], upto[e + 1] + min_words), stop[s]) - e - 1
    left = s - np.maximum(np.searchsorted(upto, upto[s] - min_words, side="right"), begin[s])
    base = begin[s]
    columns = [whole.view(np.int64), small.view(np.int64), *((x - base).astype(np.int32) for x in (at, s, e))]
    signed = h.view(np.int64)
    out = pa.StructArray.from_arrays(
        [*map(pa.array, columns), _lists(signed, s - 1, left, -1), _lists(signed, e + 1, right, 1)],
        ["hash", "fingerprint", "at", "first", "last", "before", "after"])
    return out, owner[s]


def _same_start(a: str, b: str) -> Column:
    """How many elements two arrays share from their start on."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> coalesce(x = y, false)), 0, "
                  "(n, same) -> if(n < 0, n, if(same, n + 1, -n - 1)), n -> if(n < 0, -n - 1, n))")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text",
                  every_place: bool = False) -> DataFrame:
    """Rows (id, text_hash, runs array<struct<first, last>>) of texts with runs to delete.

    first and last number the lines with a word from 0 within the text. Rows with one id and one text count as the same
    text. Every window meets only the first window of its kind, so the rows grow with the input however often a passage
    repeats; the first places are found by a minimum with map-side combining.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            found, owner = (places_of if every_place else windows_of)(batch.column(2), min_words)
            if len(owner):
                rows = pa.array(owner)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *found.flatten()],
                                                 ["id", "text_hash", *(f.name for f in found.type)])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias(text_col))
    windows = written(rows.mapInArrow(run, f"id {rows.schema[0].dataType.simpleString()}, text_hash long, "
                                     + (PLACE if every_place else WINDOW)))
    place = F.struct("id", "text_hash", "at")
    twice = (windows.groupBy("fingerprint").agg(F.min(place).alias("_a"), F.max(place).alias("_b"))
             .where(~F.col("_a").eqNullSafe(F.col("_b"))).select("fingerprint"))
    left = windows.join(twice, "fingerprint", "left_semi")
    here = F.struct("id", "text_hash", "first")
    beside = [] if every_place else ["before", "after"]
    firsts = (left.groupBy("hash").agg(F.min(F.struct("id", "text_hash", "first", *beside)).alias("_f"),
                                       F.max(here).alias("_last"))
              .where(~F.struct("_f.id", "_f.text_hash", "_f.first").eqNullSafe(F.col("_last"))).drop("_last"))
    later = left.join(firsts, "hash").where(~here.eqNullSafe(F.struct("_f.id", "_f.text_hash", "_f.first")))
    runs = later.select("id", "text_hash", "first", "last") if every_place else later.select(
        "id", "text_hash", (F.col("first") - _same_start("before", "_f.before")).alias("first"),
        (F.col("last") + _same_start("after", "_f.after")).alias("last"))
    return runs.groupBy("id", "text_hash").agg(F.collect_set(F.struct("first", "last")).alias("runs"))


def _delete(text: str, runs) -> tuple[str, int, int]:
    lines = text.split("\n")
    real = [i for i, x in enumerate(lines) if x.strip(" \t\n\v\f\r")]
    gone = np.zeros(len(real) + 1, np.int64)
    for r in runs:
        gone[r["first"]] += 1
        gone[r["last"] + 1] -= 1
    out = {real[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] > 0)}
    return "\n".join(x for i, x in enumerate(lines) if i not in out), len(lines), len(out)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text",
                every_place: bool = False) -> DataFrame:
    """All rows and columns, the text without later repeated runs, and n_lines and n_deleted (of the text before).

    Texts without repeats come back unchanged, null as null with no lines; an empty text has one line. Runs may repeat
    within one text. Columns named n_lines, n_deleted, runs, id or text_hash are no obstacle: the first two replace
    columns of the same name, the others are not used. ``every_place`` compares with all places before, see above.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    runs = repeated_runs(docs, min_words, id_col, text_col, every_place).select(
        F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("runs").alias("__runs"))
    joined = docs.select(*keep, F.xxhash64(text_col).alias("__text")).join(
        runs, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__hash")), "left").select(*keep, "__runs")
    at = keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, marks = batch.column(at), batch.column(len(keep))
            n_lines = pc.fill_null(pc.add(pc.cast(pc.count_substring(column, "\n"), pa.int64()), 1), 0).to_pylist()
            deleted = [0] * batch.num_rows
            if marks.null_count < batch.num_rows:
                texts = column.to_pylist()
                for i in np.flatnonzero(np.asarray(marks.is_valid())).tolist():
                    texts[i], _, deleted[i] = _delete(texts[i], marks[i].as_py())
                column = pa.array(texts, batch.schema.field(at).type)
            columns = [column if i == at else batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(n_lines, pa.int64()), pa.array(deleted, pa.int64())],
                                             [*keep, "n_lines", "n_deleted"])

    schema = joined.select(*keep).schema.add("n_lines", "long").add("n_deleted", "long")
    return joined.mapInArrow(run, schema)
