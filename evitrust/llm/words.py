"""Vectorized words and lines of Arrow text batches, used inside Spark tasks.

A word is a run of anything but space, tab, LF, VT, FF and CR. Null text is the empty text. All functions work on
whole texts; a batch is cut by bytes, so its memory is bounded by ``SLICE_BYTES`` and the longest single text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

SLICE_BYTES = 4 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of text, with null text made empty and typed as string."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(text)
        column = batch.column(at)
        column = pc.fill_null(column if pa.types.is_string(column.type) else column.cast(pa.string()), "")
        batch = batch.set_column(at, text, column)
        ends = np.cumsum(np.asarray(pc.binary_length(column), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        pa.default_memory_pool().release_unused()


def _split(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    owner = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
    return lists.flatten(), owner


def words_of(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words in order, and for each the index of its text. ``lower`` maps A-Z only."""
    flat, owner = _split(pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts))
    real = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(real), owner[np.asarray(real)]


def lines_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All ``\\n``-separated lines in order, and for each the index of its text."""
    return _split(pc.split_pattern(texts, "\n"))


def count_bytes(texts: pa.Array, wanted: bytes) -> np.ndarray:
    """How many of some ASCII characters each text holds."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    hit = np.zeros(256, bool)
    hit[list(wanted)] = True
    upto = np.concatenate([np.zeros(1, np.int32), np.cumsum(hit[data], dtype=np.int32)])
    at = offsets - offsets[0]
    return (upto[at[1:]] - upto[at[:-1]]).astype(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_strings(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of every string; each distinct string is hashed once."""
    if not len(values):
        return np.empty(0, np.uint64)
    coded = values.dictionary_encode()
    table = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)
    return mix(table.astype(np.uint64))[np.asarray(coded.indices)]


def shingles(hashes: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each window of k words inside one text, and the position of its first word."""
    if len(hashes) < k:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    last = len(hashes) - k + 1
    out = hashes[:last].copy()
    for j in range(1, k):
        out *= ODD
        out += hashes[j:last + j]
    at = np.flatnonzero(owner[:last] == owner[k - 1:])
    return mix(out[at]), at


def starts(owner: np.ndarray, n: int) -> np.ndarray:
    """n + 1 offsets of a sorted owner array."""
    return np.searchsorted(owner, np.arange(n + 1))


def judged(docs: DataFrame, judge: Callable[[pa.Array], list[pa.Array]], fields: str, id_col: str, text_col: str,
           columns: bool) -> DataFrame:
    """Each row with the verdict of its whole text: ``judge`` gets texts (null as empty) and gives one array a field.

    Without ``columns`` only the id stands before the verdict, else all columns but those that a field replaces.
    """
    verdict = T._parse_datatype_string(fields)
    keep = [c for c in docs.columns if c not in verdict.names] if columns else [id_col]
    rows = docs.select(*keep, F.coalesce(text_col, F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            found = judge(batch.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *found], [*keep, *verdict.names])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *verdict.fields]))
