"""Best-fit packing of token pieces by bin completion on the histogram of lengths.

Only the number of pieces of each length matters for a packing, and there are at most ``capacity`` lengths. So the
search runs on that histogram, whose size does not depend on the data, and gives fillings (which lengths share a
sequence) with multiplicities. Spark then numbers the pieces of each length and looks up their slots.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from evitrust.llm.storage import written
from evitrust.llm.words import slices

CAPACITY = 2048
END_ID = 0
NODES = 20_000
NODES_PER_LENGTH = 100
ROWS_PER_SALT = 200_000

Filling = tuple[tuple[int, ...], int]


def read_encoder(path: str):
    """A function from text to token ids (numpy uint32) for a byte-level BPE file of ``tokenizers``.

    If the ids of the file are the merge ranks, as in the public 50k vocabulary, the rank encoder gives the same ids
    several times faster; for any other file the file's own library encodes.
    """
    from tokenizers import Tokenizer

    from evitrust.llm.sentencepiece_bpe import byte_alphabet
    import public_tokenizers
    import tiktoken
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, added = whole["model"], whole.get("added_tokens") or []
    plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in added)
    names = {c: b for b, c in enumerate(byte_alphabet())}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    vocab = {p: i for p, i in model["vocab"].items() if all(c in names for c in p) and i < 256 + len(merged)}
    if plain and len(vocab) == 256 + len(merged) and all(vocab[p] == 256 + i for i, p in enumerate(merged)):
        ranks = {bytes(names[c] for c in p): i for p, i in vocab.items()}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                 special_tokens={t["content"]: t["id"] for t in added})
        return lambda text: fast.encode_to_numpy(text, allowed_special="all")
    slow = Tokenizer.from_file(path)
    return lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
                 id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32[, ids]) of the token ids of each whole text and ``end_id``.

    A document longer than ``capacity`` is cut; its first piece takes the odd rest, all others are full. Null and
    empty texts give one piece of length 1. ids are little-endian unsigned 32-bit. Repeated rows stay.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = read_encoder(tokenizer_path)
        for batch in slices(batches, text_col):
            rows, owner, ids = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                tokens = np.append(encode(text), end_id).astype("<u4")
                n, at = len(tokens), 0
                for piece, stop in enumerate(range(n % capacity or capacity, n + 1, capacity) if n > capacity else [n]):
                    part = tokens[at:stop].tobytes()
                    rows.append((piece, at, stop - at, zlib.crc32(part)))
                    owner.append(i)
                    if keep_ids:
                        ids.append(part)
                    at = stop
            columns = [batch.column(0).take(pa.array(owner)), *(pa.array(c) for c in zip(*rows))]
            columns[1] = columns[1].cast(pa.int32())
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * keep_ids,
                                             [id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)

    rows = docs.select(id_col, text_col)
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, piece int, start long, length long, "
                                "ids_crc32 long" + ", ids binary" * keep_ids)


def best_fit(counts: dict[int, int], capacity: int) -> list[Filling]:
    """Best-fit decreasing on a histogram: the longest pieces first, each where the least room is left that holds it."""
    open_: dict[int, list[list]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in sorted(r for r in open_ if r >= length):
            while left and open_.get(room):
                items, m = open_[room].pop()
                k = min(room // length, max(1, left // m))  # so many pieces of this length in each of them
                used = min(m, left // k)
                if used < m:
                    open_[room].append([items, m - used])
                open_.setdefault(room - k * length, []).append([items + (length,) * k, used])
                left -= k * used
        each = capacity // length
        if left >= each:
            open_.setdefault(capacity - each * length, []).append([(length,) * each, left // each])
        if left % each:
            open_.setdefault(capacity - (left % each) * length, []).append([(length,) * (left % each), 1])
    merged = Counter()
    for groups in open_.values():
        for items, m in groups:
            merged[items] += m
    return [*merged.items()]


def _reach(lengths: list[int], free: list[int], room: int) -> list[int]:
    """For each place i, bits of all sums up to ``room`` that ``free[j]`` pieces of ``lengths[j]`` from i on can have."""
    full, sums = (1 << room + 1) - 1, 1
    out = [1] * (len(lengths) + 1)
    for i in reversed(range(len(lengths))):
        left, step = min(free[i], room // lengths[i]), 1
        while left:
            step = min(step, left)
            sums |= sums << step * lengths[i] & full
            left, step = left - step, 2 * step
        out[i] = sums
    return out


def _dominated(items: tuple[int, ...], lengths: list[int], free: list[int], waste: int) -> bool:
    """True if one free piece can take the place of several, of a smaller one or of part of the room left over."""
    none_or_more, two_or_more, one = 1, 0, 0
    for x in items:
        two_or_more |= two_or_more << x | one << x
        one |= 1 << x
        none_or_more |= none_or_more << x
    reached, width = none_or_more << 1, 1   # sums below the piece, by up to ``waste``
    while width < waste:
        more = min(width, waste - width)
        reached |= reached << more
        width += more
    reached = two_or_more | (reached if waste else 0)
    used = Counter(items)
    return any(reached >> x & 1 and n > used[x] for x, n in zip(lengths, free))


def completions(first: int, counts: dict[int, int], capacity: int, most_waste: int, spend: Callable[[], bool],
                only_first: bool = False) -> Iterator[tuple[tuple[int, ...], bool]]:
    """All undominated fillings around a piece of length ``first``, least waste first, and if one dominates all others.

    A single perfect partner, or no room, is such a filling and ends the enumeration. Otherwise every filling is given
    that wastes at most ``most_waste`` and that no exchange of some pieces for one free piece improves. Sums that the
    pieces can have are known beforehand, so no branch is a dead end. The first one given is never dominated: none
    wastes less, and it takes the longest pieces.
    """
    room = capacity - first

    def free_of(length: int) -> int:
        return counts.get(length, 0) - (length == first)

    if not room or free_of(room) > 0:
        yield (first, room) if room else (first,), True
        return
    lengths = sorted((x for x in counts if x <= room and free_of(x) > 0), reverse=True)
    free = [free_of(x) for x in lengths]
    reach = _reach(lengths, free, room)

    def fill(at: int, rest: int) -> Iterator[tuple[int, ...]]:
        if not rest:
            yield ()
            return
        for i in range(at, len(lengths)):
            if not reach[i] >> rest & 1:
                return
            for k in range(min(free[i], rest // lengths[i]), 0, -1):
                if reach[i + 1] >> rest - k * lengths[i] & 1:
                    if not spend():
                        return
                    for tail in fill(i + 1, rest - k * lengths[i]):
                        yield (lengths[i],) * k + tail

    for waste in range(min(room, most_waste) + 1):
        if reach[0] >> room - waste & 1:
            for items in fill(0, room - waste):
                if only_first or not _dominated(items, lengths, free, waste):
                    yield (first, *items), False
                    if only_first:
                        return


def search(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES,
           nodes_per_length: int = NODES_PER_LENGTH) -> tuple[list[Filling], bool]:
    """Fillings with multiplicities that hold every piece once, and whether they are proved to be the fewest.

    Best-fit decreasing is the first incumbent. The search ends at ceil(tokens / capacity) or the number of pieces over
    half the capacity. Otherwise every undominated filling around the longest piece left is tried, least waste first, at
    every multiplicity from the largest to 1; a filling that was passed over does not come back for the same longest
    piece. A branch is cut when its waste exceeds what a better packing than the incumbent may waste.

    The first way down is free of any budget. After it, ``nodes`` and ``nodes_per_length`` for each distinct length
    bound the steps of search and enumeration; what they find is then the incumbent, always a complete packing.
    """
    counts = {k: n for k, n in counts.items() if n}
    total = sum(k * n for k, n in counts.items())
    incumbent = best_fit(counts, capacity)
    size = sum(m for _, m in incumbent)
    bound = max(-(-total // capacity), sum(n for k, n in counts.items() if 2 * k > capacity))
    budget = nodes + nodes_per_length * len(counts)
    down = True      # still on the first way down

    def spend() -> bool:
        nonlocal budget
        budget -= not down
        return budget > 0

    def children(left: dict[int, int], used: int, waste: int, barred: frozenset) -> Iterator[tuple]:
        """(step, pieces left, sequences, waste, barred fillings) of each choice for the longest piece."""
        first = max(left)

        def spare() -> int:
            return (size - 1) * capacity - total - waste

        def ways() -> Iterator[tuple[tuple[int, ...], bool]]:
            head = None
            if not barred:   # the first one without keeping the tables of the others
                head = next(completions(first, left, capacity, spare(), spend, True), None)
                if head is None:
                    return
                yield head
                if head[1]:
                    return
            yield from (w for w in completions(first, left, capacity, spare(), spend) if w != head)

        passed = barred
        for items, alone in ways():
            if items in passed:
                continue
            passed = passed | {items}
            need = Counter(items)
            lost, most = capacity - sum(items), min(left[x] // k for x, k in need.items())
            for m in range(most, most - 1 if alone else 0, -1):
                if m * lost > spare():
                    continue
                if not spend():
                    return
                after = dict(left)
                for x, k in need.items():
                    after[x] -= k * m
                    if not after[x]:
                        del after[x]
                yield (items, m), after, used + m, waste + m * lost, passed if first in after else frozenset()

    if size > bound:
        stack, chosen = [children(counts, 0, 0, frozenset())], []
        while stack and size > bound and budget > 0:
            found = next(stack[-1], None)
            if found is None:
                down = False
                stack.pop()
                if chosen:
                    chosen.pop()
                continue
            step, left, used, waste, barred = found
            if left:
                chosen.append(step)
                stack.append(children(left, used, waste, barred))
            else:
                down = False
                if used < size:
                    incumbent, size = chosen + [step], used
    return incumbent, size <= bound or budget > 0


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[Filling]:
    """The fillings of ``search``."""
    return search(counts, capacity, nodes)[0]


def slot_rows(fillings: list[Filling]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank behind, first sequence, pieces of that length a sequence, first offset)."""
    out, upto, sequence = [], Counter(), 0
    for items, m in fillings:
        offset = 0
        for length, k in sorted(Counter(items).items(), reverse=True):
            out.append((length, upto[length], upto[length] + k * m, sequence, k, offset))
            upto[length] += k * m
            offset += k * length
        sequence += m
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES, order: tuple[str, ...] = ("doc_id", "piece"),
         rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """The pieces with sequence_id and offset; sequences hold at most ``capacity`` tokens, gapless from offset 0.

    Needs a column ``length`` of 1 to ``capacity`` and reads ``pieces`` twice, so give it a written table. Pieces of one
    length are numbered in salted groups, whose sizes are summed up before, so a length that a third of the pieces
    share is no hot task. The slots (a few rows for each length) are the only broadcast. An empty table gives an empty
    result; pieces longer than the capacity raise.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    if histogram and not 1 <= min(histogram) <= max(histogram) <= capacity:
        raise ValueError(f"lengths must be 1 to {capacity}")
    slots = spark.createDataFrame(
        slot_rows(bin_completion(histogram, capacity, nodes)),
        "_length long, _from long, _to long, _sequence long, _each long, _at long")
    salts = 16 + sum(histogram.values()) // rows_per_salt
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    sizes = salted.groupBy("length", "_salt").count().withColumn(
        "_before", F.sum("count").over(Window.partitionBy("length").orderBy("_salt")) - F.col("count")).drop("count")
    numbered = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1)
    ranked = numbered.join(sizes, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    here = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    nth = F.col("_rank") - F.col("_from")
    return ranked.join(F.broadcast(slots), here).select(
        *pieces.columns, (F.col("_sequence") + F.floor(nth / F.col("_each"))).alias("sequence_id"),
        (F.col("_at") + nth % F.col("_each") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
                   id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Tokenise, cut and pack whole documents; the pieces are written once to the shared folder."""
    pieces = token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, keep_ids)
    return pack(written(pieces), capacity, order=(id_col, "piece"))
