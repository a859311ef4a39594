"""Exact top-k lexical search over posting lists that are cut into blocks of similar documents.

Documents are tokenised once, into the terms that the queries hold; sums over all of them give the term weights. Slabs of
documents are then searched side by side. In a slab every posting list a query needs is clustered: each document goes to
the nearest of some of its members, by the cosine of their scores in the terms that are asked for together with the
list's, and clusters are cut into blocks. A block keeps the coordinatewise maximum of its documents' scores. A query adds up these maxima over its terms; that is at least the
score of every document of the block, so a block whose sum is below the k-th best score known is skipped, all others are
scored document by document. Lists are visited from the heaviest term on; terms that cannot reach the k-th best score
together need no visit.

The k-th best score of a query among a hashed sample of the documents is a lower bound of that among all. It is given to
all slabs, so a slab returns what can still be among the best, not k documents a query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from evitrust.llm.storage import written
from evitrust.llm.words import slices

BLOCK_DOCS = 8                # documents of a block at most
CENTRES = 128                 # clusters of a part of a posting list at most; larger clusters are cut into blocks
SLAB_POSTINGS = 1_000_000     # postings of the documents that are searched together, about
SAMPLE = 32                   # one document in so many gives the first bounds
QUERY_BYTES = 4 << 20         # text of the queries that go over the documents together
PART_CELLS = 2_000_000        # documents times terms of a part of a posting list

#: Bytes of a term, A-Z lower-cased; all others are spaces.
_KEEP = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)], np.uint8)


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of string texts in order, and for each the index of its text."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = _KEEP[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]]
    plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(data))
    lists = pc.ascii_split_whitespace(plain)
    owner = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(real), owner[np.asarray(real)]


def term_counts(docs: DataFrame, vocabulary: pa.Array, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, n, terms, counts): all terms with repeats, and the counts of those in the vocabulary, by place in it."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            terms, owner = terms_of(batch.column(1))
            coded = terms.dictionary_encode()
            place = np.asarray(pc.fill_null(pc.index_in(coded.dictionary, vocabulary), -1)).astype(np.int64)
            known = place[np.asarray(coded.indices)] if len(terms) else np.empty(0, np.int64)
            hit = known >= 0
            pairs, counts = np.unique(owner[hit] * max(1, len(vocabulary)) + known[hit], return_counts=True)
            of, term = np.divmod(pairs, max(1, len(vocabulary)))
            ends = pa.array(np.searchsorted(of, np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.bincount(owner, minlength=batch.num_rows)),
                 pa.ListArray.from_arrays(ends, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int32)))],
                ["id", "n", "terms", "counts"])

    return rows.mapInArrow(run, f"id {rows.schema[0].dataType.simpleString()}, n long, terms array<int>, counts array<int>")


class Slab:
    """Scores of some documents: one row of postings for each document, and a list of postings for each term."""

    def __init__(self, lengths: np.ndarray, terms: np.ndarray, scores: np.ndarray, n_terms: int):
        self.lengths, self.terms, self.scores = lengths, terms, scores
        self.starts = np.r_[0, np.cumsum(lengths)]
        doc = np.repeat(np.arange(len(lengths)), lengths)
        order = np.argsort(terms, kind="stable")
        self.list_doc, self.list_start = doc[order], np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.most = np.zeros(n_terms, np.int64)
        np.maximum.at(self.most, terms, scores)
    def dense(self, docs: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
        """Scores of documents in the terms that have a place."""
        n = self.lengths[docs]
        upto = np.cumsum(n)
        at = np.arange(upto[-1]) + np.repeat(self.starts[docs] - upto + n, n)
        column, row = place[self.terms[at]], np.repeat(np.arange(len(docs)), n)
        out = np.zeros((len(docs), width), np.int64)
        out[row[column >= 0], column[column >= 0]] = self.scores[at[column >= 0]]
        return out


def blocks(cells: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows with similar ones side by side, and where each block of them begins. The list's own term,
    column ``own``, does not count."""
    x = cells.astype(np.float32)
    x[:, own] = 0
    total = x.sum(axis=1)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    n = min(CENTRES, -(-len(x) // BLOCK_DOCS))
    near = np.argmax(x @ x[np.arange(n) * len(x) // n].T, axis=1)
    order = np.lexsort((-total, near))
    within = np.arange(len(x)) - np.searchsorted(near[order], near[order])
    return order, np.flatnonzero(within % BLOCK_DOCS == 0)


class Best:
    """The best documents of one query: those that may still be among its k best."""

    def __init__(self, k: int, least: int):
        self.k, self.least, self.docs, self.scores = k, least, np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, docs: np.ndarray, scores: np.ndarray) -> None:
        self.docs, first = np.unique(np.r_[self.docs, docs], return_index=True)
        self.scores = np.r_[self.scores, scores][first]
        if len(self.scores) >= self.k:
            self.least = max(self.least, int(np.partition(self.scores, -self.k)[-self.k]))
        keep = self.scores >= self.least
        self.docs, self.scores = self.docs[keep], self.scores[keep]


def search_slab(slab: Slab, queries: list[np.ndarray], least: np.ndarray, k: int, counts: dict | None = None) -> list[Best]:
    """For each query (places of its terms) the documents of the slab that score at least ``least`` and may be among
    the k best. ``counts`` gets the numbers of blocks met, blocks scored and documents scored."""
    counts = {} if counts is None else counts
    best = [Best(k, max(1, int(x))) for x in least]

    def needed(q: int) -> np.ndarray:
        """Terms of a query without which no document reaches its bound."""
        order = queries[q][np.argsort(slab.most[queries[q]], kind="stable")]
        return order[np.cumsum(slab.most[order]) >= best[q].least]

    users: dict[int, list[int]] = {}
    for q in range(len(queries)):
        for term in needed(q):
            users.setdefault(int(term), []).append(q)
    place = np.full(len(slab.most), -1, np.int64)
    for term in sorted(users, key=lambda t: (-int(slab.most[t]), t)):
        asks = [q for q in users[term] if term in needed(q)]
        if not asks:
            continue
        wide = np.unique(np.concatenate([queries[q] for q in asks]))
        place[wide] = np.arange(len(wide))
        docs = slab.list_doc[slab.list_start[term]:slab.list_start[term + 1]]
        step = max(BLOCK_DOCS, PART_CELLS // len(wide))
        for at in range(0, len(docs), step):
            part = docs[at:at + step]
            cells = slab.dense(part, place, len(wide))
            order, begin = blocks(cells, place[term])
            part, cells = part[order], cells[order]
            summary = np.maximum.reduceat(cells, begin, axis=0)
            block = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(part)]))
            for q in asks:
                columns = place[queries[q]]
                live = summary[:, columns].sum(axis=1) >= best[q].least
                counts["blocks"] = counts.get("blocks", 0) + len(live)
                if live.any():
                    rows = np.flatnonzero(live[block])
                    scores = cells[np.ix_(rows, columns)].sum(axis=1)
                    counts["scored_blocks"] = counts.get("scored_blocks", 0) + int(live.sum())
                    counts["scored_docs"] = counts.get("scored_docs", 0) + len(rows)
                    good = scores >= best[q].least
                    if good.any():
                        best[q].add(part[rows[good]], scores[good])
        place[wide] = -1
    return best


def _slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        start = 0
        ends = np.cumsum(np.asarray(pc.list_value_length(batch.column("terms"))), dtype=np.int64)
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + SLAB_POSTINGS - size, side="right")))
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1] - base)
            start = stop
            if size >= SLAB_POSTINGS:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _found(index: DataFrame, queries: list[np.ndarray], least: np.ndarray, weights: np.ndarray, n_docs: int, n_all: int, k: int,
           report: bool = False) -> DataFrame:
    """Rows (query, id, score) of each slab, or the counts of its blocks."""
    kind = index.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _slabs(batches):
            n = np.asarray(table.column("n")).astype(np.int64)
            m = 10 + (90 * n * n_docs) // n_all
            lengths = np.asarray(pc.list_value_length(table.column("terms"))).astype(np.int64)
            terms, counts = (np.asarray(pc.list_flatten(table.column(c))).astype(np.int64) for c in ("terms", "counts"))
            scores = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 8 * np.repeat(m, lengths)))
            seen: dict[str, int] = {}
            best = search_slab(Slab(lengths, terms, scores, len(weights)), queries, least, k, seen)
            if report:
                yield pa.RecordBatch.from_arrays([pa.array([seen.get(c, 0)]) for c in ("blocks", "scored_blocks", "scored_docs")],
                                                 ["blocks", "scored_blocks", "scored_docs"])
                continue
            query = np.repeat(np.arange(len(best)), [len(b.docs) for b in best])
            docs = np.concatenate([b.docs for b in best]) if best else np.empty(0, np.int64)
            yield from pa.table({"query": pa.array(query.astype(np.int32)), "id": table.column("id").take(pa.array(docs)),
                                 "score": pa.array(np.concatenate([b.scores for b in best]) if best else docs)}).to_batches()

    return index.select("id", "n", "terms", "counts").mapInArrow(
        run, "blocks long, scored_blocks long, scored_docs long" if report else f"query int, id {kind}, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _group(docs: DataFrame, items: list[tuple], k: int, id_col: str, text_col: str, report: bool) -> DataFrame | None:
    """The results of the queries that go over the documents together."""
    spark = docs.sparkSession
    terms, owner = terms_of(pa.array([t or "" for _, t in items], pa.string()))
    coded = terms.dictionary_encode()
    vocabulary = coded.dictionary
    indices = np.asarray(coded.indices).astype(np.int64) if len(terms) else np.empty(0, np.int64)
    queries = [np.unique(indices[owner == q]) for q in range(len(items))]
    index = written(term_counts(docs, vocabulary, id_col, text_col))
    n_docs, n_all = index.agg(F.sum((F.col("n") > 0).cast("long")), F.sum("n")).first()
    if not n_all or not len(vocabulary):
        return None
    df = np.zeros(len(vocabulary), np.int64)
    for r in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row a query term
        df[r.term] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    least = np.zeros(len(items), np.int64)
    sample = _found(index.where(F.pmod(F.xxhash64("id", "n"), F.lit(SAMPLE)) == 0), queries, least, weights, n_docs, n_all, k)
    for r in _best(sample, k).where(F.col("rank") == k).collect():  # one row a query
        least[r["query"]] = r.score
    if report:
        return _found(index, queries, least, weights, n_docs, n_all, k, report)
    found = _best(_found(index, queries, least, weights, n_docs, n_all, k), k)
    names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(items)], "query int, item_id long")
    return found.join(F.broadcast(names), "query").select("item_id", "rank", F.col("id").alias(id_col), "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", query_col: str = "text", report: bool = False) -> DataFrame:
    """Rows (item_id, rank, id, score): the k highest-scoring rows of ``docs`` for each row of ``items``.

    A term is a run of letters, digits and non-ASCII characters, with A-Z lower-cased; a query counts each of its terms
    once. A term in df of N documents weighs floor(1000 ln((2N + 2) / (2 df + 1))); a document adds its weight times
    10^9 tf div (1000 tf + 8 m), with m = 10 + 90 n N div L for n of all L terms. Scores of 0 are left out, equal scores
    go by id (null first). Null and empty texts hold no term; queries without a term that occurs give no row. Each row of
    ``docs`` is judged by itself, rows with a repeated id too; rows of ``items`` with a repeated id each give their rows.
    Other columns are ignored. The queries go over the documents in groups of at most ``QUERY_BYTES`` of text (or one
    query), so what travels to the tasks does not grow with their number. ``report`` gives, instead, the numbers of
    blocks met, blocks scored and documents scored of every slab.
    """
    cut = items.select(F.col(item_col).cast("long").alias("item"), F.col(query_col).alias("text"))
    done, group, size = [], [], 0
    for row in cut.toLocalIterator():
        group.append((row.item, row.text))
        size += len((row.text or "").encode())
        if size >= QUERY_BYTES:
            done.append(_group(docs, group, k, id_col, text_col, report))
            group, size = [], 0
    if group:
        done.append(_group(docs, group, k, id_col, text_col, report))
    done = [d for d in done if d is not None]
    if not done:
        kind = docs.select(id_col).schema[0].dataType.simpleString()
        schema = "blocks long, scored_blocks long, scored_docs long" if report else f"item_id long, rank int, `{id_col}` {kind}, score long"
        return docs.sparkSession.createDataFrame([], schema)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
