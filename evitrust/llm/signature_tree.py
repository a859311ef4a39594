"""Jaccard self-join of word n-gram sets with signature trees.

1. Equal sets form a class, and the join works on classes, so copies cost nothing. 2. Two sets that link share a token
among the first n - ceil(t n) + 1 tokens of each, in any fixed order of all tokens. The order here puts frequent tokens
last. Only such prefix tokens that two classes share are kept. 3. The classes that share a token are the leaves of a
signature tree: a node holds the OR of the bitmaps of their shared prefix tokens and the range of their sizes. A dual
traversal visits pairs of nodes and drops those whose largest possible overlap is too small. 4. What is left is held
against the whole sets, exactly. 5. Links give components.

A group of near copies would have as many pairs as the square of its size. Where more than ``WIDE`` classes share a
token, they are first held against ``PIVOTS`` of them only, those with the largest share of such tokens (of copies with
edits, the ones with the fewest); then a second traversal visits the pairs that are not yet in one component. So no
link between components is lost, and none is repeated inside one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from evitrust.llm.graphs import components
from evitrust.llm.storage import written
from evitrust.llm.words import ODD, hash_strings, mix, shingles, slices, words_of

WORDS, PERCENT = 5, 75
WIDE = 64                    # classes in a leaf, and those all of whose pairs are visited at once
FANOUT = 8
PIVOTS = 4
BITS = 4                     # longs of a bitmap
SAMPLE = 16                  # one text in so many is used to find frequent tokens; only the order depends on it
FREQUENT, MOST_FREQUENT = 4, 1_000_000
BUCKET_ROWS, WIDE_BUCKET_ROWS = 250_000, 60_000
BROADCAST_ROWS = 500_000


def token_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, offsets): the sorted distinct n-gram hashes of each text; A-Z is lower-cased. A text of fewer words has
    its whole sequence as the one token, a text without words has none."""
    flat, owner = words_of(texts, lower=True)
    n = len(texts)
    h = hash_strings(flat)
    keys, at = shingles(h, owner, words)
    of = owner[at]
    count = np.bincount(owner, minlength=n)
    begin = np.searchsorted(owner, np.arange(n))
    few = np.flatnonzero((count > 0) & (count < words))
    short = np.zeros(len(few), np.uint64)
    for j in range(words - 1):
        more = count[few] > j
        short[more] = short[more] * ODD + h[begin[few[more]] + j]
    keys = np.concatenate([keys, mix(short ^ count[few].astype(np.uint64))])
    of = np.concatenate([of, few])
    order = np.lexsort((keys, of))
    keys, of = keys[order], of[order]
    new = np.r_[True, (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])] if len(keys) else np.empty(0, bool)
    keys, of = keys[new], of[new]
    return keys, np.searchsorted(of, np.arange(n + 1))


def class_of(keys: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    sums = np.concatenate([[np.uint64(0)], np.add.accumulate(mix(keys ^ ODD))])
    size = (cut[1:] - cut[:-1]).astype(np.uint64)
    return mix((sums[cut[1:]] - sums[cut[:-1]]) ^ mix(size))


def _lists(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(values.view(np.int64)))


def frequent_tokens(docs: DataFrame, id_col: str, text_col: str, words: int) -> np.ndarray:
    """Sorted tokens that several texts of the hashed sample hold, at most ``MOST_FREQUENT``. A wrong or missing token
    costs time only: any order of the tokens gives the same links."""
    def run(batches):
        for batch in slices(batches, text_col):
            keys, _ = token_sets(batch.column(0), words)
            keys, n = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["token", "n"])
    sample = docs.where(F.pmod(F.xxhash64(id_col, F.lit("order")), F.lit(SAMPLE)) == 0).select(text_col)
    counted = written(sample.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
                      .where(F.col("n") >= FREQUENT))
    sizes = sorted(((r["n"], r["count"]) for r in counted.groupBy(F.least("n", F.lit(10_000)).alias("n")).count().collect()), reverse=True)
    least, total = 1 << 62, 0
    for n, k in sizes:  # at most 10,000 rows
        total += k
        if total > MOST_FREQUENT:
            break
        least = n
    return np.sort(np.asarray(counted.where(F.col("n") >= least).select("token").toArrow().column("token")).astype(np.int64).view(np.uint64))


def document_sets(docs: DataFrame, frequent: np.ndarray, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """Rows (id, n, cls, prefix): prefix only for the first text of a class in its task, and for no empty set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.empty(0, np.uint64)
        for batch in slices(batches, text_col):
            keys, cut = token_sets(batch.column(1), words)
            size = cut[1:] - cut[:-1]
            cls = class_of(keys, cut)
            _, first = np.unique(cls, return_index=True)
            use = np.zeros(len(cls), bool)
            use[first] = True
            use &= ~np.isin(cls, seen) & (size > 0)
            seen = np.union1d(seen, cls[use])
            of = np.repeat(np.arange(len(size)), size)
            late = np.zeros(len(keys), bool)
            if len(frequent):
                late = frequent[np.searchsorted(frequent, keys).clip(0, len(frequent) - 1)] == keys
            order = np.lexsort((keys, late, of))
            take = size - -(-percent * size // 100) + 1
            rank = np.arange(len(keys)) - np.repeat(cut[:-1], size)
            kept = order[(rank < np.repeat(take, size)) & np.repeat(use, size)]
            ends = np.concatenate([[0], np.cumsum(np.where(use, take, 0))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), pa.array(cls.view(np.int64)), _lists(keys[kept], ends)], ["id", "n", "cls", "prefix"])

    rows = docs.select(id_col, text_col)
    return rows.mapInArrow(run, f"id {rows.schema[0].dataType.simpleString()}, n long, cls long, prefix array<long>")


class Tree:
    """Classes sorted by size in leaves of ``WIDE``, and levels of ``FANOUT`` nodes above them."""

    def __init__(self, n: np.ndarray, bits: np.ndarray, lost: np.ndarray):
        self.order = np.lexsort((bits[:, 0], n))
        n, bits, lost = n[self.order], bits[self.order], lost[self.order]
        self.levels = []
        step = WIDE
        while True:
            at = np.arange(0, len(n), step)
            self.levels.append((np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(n, at), np.maximum.reduceat(n, at),
                                np.maximum.reduceat(lost, at)))
            if len(at) == 1:
                break
            step *= FANOUT

    def leaf_pairs(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of leaves (a <= b) that a dual traversal from the root cannot rule out."""
        a = b = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            bits, low, high, lost = self.levels[depth]
            keep = possible(bits[a], bits[b], low[a], low[b], high[a], high[b], np.maximum(lost[a], lost[b]), percent)
            a, b = a[keep], b[keep]
            if depth == 0:
                return a, b
            child = np.arange(FANOUT)
            a, b = (np.repeat(a, FANOUT * FANOUT) * FANOUT + np.tile(np.repeat(child, FANOUT), len(a)),
                    np.repeat(b, FANOUT * FANOUT) * FANOUT + np.tile(child, len(a) * FANOUT))
            real = (a <= b) & (b < len(self.levels[depth - 1][1]))
            a, b = a[real], b[real]


def possible(bits_a, bits_b, low_a, low_b, high_a, high_b, lost, percent: int) -> np.ndarray:
    """Whether sets of the given size ranges may link: the sizes fit, and the bits their bitmaps share, with the tokens
    lost to collisions and all tokens behind the prefixes, reach the overlap that a link needs."""
    fit = (100 * high_a >= percent * low_b) & (100 * high_b >= percent * low_a)
    need = -(-percent * (low_a + low_b) // (100 + percent))
    behind = np.maximum(-(-percent * high_a // 100), -(-percent * high_b // 100)) - 1
    shared = np.bitwise_count(bits_a & bits_b).sum(axis=1, dtype=np.int64)
    return fit & (shared + lost + behind >= need)


def tree_pairs(token: np.ndarray, cls: np.ndarray, n: np.ndarray, bits: np.ndarray, lost: np.ndarray, rank: np.ndarray,
               group: np.ndarray | None, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, times): pairs of classes that share a token and may link, and how many tokens led to them.

    Without ``group``, the classes of tokens with over ``WIDE`` of them are held against the ``PIVOTS`` of highest
    ``rank`` only; with ``group``, only pairs of different groups count.
    """
    order = np.lexsort((cls, token))
    new = np.r_[True, (token[order][1:] != token[order][:-1]) | (cls[order][1:] != cls[order][:-1])]
    order = order[new]
    token, cls, n, bits, lost, rank = (x[order] for x in (token, cls, n, bits, lost, rank))
    group = None if group is None else group[order]
    begin = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    size = np.diff(np.r_[begin, len(token)])
    found = Pairs()

    def visit(i: np.ndarray, j: np.ndarray) -> None:
        near = possible(bits[i], bits[j], n[i], n[j], n[i], n[j], np.minimum(lost[i], lost[j]), percent)
        if group is not None:
            near &= group[i] != group[j]
        i, j = i[near], j[near]
        found.add(np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j]))

    narrow = np.repeat(size <= WIDE, size)
    for k in range(1, int(size[size <= WIDE].max(initial=1))):
        i = np.flatnonzero(narrow[:-k] & (token[k:] == token[:-k]))
        visit(i, i + k)
    for b, m in zip(begin[size > WIDE], size[size > WIDE]):
        here = np.arange(b, b + m)
        if group is None:
            for top in here[np.lexsort((cls[here], -rank[here]))[:PIVOTS]]:
                visit(here[here != top], np.full(m - 1, top))
            continue
        tree = Tree(n[here], bits[here], lost[here])
        for x, y in zip(*tree.leaf_pairs(percent)):
            i, j = here[tree.order[x * WIDE:(x + 1) * WIDE]], here[tree.order[y * WIDE:(y + 1) * WIDE]]
            i, j = np.repeat(i, len(j)), np.tile(j, len(i))
            once = (i < j) | (x != y)
            visit(i[once], j[once])
    return found.fold()


class Pairs:
    """Pairs with how often they came; they are folded now and then, so memory follows the distinct ones."""

    FOLD = 2_000_000

    def __init__(self):
        self.parts, self.size = [(np.empty(0, np.int64),) * 3], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.parts.append((a, b, np.ones(len(a), np.int64)))
            self.size += len(a)
            if self.size > self.FOLD:
                self.parts, self.size = [self.fold()], 0

    def fold(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, n = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((b, a))
        a, b, n = a[order], b[order], n[order]
        if not len(a):
            return a, b, n
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        return a[first], b[first], np.add.reduceat(n, first)


def _bitmap(token: Column) -> list[Column]:
    place = F.pmod(token, F.lit(64 * BITS))
    return [F.bit_or(F.when(F.floor(place / 64) == k, F.expr("shiftleft(1L, cast(pmod(token, 64) as int))")).otherwise(F.lit(0).cast("long")))
            .alias(f"w{k}") for k in range(BITS)]


def candidates(shared: DataFrame, percent: int, buckets: int, grouped: bool) -> DataFrame:
    """Rows (a, b, times) from rows (token, cls, n, w0.., lost, rank[, grp]), bucket by bucket of tokens."""
    def run(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).to_numpy() for c in table.column_names}
        bits = np.stack([col[f"w{k}"] for k in range(BITS)], axis=1).view(np.uint64)
        a, b, times = tree_pairs(col["token"], col["cls"], col["n"], bits, col["lost"], col["rank"], col.get("grp"), percent)
        return pa.table({"a": a, "b": b, "times": times})

    names = ["token", "cls", "n", *(f"w{k}" for k in range(BITS)), "lost", "rank"] + ["grp"] * grouped
    bucket = F.pmod(F.xxhash64("token"), F.lit(buckets)).alias("bucket")
    return shared.select(bucket, *names).groupBy("bucket").applyInArrow(run, "a long, b long, times long").groupBy("a", "b").agg(
        F.sum("times").alias("times"))


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets link. Sets are built anew from the one text of each class in a pair."""
    pairs = written(pairs.select("a", "b"))
    ids = classes.join(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "cls").select(F.col("rep").alias("_rep"))
    ids = written(ids)
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)

    def run(batches):
        for batch in slices(batches, text_col):
            keys, cut = token_sets(batch.column(0), words)
            yield pa.RecordBatch.from_arrays([pa.array(class_of(keys, cut).view(np.int64)), _lists(keys, cut)], ["cls", "tokens"])
    texts = docs.join(ids, F.col(id_col) == F.col("_rep"), "left_semi").select(text_col)
    sets = written(texts.mapInArrow(run, "cls long, tokens array<long>"))
    one = sets.select(F.col("cls").alias("a"), F.col("tokens").alias("_a"))
    two = sets.select(F.col("cls").alias("b"), F.col("tokens").alias("_b"))
    both = F.size(F.array_intersect("_a", "_b"))
    return pairs.join(one, "a").join(two, "b").where(
        (100 + percent) * both >= percent * (F.size("_a") + F.size("_b"))).select("a", "b")


def similar_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Rows (id, n_shingles, component_id) of all documents; component_id is the smallest id that links lead to.

    Two documents link when 100 * intersection >= percent * union of their n-gram sets. Texts without a word have an
    empty set and link with nothing, not with each other. Equal sets link, so copies share a component. A row with a
    null id takes the component of rows with an equal set, or null; it makes no links of its own. Repeated rows stay.
    """
    spark = docs.sparkSession
    docs = docs.select(id_col, text_col)
    sets = written(document_sets(docs, frequent_tokens(docs, id_col, text_col, words), id_col, text_col, words, percent))
    classes = sets.where("n > 0 AND id IS NOT NULL").groupBy("cls").agg(F.min("id").alias("rep"))
    by_token = Window.partitionBy("token")
    shared = written(
        sets.where("size(prefix) > 0").select("cls", "n", F.explode("prefix").alias("token"))
        .select("token", "cls", "n", F.min("cls").over(by_token).alias("_a"), F.max("cls").over(by_token).alias("_b"),
                F.count(F.lit(1)).over(by_token).alias("wide"))
        .where("_a <> _b").drop("_a", "_b"))
    ones = "+".join(f"bit_count(w{k})" for k in range(BITS))
    signs = shared.distinct().groupBy("cls").agg(
        *_bitmap(F.col("token")), F.count(F.lit(1)).alias("_tokens"), F.sum((F.col("wide") > WIDE).cast("long")).alias("in_wide"),
        F.first("n").alias("_n")
    ).withColumn("lost", F.col("_tokens") - F.expr(ones)).withColumn("rank", F.col("in_wide") / F.col("_n")).drop("_tokens", "_n")
    signs = written(signs)
    signed = shared.join(signs.drop("in_wide"), "cls")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + shared.count() // BUCKET_ROWS)
    pairs = candidates(signed, percent, buckets, grouped=False)
    sizes = shared.groupBy("cls").agg(F.first("n").alias("n")).join(signs.select("cls", "in_wide"), "cls")
    one, two = (sizes.select(*(F.col(c).alias(f"{c}_{x}") for c in sizes.columns)) for x in "ab")
    need = F.ceil(F.lit(percent) * (F.col("n_a") + F.col("n_b")) / (100 + percent)) - F.ceil(
        F.greatest("n_a", "n_b") * F.lit(percent) / 100) + 1
    narrow = pairs.join(one, F.col("a") == F.col("cls_a")).join(two, F.col("b") == F.col("cls_b")).where(
        F.col("times") + F.least("in_wide_a", "in_wide_b") >= need)
    links = verified(narrow, classes, docs, id_col, text_col, words, percent)
    links = written(links)
    wide = shared.where(F.col("wide") > WIDE)
    if not wide.isEmpty():
        groups = components(links).withColumnRenamed("node", "cls")
        grouped = wide.join(groups, "cls", "left").withColumn("grp", F.coalesce("component", "cls")).drop("component")
        split = grouped.groupBy("token").agg(F.min("grp").alias("_a"), F.max("grp").alias("_b")).where("_a <> _b").select("token")
        rest = grouped.join(split, "token", "left_semi").join(signs.drop("in_wide"), "cls")
        rest = written(rest)  # few tokens remain; with few buckets a pair comes up once, not for each of its tokens
        more = candidates(rest, percent, 1 + rest.count() // WIDE_BUCKET_ROWS, grouped=True).join(links, ["a", "b"], "left_anti")
        links = links.union(verified(more, classes, docs, id_col, text_col, words, percent))
    named = classes.withColumnRenamed("rep", "a")
    edges = links.join(named.withColumnRenamed("cls", "_ca").withColumnRenamed("a", "u"), F.col("a") == F.col("_ca")).join(
        named.withColumnRenamed("cls", "_cb").withColumnRenamed("a", "v"), F.col("b") == F.col("_cb")).select("u", "v")
    found = components(edges, "u", "v")
    names = classes.join(found, F.col("rep") == F.col("node"), "left").select(
        F.col("cls"), F.coalesce("component", "rep").alias("name"))
    return sets.join(names, "cls", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("name", "id")).otherwise(F.col("id")).alias("component_id"))
