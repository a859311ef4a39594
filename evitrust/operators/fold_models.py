"""Models of all (seed, fold) slots side by side: every step of all fits is one pass over one table.

Rows are joined with the roles their group has in each slot (train, calib, test) and written once. A *fit* is a slot with
the roles it learns from. Statistics of all fits come from two jobs: medians from one running order of the folded values
with one count for each fit, and moments, category and class counts from one pass. The multinomial logistic models take
Newton steps, the boosted trees and the forests one histogram a level over rows folded by their codes, for all fits together; a task adds up its own rows and sends one
vector a fit (and class), so what moves does not grow with the rows, and nothing is fitted in one task or on the driver
but the solution of small systems. Predictions of all slots are one more pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F, types as T

from evitrust import ordering
from evitrust.sources.shared import written

TRAIN, CALIB, TEST = 1, 2, 3
SLOTS_A_WORD = 21             # three bits each
ROWS_PER_TASK = 20_000
LEAST_ROWS_PER_TASK = 500     # of tables that all executors have room for
MAX_CATEGORIES = 10_000       # of all columns; more are no categories
DESIGN_CELLS = 2_000_000      # products of features that are made at once
DESIGN_ROWS = 1_000           # rows of all fits that stay in a core's cache
LAST_STEP = 1e-2              # coefficients move less than this in a step that needs no look back
POOLED_SHARE = 0.1            # pools are made side by side as long as so many points, twice counted, fall
PACKED_ROWS = 200_000         # calibration scores that are made into arrays at once
KEEP_EVERY = 10               # rounds after which the scores of the folded rows are written, at most
KEPT_BYTES = 256 << 20        # so many bytes of scores for each round more than two


@dataclass
class FoldTable:
    """``table``: row_id, group, y (place of the label or -1), cats (codes or -1), nums (NaN where missing), roles."""

    table: DataFrame
    slots: list[tuple[int, int]]
    labels: list[str]
    categories: dict[str, list[str]]
    numeric: list[str]
    group: str
    n_rows: int
    prepared: dict = field(default_factory=dict)   # by fits
    folded: dict = field(default_factory=dict)     # rows folded by their codes, by fits and edges


@dataclass(frozen=True)
class Fit:
    """A slot and whether its calibration rows are learnt from, too."""

    slot: int
    with_calib: bool

    def learns(self, roles: np.ndarray) -> np.ndarray:
        own = roles[:, self.slot]
        return (own == TRAIN) | (own == CALIB) if self.with_calib else own == TRAIN


@dataclass
class Prepared:
    """Of each fit: fill value, centre, scale and presence of every number; mode and seen codes of every category; the
    weight of every class (0 if it has no row)."""

    fill: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    used: np.ndarray
    mode: np.ndarray
    seen: list[list[np.ndarray]]
    weight: np.ndarray


def fold_table(rows: DataFrame, roles: DataFrame, categorical: Sequence[str], numeric: Sequence[str], labels: Sequence[str],
               group: str, label: str, slots: Sequence[tuple[int, int]], row_id: str = "row_id") -> FoldTable:
    """Rows of groups with a role, coded. Labels that are not listed count as missing."""
    categories: dict[str, list[str]] = {c: [] for c in categorical}
    if categorical:
        found = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in categorical]))
                            .alias("s")).select("s.*").where("v IS NOT NULL").distinct().limit(MAX_CATEGORIES + 1).collect()
        if len(found) > MAX_CATEGORIES:
            raise ValueError(f"more than {MAX_CATEGORIES} categories")
        for r in sorted(found):
            categories[r.c].append(r.v)
    by_group = _roles_of_groups(roles, group, slots)
    place = lambda values, x: F.coalesce(F.array_position(F.array(*map(F.lit, values)), x), F.lit(0)).cast("int") - 1
    coded = rows.join(by_group, F.col(group) == F.col("_g")).select(
        F.col(row_id).alias("row_id"), F.col(group).alias(group), place(labels, F.col(label)).alias("y"),
        F.array(*[place(v, F.col(c).cast("string")) if v else F.lit(-1) for c, v in categories.items()]).cast("array<int>").alias("cats"),
        F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in numeric]).cast("array<double>").alias("nums"), "roles")
    n_rows = rows.count()
    spread = min(rows.sparkSession.sparkContext.defaultParallelism, n_rows // LEAST_ROWS_PER_TASK)
    coded = written(coded.repartition(max(1, spread, -(-n_rows // ROWS_PER_TASK)), F.xxhash64("row_id")))
    return FoldTable(coded, list(slots), list(labels), categories, list(numeric), group, n_rows)


def _roles_of_groups(roles: DataFrame, group: str, slots: Sequence[tuple[int, int]]) -> DataFrame:
    """Rows (_g, roles array): the highest role of each group in every slot, 0 if none. A role is one of three bits of a slot,
    so one number gathers ``SLOTS_A_WORD`` slots."""
    code = F.when(F.col("role") == "train", TRAIN).when(F.col("role") == "calib", CALIB).when(F.col("role") == "test", TEST)
    place = F.lit(None).cast("int")
    for i, (s, f) in enumerate(slots):
        place = F.when((F.col("seed") == s) & (F.col("fold") == f), F.lit(i)).otherwise(place)
    coded = roles.select(F.col(group).alias("_g"), place.alias("_i"), code.alias("_c"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), 3 * (F.col("_i") % SLOTS_A_WORD) + F.col("_c") - 1)
    words = range(-(-len(slots) // SLOTS_A_WORD))
    held = coded.groupBy("_g").agg(*[F.coalesce(F.bit_or(F.when(F.floor(F.col("_i") / SLOTS_A_WORD) == w, bit)), F.lit(0).cast("bigint")).alias(f"_w{w}")
                                     for w in words])

    def role(i: int) -> Column:
        bits = F.shiftright(f"_w{i // SLOTS_A_WORD}", 3 * (i % SLOTS_A_WORD)).bitwiseAND(F.lit(7).cast("bigint"))
        return F.when(bits >= 4, TEST).when(bits >= 2, CALIB).otherwise(bits.cast("int"))
    return held.select("_g", F.array(*[role(i) for i in range(len(slots))]).alias("roles"))


class Rows:
    """One batch as arrays."""

    def __init__(self, batch: pa.RecordBatch, n_cats: int, n_nums: int):
        n = batch.num_rows
        wide = lambda c, w, kind: np.asarray(batch.column(c).flatten()).astype(kind).reshape(n, w)
        self.n, self.y = n, np.asarray(batch.column("y"))
        self.cats, self.nums = wide("cats", n_cats, np.int64), wide("nums", n_nums, np.float64)
        self.roles = np.asarray(batch.column("roles").flatten()).reshape(n, -1)

    def part(self, own: slice) -> Rows:
        """Some rows, without labels and roles."""
        return Rows.of(self.cats[own], self.nums[own])

    @classmethod
    def of(cls, cats: np.ndarray, nums: np.ndarray) -> Rows:
        """Rows without labels and roles."""
        out = object.__new__(cls)
        out.n, out.cats, out.nums = len(cats), cats, nums
        return out


def _sums(ft: FoldTable, table: DataFrame, work: Callable[[Rows], Iterator[tuple[int, np.ndarray]]]) -> dict[int, np.ndarray]:
    """The sum of the vectors that ``work`` gives for each key, added up in the tasks first."""
    n_cats, n_nums = len(ft.categories), len(ft.numeric)
    return _added(table.select("y", "cats", "nums", "roles"), lambda batch: work(Rows(batch, n_cats, n_nums)))


def _total(batches: Iterator[pa.RecordBatch], work: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]) -> dict[int, np.ndarray]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        if batch.num_rows:
            for key, v in work(batch):
                total[key] = total[key] + v if key in total else v
    return total


def _added(table: DataFrame, work: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]) -> dict[int, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _total(batches, work)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["key", "v"])

    sums = table.mapInArrow(run, "key int, v array<double>").groupBy("key").agg(Summarizer.sum(array_to_vector("v")).alias("v"))
    return {r["key"]: r["v"].toArray() for r in sums.collect()}  # one row a key


def prepare(ft: FoldTable, fits: Sequence[Fit], balanced: bool = True, **sizing) -> Prepared:
    """Medians, moments, modes, seen categories and class weights of all fits, in two jobs. Models of one table share them."""
    key = tuple(fits), balanced
    if key in ft.prepared:
        return ft.prepared[key]
    n, p = len(fits), len(ft.numeric)
    fill = np.full((n, p), np.nan)
    if p:
        learns = {f"w{i}": F.get("roles", F.lit(f.slot)).isin([TRAIN, CALIB] if f.with_calib else [TRAIN]).cast("bigint") for i, f in enumerate(fits)}
        long = ft.table.select("roles", F.posexplode("nums").alias("c", "x")).where(~F.isnan("x"))
        folded = long.groupBy("c", "x").agg(*[F.sum(e).alias(k) for k, e in learns.items()])
        upto = ordering.cumulative(folded, ["c"], "x", {f"u{i}": F.col(f"w{i}") for i in range(n)}, **({"group_at_most": ft.n_rows} | sizing))

        def at(i: int, rank):
            return F.max(F.when((F.col(f"u{i}") - F.col(f"w{i}") <= rank) & (rank < F.col(f"u{i}")), F.col("x")))
        halves = {i: (F.col(f"u{i}_total") - 1) * 0.5 for i in range(n)}
        picked = upto.groupBy("c").agg(*[at(i, side(halves[i])).alias(f"{name}{i}") for i in range(n) for name, side in (("lo", F.floor), ("hi", F.ceil))])
        for r in picked.collect():  # one row a column
            for i in range(n):
                if r[f"lo{i}"] is not None:
                    fill[i, r["c"]] = r[f"lo{i}"] + (r[f"hi{i}"] - r[f"lo{i}"]) * 0.5
    used = ~np.isnan(fill)
    fill = np.where(used, fill, 0.0)
    sizes, n_labels = [len(v) for v in ft.categories.values()], len(ft.labels)

    middle = np.array([np.mean(fill[used[:, c], c]) if used[:, c].any() else 0.0 for c in range(p)])

    def count(rows: Rows) -> Iterator[tuple[int, np.ndarray]]:
        """Of each fit: rows, then present numbers, their distances from a middle and squares, labels and codes."""
        there = ~np.isnan(rows.nums)
        x = np.where(there, rows.nums - middle, 0.0)
        coded = [rows.y[:, None] == np.arange(n_labels), *(rows.cats[:, c, None] == np.arange(size) for c, size in enumerate(sizes))]
        learns = np.column_stack([f.learns(rows.roles) for f in fits]).astype(np.float64)
        yield 0, np.hstack([learns.sum(axis=0)[:, None], learns.T @ there, learns.T @ x, learns.T @ (x * x), *(learns.T @ c for c in coded)]).ravel()

    centre, scale = np.zeros((n, p)), np.ones((n, p))
    mode, seen, weight = np.full((n, len(sizes)), -1), [[np.zeros(s, bool) for s in sizes] for _ in fits], np.zeros((n, len(ft.labels)))
    sums = _sums(ft, ft.table, count)
    for i, v in enumerate(sums[0].reshape(n, -1) if sums else []):
        if v[0]:
            present, first, second = v[1:3 * p + 1].reshape(3, p)
            away = fill[i] - middle                                         # distances from the fit's own median, where missing numbers lie
            shift = (first - present * away) / v[0]
            centre[i] = np.where(used[i], fill[i] + shift, 0.0)
            spread = np.sqrt(np.maximum((second - 2 * away * first + present * away * away) / v[0] - shift * shift, 0.0))
            scale[i] = np.where(used[i] & (spread > 0), spread, 1.0)
        at = 3 * p + 1
        k = v[at:at + len(ft.labels)]
        there = k > 0
        weight[i, there] = k.sum() / (there.sum() * k[there]) if balanced else 1.0
        at += len(ft.labels)
        for c, size in enumerate(sizes):
            counts = v[at:at + size]
            at += size
            seen[i][c] = counts > 0
            if counts.any():
                mode[i, c] = int(np.argmax(counts))        # the first in text order of the most frequent ones
    ft.prepared[key] = Prepared(fill, centre, scale, used, mode, seen, weight)
    return ft.prepared[key]


def _codes(prep: Prepared, i: int, rows: Rows) -> np.ndarray:
    return np.where(rows.cats < 0, prep.mode[i], rows.cats)


def _design(prep: Prepared, i: int, rows: Rows, m: np.ndarray) -> np.ndarray:
    """Constant, one column for each category and the scaled numbers; unseen categories are zeros."""
    codes, parts = _codes(prep, i, rows)[m], [np.ones((int(m.sum()), 1))]
    for c, seen in enumerate(prep.seen[i]):
        hot = np.zeros((len(codes), len(seen)))
        ok = (codes[:, c] >= 0) & seen[np.maximum(codes[:, c], 0)] if len(seen) else np.zeros(len(codes), bool)
        hot[np.flatnonzero(ok), codes[ok, c]] = 1.0
        parts.append(hot)
    x = rows.nums[m]
    parts.append((np.where(np.isnan(x), prep.fill[i], x) - prep.centre[i]) / prep.scale[i] * prep.used[i])
    return np.hstack(parts)


def softmax(scores: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Probabilities of the classes that are there; the others have none."""
    z = np.where(there, scores, -np.inf)
    if not there.any():
        return np.full(scores.shape, 1.0 / scores.shape[1])
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


# --- logistic --------------------------------------------------------------------------------

def width(ft: FoldTable) -> int:
    return 1 + sum(map(len, ft.categories.values())) + len(ft.numeric)


def fit_logistic(ft: FoldTable, fits: Sequence[Fit], prep: Prepared, reg: float = 0.0, max_iter: int = 50, tol: float = 1e-8) -> np.ndarray:
    """Coefficients (fit, feature, class) of the multinomial model, by Newton steps that are halved while the loss grows.

    ``reg`` is the L2 weight of all but the constants. Directions that the rows leave open stay at zero.
    """
    d, k = width(ft), len(ft.labels)
    now = np.zeros((len(fits), d, k))
    step, before, live = np.zeros_like(now), np.full(len(fits), np.inf), list(range(len(fits)))
    there = prep.weight > 0
    penalty = np.full((d, k), reg)
    penalty[0] = 0
    shared = _Shared(ft, prep)
    own = [shared.of_fit(i) for i in range(len(fits))]
    wide = shared.width
    up, across = np.triu_indices(wide)
    pairs = [(a, b) for a in range(k) for b in range(a + 1, k)]
    some = max(64, min(DESIGN_ROWS, DESIGN_CELLS // len(up)))

    for _ in range(max_iter):
        def work(rows: Rows, now=now, live=tuple(live)) -> Iterator[tuple[int, np.ndarray]]:
            coefficients = np.hstack([own[i] @ now[i] for i in live])
            masked = np.where(there[list(live)], 0.0, -np.inf)
            learns = np.column_stack([fits[i].learns(rows.roles) for i in live]) & (rows.y >= 0)[:, None]
            total = 0.0
            for at in range(0, rows.n, some):
                part = slice(at, at + some)
                x, y, m = shared.design(rows.part(part)), rows.y[part], learns[part]
                q = (x @ coefficients).reshape(len(x), len(live), k) + masked
                q -= q.max(axis=2, keepdims=True)
                np.exp(q, out=q)
                q /= q.sum(axis=2, keepdims=True)
                w = np.where(m, prep.weight[list(live)][:, y].T, 0.0)
                p = np.take_along_axis(q, np.maximum(y, 0)[:, None, None], axis=2)[:, :, 0]
                loss = -(w * np.log(np.where(m, np.maximum(p, 1e-300), 1.0))).sum(axis=0)
                off = w[:, :, None] * (q - (np.arange(k) == y[:, None])[:, None])
                grad = (x.T @ off.reshape(len(x), -1)).reshape(wide, len(live), k)
                # the second derivatives of two classes; those of a class with itself make up for the others
                both = np.stack([-w * q[:, :, a] * q[:, :, b] for a, b in pairs], axis=2) if pairs else np.zeros((len(x), len(live), 0))
                curve = ((x[:, up] * x[:, across]).T @ both.reshape(len(x), -1)).reshape(len(up), len(live), -1)
                total = total + np.hstack([loss[:, None], w.sum(axis=0)[:, None], m.sum(axis=0)[:, None], np.moveaxis(grad, 1, 0).reshape(len(live), -1),
                                           np.moveaxis(curve, 1, 0).reshape(len(live), -1)])
            for i, v in zip(live, total):
                if v[2]:
                    yield i, v

        sums = _sums(ft, ft.table, work)
        for i in list(live):
            if i not in sums:
                live.remove(i)
                continue
            v = sums[i]
            loss = v[0] + 0.5 * v[1] * (penalty * now[i] ** 2).sum()
            if not loss <= before[i] * (1 + 1e-13) + 1e-12:
                step[i] /= 2
                now[i] -= step[i]
                if np.abs(step[i]).max() < 1e-12:
                    live.remove(i)
                continue
            done = before[i] - loss < tol * max(abs(loss), 1e-300)
            before[i] = loss
            if done:
                live.remove(i)
                continue
            grad = own[i].T @ v[3:3 + wide * k].reshape(wide, k)
            hess = np.zeros((d, k, d, k))
            for (a, b), half in zip(pairs, v[3 + wide * k:].reshape(len(up), len(pairs)).T):
                full = np.zeros((wide, wide))
                full[up, across] = full[across, up] = half
                full = own[i].T @ full @ own[i]
                hess[:, a, :, b] += full
                hess[:, b, :, a] += full
                hess[:, a, :, a] -= full
                hess[:, b, :, b] -= full
            grad = (grad + v[1] * penalty * now[i]).ravel()
            hess = hess.reshape(d * k, d * k) + v[1] * np.diag(penalty.ravel())
            step[i] = -(np.linalg.pinv(hess, rcond=1e-11, hermitian=True) @ grad).reshape(d, k)
            now[i] += step[i]
            # a short step that gains less than ``tol`` is the last one; no pass is needed to see that
            if -0.5 * grad @ step[i].ravel() < tol * max(abs(loss), 1e-300) and np.abs(step[i]).max() < LAST_STEP:
                live.remove(i)
        if not live:
            break
    return now


class _Shared:
    """One design of the rows for all fits. Fits differ in fill values, scales and modes only, so the design of each is this
    one (a constant, codes and numbers as they are, and which are missing) times a matrix of its own."""

    def __init__(self, ft: FoldTable, prep: Prepared):
        self.prep, self.sizes, n_nums = prep, [len(v) for v in ft.categories.values()], len(ft.numeric)
        self.middle, self.unit = prep.centre.mean(axis=0), prep.scale.mean(axis=0)
        self.width = 1 + sum(self.sizes) + len(self.sizes) + 2 * n_nums

    def design(self, rows: Rows) -> np.ndarray:
        gone = np.isnan(rows.nums)
        codes = [rows.cats[:, c, None] == np.arange(size) for c, size in enumerate(self.sizes)]
        return np.hstack([np.ones((rows.n, 1)), *codes, rows.cats < 0, np.where(gone, 0.0, (rows.nums - self.middle) / self.unit), gone]).astype(np.float64)

    def of_fit(self, i: int) -> np.ndarray:
        """The matrix that makes the columns of ``_design`` of this one's."""
        prep, n_nums, codes = self.prep, len(self.middle), sum(self.sizes)
        out = np.zeros((self.width, 1 + codes + n_nums))
        out[0, 0], at = 1.0, 1
        for c, size in enumerate(self.sizes):
            known = np.flatnonzero(prep.seen[i][c])
            out[at + known, at + known] = 1.0
            if prep.mode[i, c] >= 0:
                out[1 + codes + c, at + prep.mode[i, c]] = 1.0
            at += size
        used, number = prep.used[i] / prep.scale[i], np.arange(n_nums)
        first = 1 + codes + len(self.sizes)
        out[0, at + number] = used * (self.middle - prep.centre[i])
        out[first + number, at + number] = used * self.unit
        out[first + n_nums + number, at + number] = used * (prep.fill[i] - self.middle)
        return out


# --- boosting --------------------------------------------------------------------------------

@dataclass
class Trees:
    """Complete trees of (round, fit, class): feature (-1: all rows go left), cut and node values."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    edges: list[np.ndarray]
    n_cats: int
    depth: int


def _bins(edges: Sequence[np.ndarray], rows: Rows) -> np.ndarray:
    """Codes of all features: categories as they are, numbers by the edges; -1 where missing."""
    bins = [np.where(np.isnan(rows.nums[:, c]), -1, np.searchsorted(e, rows.nums[:, c], side="left")) for c, e in enumerate(edges)]
    return np.column_stack([rows.cats, *bins]).astype(np.int64)


def _filled(edges: Sequence[np.ndarray], prep: Prepared, i: int, bins: np.ndarray) -> np.ndarray:
    """Missing categories by the mode, missing numbers by the bin of the median."""
    fill = np.array([*prep.mode[i], *(np.searchsorted(e, prep.fill[i, c], side="left") for c, e in enumerate(edges))], np.int64)
    return np.where(bins < 0, fill, bins)


def _descend(trees: Trees, r: int, i: int, k: int, codes: np.ndarray, levels: int) -> np.ndarray:
    """The node of each row after so many levels of one tree."""
    node, n, width = np.zeros(len(codes), np.intp), len(codes), codes.shape[1]
    feature = trees.feature[r, i, k].astype(np.intp)
    cut = trees.cut[r, i, k].astype(np.int64)
    no_cut = np.iinfo(np.int64)
    high = np.where(feature < 0, no_cut.max, cut)                                          # codes above it go right
    low = np.where((feature >= 0) & (feature < trees.n_cats), cut, no_cut.min)             # of a category, those below it, too
    flat, at, feature = np.ascontiguousarray(codes).ravel(), np.arange(n) * width, np.maximum(feature, 0)
    for level in range(levels):
        code = flat.take(at + feature.take(node))
        right = code > high.take(node)
        if (low[2 ** level - 1:2 ** (level + 1) - 1] > no_cut.min).any():
            right |= code < low.take(node)
        node += node
        node += right
        node += 1
    return node


def _scores(trees: Trees, i: int, codes: np.ndarray, start: np.ndarray | None, first: int, rounds: int) -> np.ndarray:
    out = np.zeros((len(codes), trees.value.shape[2])) if start is None else start.copy()
    for r in range(first, rounds):
        for k in range(out.shape[1]):
            out[:, k] += trees.value[r, i, k].take(_descend(trees, r, i, k, codes, trees.depth))
    return out


def _edges(ft: FoldTable, bins: int) -> list[np.ndarray]:
    """Approximate quantiles of every number over all rows."""
    if not ft.numeric:
        return []
    steps = [b / bins for b in range(1, bins)]
    clean = ft.table.select(*[F.when(~F.isnan(x), x).alias(c) for c, x in ((f"x{c}", F.get("nums", F.lit(c))) for c in range(len(ft.numeric)))])
    return [np.unique(np.array(q, np.float64)) for q in clean.approxQuantile(clean.columns, steps, 1 / (4 * bins))]


def folded_rows(ft: FoldTable, fits: Sequence[Fit], edges: Sequence[np.ndarray]) -> tuple[DataFrame, int]:
    """Rows (y, bins, n, calib, test) and their number: the distinct codes of labelled rows, with the count that each fit learns
    from, and the counts of calibration and test rows of each slot.

    Trees see nothing of a row but its codes and its label, so rows that share them are one row with a weight. There are no
    more than combinations of codes, however long the table is.
    """
    n_cats, n_nums = len(ft.categories), len(ft.numeric)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bins = _bins(edges, Rows(batch, n_cats, n_nums))
                ends = pa.array(np.arange(0, bins.size + 1, bins.shape[1]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("y"), pa.ListArray.from_arrays(ends, pa.array(bins.astype(np.int32).ravel())),
                                                  batch.column("roles")], ["y", "bins", "roles"])

    key = tuple(fits), tuple(e.tobytes() for e in edges)
    if key in ft.folded:
        return ft.folded[key]
    coded = ft.table.where("y >= 0").select("y", "cats", "nums", "roles").mapInArrow(code, "y int, bins array<int>, roles array<int>")
    sums = {(i, role): F.sum((F.get("roles", F.lit(i)) == role).cast("bigint")) for i in range(len(ft.slots)) for role in (TRAIN, CALIB, TEST)}
    counted = coded.groupBy("y", "bins").agg(*[x.alias(f"_{role}_{i}") for (i, role), x in sums.items()])
    of = lambda role, i: F.col(f"_{role}_{i}")
    slots = range(len(ft.slots))
    folded = written(counted.select("y", "bins", F.array(*[of(TRAIN, f.slot) + of(CALIB, f.slot) if f.with_calib else of(TRAIN, f.slot) for f in fits]).alias("n"),
                                    F.array(*[of(CALIB, i) for i in slots]).alias("calib"), F.array(*[of(TEST, i) for i in slots]).alias("test")))
    n_rows = folded.count()
    spread = min(folded.sparkSession.sparkContext.defaultParallelism, n_rows // LEAST_ROWS_PER_TASK)
    ft.folded[key] = written(folded.repartition(max(1, spread, -(-n_rows // ROWS_PER_TASK)), F.xxhash64("y", "bins"))), n_rows
    return ft.folded[key]


class Cells:
    """One batch of ``folded_rows`` as arrays. Fits that fill missing values alike share their codes."""

    def __init__(self, batch: pa.RecordBatch, edges: Sequence[np.ndarray], prep: Prepared):
        n = batch.num_rows
        wide = lambda c: np.asarray(batch.column(c).flatten()).reshape(n, -1)
        self.y, self.bins, self.n = np.asarray(batch.column("y")), wide("bins").astype(np.int64), wide("n")
        self.calib, self.test = (wide(c) if c in batch.schema.names else None for c in ("calib", "test"))
        self.edges, self.prep = edges, prep
        self.filled: dict[bytes, np.ndarray] = {}

    def codes(self, i: int) -> np.ndarray:
        codes = _filled(self.edges, self.prep, i, self.bins[:1] * 0 - 1)
        key = codes.tobytes()
        if key not in self.filled:
            self.filled[key] = np.where(self.bins < 0, codes, self.bins)
        return self.filled[key]


class Codes(Cells):
    """One batch of ``_class_counts``: ``n`` and the scores, if there are any yet, by row, fit and class."""

    def __init__(self, batch: pa.RecordBatch, edges: Sequence[np.ndarray], prep: Prepared, n_fits: int, k: int):
        wide = lambda c: np.frombuffer(b"".join(batch.column(c).to_pylist())).reshape(-1, n_fits, k)
        self.bins = np.asarray(batch.column("bins").flatten()).reshape(batch.num_rows, -1).astype(np.int64)
        self.n, self.scores = wide("n"), wide("scores") if "scores" in batch.schema.names else None
        self.edges, self.prep, self.filled = edges, prep, {}

    def start(self, i: int, some: np.ndarray | slice = slice(None)) -> np.ndarray | None:
        return None if self.scores is None else self.scores[some, i]


def _best_splits(hist: np.ndarray, n_bins: Sequence[int], n_cats: int, l2: float, least: float):
    """For each node (feature or -1, cut, (G, H) of both children). hist: (node, cell, [g, h])."""
    total = hist[:, :n_bins[0]].sum(axis=1)
    quality = lambda s: s[..., 0] ** 2 / (s[..., 1] + l2)
    best = [(-1, 0, t, np.zeros(2)) for t in total]
    gain_of = np.full(len(hist), 1e-9)
    at = 0
    for f, n in enumerate(n_bins):
        cells = hist[:, at:at + n]
        at += n
        left = cells if f < n_cats else np.cumsum(cells, axis=1)[:, :-1]
        if not left.shape[1]:
            continue
        right = total[:, None] - left
        gain = quality(left) + quality(right) - quality(total)[:, None]
        gain = np.where((left[..., 1] >= least) & (right[..., 1] >= least), gain, -np.inf)
        top = gain.argmax(axis=1)
        for node in np.flatnonzero(gain[np.arange(len(gain)), top] > gain_of):
            c = top[node]
            gain_of[node] = gain[node, c]
            best[node] = (f, int(c), left[node, c], right[node, c])
    return best


def fit_boosting(ft: FoldTable, fits: Sequence[Fit], prep: Prepared, max_iter: int = 20, depth: int = 5, rate: float = 0.1, bins: int = 32,
                 l2: float = 1.0, least: float = 1.0) -> Trees:
    """Softmax boosting: each round one tree a class on the gradients, second-order leaf values.

    Numbers are cut at approximate quantiles of all rows (labels play no part in them), categories are split one against
    the rest. ``least`` is the smallest sum of second derivatives in a child. One job a level and round serves all fits.
    """
    n, k, n_cats = len(fits), len(ft.labels), len(ft.categories)
    edges = _edges(ft, bins)
    n_bins = [max(1, len(v)) for v in ft.categories.values()] + [len(e) + 1 for e in edges]
    nodes = 2 ** (depth + 1) - 1
    trees = Trees(np.full((max_iter, n, k, nodes), -1, np.int16), np.zeros((max_iter, n, k, nodes), np.int16),
                  np.zeros((max_iter, n, k, nodes)), edges, n_cats, depth)
    cells = int(sum(n_bins))
    if not cells:
        return trees
    there = prep.weight > 0
    table, n_rows = _class_counts(ft, fits, edges)
    every = min(KEEP_EVERY, 2 + n_rows * n * k * 8 // KEPT_BYTES)
    kept = 0
    for r in range(max_iter):
        if r and r % every == 0:
            table, kept = written(_with_scores(table, fits, prep, trees, kept, r)), r
        for level in range(depth):
            first = 2 ** level - 1

            def work(own: Codes, r=r, level=level, first=first, kept=kept) -> Iterator[tuple[int, np.ndarray]]:
                for i in range(n):
                    if there[i].sum() < 2:
                        continue
                    w = own.n[:, i] * prep.weight[i]
                    whole = w.sum(axis=1)
                    some = np.flatnonzero(whole)
                    if not len(some):
                        continue
                    codes, w, whole = own.codes(i)[some], w[some], whole[some]
                    q = softmax(_scores(trees, i, codes, own.start(i, some), kept, r), there[i])
                    columns = [np.ascontiguousarray(codes[:, f]) for f in range(codes.shape[1])]
                    known = [None if (c >= 0).all() else c >= 0 for c in columns]
                    for c in np.flatnonzero(there[i]):
                        sums = whole * q[:, c] - w[:, c], whole * q[:, c] * (1 - q[:, c])
                        node = _descend(trees, r, i, c, codes, level) - first
                        hist = np.empty((2 ** level, cells, 2))
                        at = 0
                        for code, ok, size in zip(columns, known, n_bins):
                            place = node * size + code
                            for j, v in enumerate(sums):
                                hist[:, at:at + size, j] = (np.bincount(place, v, minlength=2 ** level * size) if ok is None else
                                                            np.bincount(place[ok], v[ok], minlength=2 ** level * size)).reshape(-1, size)
                            at += size
                        yield i * k + c, hist.ravel()

            def split(parts: pa.Table) -> pa.Table:     # runs before the next level is defined
                hist = sum(np.frombuffer(v.as_py()) for v in parts.column("v")).reshape(2 ** level, cells, 2)
                found = zip(*_best_splits(hist, n_bins, n_cats, l2, least))
                feature, cut, left, right = (np.array(x, np.float64) for x in found)
                return pa.table({"key": parts.column("key")[:1], "v": pa.array([np.column_stack([feature, cut, left, right]).tobytes()], pa.binary())})

            def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = _total(batches, lambda batch: work(Codes(batch, edges, prep, n, k)))
                if total:
                    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["key", "v"])

            found = table.mapInArrow(count, "key int, v binary").groupBy("key").applyInArrow(split, "key int, v binary")
            for row in found.collect():     # one row a tree: the splits of its nodes
                i, c = divmod(row.key, k)
                v = np.frombuffer(row.v).reshape(2 ** level, 6)
                own = slice(first, first + 2 ** level)
                trees.feature[r, i, c, own], trees.cut[r, i, c, own] = v[:, 0], v[:, 1]
                below = slice(2 * first + 1, 2 * first + 1 + 2 ** (level + 1))
                trees.value[r, i, c, below] = (-rate * v[:, 2::2] / (v[:, 3::2] + l2)).ravel()
    return trees


def _with_scores(table: DataFrame, fits: Sequence[Fit], prep: Prepared, trees: Trees, first: int, rounds: int) -> DataFrame:
    """The codes with the scores of all fits after so many rounds."""
    n, k, plain = len(fits), trees.value.shape[2], ["bins", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = Codes(batch, trees.edges, prep, n, k)
                out = np.hstack([_scores(trees, i, own.codes(i), own.start(i), first, rounds) for i in range(n)])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in plain), _as_bytes(out)], [*plain, "scores"])

    return table.mapInArrow(run, "bins array<int>, n binary, scores binary")


def _as_bytes(x: np.ndarray) -> pa.Array:
    """Each row as one value, which moves faster than an array of numbers."""
    return pa.array([row.tobytes() for row in np.ascontiguousarray(x, np.float64)], pa.binary())


def _class_counts(ft: FoldTable, fits: Sequence[Fit], edges: Sequence[np.ndarray]) -> tuple[DataFrame, int]:
    """Rows (bins, n) and their number: distinct codes, with the count of every class that each fit learns from. Scores hang on
    codes only, so the classes of a code share them."""
    folded, k = folded_rows(ft, fits, edges)[0], len(ft.labels)
    none = F.array(*[F.lit(0).cast("bigint") for _ in fits])
    counts = folded.groupBy("bins").agg(F.array(*[F.coalesce(F.max(F.when(F.col("y") == c, F.col("n"))), none) for c in range(k)]).alias("n"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = np.asarray(batch.column("n").flatten().flatten()).reshape(batch.num_rows, k, len(fits))
                yield pa.RecordBatch.from_arrays([batch.column("bins"), _as_bytes(n.transpose(0, 2, 1).reshape(batch.num_rows, -1))], ["bins", "n"])

    packed = written(counts.mapInArrow(pack, "bins array<int>, n binary"))
    n_rows = packed.count()
    spread = min(packed.sparkSession.sparkContext.defaultParallelism, n_rows // LEAST_ROWS_PER_TASK)
    return written(packed.repartition(max(1, spread, -(-n_rows // ROWS_PER_TASK)), F.xxhash64("bins"))), n_rows


# --- forests ---------------------------------------------------------------------------------

@dataclass
class Forest:
    """Complete trees of (tree, fit): feature (-1: all rows go left) and cut of the inner nodes, class shares of the leaves."""

    feature: np.ndarray      # (tree, fit, 1, node), as ``_descend`` reads it
    cut: np.ndarray
    value: np.ndarray        # (tree, fit, leaf, class)
    edges: list[np.ndarray]
    n_cats: int
    depth: int

    def shares(self, i: int, codes: np.ndarray, there: np.ndarray) -> np.ndarray:
        """Mean class shares of the leaves that each row falls into."""
        out = np.zeros((len(codes), self.value.shape[3]))
        for t in range(len(self.value)):
            out += self.value[t, i].take(_descend(self, t, i, 0, codes, self.depth) - (2 ** self.depth - 1), axis=0)
        total = out.sum(axis=1, keepdims=True)
        return np.where(total > 0, out / np.where(total > 0, total, 1.0), softmax(np.zeros_like(out), there))


def _mix(x: np.ndarray) -> np.ndarray:
    """Well-spread 64 bits of each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Bootstrap:
    """How often each folded row is drawn for a tree: a Poisson number with the row's count as its mean, which is what its
    rows would add up to if each was drawn by itself. It hangs on the row's codes, the seed and the tree only, so every pass
    draws the same; means over ``LARGE`` are drawn from the rounded normal distribution."""

    LARGE = 1000

    def __init__(self, y: np.ndarray, bins: np.ndarray, n: np.ndarray):
        key = np.full(len(y), 0x9E3779B97F4A7C15, np.uint64)
        for column in (y, *bins.T):
            key = _mix(key ^ (column.astype(np.int64) + 2).astype(np.uint64))
        self.key, self.n, self.large = key, n, np.flatnonzero(n > self.LARGE)
        means, self.at = np.unique(np.minimum(n, self.LARGE), return_inverse=True)
        tables = []
        for m in means.tolist():
            k = np.arange(int(m + 12 * np.sqrt(m)) + 20)
            log = k * np.log(m) - np.concatenate([[0.0], np.cumsum(np.log(k[1:]))]) - m if m else np.where(k, -np.inf, 0.0)
            tables.append(np.minimum(np.cumsum(np.exp(log)), 1.0))
        self.start = np.concatenate([[0], np.cumsum([len(x) for x in tables])[:-1]]).astype(np.int64)
        self.table = np.concatenate([i + x for i, x in enumerate(tables)])     # one sorted table: place of the mean + share

    def _even(self, key: np.ndarray, seed: int, tree: int, turn: int) -> np.ndarray:
        salt = _mix(np.array([seed, tree, turn], np.int64).astype(np.uint64) + np.uint64(1))
        salt = _mix(salt[0] ^ _mix(salt[1] ^ (salt[2] << np.uint64(1))))
        return (_mix(key ^ salt) >> np.uint64(11)) * 2.0 ** -53

    def drawn(self, seed: int, tree: int) -> np.ndarray:
        out = np.searchsorted(self.table, self.at + self._even(self.key, seed, tree, 0), side="right") - self.start[self.at]
        if len(self.large):
            mean, key = self.n[self.large], self.key[self.large]
            a, b = (self._even(key, seed, tree, turn) for turn in (1, 2))
            z = np.sqrt(-2 * np.log1p(-a)) * np.cos(2 * np.pi * b)
            out[self.large] = np.maximum(np.rint(mean + np.sqrt(mean) * z), 0)
        return out


class _Offer:
    """The features offered to the nodes of one level of a tree, a random few for each node, and where their counts lie."""

    def __init__(self, columns: np.ndarray, category: np.ndarray, sizes: np.ndarray, seed: int, tree: int, level: int, closed: np.ndarray):
        width = len(columns)
        few = int(np.ceil(np.sqrt(width)))
        order = np.random.default_rng([seed, tree, level]).random((2 ** level, width))
        picked = np.sort(np.argpartition(order, few - 1, axis=1)[:, :few], axis=1)
        self.column, self.category = columns[picked], category[picked]
        self.size = np.where(closed[:, None], 0, sizes[picked])
        self.start = (np.cumsum(self.size.ravel()) - self.size.ravel()).reshape(self.size.shape)
        self.cells = int(self.size.sum())


def fit_forest(ft: FoldTable, fits: Sequence[Fit], prep: Prepared, trees: int = 200, depth: int = 10, bins: int = 32) -> Forest:
    """Random forests: each tree is grown on its own bootstrap of the rows, each node splits by the best of a random few
    features (the root of their number) by the weighted Gini impurity. Every category is a feature, split one against the rest.

    One job a level grows all trees of all fits: tasks count their folded rows by node, feature and class, the counts of a
    tree are added up in one group, which gives the splits of that level. Only splits reach the driver.
    """
    n, k, n_cats = len(fits), len(ft.labels), len(ft.categories)
    edges = _edges(ft, bins)
    forest = Forest(np.full((trees, n, 1, 2 ** depth - 1), -1, np.int16), np.zeros((trees, n, 1, 2 ** depth - 1), np.int16),
                    np.zeros((trees, n, 1, k), np.float32), edges, n_cats, depth)
    features = []      # of each fit: column, category (-1: a number), number of cells
    for i in range(n):
        hot = [(c, v, 2) for c, seen in enumerate(prep.seen[i]) for v in np.flatnonzero(seen).tolist()]
        features.append(np.array(hot + [(n_cats + c, -1, len(e) + 1) for c, e in enumerate(edges) if prep.used[i, c]], np.int64).reshape(-1, 3).T)
    seeds = [ft.slots[f.slot][0] for f in fits]
    grown = [i for i in range(n) if features[i].shape[1]]
    table = folded_rows(ft, fits, edges)[0].select("y", "bins", "n")
    shares = np.zeros((trees, n, 1, k), np.float32)
    closed = np.zeros((trees, n, 1), bool)

    for level in range(depth):
        first = 2 ** level - 1

        def offer(i: int, t: int) -> _Offer:
            return _Offer(*features[i], seeds[i], t, level, closed[t, i])

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None   # ROWS_PER_TASK rows a file
            if whole is None:
                return
            own = Cells(whole.combine_chunks().to_batches()[0], edges, prep)
            for i in grown:
                some = np.flatnonzero(own.n[:, i] > 0)
                if not len(some):
                    continue
                codes, y = own.codes(i)[some].astype(np.int32), own.y[some].astype(np.int64)
                sample = _Bootstrap(y, own.bins[some], own.n[some, i])
                for t in range(trees):
                    if closed[t, i].all():
                        continue
                    times = sample.drawn(seeds[i], t)
                    taken = np.flatnonzero(times)
                    code = codes[taken]
                    node = _descend(forest, t, i, 0, code, level) - first
                    if closed[t, i].any():
                        still = np.flatnonzero(~closed[t, i][node])
                        taken, code, node = taken[still], code[still], node[still]
                    if not len(taken):
                        continue
                    o, flat, at = offer(i, t), code.ravel(), np.arange(len(code)) * code.shape[1]
                    hit, weight = y[taken], times[taken].astype(np.float64)
                    total = np.zeros(o.cells * k)
                    for j in range(o.column.shape[1]):
                        x, category = flat.take(at + o.column[:, j].take(node)), o.category[:, j].take(node)
                        cell = np.where(category < 0, x, x != category) + o.start[:, j].take(node)
                        total += np.bincount(cell * k + hit, weight, minlength=len(total))
                    yield pa.RecordBatch.from_arrays([pa.array([i * trees + t], pa.int32()), pa.array([total.astype(np.int64).tobytes()], pa.binary())], ["key", "v"])

        def split(parts: pa.Table) -> pa.Table:     # runs before the next level is defined
            key = parts.column("key")[0].as_py()
            i, t = divmod(key, trees)
            o = offer(i, t)
            counts = sum(np.frombuffer(v.as_py(), np.int64) for v in parts.column("v")).reshape(-1, k) * prep.weight[i]
            size, start = o.size.ravel(), o.start.ravel()
            deep = np.zeros((len(size), max(2, int(size.max())), k))
            deep[np.repeat(np.arange(len(size)), size), np.arange(o.cells) - np.repeat(start, size)] = counts
            deep = deep.reshape(*o.size.shape, -1, k)                 # (node, offered feature, cell, class)
            whole = deep[:, :1].sum(axis=2, keepdims=True)
            left = np.where((o.category < 0)[:, :, None, None], np.cumsum(deep, axis=2), deep)[:, :, :-1]
            left[:, :, 1:] = np.where((o.category < 0)[:, :, None, None], left[:, :, 1:], 0.0)
            right = whole - left
            pure = lambda s: (s * s).sum(axis=-1) / np.maximum(s.sum(axis=-1), 1e-300)
            gain = (pure(left) + pure(right) - pure(whole)) / np.maximum(whole.sum(axis=-1), 1e-300)
            some = 1e-9 * np.maximum(whole.sum(axis=-1), 1e-300)
            gain = np.where((left.sum(axis=-1) > some) & (right.sum(axis=-1) > some), gain, -np.inf).reshape(len(deep), -1)
            at = np.arange(len(deep))
            best = gain.argmax(axis=1)
            good = gain[at, best] > 1e-9
            j, c = np.divmod(best, left.shape[2])
            feature = np.where(good, o.column[at, j], -1)
            cut = np.where(o.category[at, j] < 0, c, o.category[at, j])
            sides = np.stack([left[at, j, c], np.maximum(right[at, j, c], 0.0), whole[:, 0, 0]], axis=1)
            sides = sides / np.maximum(sides.sum(axis=2, keepdims=True), 1e-300)
            return pa.table({"key": pa.array([key], pa.int32()), **{name: pa.array([x.tobytes()], pa.binary()) for name, x in (
                ("feature", feature.astype(np.int16)), ("cut", cut.astype(np.int16)), ("sides", sides.astype(np.float32)))}})

        found = table.mapInArrow(count, "key int, v binary").groupBy("key").applyInArrow(split, "key int, feature binary, cut binary, sides binary")
        below = np.repeat(shares, 2, axis=2)
        open_below = np.zeros((trees, n, 2 ** (level + 1)), bool)
        for r in found.collect():     # one row a tree: the splits of its nodes
            i, t = divmod(r.key, trees)
            feature, sides = np.frombuffer(r.feature, np.int16), np.frombuffer(r.sides, np.float32).reshape(-1, 3, k)
            if not level:
                below[t, i] = sides[0, 2]
            forest.feature[t, i, 0, first:2 * first + 1], forest.cut[t, i, 0, first:2 * first + 1] = feature, np.frombuffer(r.cut, np.int16)
            done = np.repeat(feature >= 0, 2)
            below[t, i, done], open_below[t, i] = sides[:, :2].reshape(-1, k)[done], done
        shares, closed = below, ~open_below
        if closed.all():
            below_leaf = 2 ** (depth - level - 1)
            shares = np.repeat(shares, below_leaf, axis=2)
            break
    forest.value = shares
    return forest


# --- predictions -----------------------------------------------------------------------------

def _probabilities(ft: FoldTable, prep: Prepared, model: np.ndarray | Trees | Forest) -> Callable[[int, Rows, np.ndarray | None, np.ndarray], np.ndarray]:
    """A function of a fit, rows, their bins and places: class probabilities. Fits of trees look at the bins only."""
    there = prep.weight > 0

    def of(i: int, rows: Rows, bins: np.ndarray | None, m: np.ndarray) -> np.ndarray:
        if isinstance(model, Forest):
            return model.shares(i, _filled(model.edges, prep, i, bins[m]), there[i])
        if isinstance(model, Trees):
            return softmax(_scores(model, i, _filled(model.edges, prep, i, bins[m]), None, 0, len(model.value)), there[i])
        return softmax(_design(prep, i, rows, m) @ model[i], there[i])
    return of


def predictions(ft: FoldTable, fits: Sequence[Fit], prep: Prepared, model: np.ndarray | Trees | Forest, roles: Sequence[int] = (TEST, CALIB)) -> DataFrame:
    """Rows (row_id, group, y, fit, role, p array): the test rows of every fit, and the calibration rows it did not learn from."""
    n_cats, n_nums, group, probabilities = len(ft.categories), len(ft.numeric), ft.group, _probabilities(ft, prep, model)
    edges = None if isinstance(model, np.ndarray) else model.edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = Rows(batch, n_cats, n_nums)
            bins = None if edges is None else _bins(edges, rows)
            for i, f in enumerate(fits):
                own = rows.roles[:, f.slot]
                m = np.isin(own, [role for role in roles if role == TEST or not f.with_calib])
                if not m.any():
                    continue
                p = probabilities(i, rows, bins, m)
                take = pa.array(np.flatnonzero(m))
                ends = pa.array(np.arange(0, p.size + 1, p.shape[1]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row_id").take(take), batch.column(group).take(take), batch.column("y").take(take),
                     pa.array(np.full(len(p), i, np.int32)), pa.array(own[m].astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(p.ravel()))],
                    ["row_id", group, "y", "fit", "role", "p"])

    kinds = dict(ft.table.dtypes)
    return ft.table.mapInArrow(run, f"row_id {kinds['row_id']}, `{ft.group}` {kinds[ft.group]}, y int, fit int, role int, p array<double>")


def _scored(ft: FoldTable, fits: Sequence[Fit], prep: Prepared, model: np.ndarray | Trees | Forest, role: int) -> tuple[DataFrame, Callable]:
    """A table, and a function of its batches that gives (fit, y, p, weight) of the labelled rows which have the role. Trees see
    nothing of a row but its codes, so theirs are folded rows, however many rows share them."""
    n_cats, n_nums, probabilities = len(ft.categories), len(ft.numeric), _probabilities(ft, prep, model)
    some = [(i, f.slot) for i, f in enumerate(fits) if role == TEST or not f.with_calib]

    def of_rows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        rows = Rows(batch, n_cats, n_nums)
        for i, slot in some:
            m = (rows.roles[:, slot] == role) & (rows.y >= 0)
            if m.any():
                yield i, rows.y[m], probabilities(i, rows, None, m), np.ones(int(m.sum()), np.int64)

    if isinstance(model, np.ndarray):
        return ft.table.select("y", "cats", "nums", "roles"), of_rows
    edges, column = model.edges, {CALIB: "calib", TEST: "test"}[role]

    def of_codes(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        own = Cells(batch, edges, prep)
        for i, slot in some:
            times = getattr(own, column)[:, slot]
            m = times > 0
            if m.any():
                yield i, own.y[m], probabilities(i, None, own.bins, m), times[m]

    return folded_rows(ft, fits, edges)[0], of_codes


# --- calibration -----------------------------------------------------------------------------

@dataclass
class Packed:
    """``table``: rows (_key, score, hit, n), arrays of distinct scores, their hits and rows; a key has many such rows.
    ``sizes``: rows and hits of each key."""

    table: DataFrame
    sizes: dict[int, tuple[int, int]]

    def usable(self) -> list[int]:
        """Keys with a hit and a miss."""
        return sorted(key for key, (n, hits) in self.sizes.items() if 0 < hits < n)


_PACKED = "_key int, score binary, hit binary, n binary, n_rows bigint, n_hits bigint"


def _folded_scores(score: np.ndarray, hit: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct scores in order, with their hits and rows."""
    at = np.argsort(score, kind="stable")
    score = score[at]
    first = np.flatnonzero(np.r_[True, score[1:] != score[:-1]]) if len(score) else at
    return score[first], np.add.reduceat(hit[at], first) if len(at) else hit, np.add.reduceat(n[at], first) if len(at) else n


def _pack(table: DataFrame, work: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]) -> Packed:
    """Scores of keys, as ``work`` gives them with their hits and rows, written as arrays once; calibration reads nothing else."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> pa.RecordBatch:
            rows = []
            for key, parts in held.items():
                score, hit, n = _folded_scores(*(np.concatenate(x) for x in zip(*parts)))
                rows.append((key, score.tobytes(), hit.astype(np.int64).tobytes(), n.astype(np.int64).tobytes(), int(n.sum()), int(hit.sum())))
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], ["_key", "score", "hit", "n", "n_rows", "n_hits"])

        held: dict[int, list] = {}
        size = 0
        for batch in batches:
            if batch.num_rows:
                for key, *part in work(batch):
                    held.setdefault(key, []).append(part)
                    size += len(part[0])
            if size >= PACKED_ROWS:
                yield packed()
                held, size = {}, 0
        if held:
            yield packed()

    table = written(table.mapInArrow(run, _PACKED))
    return Packed(table, {r["_key"]: (r["n"], r["h"]) for r in table.groupBy("_key").agg(
        F.sum("n_rows").alias("n"), F.sum("n_hits").alias("h")).collect()})     # one row a key


def packed_scores(ft: FoldTable, fits: Sequence[Fit], prep: Prepared, model: np.ndarray | Trees | Forest) -> Packed:
    """Calibration scores of every slot and class; the key is slot * classes + class. Rows never leave their tasks one by one."""
    table, scored = _scored(ft, fits, prep, model, CALIB)
    k, slots = len(ft.labels), [f.slot for f in fits]

    def work(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for i, y, p, n in scored(batch):
            for c in range(k):
                yield slots[i] * k + c, p[:, c], np.where(y == c, n, 0), n

    return _pack(table, work)


def _packed_rows(calib: DataFrame, keys: Sequence[str], order: Sequence[tuple]) -> Packed:
    """Rows (*keys, score, hit) of the keys in ``order``, by their places there."""
    kinds = dict(calib.dtypes)
    places = calib.sparkSession.createDataFrame([(*k, i) for i, k in enumerate(order)], ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", _key int")
    rows = calib.where("score IS NOT NULL").join(F.broadcast(places), list(keys)).select(  # one row a key
        "_key", F.col("score").cast("double").alias("score"), "hit")

    def work(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        key, score = np.asarray(batch.column("_key")), np.asarray(batch.column("score"))
        hit = batch.column("hit").to_numpy(zero_copy_only=False).astype(bool).astype(np.int64)
        for i in np.unique(key).tolist():
            m = key == i
            yield i, score[m], hit[m], np.ones(int(m.sum()), np.int64)

    return _pack(rows, work)


def sigmoid_maps(calib: DataFrame, keys: Sequence[str], max_iter: int = 60, tol: float = 1e-10) -> list[tuple]:
    """(*keys, slope, constant) of a logistic map from ``score`` to the smoothed target of ``hit``, for each key.

    Newton steps for all keys together: one aggregate a step, a handful of numbers a key.
    """
    keys = list(keys)
    sizes = {tuple(r[c] for c in keys): (r["n"], r["h"]) for r in calib.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("hit").cast("long")).alias("h")).collect()}  # one row a key
    order = sorted(key for key, (n, h) in sizes.items() if 0 < h < n)
    if not order:
        return []
    packed = _packed_rows(calib, keys, order)
    maps = packed_sigmoids(Packed(packed.table, dict(enumerate(sizes[k] for k in order))), max_iter, tol)
    return [(*order[i], a, b) for i, (a, b) in maps.items()]


def packed_sigmoids(packed: Packed, max_iter: int = 60, tol: float = 1e-10) -> dict[int, tuple[float, float]]:
    """Slope and constant of the logistic map of each usable key."""
    order = packed.usable()
    now = {k: np.zeros(2) for k in order}
    live, step, before = set(now), {k: np.zeros(2) for k in now}, {k: np.inf for k in now}
    goal = {k: ((packed.sizes[k][1] + 1) / (packed.sizes[k][1] + 2), 1 / (packed.sizes[k][0] - packed.sizes[k][1] + 2)) for k in now}
    for _ in range(max_iter):
        if not live:
            break

        def work(batch: pa.RecordBatch, now={k: (*now[k], *goal[k]) for k in live}) -> Iterator[tuple[int, np.ndarray]]:
            for i, score, hit, n in zip(batch.column("_key").to_pylist(), batch.column("score"), batch.column("hit"), batch.column("n")):
                if i not in now:
                    continue
                a, b, hi, lo = now[i]
                x, hit, n = (np.frombuffer(v.as_buffer(), kind) for v, kind in ((score, np.float64), (hit, np.int64), (n, np.int64)))
                t = hit * hi + (n - hit) * lo
                z = a * x + b
                small = np.exp(-np.abs(z))
                q = np.where(z >= 0, 1.0, small) / (1 + small)
                e, c = n * q - t, n * q * (1 - q)
                yield i, np.array([(n * (np.maximum(z, 0.0) + np.log1p(small)) - t * z).sum(), (e * x).sum(), e.sum(), (c * x * x).sum(), (c * x).sum(), c.sum()])

        for key, v in _added(packed.table, work).items():
            loss = v[0]
            if not loss <= before[key] * (1 + 1e-13) + 1e-12:
                step[key] = step[key] / 2
                now[key] = now[key] - step[key]
                if np.abs(step[key]).max() < 1e-12:
                    live.discard(key)
                continue
            if before[key] - loss < tol * max(loss, 1e-300):
                live.discard(key)
            before[key] = loss
            if key in live:
                hess = np.array([[v[3], v[4]], [v[4], v[5]]])
                step[key] = -np.linalg.pinv(hess, rcond=1e-12, hermitian=True) @ v[1:3]
                now[key] = now[key] + step[key]
                if -0.5 * v[1:3] @ step[key] < tol * max(loss, 1e-300) and np.abs(step[key]).max() < LAST_STEP:
                    live.discard(key)       # as in ``fit_logistic``
    return {k: (float(v[0]), float(v[1])) for k, v in sorted(now.items())}


def pooled(x: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pool-adjacent-violators on points in order of x: (first x, last x, mean, weight) of each pool."""
    first, last, m, w = x, x, mean, weight
    while len(m) > 1:       # neighbours that fall belong to one pool in the end, so all of them are pooled at once
        starts = np.flatnonzero(np.r_[True, m[1:] > m[:-1]])
        if 2 * (len(m) - len(starts)) < POOLED_SHARE * len(m):
            break
        total = np.add.reduceat(w, starts)
        first, last, m, w = first[starts], last[np.r_[starts[1:], len(m)] - 1], np.add.reduceat(m * w, starts) / total, total
    pools: list[list[float]] = []
    for a, b, mean_of, weight_of in zip(first.tolist(), last.tolist(), m.tolist(), w.tolist()):
        pools.append([a, b, mean_of, weight_of])
        while len(pools) > 1 and pools[-2][2] >= pools[-1][2]:
            _, end, m2, w2 = pools.pop()
            own = pools[-1]
            own[1], own[2], own[3] = end, (own[2] * own[3] + m2 * w2) / (own[3] + w2), own[3] + w2
    out = np.array(pools, np.float64).reshape(-1, 4)
    return out[:, 0], out[:, 1], out[:, 2], out[:, 3]


def isotonic_pools(calib: DataFrame, keys: Sequence[str], rows_per_range: int = ordering.MAX_ROWS_PER_RANGE) -> DataFrame:
    """Rows (*keys, lo, hi, mean, weight): the pools of the rising step map from ``score`` to the mean of ``hit``."""
    keys = list(keys)
    order = sorted(tuple(r) for r in calib.select(*keys).distinct().collect())      # one row a key
    kinds = dict(calib.dtypes)
    places = calib.sparkSession.createDataFrame([(*k, i) for i, k in enumerate(order)], ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", _key int")
    pools = packed_pools(_packed_rows(calib, keys, order), rows_per_range)
    return pools.join(F.broadcast(places), "_key").select(*keys, "lo", "hi", "mean", "weight")   # one row a key


def packed_pools(packed: Packed, rows_per_range: int = ordering.MAX_ROWS_PER_RANGE) -> DataFrame:
    """Rows (_key, lo, hi, mean, weight): the pools of the rising step maps of all keys.

    Scores are folded to one weighted point a score, without rounding, and travel as arrays, once. Where a key has more points
    than a task should hold, each range of its scores is pooled by itself first; pools of neighbouring ranges then take part as
    points, which gives the same pools, since points that a range has pooled are pooled in the whole order, too.
    """
    schema = "_key int, lo double, hi double, mean double, weight double"
    ranges = {key: -(-n // rows_per_range) for key, (n, _) in packed.sizes.items()}
    cuts: dict[int, np.ndarray] = {}
    if max(ranges.values(), default=1) > 1:
        every = max(1, rows_per_range // ordering.OVERSAMPLE)

        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Scores between which ranges may be cut; results do not hang on them."""
            picked: dict[int, list] = {}
            left: dict[int, int] = {}
            for batch in batches:
                for key, score in zip(batch.column("_key").to_pylist(), batch.column("score")):
                    x = np.frombuffer(score.as_buffer(), np.float64)
                    start = left.get(key, int(np.frombuffer(x[:1].tobytes(), np.uint64)[0] % np.uint64(every)) if len(x) else 0)
                    at = np.arange(start, len(x), every)
                    picked.setdefault(key, []).append(np.random.default_rng(len(x)).permutation(x)[at])
                    left[key] = start + len(at) * every - len(x)
            for key, parts in picked.items():
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([np.concatenate(parts).tobytes()], pa.binary())], ["_key", "x"])

        found: dict[int, list] = {}
        for r in packed.table.select("_key", "score").mapInArrow(some, "_key int, x binary").collect():     # OVERSAMPLE scores a range
            found.setdefault(r["_key"], []).append(np.frombuffer(r["x"]))
        for key, parts in found.items():
            x = np.sort(np.concatenate(parts))
            if len(x) and ranges[key] > 1:
                cuts[key] = np.unique(x[(np.arange(1, ranges[key]) * len(x)) // ranges[key]])
    arrays = lambda row: (np.frombuffer(v.as_buffer(), kind) for v, kind in zip(row, (np.float64, np.int64, np.int64)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, *row in zip(batch.column("_key").to_pylist(), *(batch.column(c) for c in ("score", "hit", "n"))):
                score, hit, n = arrays(row)
                ends = np.r_[0, np.searchsorted(score, cuts.get(key, np.zeros(0)), side="left"), len(score)]
                rows += [(key, j, score[a:b].tobytes(), hit[a:b].tobytes(), n[a:b].tobytes()) for j, (a, b) in enumerate(zip(ends, ends[1:])) if a < b]
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], ["_key", "_range", "score", "hit", "n"])

    def pools(keys: pa.ChunkedArray, lo: np.ndarray, hi: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> pa.Table:
        first, last, m, w = pooled(np.arange(len(lo)).astype(np.float64), mean, weight)
        return pa.table({"_key": pa.array(np.full(len(m), keys[0].as_py()), pa.int32()), "lo": lo[first.astype(np.int64)],
                         "hi": hi[last.astype(np.int64)], "mean": m, "weight": w})

    def of_scores(table: pa.Table) -> pa.Table:
        parts = [list(arrays(row)) for row in zip(*(table.column(c) for c in ("score", "hit", "n")))]
        score, hit, n = _folded_scores(*(np.concatenate(x) for x in zip(*parts)))
        return pools(table.column("_key"), score, score, hit / n, n.astype(np.float64))

    def of_pools(table: pa.Table) -> pa.Table:
        table = table.sort_by("lo")
        return pools(table.column("_key"), *(np.asarray(table.column(c)) for c in ("lo", "hi", "mean", "weight")))

    out = packed.table.select("_key", "score", "hit", "n").mapInArrow(cut, "_key int, _range int, score binary, hit binary, n binary").groupBy(
        "_key", "_range").applyInArrow(of_scores, schema)
    return out.groupBy("_key").applyInArrow(of_pools, schema) if cuts else out


# --- metrics ---------------------------------------------------------------------------------

def temperature_sums(ft: FoldTable, fits: Sequence[Fit], prep: Prepared, model: np.ndarray | Trees | Forest, grid: Sequence[float],
                     clip: float, eps: float) -> dict[int, np.ndarray]:
    """Of each slot, the mean log loss of its calibration rows at every temperature, probabilities clipped first."""
    table, scored = _scored(ft, fits, prep, model, CALIB)
    slots = [f.slot for f in fits]

    def work(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for i, y, p, n in scored(batch):
            p = np.clip(p, clip, 1 - clip)
            losses = []
            for t in grid:
                q = p if t == 1.0 else p ** (1.0 / t)
                own = q[np.arange(len(y)), y] / q.sum(axis=1)
                losses.append(-(n * np.log(np.clip(own, eps, 1 - eps))).sum())
            yield slots[i], np.array([*losses, n.sum()])

    return {slot: v[:-1] / v[-1] for slot, v in _added(table, work).items()}


def run_sums(ft: FoldTable, fits: Sequence[Fit], prep: Prepared, model: np.ndarray | Trees | Forest,
             maps: Sequence[tuple[bool, Callable[[int, np.ndarray], np.ndarray] | None]], bin_of: Callable[[np.ndarray], np.ndarray], n_bins: int,
             eps: float) -> dict[tuple[int, int], np.ndarray]:
    """Sums over the test rows of each (run, slot), all runs in one pass: the confusion table, log loss, squared distance and,
    for each bin of the confidence, rows, hits and confidence.

    A run is whether its fit has learnt from calibration rows, too, and a function of slot and probabilities (None: as they
    are). ``bin_of`` gives the bin of confidences, ``n_bins`` for none.
    """
    table, scored = _scored(ft, fits, prep, model, TEST)
    k, n_slots = len(ft.labels), len(ft.slots)

    def work(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for i, y, raw, n in scored(batch):
            for j, (with_calib, change) in enumerate(maps):
                if with_calib != fits[i].with_calib:
                    continue
                p = raw if change is None else change(fits[i].slot, raw)
                best, at = p.argmax(axis=1), np.arange(len(p))
                hit = np.arange(k) == y[:, None]
                confidence, place = p[at, best], bin_of(p[at, best])
                yield j * n_slots + fits[i].slot, np.concatenate([
                    np.bincount(y * k + best, n, k * k), [-(n * np.log(np.clip(p[at, y], eps, 1 - eps))).sum(), (n[:, None] * (p - hit) ** 2).sum()],
                    np.bincount(place, n, n_bins + 1), np.bincount(place, n * (best == y), n_bins + 1), np.bincount(place, n * confidence, n_bins + 1)])

    return {divmod(key, n_slots): v for key, v in _added(table, work).items()}
