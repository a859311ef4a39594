"""Distance of each test row to the learning rows of its own fold, on the features prepared for that fold.

Rows are written once, coded, with their roles in every (seed, fold) slot (``fold_models.fold_table``). A row's vector in a
slot is sparse: a one for each category that the slot's learning rows hold, and the filled, scaled numbers. It is never
stored: two rows share as many ones as they have equal codes, so a task makes the vectors of a slot from the codes.
A row therefore travels once for all slots, not once a slot.

Search is exact. Rows lie in cells around a bounded number of pivots of their own categories, and cells are cut into blocks of
bounded size. For each slot and class a cell has a size and a radius. A block is searched for neighbours of its own test rows
first, which says how far their k nearest rows of every class can be: by the triangle inequality only cells that start within
that distance matter. Test rows of neighbouring cells form large teams, and the learning rows of a block travel once to each
team that may need them, never a test row to its cells: what moves is blocks times teams. A team meets a bounded part of its
blocks at once, and no more than k rows of a class leave a part for a test row. The overall, class and margin distances at
every smaller k are read from these lists.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from evitrust import contracts
from evitrust.operators.fold_models import TEST, Fit, FoldTable, Prepared, Rows, _codes
from evitrust.sources.shared import written

CHUNK_ROWS = 4096      # rows of a block, at most (about)
CELL_ROWS = 1024       # rows of a cell, on average, as long as there are pivots
MAX_PIVOTS = 4096
TEAMS = 64             # teams of small tables, of TEAM_ROWS rows at least
TEAM_ROWS = 1024
TEAM_CHUNKS = 8        # test rows of a team at most (about), in rows of a block
PART_CHUNKS = 32       # learning rows that a team meets at once, in rows of a block
SLICE_ROWS = 1024      # rows whose distances are computed at once
_SLACK = 1e-6     # rounding allowance on pruning bounds


class _Vectors:
    """Vectors of some rows in one slot: codes of the ones (-1: none), numbers, length."""

    def __init__(self, prep: Prepared, i: int, rows: Rows, m: np.ndarray):
        codes = _codes(prep, i, rows)[m]
        for c, seen in enumerate(prep.seen[i]):
            known = (codes[:, c] >= 0) & (seen[np.maximum(codes[:, c], 0)] if len(seen) else False)
            codes[:, c] = np.where(known, codes[:, c], -1)
        x = rows.nums[m]
        self.codes = codes
        self.x = np.where(np.isnan(x), prep.fill[i], x) / prep.scale[i] * prep.used[i]
        self.length = np.sqrt((codes >= 0).sum(axis=1) + (self.x * self.x).sum(axis=1))

    def take(self, at: np.ndarray) -> _Vectors:
        out = object.__new__(_Vectors)
        out.codes, out.x, out.length = self.codes[at], self.x[at], self.length[at]
        return out

    def _scaled(self) -> np.ndarray:
        return np.divide(1.0, self.length, out=np.zeros_like(self.length), where=self.length > 0)[:, None]

    def cosine_to(self, other: _Vectors) -> np.ndarray:
        """Zero vectors are at right angles to everything. Only the codes that the own rows have can meet."""
        mine, theirs = [self.x], [other.x]
        for c in range(self.codes.shape[1]):
            codes = np.unique(self.codes[:, c])
            codes = codes[codes >= 0]
            mine.append(self.codes[:, c, None] == codes)
            theirs.append(other.codes[:, c, None] == codes)
        return (np.hstack(mine) * self._scaled()) @ (np.hstack(theirs) * other._scaled()).T

    def cosine_with(self, other: _Vectors, at: np.ndarray) -> np.ndarray:
        """Of each row to one row of the other vectors."""
        dot = (self.x * other.x[at]).sum(axis=1) + ((self.codes == other.codes[at]) & (self.codes >= 0)).sum(axis=1)
        return dot * self._scaled()[:, 0] * other._scaled()[at, 0]

    def alike(self, other: _Vectors) -> np.ndarray:
        """Which rows have all codes in common."""
        return np.logical_and.reduce([self.codes[:, c, None] == other.codes[None, :, c] for c in range(self.codes.shape[1])]
                                     or [np.ones((len(self.length), len(other.length)), bool)])


def _chord(cosine: np.ndarray) -> np.ndarray:
    """Distance of unit vectors, for which the triangle inequality holds."""
    return np.sqrt(np.maximum(2.0 - 2.0 * cosine, 0.0))


def _only(rows: Rows, at: np.ndarray) -> np.ndarray:
    m = np.zeros(rows.n, bool)
    m[at] = True
    return m


def _slices(at: np.ndarray) -> Iterator[np.ndarray]:
    return (at[start:start + SLICE_ROWS] for start in range(0, len(at), SLICE_ROWS))


def _schema(df: DataFrame, *more: str) -> str:
    return ", ".join([f"`{c}` {t}" for c, t in df.dtypes] + list(more))


def _spread_out(vectors: _Vectors, n: int) -> list[int]:
    """Half of the rows each the farthest from those before, which reaches every category and edge, half the first others."""
    picked, far = [0], np.full(len(vectors.length), np.inf)

    def one(j: int) -> np.ndarray:
        to = np.full(len(far), j)
        return _chord(vectors.cosine_with(vectors, to)) + 10.0 * (vectors.codes != vectors.codes[to]).any(axis=1)

    while len(picked) < (n + 1) // 2:
        far = np.minimum(far, one(picked[-1]))
        far[picked[-1]] = -1.0
        picked.append(int(far.argmax()))
    rest = np.setdiff1d(np.arange(len(far)), picked)
    return sorted(picked + rest[:n - len(picked)].tolist())


def neighbor_lists(ft: FoldTable, fits: Sequence[Fit], prep: Prepared, k: int, chunk_rows: int = CHUNK_ROWS,
                   max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """(row_id, slot, y, train_id, distance): arrays that hold the k nearest learning rows of every class ``y`` for each test
    row of each slot, by cosine distance, ties by train_id. ``fits`` has one entry a slot, in the order of ``ft.slots``.

    A test row that meets many blocks has several rows, whose arrays hold the k nearest rows together. Learning rows without a
    listed label are no neighbours. A class with fewer than k rows gives all it has. Rows that are a test row in no slot, and
    slots without learning rows, give no row; an empty table gives an empty result.
    """
    n_cats, n_nums, n_labels = len(ft.categories), len(ft.numeric), len(ft.labels)
    id_kind = dict(ft.table.dtypes)["row_id"]
    found_schema = f"row_id {id_kind}, slot int, y array<int>, train_id array<{id_kind}>, distance array<double>"
    n_pivots = int(min(max_pivots, max(1, np.sqrt(ft.n_rows) / 2, ft.n_rows // CELL_ROWS)))
    # a fixed, bounded, reproducible sample
    sample = ft.table.orderBy(F.xxhash64("row_id"), "row_id").limit(4 * n_pivots).toArrow().combine_chunks()
    if not sample.num_rows:
        return ft.table.sparkSession.createDataFrame([], found_schema)
    n_pivots = min(n_pivots, sample.num_rows)
    rows = Rows(sample.to_batches()[0], n_cats, n_nums)
    chosen = _spread_out(_Vectors(prep, 0, rows, np.ones(rows.n, bool)), n_pivots)
    middle = Rows(sample.take(pa.array(chosen)).combine_chunks().to_batches()[0], n_cats, n_nums)
    known: dict[int, _Vectors] = {}     # of a task

    def pivots(i: int) -> _Vectors:
        if i not in known:
            known[i] = _Vectors(prep, i, middle, np.ones(middle.n, bool))
        return known[i]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rows = Rows(b, n_cats, n_nums)
                own = [_Vectors(prep, 0, rows, _only(rows, at)) for at in _slices(np.arange(rows.n))]
                cell = np.concatenate([(v.cosine_to(pivots(0)) + 10.0 * v.alike(pivots(0))).argmax(axis=1) for v in own])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], [*b.schema.names, "cell"])

    table = ft.table.withColumn("roles", F.col("roles").cast("array<tinyint>"))
    placed = written(table.mapInArrow(place, _schema(table, "cell int")))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.zeros((len(fits), n_labels, n_pivots), np.int64)
        radius = np.zeros((len(fits), n_labels, n_pivots))
        for b in batches:
            if not b.num_rows:
                continue
            rows, cell = Rows(b, n_cats, n_nums), np.asarray(b.column("cell"))
            for i, f in enumerate(fits):
                m = f.learns(rows.roles) & (rows.y >= 0)
                y, own = rows.y[m], cell[m]
                if len(y):
                    far = _chord(_Vectors(prep, i, rows, m).cosine_with(pivots(i), own))
                    np.add.at(size[i], (y, own), 1)
                    np.maximum.at(radius[i], (y, own), far)
        at = np.nonzero(size)
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)) for a in at] + [pa.array(size[at]), pa.array(radius[at])],
                                         ["slot", "y", "cell", "n", "r"])

    size, radius = np.zeros((len(fits), n_labels, n_pivots), np.int64), np.zeros((len(fits), n_labels, n_pivots))
    for r in placed.mapInArrow(measure, "slot int, y int, cell int, n bigint, r double").groupBy("slot", "y", "cell").agg(
            F.sum("n").alias("n"), F.max("r").alias("r")).collect():      # slots x classes x pivots rows at most
        size[r.slot, r.y, r.cell], radius[r.slot, r.y, r.cell] = r.n, r.r

    cut = written(placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(chunk_rows))).cast("int").alias("n")))
    blocks = placed.join(F.broadcast(cut), "cell").withColumn(
        "chunk", F.pmod(F.xxhash64("row_id", F.lit(1)), F.col("n")).cast("int")).drop("n")

    team_rows, part_rows = min(max(ft.n_rows // TEAMS, TEAM_ROWS), TEAM_CHUNKS * chunk_rows), PART_CHUNKS * chunk_rows
    n_rows = np.zeros(n_pivots, np.int64)
    for r in placed.groupBy("cell").count().collect():      # one row a cell
        n_rows[r["cell"]] = r["count"]
    home = pivots(0)
    order = np.lexsort((home.x[:, 0] if n_nums else home.length, *home.codes.T))
    team = np.empty(n_pivots, np.int64)     # neighbouring cells until they hold enough rows
    team[order] = np.cumsum(n_rows[order]) // team_rows

    def survey(block: pa.Table) -> pa.Table:
        """Test rows with their slots, and how far to look for each class there."""
        rows = Rows(block.combine_chunks().to_batches()[0], n_cats, n_nums)
        found = [(np.zeros(0, np.intp), np.zeros(0, np.intp), np.zeros((0, n_labels)))]
        for i, f in enumerate(fits):
            learns = f.learns(rows.roles)
            for at in _slices(np.flatnonzero(rows.roles[:, f.slot] == TEST)):
                own, far = _Vectors(prep, i, rows, _only(rows, at)), np.zeros((len(at), n_labels))
                for y in range(n_labels):
                    here = learns & (rows.y == y)
                    if here.sum() >= k:
                        d = 1.0 - own.cosine_to(_Vectors(prep, i, rows, here))
                        reach = _chord(1.0 - np.partition(d, k - 1, axis=1)[:, k - 1])
                    else:       # the distance within which whole cells hold k rows for sure
                        upper = np.where(size[i, y] > 0, _chord(own.cosine_to(pivots(i))) + radius[i, y], np.inf)
                        order = np.argsort(upper, axis=1)
                        enough = np.cumsum(size[i, y][order], axis=1) >= k
                        reach = np.where(enough.any(axis=1), np.take_along_axis(upper, order, 1)[np.arange(len(at)), enough.argmax(axis=1)], np.inf)
                    far[:, y] = reach + _SLACK
                found.append((at, np.full(len(at), i), far))
        who, slot, far = (np.concatenate(v) for v in zip(*found))
        order = np.lexsort((slot, who))
        who, slot, far = who[order], slot[order], far[order]
        first = np.flatnonzero(np.diff(who, prepend=-1))
        ends = np.r_[first, len(who)]
        return block.select(["row_id", "cats", "nums", "cell"]).take(pa.array(who[first])).append_column(
            "slots", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(slot, pa.int32()))).append_column(
            "reach", pa.ListArray.from_arrays(pa.array(ends * n_labels, pa.int32()), pa.array(far.ravel())))

    class Tests:
        """Surveyed rows: ``row``, ``slots`` and ``reach`` have one entry for each slot of a row."""

        def __init__(self, batch: pa.RecordBatch):
            n = batch.num_rows
            self.rows = Rows.of(*(np.asarray(batch.column(c).flatten()).astype(t).reshape(n, w) for c, w, t in (
                ("cats", n_cats, np.int64), ("nums", n_nums, np.float64))))
            self.cell = np.asarray(batch.column("cell"))
            self.row = np.repeat(np.arange(n), np.asarray(batch.column("slots").value_lengths()))
            self.slots = np.asarray(batch.column("slots").flatten())
            self.reach = np.asarray(batch.column("reach").flatten()).reshape(-1, n_labels)

        def of(self, i: int) -> Iterator[tuple[np.ndarray, np.ndarray, _Vectors]]:
            """Rows of a slot, some at a time, in order of cells: places, distances to look within, vectors."""
            mine = np.flatnonzero(self.slots == i)
            for some in _slices(mine[np.argsort(self.cell[self.row[mine]], kind="stable")]):
                some = np.sort(some)        # rows rise, as in the vectors
                yield self.row[some], self.reach[some], _Vectors(prep, i, self.rows, _only(self.rows, self.row[some]))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells that the test rows of each team need."""
        need: dict[int, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                tests = Tests(b)
                for i in range(len(fits)):
                    for at, reach, own in tests.of(i):
                        near, own_team = _chord(own.cosine_to(pivots(i))), team[tests.cell[at]]
                        hit = np.zeros(near.shape, bool)
                        for y in range(n_labels):
                            hit |= (size[i, y] > 0) & (near - radius[i, y] <= reach[:, y, None])
                        for g in np.unique(own_team).tolist():
                            need[g] = need.get(g, False) | hit[own_team == g].any(axis=0)
        for g, cells in need.items():
            cells = np.flatnonzero(cells)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), g), pa.int32()), pa.array(cells, pa.int32())], ["team", "cell"])

    kinds = dict(table.dtypes)
    tests = written(blocks.groupBy("cell", "chunk").applyInArrow(
        survey, f"row_id {id_kind}, cats {kinds['cats']}, nums {kinds['nums']}, cell int, slots array<int>, reach array<double>"))
    needs = written(tests.mapInArrow(pair, "team int, cell int").distinct())       # at most teams x cells
    spark = ft.table.sparkSession
    cells = F.broadcast(spark.createDataFrame(
        [(j, int(team[j]), int(max(1, -(-n_rows[j] // team_rows)))) for j in range(n_pivots)], "cell int, own int, shares int"))
    # a team has as many shares as its largest cell, which each meet all its parts
    teams = needs.join(F.broadcast(spark.createDataFrame([(j, int(n_rows[j])) for j in range(n_pivots)], "cell int, n_rows long")), "cell").groupBy(
        "team").agg(F.ceil(F.sum("n_rows") / F.lit(float(part_rows))).cast("int").alias("parts")).join(
        cells.groupBy(F.col("own").alias("team")).agg(F.max("shares").alias("shares")), "team")
    teams = F.broadcast(written(teams))     # one row a team
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = tests.join(cells.select("cell", F.col("own").alias("team")), "cell").join(teams, "team").withColumn(
        "share", F.pmod(F.xxhash64("row_id", F.lit(0)), F.col("shares")).cast("int")).withColumn("part", each("parts")).drop("parts", "shares")
    right = blocks.where("y >= 0").join(needs.join(teams, "team"), "cell").withColumn(
        "part", F.pmod(F.xxhash64("cell", "chunk"), F.col("parts")).cast("int")).withColumn("share", each("shares")).drop("parts", "shares", "chunk")

    def meet(test: pa.Table, train: pa.Table) -> pa.Table:
        id_type = test.schema.field("row_id").type
        parts: list[tuple] = []
        if test.num_rows and train.num_rows:
            train = train.sort_by("row_id")
            a, b = Tests(test.combine_chunks().to_batches()[0]), Rows(train.combine_chunks().to_batches()[0], n_cats, n_nums)
            cells, place_of = np.unique(np.asarray(train.column("cell")), return_inverse=True)
            by_cell = np.argsort(place_of, kind="stable")
            ends = np.searchsorted(place_of[by_cell], np.arange(len(cells) + 1))
            for i, f in enumerate(fits):
                others, learns = {}, f.learns(b.roles)     # of each cell and class, vectors and places of its rows
                for c in range(len(cells)):
                    own = by_cell[ends[c]:ends[c + 1]]
                    own = own[learns[own]]
                    for y in range(n_labels):
                        at = own[b.y[own] == y]
                        if len(at):
                            others[c, y] = _Vectors(prep, i, Rows.of(b.cats[at], b.nums[at]), np.ones(len(at), bool)), at
                for at, reach, own in a.of(i):
                    parts += [(at[who], np.full(len(who), i), np.full(len(who), y), whom, d) for y, who, whom, d in nearest(i, own, reach, cells, others)]
        if not sum(len(p[0]) for p in parts):
            return pa.table({"row_id": pa.array([], id_type), "slot": pa.array([], pa.int32()), "y": pa.array([], pa.list_(pa.int32())),
                             "train_id": pa.array([], pa.list_(id_type)), "distance": pa.array([], pa.list_(pa.float64()))})
        who, slot, y, whom, d = (np.concatenate(v) for v in zip(*parts))
        order = np.lexsort((whom, d, y, slot, who))
        who, slot, y, whom, d = who[order], slot[order], y[order], whom[order], d[order]
        first = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (slot[1:] != slot[:-1])])
        ends = pa.array(np.r_[first, len(who)], pa.int32())
        ids = train.column("row_id").combine_chunks().take(pa.array(whom))
        return pa.table({"row_id": test.column("row_id").combine_chunks().take(pa.array(who[first])), "slot": pa.array(slot[first], pa.int32()),
                         "y": pa.ListArray.from_arrays(ends, pa.array(y, pa.int32())), "train_id": pa.ListArray.from_arrays(ends, ids),
                         "distance": pa.ListArray.from_arrays(ends, pa.array(d))})

    def nearest(i: int, own: _Vectors, reach: np.ndarray, cells: np.ndarray, others: dict[tuple[int, int], tuple]) -> Iterator[tuple]:
        """Of each class: places of rows, of their neighbours (both among those given), and distances; k of a row at most."""
        near = _chord(own.cosine_to(pivots(i).take(cells)))
        limit = 0.5 * reach.T ** 2          # cosine distance within which the k nearest rows are
        kept: list[list[tuple]] = [[] for _ in range(n_labels)]
        size_of, bound = np.zeros(n_labels, np.int64), 8 * k * len(reach)

        def trim(y: int) -> None:
            who, whom, d = (np.concatenate(v) for v in zip(*kept[y]))
            order = np.lexsort((whom, d, who))
            who, whom, d = who[order], whom[order], d[order]
            place = np.arange(len(who)) - np.searchsorted(who, who)
            limit[y, who[place == k - 1]] = d[place == k - 1]
            kept[y], size_of[y] = [(who[place < k], whom[place < k], d[place < k])], 0

        for (c, y), (other, at) in others.items():
            rows = np.flatnonzero(near[:, c] - radius[i, y, cells[c]] <= np.sqrt(2.0 * limit[y]) + _SLACK)
            if not len(rows):
                continue
            cosine = own.take(rows).cosine_to(other)
            found = np.flatnonzero(cosine >= (1.0 - limit[y, rows, None] - 1e-12))
            j, whom = np.divmod(found, len(at))
            kept[y].append((rows[j], at[whom], 1.0 - cosine.ravel()[found]))
            size_of[y] += len(j)
            if size_of[y] > bound:
                trim(y)
        for y in range(n_labels):
            if kept[y]:
                trim(y)
                yield y, *kept[y][0]


    keys = ["team", "share", "part"]
    right = right.select(*[F.col(c).alias(c) for c in right.columns])       # columns of its own, as both sides read one table
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, found_schema)


def fold_neighbors(ft: FoldTable, fits: Sequence[Fit], prep: Prepared, k: int, chunk_rows: int = CHUNK_ROWS,
                   max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """(row_id, slot, y, train_id, distance, rank): the neighbours of ``neighbor_lists``, one a row."""
    lists = neighbor_lists(ft, fits, prep, k, chunk_rows, max_pivots)
    found = lists.select("row_id", "slot", F.inline(F.arrays_zip("y", "train_id", "distance")))
    w = Window.partitionBy("row_id", "slot", "y").orderBy("distance", "train_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fold_distances(near: DataFrame, ft: FoldTable, predictions: DataFrame, ks: Sequence[int], row_id: str = "row_id") -> DataFrame:
    """(row_id, seed, fold, k, cosine, cosine_class, cosine_margin) from one neighbour table, for every k up to its own.

    ``near`` is a result of ``neighbor_lists`` or of ``fold_neighbors``. ``predictions`` holds (row_id, seed, fold, y_pred).
    ``cosine`` is the mean distance to the k nearest rows of any class, ``cosine_class`` to those of the predicted class (all it
    has, if fewer; of any class if it has none), ``cosine_margin`` the second less the first. Raises when predictions and
    distances do not cover the same rows.
    """
    slots = F.array(*[F.struct(F.lit(s).alias("seed"), F.lit(f).alias("fold")) for s, f in ft.slots])
    if "rank" in near.columns:
        lists = near.groupBy("row_id", "slot").agg(F.collect_list(F.struct("distance", "y")).alias("near"))
    else:
        lists = near.groupBy("row_id", "slot").agg(F.flatten(F.transform(
            F.collect_list(F.struct("distance", "y")), lambda p: F.arrays_zip(p["distance"], p["y"]))).alias("near"))

    def means(values: str) -> Column:
        """For every k the mean of the first k, null without values."""
        first = lambda k: F.slice(F.col(values)["distance"], 1, int(k))
        return F.when(F.size(values) > 0, F.array(*[F.aggregate(first(k), F.lit(0.0), lambda a, x: a + x) / F.size(first(k)) for k in ks]))

    lists = lists.select(F.col("row_id").alias(row_id), F.get(slots, F.col("slot")).alias("s"), F.array_sort("near").alias("near"))
    of_label = lambda j: F.filter("near", lambda x: x["y"] == j)
    own = [f"own{j}" for j in range(len(ft.labels))]
    lists = lists.select(row_id, "s", "near", *[of_label(j).alias(c) for j, c in enumerate(own)])
    # only means are kept: a number for each k and class
    lists = written(lists.select(row_id, "s.*", means("near").alias("all"), F.array(*map(means, own)).alias("own")))
    contracts.require_aligned(predictions, lists, [row_id, "seed", "fold"])
    place = F.array_position(F.array(*map(F.lit, ft.labels)), F.col("y_pred")).cast("int") - 1
    out = lists.join(predictions.select(row_id, "seed", "fold", F.coalesce(place, F.lit(-1)).alias("_p")), [row_id, "seed", "fold"])
    own_means = F.coalesce(F.get("own", F.col("_p")), F.col("all"))
    out = out.select(row_id, "seed", "fold", F.inline(F.arrays_zip(
        F.array(*[F.lit(int(k)) for k in ks]).alias("k"), F.col("all").alias("cosine"), own_means.alias("cosine_class"))))
    return out.withColumn("cosine_margin", F.col("cosine_class") - F.col("cosine"))
