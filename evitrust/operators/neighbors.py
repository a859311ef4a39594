"""Exact nearest neighbours between two vector tables, and distance scores built on them.

Train rows are put into cells around a fixed number of pivots. By the triangle inequality a test row visits only the
cells that can hold one of its k nearest rows. Test rows of neighbouring cells form teams of bounded size, and the train rows
of a cell travel once to each team that visits it, packed into blocks: what moves is train rows times teams, never a
test row to its cells. A team meets a bounded part of its blocks in one cogroup, which keeps k rows per test row over
all of them, and these short lists are merged per test row. Nothing is broadcast except the pivots, one radius per cell and
the cells of each team.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from evitrust.sources.shared import written

CHUNK_ROWS = 4096     # rows of a block
TEAMS = 16            # teams of small tables, of TEAM_ROWS rows at least
TEAM_ROWS = 1024
TEAM_CHUNKS = 8       # test rows of a team at most (about), in rows of a block
PART_CHUNKS = 32      # train rows that a team meets in one cogroup, in rows of a block
SLICE_ROWS = 512      # test rows whose distances are computed at once
MAX_PIVOTS = 256
MAX_CLASSES = 1000
_SLACK = 1e-6  # rounding allowance on pruning bounds


def _matrix(vectors: pd.Series, metric: str, side: str) -> np.ndarray:
    """Rows of a batch as float64. For cosine they are scaled to unit length; a zero vector gets its
    own direction per side, so that its distance to everything is 1."""
    return _unit(np.asarray(vectors.tolist(), dtype=np.float64), metric, side)


def _unit(x: np.ndarray, metric: str, side: str) -> np.ndarray:
    if metric == "euclidean":
        return x
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    empty = norm[:, 0] == 0
    x = x / np.where(norm == 0, 1.0, norm)
    own = np.zeros((len(x), 2))
    own[empty, 0 if side == "test" else 1] = 1.0
    return np.hstack([x, own])


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        return 1.0 - a @ b.T
    out = np.empty((len(a), len(b)))
    for i, row in enumerate(a):  # differences, since the expanded square loses small distances
        d = b - row
        out[i] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def _metric_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances for the pruning bounds (valid for unit vectors under cosine as well)."""
    sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(sq, 0.0))


@dataclass
class _Cells:
    """Pivots and, per class, the size and radius of each pivot's cell (fixed, small)."""

    pivots: np.ndarray
    stats: dict[object, tuple[np.ndarray, np.ndarray]]


def _assign(metric: str, side: str, pivots: np.ndarray, id_col: str, by: str | None) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                d = _metric_distances(_matrix(b["vec"], metric, side), pivots)
                cell = d.argmin(axis=1)
                yield b.assign(cell=cell.astype("int32"), to_pivot=d[np.arange(len(b)), cell])
    return run


def _visits(metric: str, cells: _Cells, k: int) -> Callable:
    """Cells a test row has to look at. The k nearest rows are within ``reach``, the distance by which
    the closest cells have k rows for sure; cells that start beyond it are left out."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            d = _metric_distances(_matrix(b["vec"], metric, "test"), cells.pivots)
            visited = []
            for row, cls in zip(d, b["_by"]):
                size, radius = cells.stats[cls]
                there = size > 0
                upper = np.where(there, row + radius, np.inf)
                order = np.argsort(upper)
                full = np.searchsorted(np.cumsum(size[order]), k)
                reach = upper[order[full]] if full < len(order) else np.inf
                visited.append(np.flatnonzero(there & (row - radius <= reach + _SLACK)).tolist())
            yield b.assign(cells=visited)
    return run


def _nearest(metric: str, k: int) -> Callable:
    def run(test: pd.DataFrame, train: pd.DataFrame) -> pd.DataFrame:
        names = ["test_id", "train_id", "distance"]
        if not len(test) or not len(train):
            return pd.DataFrame({"test_id": pd.Series(dtype=object), "train_id": pd.Series(dtype=object),
                                 "distance": pd.Series(dtype=float)})
        train = train.sort_values("train_id")
        ids = train["train_id"].to_numpy()
        right = _matrix(train["vec"], metric, "train")
        out = []
        for start in range(0, len(test), 512):
            part = test.iloc[start:start + 512]
            d = _distances(_matrix(part["vec"], metric, "test"), right, metric)
            best = np.argsort(d, axis=1, kind="stable")[:, :k]
            out.append(pd.DataFrame({
                "test_id": np.repeat(part["test_id"].to_numpy(), best.shape[1]),
                "train_id": ids[best].ravel(),
                "distance": np.take_along_axis(d, best, axis=1).ravel(),
            }, columns=names))
        return pd.concat(out)
    return run


def nearest_neighbors(test: DataFrame, train: DataFrame, id_col: str, vector: str, k: int,
                      metric: str = "cosine", test_class: str | None = None,
                      train_class: str | None = None, chunk_rows: int = CHUNK_ROWS,
                      max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """(test_id, train_id, distance, rank) of the k nearest train rows of every test row.

    With ``test_class``/``train_class`` only train rows of the test row's class count (fewer than k when
    the class is smaller); a test row whose class has no train row looks at all classes.
    """
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"unknown metric {metric}")
    kinds = dict(test.dtypes)
    id_type = kinds[id_col]
    as_vec = F.col(vector).cast("array<double>").alias("vec")
    with_class = test_class is not None
    train_by = F.col(train_class).cast("string") if with_class else F.lit("")
    tr = train.select(F.col(id_col).alias("train_id"), as_vec, train_by.alias("_by"))
    te = test.select(F.col(id_col).alias("test_id"), as_vec,
                     (F.col(test_class).cast("string") if with_class else F.lit("")).alias("_by"))

    sizes = {r["_by"]: r["n"] for r in tr.groupBy("_by").agg(F.count(F.lit(1)).alias("n")).limit(MAX_CLASSES + 1).collect()}
    if len(sizes) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes; {train_class} is not a class label")
    n_train = sum(sizes.values())
    if n_train == 0:
        raise ValueError("no train rows")
    n_pivots = max(1, min(max_pivots, -(-n_train // chunk_rows)))
    # TakeOrdered over a hash: a fixed, small, reproducible sample
    picked = tr.orderBy(F.xxhash64("train_id"), "train_id").select("vec").limit(n_pivots).toPandas()
    pivots = _matrix(picked["vec"], metric, "train")

    placed = tr.mapInPandas(
        _assign(metric, "train", pivots, "train_id", "_by"),
        f"train_id {id_type}, vec array<double>, _by string, cell int, to_pivot double")
    stats = {c: (np.zeros(n_pivots, dtype=np.int64), np.zeros(n_pivots)) for c in sizes}
    for r in placed.groupBy("_by", "cell").agg(
            F.count(F.lit(1)).alias("n"), F.max("to_pivot").alias("r")).collect():  # classes x pivots rows
        stats[r["_by"]][0][r["cell"]] = r["n"]
        stats[r["_by"]][1][r["cell"]] = r["r"]
    if with_class:  # the fallback class holds every row
        total = sum(s for s, _ in stats.values())
        widest = np.max([r for _, r in stats.values()], axis=0)
        stats[None] = (total, widest)
        known = F.col("_by").isin(list(sizes))
        te = te.withColumn("_by", F.when(known, F.col("_by")))
    cells = _Cells(pivots, stats)
    routed = written(te.mapInPandas(_visits(metric, cells, k), f"test_id {id_type}, vec array<double>, _by string, cells array<int>"))
    return _met(routed, placed.drop("to_pivot"), stats, metric, k, chunk_rows, id_type)


def _met(routed: DataFrame, placed: DataFrame, stats: dict, metric: str, k: int, chunk_rows: int, id_type: str) -> DataFrame:
    """The k nearest train rows of every test row, of those in the cells it visits: (test_id, train_id, distance, rank)."""
    spark = routed.sparkSession
    classes = [c for c in stats if c is not None]
    sizes = sum(stats[c][0] for c in classes)
    n_cells = len(sizes)
    # test rows of one first cell are together, in teams of bounded size; a class is no part of a team, its rows are told apart there
    routed = routed.withColumn("home", F.coalesce(F.get("cells", F.lit(0)), F.lit(0)))
    counts = np.zeros(n_cells, np.int64)
    for r in routed.groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect():    # one row a cell
        counts[r["home"]] = r["n"]
    team_rows, part_rows = min(max(int(counts.sum()) // TEAMS, TEAM_ROWS), TEAM_CHUNKS * chunk_rows), PART_CHUNKS * chunk_rows
    team_of = (np.cumsum(counts) - counts) // team_rows                             # neighbours in number until they are enough
    shares = np.maximum(1, -(-counts // team_rows))                                 # of a cell with very many test rows
    homes = F.broadcast(spark.createDataFrame([(j, int(team_of[j]), int(shares[j])) for j in range(n_cells)], "home int, team int, shares int"))
    left = routed.join(homes, "home").withColumn("share", F.pmod(F.xxhash64("test_id"), F.col("shares")).cast("int")).drop("shares", "home")

    needed: dict[int, np.ndarray] = {}
    for r in left.select("team", F.explode("cells").alias("cell")).distinct().collect():    # teams x cells at most
        needed.setdefault(r["team"], np.zeros(n_cells, bool))[r["cell"]] = True
    shares_of = {int(g): int(shares[team_of == g].max()) for g in np.unique(team_of)}
    parts = {g: max(1, -(-int(sizes[cells].sum()) // part_rows)) for g, cells in needed.items()}
    if not needed:
        return spark.createDataFrame([], f"test_id {id_type}, train_id {id_type}, distance double, rank int")
    wanted = F.broadcast(spark.createDataFrame([(g, int(j), parts[g], shares_of[g]) for g, cells in needed.items() for j in np.flatnonzero(cells)],
                                               "team int, cell int, parts int, shares int"))
    n_parts = F.broadcast(spark.createDataFrame(list(parts.items()), "team int, parts int"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = left.join(n_parts, "team").withColumn("part", each("parts")).drop("parts")
    right = placed.join(wanted, "cell").withColumn("part", F.pmod(F.xxhash64("train_id", F.lit(1)), F.col("parts")).cast("int")).withColumn(
        "share", each("shares")).drop("parts", "shares")
    keys = ["team", "share", "part"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        _team_nearest(metric, k, classes, id_type), f"test_id {id_type}, train_id array<{id_type}>, distance array<double>")
    found = met.select("test_id", F.inline(F.arrays_zip("train_id", "distance")))
    w = Window.partitionBy("test_id").orderBy("distance", "train_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _vectors(column: pa.ChunkedArray, metric: str, side: str) -> np.ndarray:
    values = column.combine_chunks()
    return _unit(np.asarray(values.flatten()).reshape(len(values), -1), metric, side)


def _team_nearest(metric: str, k: int, classes: Sequence[str], id_type: str) -> Callable:
    """The k nearest of the train rows of each test row's class (of all, without one), as arrays in order of (distance, id)."""
    def run(test: pa.Table, train: pa.Table) -> pa.Table:
        kind = test.schema.field("test_id").type
        who, whom, far = [], [], []
        if test.num_rows and train.num_rows:
            train = train.sort_by("train_id")
            right, cell = _vectors(train.column("vec"), metric, "train"), np.asarray(train.column("cell"))
            left = _vectors(test.column("vec"), metric, "test")
            train_by, test_by = (np.array(x.column("_by").to_pylist(), object) for x in (train, test))
            lists = test.column("cells").combine_chunks()
            visits = np.zeros((len(left), int(max(cell.max(), np.asarray(lists.flatten()).max(initial=0))) + 1), bool)
            visits[np.repeat(np.arange(len(left)), np.asarray(lists.value_lengths())), np.asarray(lists.flatten())] = True
            for c in [*classes, None]:
                mine = np.flatnonzero(test_by == c) if c is not None else np.flatnonzero([x is None for x in test_by])
                theirs = np.flatnonzero(train_by == c) if c is not None else np.arange(len(right))
                if not len(mine) or not len(theirs):
                    continue
                for start in range(0, len(mine), SLICE_ROWS):
                    at = mine[start:start + SLICE_ROWS]
                    rows, cols, d = _k_smallest(left[at], right, theirs, visits[at], cell, metric, k)
                    who.append(at[rows])
                    whom.append(cols)
                    far.append(d)
        who, whom, far = (np.concatenate([*x, np.zeros(0, t)]) for x, t in ((who, np.int64), (whom, np.int64), (far, np.float64)))
        first = np.flatnonzero(np.diff(who, prepend=-1))
        ends = pa.array(np.r_[first, len(who)], pa.int32())
        ids = train.column("train_id").combine_chunks().take(pa.array(whom)) if len(whom) else pa.array([], kind)
        return pa.table({"test_id": test.column("test_id").combine_chunks().take(pa.array(who[first])) if len(who) else pa.array([], kind),
                         "train_id": pa.ListArray.from_arrays(ends, ids), "distance": pa.ListArray.from_arrays(ends, pa.array(far))})
    return run


def _k_smallest(left: np.ndarray, right: np.ndarray, theirs: np.ndarray, visits: np.ndarray, cell: np.ndarray, metric: str,
                k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in ``right``, distance), k of a row at most, by (row, distance, place). Blocks of ``theirs`` are looked at in
    turn, and only what lies within the k-th distance so far is kept."""
    limit = np.full(len(left), np.inf)
    rows, cols, far = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    theirs = theirs[np.argsort(cell[theirs], kind="stable")]
    for start in range(0, len(theirs), CHUNK_ROWS):
        own = theirs[start:start + CHUNK_ROWS]
        look = np.flatnonzero(visits[:, np.unique(cell[own])].any(axis=1))
        if not len(look):
            continue
        d, near = _distances(left[look], right[own], metric), limit[look]
        if len(own) >= k and np.isinf(near).any():      # the k-th of a block bounds what may count
            near = np.minimum(near, np.partition(d, k - 1, axis=1)[:, k - 1])
        i, j = np.nonzero(d <= near[:, None])
        rows, cols, far = np.r_[rows, look[i]], np.r_[cols, own[j]], np.r_[far, d[i, j]]
        order = np.lexsort((cols, far, rows))
        rows, cols, far = rows[order], cols[order], far[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        limit[rows[place == k - 1]] = far[place == k - 1]
        kept = place < k
        rows, cols, far = rows[kept], cols[kept], far[kept]
    return rows, cols, far


def mean_distances(neighbors: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Mean distance to the first k neighbours for every k, from one neighbour table: (test_id, k, distance)."""
    kept = neighbors.withColumn("k", F.explode(F.filter(
        F.array(*[F.lit(int(k)) for k in ks]), lambda k: k >= F.col("rank"))))
    return kept.groupBy("test_id", "k").agg(F.avg("distance").alias("distance"))


def distance_scores(test: DataFrame, train: DataFrame, id_col: str, vector: str, k: int,
                    method: str = "cosine", test_class: str | None = None,
                    train_class: str | None = None, **blocks) -> DataFrame:
    """(test_id, ood_distance, ood_method). ``method`` is a metric, optionally with ``_class`` (only train
    rows of the predicted class) or ``_margin`` (class distance minus overall distance)."""
    metric = method.removesuffix("_class").removesuffix("_margin")

    def score(*classes):
        near = nearest_neighbors(test, train, id_col, vector, k, metric, *classes, **blocks)
        return near.groupBy("test_id").agg(F.avg("distance").alias("ood_distance"))

    if method.endswith("_class"):
        out = score(test_class, train_class)
    elif method.endswith("_margin"):
        inner = score(test_class, train_class).withColumnRenamed("ood_distance", "_c")
        out = inner.join(score(), "test_id").select(
            "test_id", (F.col("_c") - F.col("ood_distance")).alias("ood_distance"))
    else:
        out = score()
    return out.withColumn("ood_method", F.lit(method))


def fold_distance_scores(rows: DataFrame, fold: str, folds: Sequence[int], id_col: str, vector: str, k: int,
                         **options) -> DataFrame:
    """Distance of every row to the rows of the other folds: one job per fold, folds are few."""
    out = None
    for f in folds:
        part = distance_scores(rows.where(F.col(fold) == f), rows.where(F.col(fold) != f),
                               id_col, vector, k, **options).withColumn(fold, F.lit(f))
        out = part if out is None else out.unionByName(part)
    return out


# --- projection ------------------------------------------------------------------------------

def _gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = None
    for b in batches:
        if len(b):
            x = np.asarray(b["vec"].tolist(), dtype=np.float64)
            total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})


def svd_directions(train: DataFrame, vector: str, n_components: int) -> np.ndarray:
    """Leading right singular vectors of the uncentred train matrix (features x components).

    Each task sums its own feature-by-feature products; only that small matrix reaches the driver.
    """
    sums = train.select(F.col(vector).cast("array<double>").alias("vec")).mapInPandas(
        _gram, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    p = int(sums["i"].max()) + 1
    gram = np.zeros((p, p))
    gram[sums["i"], sums["j"]] = sums["v"]
    n = min(n_components, max(1, p - 1))
    _, vectors = np.linalg.eigh((gram + gram.T) / 2)
    top = vectors[:, ::-1][:, :n]
    return top * np.sign(top[np.abs(top).argmax(axis=0), np.arange(n)])  # fixed signs


def project(df: DataFrame, id_cols: Sequence[str], vector: str, directions: np.ndarray, out: str = "vec") -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.asarray(b[vector].tolist(), dtype=np.float64) @ directions
                yield b.drop(columns=[vector]).assign(**{out: x.tolist()})
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in id_cols) + f", {out} array<double>"
    return df.select(*id_cols, F.col(vector).cast("array<double>").alias(vector)).mapInPandas(run, schema)


def standardize(train: DataFrame, others: Sequence[DataFrame], vector: str) -> list[DataFrame]:
    """Scale each coordinate by the train mean and deviation (constant coordinates are only centred)."""
    stats = train.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(
        F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("i").collect()  # one row per coordinate
    mean = F.array(*[F.lit(r["m"]) for r in stats])
    scale = F.array(*[F.lit(r["s"] or 1.0) for r in stats])
    scaled = F.transform(F.arrays_zip(F.col(vector).alias("x"), mean.alias("m"), scale.alias("s")),
                         lambda z: (z["x"] - z["m"]) / z["s"])
    return [d.withColumn(vector, scaled) for d in others]


def svd_distance_scores(test: DataFrame, train: DataFrame, id_col: str, vector: str, k: int,
                        n_components: int = 30, suffix: str = "", test_class: str | None = None,
                        train_class: str | None = None, **blocks) -> DataFrame:
    """Euclidean neighbour distance after projection on the leading train directions and scaling."""
    directions = svd_directions(train, vector, n_components)
    test_ids = [id_col] + ([test_class] if test_class else [])
    train_ids = [id_col] + ([train_class] if train_class else [])
    low_train = project(train, train_ids, vector, directions, "_low")
    low_test = project(test, test_ids, vector, directions, "_low")
    a, b = standardize(low_train, [low_test, low_train], "_low")
    return distance_scores(a, b, id_col, "_low", k, "euclidean" + suffix, test_class, train_class, **blocks)
