"""Approximate nearest neighbours: an index of cells around trained centres, searched with a fixed number of probes.

Every row is indexed. The number of probes that reaches a wanted recall is measured on a bounded sample of queries whose
exact neighbours are looked up in the whole table. Centres start from a hashed sample and take a few averaging steps; each step is one pass in which a
task adds up its own rows, so one sum a cell and task moves. A search looks at the closest cells of each query only. The
number of cells is bounded, cells are cut into chunks, and no group grows with the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from evitrust.operators.neighbors import CHUNK_ROWS, _matrix, _metric_distances, _nearest, nearest_neighbors
from evitrust.sources.shared import written

MAX_CELLS = 1024
SAMPLE_QUERIES = 256


@dataclass
class CellIndex:
    """``rows``: train_id, vec, cell, of all rows; ``centres`` and ``sizes`` by cell."""

    rows: DataFrame
    centres: np.ndarray
    sizes: np.ndarray
    metric: str


def _closest(metric: str, side: str, centres: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(cell=_metric_distances(_matrix(b["vec"], metric, side), centres).argmin(axis=1).astype("int32"))
    return run


def _sums(metric: str, centres: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros_like(centres), np.zeros(len(centres), np.int64)
        for b in batches:
            if len(b):
                x = _matrix(b["vec"], metric, "train")
                cell = _metric_distances(x, centres).argmin(axis=1)
                np.add.at(total, cell, x)
                n += np.bincount(cell, minlength=len(centres))
        at = np.flatnonzero(n)
        cells, places = np.repeat(at, centres.shape[1]), np.tile(np.arange(centres.shape[1]), len(at))
        yield pd.DataFrame({"cell": cells.astype("int32"), "i": places.astype("int32"), "x": total[at].ravel(), "n": n[cells]})
    return run


def build_index(rows: DataFrame, id_col: str, vector: str, n_cells: int | None = None, rounds: int = 3,
                metric: str = "cosine") -> CellIndex:
    """Index of all rows with a vector. ``n_cells`` is the square root of the rows unless given, at most MAX_CELLS. A cell
    that gets no row keeps its centre. Equal vectors lie in one cell, which search cuts into chunks."""
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"unknown metric {metric}")
    table = rows.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("train_id"), F.col(vector).cast("array<double>").alias("vec"))
    n = table.count()
    if not n:
        raise ValueError("no rows to index")
    n_cells = min(MAX_CELLS, n_cells or max(1, int(np.sqrt(n))))
    start = table.orderBy(F.xxhash64("train_id"), "train_id").limit(n_cells).toPandas()      # at most MAX_CELLS rows
    centres = _matrix(start["vec"], metric, "train")
    for _ in range(rounds):
        moved = table.mapInPandas(_sums(metric, centres), "cell int, i int, x double, n bigint").groupBy("cell", "i").agg(
            (F.sum("x") / F.sum("n")).alias("x")).toPandas()                                 # cells x coordinates
        centres = centres.copy()
        centres[moved["cell"], moved["i"]] = moved["x"]
    kind = dict(table.dtypes)["train_id"]
    placed = written(table.mapInPandas(_closest(metric, "train", centres), f"train_id {kind}, vec array<double>, cell int"))
    sizes = np.zeros(len(centres), np.int64)
    for r in placed.groupBy("cell").count().collect():
        sizes[r["cell"]] = r["count"]
    return CellIndex(placed, centres, sizes, metric)


def _probes(index_metric: str, centres: np.ndarray, sizes: np.ndarray, probes: int, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            d = np.where(sizes > 0, _metric_distances(_matrix(b["vec"], index_metric, "test"), centres), np.inf)
            order = np.argsort(d, axis=1, kind="stable")
            enough = np.cumsum(sizes[order], axis=1) < k               # cells before it do not hold k rows
            look = np.minimum(np.maximum(enough.sum(axis=1) + 1, probes), int((sizes > 0).sum()))
            yield b.assign(cells=[o[:n].tolist() for o, n in zip(order, look)])
    return run


def search(index: CellIndex, queries: DataFrame, id_col: str, vector: str, k: int, probes: int = 8,
           chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(test_id, train_id, distance, rank) of the k nearest rows in the ``probes`` closest cells of each query with a
    vector, ties by train_id. More cells are visited where those hold fewer than k rows; with as many probes as cells the
    result is exact."""
    kinds, train_kind = dict(queries.dtypes), dict(index.rows.dtypes)["train_id"]
    te = queries.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("test_id"), F.col(vector).cast("array<double>").alias("vec"))
    routed = te.mapInPandas(_probes(index.metric, index.centres, index.sizes, probes, k),
                            f"test_id {kinds[id_col]}, vec array<double>, cells array<int>")
    routed = written(routed.withColumn("cell", F.explode("cells")).drop("cells"))
    parts = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(chunk_rows))).cast("int").alias(name))
    counts = F.broadcast(parts(index.rows, "n_chunks").join(parts(routed, "n_blocks"), "cell"))   # one row a cell

    def spread(df: DataFrame, key: str, own: str, other: str, salt: int) -> DataFrame:
        return df.join(counts, "cell").withColumn(own, F.pmod(F.xxhash64(key, F.lit(salt)), F.col(f"n_{own}s")).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.col(f"n_{other}s") - 1))).drop("n_chunks", "n_blocks")

    keys = ["cell", "chunk", "block"]
    found = spread(routed, "test_id", "block", "chunk", 0).groupBy(*keys).cogroup(
        spread(index.rows, "train_id", "chunk", "block", 1).groupBy(*keys)).applyInPandas(
        _nearest(index.metric, k), f"test_id {kinds[id_col]}, train_id {train_kind}, distance double")
    w = Window.partitionBy("test_id").orderBy("distance", "train_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _places(metric: str, centres: np.ndarray, sizes: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                d = np.where(sizes > 0, _metric_distances(_matrix(b["vec"], metric, "test"), centres), np.inf)
                order = np.argsort(d, axis=1, kind="stable")
                yield pd.DataFrame({"place": (order == b["cell"].to_numpy()[:, None]).argmax(axis=1).astype("int32")})
    return run


def probes_for(index: CellIndex, queries: DataFrame, id_col: str, vector: str, k: int, target: float = 0.95,
               sample: int = SAMPLE_QUERIES) -> int:
    """The least number of probes with which ``target`` of the k nearest rows are found, measured on ``sample`` queries (by
    a hash of the id; the only thing that is sampled) against all indexed rows."""
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("train_id"), F.col(vector).cast("array<double>").alias("vec"))
    asked = written(asked.orderBy(F.xxhash64("train_id", F.lit(7)), "train_id").limit(sample))
    exact = nearest_neighbors(asked, index.rows.select("train_id", "vec"), "train_id", "vec", k, index.metric)
    found = exact.select("test_id", "train_id").join(index.rows.select("train_id", "cell"), "train_id").select("test_id", "cell").join(
        asked.withColumnRenamed("train_id", "test_id"), "test_id").select("vec", "cell")
    at = np.zeros(len(index.centres), np.int64)
    for r in found.mapInPandas(_places(index.metric, index.centres, index.sizes), "place int").groupBy("place").count().collect():
        at[r["place"]] = r["count"]
    return int(np.searchsorted(np.cumsum(at), target * at.sum() - 1e-9)) + 1 if at.sum() else 1


def recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """(test_id, distance, approximate_distance, n_found, recall) from two neighbour tables of the same queries."""
    side = lambda df, s: df.select("test_id", "train_id", "distance", F.lit(s).alias("s"))
    pairs = side(exact, 1).unionByName(side(approximate, 2)).groupBy("test_id", "train_id").agg(
        F.max(F.when(F.col("s") == 1, F.col("distance"))).alias("e"), F.max(F.when(F.col("s") == 2, F.col("distance"))).alias("a"))
    return pairs.groupBy("test_id").agg(
        F.avg("e").alias("distance"), F.avg("a").alias("approximate_distance"), F.count("a").alias("n_found"),
        (F.count_if(F.col("e").isNotNull() & F.col("a").isNotNull()) / F.count("e")).alias("recall"))
