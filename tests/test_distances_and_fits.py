"""Neighbours and fits against brute force; distributed paths against the in-task ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evitrust.operators import dose, neighbors


def brute(te, tr, k, metric, same=None):
    out = {}
    for i, a in te.items():
        d = []
        for j, b in tr.items():
            if same and not same(i, j):
                continue
            if metric == "cosine":
                na, nb = np.linalg.norm(a), np.linalg.norm(b)
                x = 1.0 if na == 0 or nb == 0 else 1 - a @ b / (na * nb)
            else:
                x = np.linalg.norm(a - b)
            d.append((round(x, 9), j))
        out[i] = [x for x, _ in sorted(d)[:k]]
    return out


@pytest.fixture(scope="module")
def points(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(6, 5)) * 4
    x = centres[r.integers(0, 6, 500)] + r.normal(size=(500, 5)) * 0.4
    x[:170] = x[0]  # a third of all rows are copies of one
    x[200] = 0.0
    x[401] = 0.0
    cls = np.where(np.arange(500) % 3 == 0, "p", "q")
    cls[490:] = "only_in_test"
    df = spark.createDataFrame([(i, x[i].tolist(), str(cls[i])) for i in range(500)], "id long, v array<double>, c string")
    return x, cls, df.where("id < 400"), df.where("id >= 400")


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("chunk", [4096, 40])
def test_neighbors(points, metric, chunk):
    x, _, train, test = points
    got = neighbors.nearest_neighbors(test, train, "id", "v", 4, metric, chunk_rows=chunk).orderBy("test_id", "rank").collect()
    want = brute({i: x[i] for i in range(400, 500)}, {i: x[i] for i in range(400)}, 4, metric)
    for i, w in want.items():
        np.testing.assert_allclose([r["distance"] for r in got if r["test_id"] == i], w, atol=1e-8)


@pytest.mark.parametrize("chunk", [4096, 40])
def test_class_neighbors_fall_back_to_all(points, chunk):
    x, cls, train, test = points
    got = neighbors.nearest_neighbors(test, train, "id", "v", 3, "euclidean", "c", "c", chunk_rows=chunk).collect()
    known = set(cls[:400])
    same = lambda i, j: cls[i] not in known or cls[i] == cls[j]
    want = brute({i: x[i] for i in range(400, 500)}, {i: x[i] for i in range(400)}, 3, "euclidean", same)
    for i, w in want.items():
        rows = sorted((r["rank"], r["distance"]) for r in got if r["test_id"] == i)
        np.testing.assert_allclose([d for _, d in rows], w, atol=1e-8)


def test_pruning_skips_cells(points):
    x, _, train, test = points
    tr = np.unique(x[:400], axis=0)
    piv = tr[:: max(1, len(tr) // 20)]
    d = neighbors._metric_distances(tr, piv)
    cell = d.argmin(1)
    size = np.bincount(cell, minlength=len(piv))
    radius = np.array([d[cell == j, j].max() if (cell == j).any() else 0 for j in range(len(piv))])
    import pandas as pd
    run = neighbors._visits("euclidean", neighbors._Cells(piv, {"": (size, radius)}), 2)
    out = next(run(iter([pd.DataFrame({"vec": x[400:].tolist(), "_by": [""] * 100})])))
    assert np.mean([len(c) for c in out["cells"]]) < 0.7 * len(piv)


def test_small_class_has_fewer_neighbors(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0], "a"), (2, [1.0, 1.0], "a"), (3, [5.0, 1.0], "b")], "id long, v array<double>, c string")
    got = neighbors.nearest_neighbors(df.where("id = 1"), df, "id", "v", 5, "euclidean", "c", "c")
    assert [r["train_id"] for r in got.orderBy("rank").collect()] == [1, 2]


def test_svd_keeps_distances_when_all_directions_are_kept(points):
    x, _, train, test = points
    d = neighbors.svd_directions(train, "v", 30)
    assert d.shape == (5, 4)  # at most features - 1
    np.testing.assert_allclose(d.T @ d, np.eye(4), atol=1e-9)


def test_fit_rules_and_recovery(spark):
    rows = []
    for c in (0.1, 1.0, 3.0, 10.0, 100.0):
        rows.append(("good", c, 100 / (1 + (2.5 / c) ** 1.3)))
        rows.append(("weak", c, 100 / (1 + (900.0 / c) ** 1.0)))
    rows += [("few", 1.0, 60.0), ("few", 2.0, 70.0), ("few", 2.0, 90.0), ("good", None, 3.0)]
    df = spark.createDataFrame(rows, "e string, c double, y double")
    got = {r["e"]: r for r in dose.fit_curves(df, ["e"], "c", "y").collect()}
    assert got["good"]["ic50"] == pytest.approx(2.5, rel=1e-6) and got["good"]["hill_n"] == pytest.approx(1.3, rel=1e-6)
    assert (got["weak"]["relation"], got["weak"]["ic50"], got["weak"]["hill_n"]) == (">", 100.0, None)
    assert (got["few"]["relation"], got["few"]["ic50"], got["few"]["n_points"]) == ("NA", None, 2)


def test_noisy_fit_is_the_least_squares_optimum(spark, tmp_path):
    r = np.random.default_rng(2)
    rows = []
    for e in range(4):
        for c in np.exp(np.linspace(-2, 4, 12)):
            rows.append((e, float(c), float(100 / (1 + ((1 + e) / c) ** 1.1) + r.normal() * 6)))
    df = spark.createDataFrame(rows, "e int, c double, y double")
    near = {x["e"]: x for x in dose.fit_curves(df, ["e"], "c", "y").collect()}
    for e, fit in near.items():
        x = np.array([c for k, c, _ in rows if k == e])
        y = np.array([v for k, _, v in rows if k == e])
        err = lambda u, h: ((y - 100 / (1 + (u / x) ** h)) ** 2).sum()
        best = err(fit["ic50"], fit["hill_n"])
        for du in (0.98, 1.0, 1.02):
            for dh in (0.98, 1.0, 1.02):
                assert best <= err(fit["ic50"] * du, fit["hill_n"] * dh) + 1e-6
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    far = {x["e"]: x for x in dose.fit_curves(df, ["e"], "c", "y", max_points_in_task=5).collect()}
    for e in near:
        assert far[e]["ic50"] == pytest.approx(near[e]["ic50"], rel=1e-5)
        assert far[e]["hill_n"] == pytest.approx(near[e]["hill_n"], rel=1e-5)


def test_block_prediction_limits(spark):
    r = spark.range(1).select(
        dose.hill_block(F.lit(0.0), F.lit(2.0), F.lit(1.0)).alias("zero"), dose.hill_block(F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("bad"),
        dose.hill_block(F.lit(2.0), F.lit(2.0), F.lit(1.0)).alias("half")).first()
    assert (r["zero"], r["bad"], r["half"]) == (0.0, None, 0.5)


def test_censored_cells(spark):
    fits = spark.createDataFrame([("a", "c1", 5.0, None, ">", 4), ("b", "c1", 2.0, 1.0, "=", 4)],
                                 "entity string, channel string, ic50 double, hill_n double, relation string, n_points long")
    assert dose.fitted_cells(fits, "s", 0).count() == 2
    assert [r["entity"] for r in dose.fitted_cells(fits, "s", 0, censored_as_value=False).collect()] == ["b"]


def test_neighbors_travel_to_teams_not_to_cells(spark, monkeypatch):
    """Train rows travel once to each team of test rows and part; test rows are not copied to every cell that they visit."""
    r = np.random.default_rng(5)
    x = r.normal(size=(900, 16))
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(900)], "id long, v array<double>")
    test, train = df.where("id % 3 = 0"), df.where("id % 3 <> 0")
    monkeypatch.setattr(neighbors, "TEAM_ROWS", 100)
    rows = spark.sparkContext.accumulator(0)
    plain = neighbors._team_nearest

    def counted(*a):
        run = plain(*a)

        def own(left, right):
            rows.add(left.num_rows + right.num_rows)
            return run(left, right)
        return own
    monkeypatch.setattr(neighbors, "_team_nearest", counted)
    got = neighbors.nearest_neighbors(test, train, "id", "v", 5, "cosine", chunk_rows=20).orderBy("test_id", "rank").collect()
    want = brute({i: x[i] for i in range(0, 900, 3)}, {i: x[i] for i in range(900) if i % 3}, 5, "cosine")
    for i, w in want.items():
        np.testing.assert_allclose([g["distance"] for g in got if g["test_id"] == i], w, atol=1e-8)
    assert 0 < rows.value < 300 * 3 + 600 * 8      # 300 rows times about 25 visited cells before
