"""Distances on prepared features of every fold, against all pairs."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from evitrust.contracts import ContractError
from evitrust.operators import fold_models as FM, fold_neighbors as FN, modeling as M

LABELS = ["a", "b", "c"]
SLOTS = [(s, f) for s in (1, 2) for f in range(3)]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    n = 300
    x = rng.normal(size=(n, 2)) * [3, 1] + [10, 0]
    cat = rng.choice(["u", "v", "w"], n, p=[.6, .3, .1])
    rows = [(i, i % 30, LABELS[i % 7 % 2] if i % 41 else None, None if i % 11 == 0 else str(cat[i]),
             None if i % 7 == 0 else float(x[i // 2, 0]), float(x[i // 2, 1])) for i in range(n)]     # many equal rows
    df = spark.createDataFrame(rows, "row_id int, grp int, y_true string, cat string, x1 double, x2 double")
    roles = spark.createDataFrame([(s, f, g, "test" if (g + s) % 3 == f else "train") for s, f in SLOTS for g in range(30)],
                                  "seed int, fold int, grp int, role string")
    return df, roles


def fitted(df, roles):
    ft = FM.fold_table(df, roles, ["cat"], ["x1", "x2"], LABELS, "grp", "y_true", SLOTS)
    fits = [FM.Fit(i, True) for i in range(len(SLOTS))]
    return ft, fits, FM.prepare(ft, fits)


@pytest.fixture(scope="module")
def brute(data):
    """Mean distances at k = 3 and 5 from the dense vectors of one preparation a fold."""
    df, roles = data
    out = {}
    for seed, fold in SLOTS:
        own = df.join(roles.where((F.col("seed") == seed) & (F.col("fold") == fold)), "grp")
        train = own.where("role = 'train'")
        prep = M.fit_preparation(train, ["cat"], ["x1", "x2"], with_mean=False)
        rows = prep.apply(own).select("row_id", "y_true", "role", vector_to_array("features").alias("v")).collect()
        x = {r.row_id: np.array(r.v) / np.linalg.norm(r.v) for r in rows}
        for r in rows:
            if r.role == "test":
                near = sorted((1 - x[r.row_id] @ x[o.row_id], o.y_true) for o in rows if o.role == "train" and o.y_true)
                pred = "c" if r.row_id % 5 == 0 else LABELS[r.row_id % 2]      # no row has label c
                same = [d for d, y in near if y == pred] or [d for d, _ in near]
                for k in (3, 5):
                    out[r.row_id, seed, fold, k] = np.mean([d for d, _ in near[:k]]), np.mean(same[:k])
    return out


@pytest.mark.parametrize("chunk_rows,max_pivots", [(4096, 256), (20, 7), (10, 1)])
def test_distances_match_all_pairs(data, brute, chunk_rows, max_pivots):
    df, roles = data
    ft, fits, prep = fitted(df, roles)
    near = FN.fold_neighbors(ft, fits, prep, 5, chunk_rows, max_pivots)
    pred = df.join(roles.where("role = 'test'"), "grp").select(
        "row_id", "seed", "fold", F.expr("CASE WHEN row_id % 5 = 0 THEN 'c' WHEN row_id % 2 = 0 THEN 'a' ELSE 'b' END").alias("y_pred"))
    got = FN.fold_distances(near, ft, pred, [3, 5]).collect()
    assert len(got) == 2 * 600
    assert set(brute) == {(r.row_id, r.seed, r.fold, r.k) for r in got}
    for r in got:
        assert np.allclose([r.cosine, r.cosine_class], brute[r.row_id, r.seed, r.fold, r.k], atol=1e-9)
        assert abs(r.cosine_margin - (r.cosine_class - r.cosine)) < 1e-12


def test_predictions_of_other_rows_are_refused(data):
    df, roles = data
    ft, fits, prep = fitted(df, roles)
    pred = df.where("row_id <> 4").join(roles.where("role = 'test'"), "grp").select("row_id", "seed", "fold", F.lit("a").alias("y_pred"))
    with pytest.raises(ContractError):
        FN.fold_distances(FN.fold_neighbors(ft, fits, prep, 3), ft, pred, [3])


def test_tables_without_rows(data):
    df, roles = data
    ft, fits, prep = fitted(df.where("false"), roles)
    assert FN.fold_neighbors(ft, fits, prep, 3).columns == ["row_id", "slot", "y", "train_id", "distance", "rank"]
    assert FN.fold_neighbors(ft, fits, prep, 3).count() == 0


def test_a_block_travels_once_to_a_team_and_k_rows_of_a_class_come_back(data):
    """before, a test row went to every cell it visited, and each visit brought k rows of every class back."""
    df, roles = data
    ft, fits, prep = fitted(df, roles)
    lists = FN.neighbor_lists(ft, fits, prep, 3, 4096, 16).collect()
    assert len(lists) == 600 == len({(r.row_id, r.slot) for r in lists})       # a test row of two slots, one part each
    assert all(r.y.count(y) <= 3 for r in lists for y in range(3))
    whole = {(r.row_id, r.slot): (r.y, r.train_id) for r in lists}
    cut = FN.fold_neighbors(ft, fits, prep, 3, 10, 1).orderBy("row_id", "slot", "y", "rank").collect()     # shares and parts
    assert len({(r.row_id, r.slot) for r in cut}) == 600
    far = {key: 0 for key in whole}
    for r in cut:
        far[r.row_id, r.slot] += 1
    assert all(far[key] == len(y) for key, (y, _) in whole.items())
