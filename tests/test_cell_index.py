"""The approximate search against the exact one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evitrust.operators import cell_index as C, neighbors as N


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(20, 8))
    rows = [(i, (middles[i % 20] + rng.normal(size=8) * .2).tolist()) for i in range(600)]
    rows += [(600 + i, rows[7][1]) for i in range(80)] + [(700, [0.0] * 8), (701, None)]      # copies, a zero vector, a null
    return spark.createDataFrame(rows, "id int, v array<double>").repartition(4)


@pytest.fixture(scope="module")
def index(vectors):
    return C.build_index(vectors, "id", "v")


def neighbours(df):
    return {(r.test_id, r["rank"]): (r.train_id, round(r.distance, 9)) for r in df.collect()}


def test_every_row_with_a_vector_is_indexed(index):
    assert index.rows.count() == 681 and index.sizes.sum() == 681


@pytest.mark.parametrize("chunk_rows", [4096, 25])
def test_all_probes_give_the_exact_neighbours(vectors, index, chunk_rows):
    asked = vectors.where("id % 9 = 0")
    got = neighbours(C.search(index, asked, "id", "v", 5, len(index.centres), chunk_rows))
    want = neighbours(N.nearest_neighbors(asked.where("v IS NOT NULL"), vectors.where("v IS NOT NULL"), "id", "v", 5))
    assert {k: d for k, (_, d) in got.items()} == {k: d for k, (_, d) in want.items()}


def test_measured_probes_reach_the_recall(vectors, index):
    probes = C.probes_for(index, vectors, "id", "v", 5)
    asked, every = vectors.where("id % 9 = 0 AND v IS NOT NULL"), vectors.where("v IS NOT NULL")
    out = C.recall(N.nearest_neighbors(asked, every, "id", "v", 5), C.search(index, asked, "id", "v", 5, probes)).collect()
    assert probes < len(index.centres) and len(out) == asked.count()
    assert np.mean([r.recall for r in out]) >= 0.9 and all(r.n_found == 5 for r in out)
    assert all(r.approximate_distance >= r.distance - 1e-9 for r in out)


def test_few_rows_give_all_of_them(spark):
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "id int, v array<double>")
    got = C.search(C.build_index(few, "id", "v", n_cells=3), few, "id", "v", 5, probes=1)
    assert got.groupBy("test_id").count().where("count = 3").count() == 3
    with pytest.raises(ValueError):
        C.build_index(few.where(F.lit(False)), "id", "v")
