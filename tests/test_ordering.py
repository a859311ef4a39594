"""Ranks, running totals and quantiles under skew: the split path must equal the plain one."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evitrust import ordering


def hot_frame(n=6000, seed=7):
    """One key and one value hold a third of all rows each."""
    r = np.random.default_rng(seed)
    key = np.where(r.random(n) < 0.35, "hot", r.choice(list("abcdefgh"), n))
    value = np.where(r.random(n) < 0.35, 0.5, np.round(r.normal(size=n), 3))
    return pd.DataFrame({"k": key, "v": value, "id": r.permutation(n).astype("int64"), "w": r.integers(0, 5, n)})


@pytest.fixture(scope="module")
def hot(spark):
    pdf = hot_frame()
    return pdf, spark.createDataFrame(pdf).repartition(7)


@pytest.mark.parametrize("limit", [10**9, 900, 150])
@pytest.mark.parametrize("descending", [False, True])
def test_row_positions(hot, limit, descending):
    pdf, df = hot
    got = ordering.row_positions(df, ["k"], "v", ["id"], descending, max_rows_per_range=limit).toPandas()
    want = pdf.sort_values(["v", "id"], ascending=[not descending, True])
    want = want.assign(pos=want.groupby("k").cumcount() + 1, n_total=want.groupby("k")["v"].transform("size"))
    a = got[["id", "pos", "n_total"]].sort_values("id").reset_index(drop=True)
    b = want[["id", "pos", "n_total"]].sort_values("id").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_hot_value_is_split_by_the_tie(hot):
    _, df = hot
    sizes = ordering.with_ranges(df, ["v", "id"], 150).groupBy("_range", "_part").count().toPandas()
    assert sizes["count"].max() < 450 and len(sizes) > 20


def test_second_level_of_ranges(hot, monkeypatch):
    pdf, df = hot
    monkeypatch.setattr(ordering, "CUTS", 7)
    cut = ordering.with_ranges(df, ["v", "id"], 150)
    assert cut.select("_range", "_part").distinct().count() > 20
    got = ordering.row_positions(df, ["k"], "v", ["id"], max_rows_per_range=150).toPandas().sort_values(["k", "pos"])
    want = pdf.sort_values(["k", "v", "id"])
    assert got["id"].tolist() == want["id"].tolist()


def odd_frame(spark):
    """Nulls, NaN, infinities, ties and text ids, with a hot key."""
    values = [None, float("nan"), 0.0, -0.0, 1.5, 1.5, float("inf"), float("-inf"), 2.0, None]
    rows = [("hot" if i % 3 else f"k{i % 2}", values[i * 7 % 10], f"id-{i * 37 % 400:03d}" if i % 50 else None, i) for i in range(400)]
    return spark.createDataFrame(rows, "k string, v double, t string, n long").repartition(5)


@pytest.mark.parametrize("descending", [False, True])
def test_nulls_nan_and_text_ties_on_both_paths(spark, descending):
    df = odd_frame(spark)
    runs = [sorted(map(str, ordering.row_positions(df, ["k"], "v", ["t", "n"], descending, max_rows_per_range=limit).collect()))
            for limit in (10**9, 40, 7)]
    assert len(runs[0]) == 400 and runs[0] == runs[1] == runs[2]


@pytest.mark.parametrize("limit", [40, 7])
def test_ranks_and_quantiles_with_nulls_and_nan_on_both_paths(spark, limit):
    df = odd_frame(spark)
    for keys in (["k"], []):
        plain, split = (ordering.with_average_rank(df, keys, "v", "r", "p", max_rows_per_range=m).collect() for m in (10**9, limit))
        assert sorted(map(str, plain)) == sorted(map(str, split))
        plain, split = (ordering.grouped_quantiles(df, keys, "v", {"a": 0.1, "m": 0.5, "z": 0.97}, m).collect() for m in (10**9, limit))
        assert sorted(map(str, plain)) == sorted(map(str, split))


@pytest.mark.parametrize("limit", [10**9, 200])
def test_running_sums(hot, limit):
    pdf, df = hot
    got = ordering.cumulative(df, ["k"], "v", {"s": F.col("w")}, ["id"], limit).toPandas()
    want = pdf.sort_values(["v", "id"])
    want = want.assign(s=want.groupby("k")["w"].cumsum(), s_total=want.groupby("k")["w"].transform("sum"))
    m = got.merge(want, on="id")
    assert len(m) == len(pdf)
    assert (m["s_x"] == m["s_y"]).all() and (m["s_total_x"] == m["s_total_y"]).all()


@pytest.mark.parametrize("limit", [10**9, 200])
def test_average_rank_percentile(hot, limit):
    pdf, df = hot
    got = ordering.with_average_rank(df, ["k"], "v", rank="r", percentile="p", max_rows_per_range=limit).toPandas()
    want = pdf.assign(r=pdf.groupby("k")["v"].rank(), p=pdf.groupby("k")["v"].rank(pct=True))
    m = got.merge(want, on="id")
    np.testing.assert_allclose(m["r_x"], m["r_y"])
    np.testing.assert_allclose(m["p_x"], m["p_y"])


@pytest.mark.parametrize("limit", [10**9, 200])
@pytest.mark.parametrize("keys", [["k"], []])
def test_exact_quantiles(hot, limit, keys):
    pdf, df = hot
    got = ordering.grouped_quantiles(df, keys, "v", {"q1": 0.25, "m": 0.5, "q9": 0.9}, limit).toPandas()
    for _, row in got.iterrows():
        part = pdf[pdf["k"] == row["k"]] if keys else pdf
        np.testing.assert_allclose([row["q1"], row["m"], row["q9"]], np.percentile(part["v"], [25, 50, 90]))


def test_nulls_and_single_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", None, 2), ("b", 4.0, 3)], "k string, v double, id long")
    got = {r["id"]: r["p"] for r in ordering.with_average_rank(df, ["k"], "v", percentile="p").collect()}
    assert got == {1: 1.0, 2: None, 3: 1.0}
    assert {r["k"]: r["median"] for r in ordering.grouped_median(df, ["k"], "v").collect()} == {"a": 1.0, "b": 4.0}


@pytest.mark.parametrize("limit", [2, 1000])
@pytest.mark.parametrize("kind,values", [
    ("bigint", [2**60, 2**60 + 1, 2**60 + 2, -2**63, 2**63 - 1]), ("decimal(38,0)", [10**30, 10**30 + 1, 10**30 - 1, 0, -5]),
    ("string", ["a", "ab", "", "b", "é"]), ("boolean", [True, False, True, False, True]), ("double", [0.5, -1.0, float("inf"), 2.0, -0.5])])
def test_falling_positions_of_any_type(spark, kind, values, limit):
    df = spark.createDataFrame([("k", str(v), i) for i, v in enumerate(values)], "k string, v string, i int").withColumn("v", F.col("v").cast(kind))
    got = {r.i: r.pos for r in ordering.row_positions(df, ["k"], "v", ["i"], True, max_rows_per_range=limit).collect()}
    key = (lambda v: v.encode()) if kind == "string" else (lambda v: v)
    order = sorted(sorted(range(len(values))), key=lambda i: key(values[i]), reverse=True)
    order = sorted(range(len(values)), key=lambda i: (order.index(next(j for j in order if values[j] == values[i])), i))
    assert [got[i] for i in order] == list(range(1, len(values) + 1))


def test_ranges_do_not_multiply_the_plan(spark):
    """Two ranks one after the other in two levels of ranges: the plan holds the rows a few times, not hundreds."""
    df = spark.range(4000).selectExpr("id", "id % 3 AS k", "CAST(id * 7 % 1009 AS DOUBLE) AS a", "CAST(id * 11 % 53 AS DOUBLE) AS b")
    out = ordering.with_average_rank(df, ["k"], "a", rank="ra", max_rows_per_range=3)
    out = ordering.with_average_rank(out, ["k"], "b", rank="rb", max_rows_per_range=3)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (") <= 20
    assert out.count() == 4000 and out.where("ra IS NULL OR rb IS NULL").count() == 0


def test_cells_are_dealt_once_by_rows_not_by_the_session(spark, monkeypatch):
    """Cells of a large table lie in as many tasks as its rows ask for, and the choice of sources moves nothing again."""
    from evitrust.operators import harmonize
    monkeypatch.setattr(ordering, "ROWS_PER_TASK", 100)
    df = spark.range(3000).selectExpr("id % 40 AS entity", "'c' || id % 7 AS channel", "'s' || id % 5 AS source", "CAST(id % 5 AS INT) AS prio",
                                      "CAST(id * 7 % 1009 AS DOUBLE) AS v")
    one = lambda **kw: harmonize.cells_by_source(df, "v", F.col("v") > 3, **kw)
    cells = one(group_at_most=3000)
    assert cells.rdd.getNumPartitions() == 30
    best = harmonize.select_cells(cells)
    assert best._jdf.queryExecution().sparkPlan().toString().count("Repartition") <= 1
    assert best._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(str, cells.collect())) == sorted(map(str, one().collect()))


def test_groups_fit_by_buckets_of_hashed_keys(spark, monkeypatch):
    df = spark.range(1000).selectExpr("id % 10 AS k", "id % 3 AS l")
    for buckets in (1 << 14, 1):        # groups apart, and all in one bucket
        monkeypatch.setattr(ordering, "BUCKETS", buckets)
        assert ordering.groups_fit(df, ["k"], 100) and not ordering.groups_fit(df, ["k"], 99)
        assert ordering.groups_fit(df, ["k", "l"], 34) and not ordering.groups_fit(df, ["k", "l"], 33)


def test_two_ranks_read_the_rows_once(spark):
    df = spark.range(4000).selectExpr("id", "id % 3 AS k", "CAST(id * 7 % 1009 AS DOUBLE) AS a")
    out = ordering.with_average_rank(df, ["k"], "a", rank="ra", max_rows_per_range=300)
    assert "Range (" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.where("ra IS NOT NULL").count() == 4000


def test_ranges_are_dealt_by_rows_not_by_some_of_the_keys(spark, monkeypatch):
    """Rows that lie by (k) must not be ranked there for (p, k): a task would hold all p of a k."""
    monkeypatch.setattr(ordering, "ROWS_PER_TASK", 100)
    df = spark.range(4000).selectExpr("id", "id % 2 AS k", "explode(array(1, 2, 3)) AS p", "CAST(id * 7 % 1009 AS DOUBLE) AS v").repartition(2, "k")
    out = ordering.row_positions(df, ["p", "k"], "v", ["id"], max_rows_per_range=500)
    sizes = [r.n for r in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 12000 and max(sizes) <= 1000
    assert out.where("pos = n_total").count() == 6
