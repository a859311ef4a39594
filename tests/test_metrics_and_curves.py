"""Hand-computed metric values, tie handling and curve rules."""

import math

import pytest
from pyspark.sql import functions as F

from evitrust import contracts
from evitrust.functions import probs
from evitrust.operators import curves, late_fusion, metrics, plausibility, trust


@pytest.fixture(scope="module")
def six(spark):
    rows = [(1, "a", "a", 0.9), (2, "a", "b", 0.8), (3, "b", "b", 0.7), (4, "b", "b", 0.7), (5, "a", "a", 0.6), (6, "b", "a", 0.1)]
    return spark.createDataFrame(rows, "row_id long, y_true string, y_pred string, confidence double").withColumns(
        {"seed": F.lit(1), "fold": F.lit(0)})


def test_class_scores(six):
    r = metrics.classification_scores(six, ["seed"], ["a", "b", "c"]).first()
    assert r["n_rows"] == 6 and r["accuracy"] == pytest.approx(4 / 6)
    assert r["balanced_accuracy"] == pytest.approx(2 / 3)  # the absent class c is left out
    assert r["macro_f1"] == pytest.approx((2 / 3 + 2 / 3 + 0) / 3)  # and scores 0 here


def test_predicted_class_outside_true_classes(spark):
    df = spark.createDataFrame([(1, "a", "z"), (1, "a", "a")], "seed int, y_true string, y_pred string")
    r = metrics.classification_scores(df, ["seed"], ["a"]).first()
    assert r["balanced_accuracy"] == pytest.approx(0.5) and r["macro_f1"] == pytest.approx(2 / 3)


def test_auc_with_ties_and_one_class(spark):
    df = spark.createDataFrame([("x", 0.1, 0), ("x", 0.4, 0), ("x", 0.4, 1), ("x", 0.8, 1), ("y", 0.3, 1)],
                               "k string, s double, e int")
    got = {r["k"]: r["auc"] for r in metrics.roc_auc(df, ["k"], "s", F.col("e") == 1).collect()}
    assert got["x"] == pytest.approx(3.5 / 4) and got["y"] is None


def test_constant_side_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert metrics.spearman(df, [], "a", "b").first()[0] is None
    assert metrics.pearson(df, [], "a", "b").first()[0] is None


def test_calibration_error_edges(spark):
    df = spark.createDataFrame([(1, 0.0, 1), (1, 0.1, 1), (1, 0.1000001, 0), (1, 1.0, 1)], "seed int, c double, ok int")
    r = metrics.expected_calibration_error(df, ["seed"], "c", F.col("ok")).first()
    assert r["ece"] == pytest.approx((abs(1 - 0.1) + abs(0 - 0.1000001) + 0) / 4)  # confidence 0 is in no bin


def test_curve_drops_floor_and_cuts_ties_by_row(six):
    df = six.withColumn("u", -F.col("confidence"))
    c = {r["abstention_rate"]: r for r in curves.abstention_curve(df, ["seed", "fold"], "u", ["a", "b"], [0.0, 0.3, 0.5]).collect()}
    assert c[0.0]["n_kept"] == 6 and c[0.3]["n_kept"] == 5 and c[0.5]["n_kept"] == 3
    # of the tied rows 3 and 4 the one with the lower id is dropped first
    assert c[0.5]["balanced_accuracy"] == pytest.approx((1 / 2 + 1) / 2)
    check = curves.rate_zero_check(curves.abstention_curve(df, ["seed", "fold"], "u", ["a", "b"]), six, ["seed", "fold"], ["a", "b"])
    assert check.first()["gap"] == 0


def test_coverage_keeps_ceil(six):
    r = curves.coverage_curve(six, ["seed", "fold"], "confidence", [0.5, 0.51], ["a", "b"]).collect()
    assert {x["coverage"]: x["n_kept"] for x in r} == {0.5: 3, 0.51: 4}


def test_split_path_gives_the_same_curve(spark, six):
    df = six.withColumn("u", -F.col("confidence"))
    big = df.crossJoin(spark.range(300).select((F.col("id") * 10).alias("o"))).withColumn("row_id", F.col("row_id") + F.col("o"))
    a = curves.abstention_curve(big, ["seed", "fold"], "u", ["a", "b"])
    b = curves.abstention_curve(big, ["seed", "fold"], "u", ["a", "b"], max_rows_per_range=100)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_rollup_of_one_row_has_zero_deviation(spark):
    df = spark.createDataFrame([(1, 0.5)], "seed int, m double")
    r = metrics.two_level_rollup(df, [], "seed", ["m"]).first()
    assert (r["m_mean"], r["m_std"], r["n_seeds"]) == (0.5, 0.0, 1)


def test_probability_operations(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.2, 0.2), (0.9, 0.1)], "prob_a double, prob_b double")
    al = probs.align_probabilities(df, ["a", "b", "c"])
    cols = [F.col(f"prob_{x}") for x in "abc"]
    n = al.select(*[c.alias(x) for c, x in zip(probs.normalized(cols), "abc")]).collect()
    assert tuple(n[0]) == pytest.approx((1 / 3,) * 3) and tuple(n[1]) == pytest.approx((0.5, 0.5, 0))
    assert [r[0] for r in al.select(probs.arg_max(cols, list("abc"))).collect()] == ["a", "a", "a"]
    warm = al.select(*[c.alias(x) for c, x in zip(probs.tempered(cols, 2.0), "abc")]).collect()[2]
    assert warm["a"] == pytest.approx(math.sqrt(.9) / (math.sqrt(.9) + math.sqrt(.1)))
    bins = spark.createDataFrame([(x,) for x in (0.0, 0.25, 0.26, 0.75, 1.0)], "x double").select(
        probs.right_closed_bin(F.col("x"), probs.MISSINGNESS_EDGES, probs.MISSINGNESS_NAMES)).collect()
    assert [b[0] for b in bins] == ["<=0.25", "<=0.25", "0.25-0.5", "0.5-0.75", ">0.75"]


def test_contracts(spark):
    a = spark.createDataFrame([(1, 1), (2, 1)], "row_id int, seed int")
    dup = a.unionByName(a)
    with pytest.raises(contracts.ContractError):
        contracts.join_one_to_one(a, dup, ["row_id", "seed"])
    with pytest.raises(contracts.ContractError):
        contracts.join_many_to_one(a, dup, ["row_id", "seed"])
    with pytest.raises(contracts.ContractError):
        contracts.require_columns(a, ["nope"])
    with pytest.raises(contracts.ContractError):
        contracts.require_no_nulls(a.withColumn("x", F.lit(None)), "x")
    shifted = a.withColumn("row_id", F.col("row_id") + 1)
    assert contracts.aligned_key_counts(a, shifted, ["row_id", "seed"]).first().asDict() == {
        "left_rows": 2, "right_rows": 2, "sym_diff": 2}
    with pytest.raises(contracts.ContractError):
        trust.align_and_merge(a, shifted, ["row_id", "seed"])


def test_direction_fix_flips_only_when_inverted(spark):
    df = spark.createDataFrame([(1.0, 0), (0.2, 1)], "raw double, error int")
    assert [r["ood_score"] for r in trust.fix_direction(df, "raw").collect()] == [-1.0, -0.2]
    same = trust.fix_direction(df.withColumn("error", 1 - F.col("error")), "raw").collect()
    assert [r["ood_score"] for r in same] == [1.0, 0.2] and not same[0]["flipped"]


def test_default_alpha(spark):
    assert trust.alpha_or_default(spark.createDataFrame([], "alpha double")).first()["alpha"] == 0.5


def test_plausibility_keeps_unknown_entities(spark):
    pred = spark.createDataFrame([(1, "e1", "a", "a"), (2, "e9", "b", "a")], "row_id int, grp string, y_true string, y_pred string")
    table = spark.createDataFrame([("e1", 0.8, 0.2, 0.25)], "grp string, p_mech_a double, p_mech_b double, mech_missing_frac double")
    got = {r["row_id"]: r for r in plausibility.plausibility_scores(pred, table, ["grp"], ["a", "b"]).collect()}
    assert got[1]["mech_plausibility"] == pytest.approx(0.6) and got[2]["mech_support"] is None


def test_temperature_keeps_one_when_already_calibrated(spark):
    df = spark.createDataFrame([(1, "a", 0.5, 0.5), (1, "b", 0.5, 0.5)], "seed int, y_true string, prob_a double, prob_b double")
    best = late_fusion.select_temperature(late_fusion.temperature_losses(df, ["seed"], ["prob_a", "prob_b"], ["a", "b"]), ["seed"])
    assert best.first()["temperature"] == 1.0


def test_plausibility_report_reads_its_rows_once(spark):
    scored = spark.range(200).selectExpr(
        "42 AS seed", "IF(id % 3 = 0, 'a', 'b') AS y_true", "'b' AS y_pred", "CAST(id % 7 AS DOUBLE) / 7 AS mech_missing_frac",
        "CAST(id % 11 AS DOUBLE) / 11 AS mech_support", "1 - CAST(id % 11 AS DOUBLE) / 11 AS mech_disagreement",
        "CAST(id % 13 AS DOUBLE) / 13 AS mech_plausibility")
    out = plausibility.plausibility_report(scored)
    assert "Range (" not in out._jdf.queryExecution().optimizedPlan().toString()
    r = out.first()
    assert (r.n_rows, r.n_rows_usable) == (200, 200) and abs(r.auc_support + r.auc_disagreement - 1) < 1e-12
