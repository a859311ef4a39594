"""Fold invariants, preparation on train rows only, calibration and comparison runs."""

import pytest
from pyspark.sql import functions as F

from evitrust.operators import folds, modeling as M
from evitrust.plans import Tables
from evitrust.plans import model_queries as Q

LABELS = Q.LABELS


@pytest.fixture(scope="module")
def data(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = Q.rows(t).persist()
    f = folds.stratified_group_folds(rows, "grp", "y_true", LABELS, [1, 2], 3).persist()
    return t, rows, f


def test_groups_stay_in_one_fold(data):
    _, rows, f = data
    assert folds.leaking_groups(folds.with_folds(rows, f, "grp"), "grp").agg(F.sum("n_leaking")).first()[0] == 0
    assert folds.with_folds(rows, f, "grp").count() == 2 * rows.count()
    sizes = f.groupBy("seed", "fold").count().collect()
    assert max(r["count"] for r in sizes) - min(r["count"] for r in sizes) <= 3 * len(LABELS)


def test_split_path_gives_the_same_folds(data):
    _, rows, f = data
    again = folds.stratified_group_folds(rows, "grp", "y_true", LABELS, [1, 2], 3, max_rows_per_range=30)
    assert sorted(map(tuple, again.select("seed", "grp", "fold").collect())) == sorted(map(tuple, f.select("seed", "grp", "fold").collect()))


def test_nested_roles_partition_the_groups(data):
    _, rows, f = data
    roles = folds.calibration_roles(rows, f, "grp", "y_true", LABELS, n_outer=3)
    n = rows.select("grp").distinct().count()
    per = roles.groupBy("seed", "fold").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("grp").alias("g")).collect()
    assert len(per) == 6 and all(r["n"] == r["g"] == n for r in per)
    assert roles.where("role = 'calib'").count() > 0


def test_preparation_ignores_test_rows(spark):
    train = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, None), ("b", None, None)], "c string, x double, z double")
    prep = M.fit_preparation(train, ["c"], ["x", "z"])
    assert prep.medians == {"x": 2.0} and prep.dropped == ["z"] and prep.fills == {"c": "a"}
    from pyspark.ml.functions import vector_to_array
    new = spark.createDataFrame([("zzz", None, 1.0)], "c string, x double, z double")
    v = prep.apply(new).select(vector_to_array("features").alias("v")).first()["v"]
    assert v == [0.0, 0.0, 0.0]  # unknown category encodes as zeros, the median is the centre
    assert M.encoded_shape(train, ["c"], ["x", "z"]) == (3, 3)


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "y string")
    assert {r["y"]: r["weight"] for r in M.class_weights(df, "y").collect()} == {"a": pytest.approx(4 / 6), "b": 2.0}


@pytest.mark.parametrize("kind,params", [("logistic", {"max_iter": 10}), ("forest", {"trees": 5, "depth": 4}), ("boosting", {"max_iter": 2, "depth": 2})])
def test_models_give_all_probabilities(data, kind, params):
    _, rows, _ = data
    prep = M.fit_preparation(rows, Q.CATEGORICAL, Q.NUMERIC)
    ready = prep.apply(rows)
    fitted = M.fit_classifier(ready.where("y_true <> 'P'"), kind, LABELS, **params)  # the last class is absent
    out = fitted.predict(ready)
    bad = out.where((F.abs(F.col("prob_F") + F.col("prob_O") + F.col("prob_P") - 1) > 1e-9) | (F.col("prob_P") > 1e-9))
    assert out.count() == rows.count() and bad.count() == 0


def test_calibration_does_not_hurt_its_own_rows(spark):
    base = spark.range(2000).select(
        F.col("id").alias("row_id"), (F.col("id") % 10 / 10.0).alias("p"),
        F.when(F.xxhash64("id") % 100 / 100.0 < (F.col("id") % 10 / 20.0), "a").otherwise("b").alias("y_true"))
    df = base.select("row_id", "y_true", (F.col("p") * 0.98 + 0.01).alias("prob_a"), (1 - (F.col("p") * 0.98 + 0.01)).alias("prob_b"))
    from evitrust.operators import metrics
    loss = lambda d: metrics.probability_scores(d, [], ["prob_a", "prob_b"], ["a", "b"]).first()["log_loss"]
    before = loss(df)
    for method in ("sigmoid", "isotonic"):
        after = M.fit_calibrator(df, method, ["a", "b"]).apply(df)
        assert after.count() == 2000 and loss(after) <= before + 1e-9


def test_isotonic_gate():
    assert "missing" in M.isotonic_gate({"a": 60, "b": 0})
    assert "fewer" in M.isotonic_gate({"a": 60, "b": 10})
    assert M.isotonic_gate({"a": 60, "b": 50}) is None


def test_grid_reports_skip_and_failure(data):
    t, rows, f = data
    roles = folds.calibration_roles(rows, f.where("seed = 1"), "grp", "y_true", LABELS, n_outer=3).persist()
    few = rows.where("y_true <> 'P' or row_id % 11 = 0")
    specs = [M.RunSpec("logistic", "none", (("max_iter", 5),)), M.RunSpec("nonsense", "none"),
             M.RunSpec("logistic", "isotonic", (("max_iter", 5),))]
    got = {(r["model"], r["calibration"]): r for r in M.compare_runs(few, roles, Q.FUSED, specs, LABELS, "grp").collect()}
    assert got[("nonsense", "none")]["status"] == "FAIL" and got[("logistic", "none")]["status"] == "OK"
    assert got[("logistic", "isotonic")]["status"] in ("OK", "SKIP")
    assert M.default_run(M.compare_runs(few, roles, Q.FUSED, specs[:1], LABELS, "grp")).first()["model"] == "logistic"


def test_empty_feature_changes_nothing(data):
    t, _, _ = data
    assert all(r["equal"] for r in Q.feature_ablation_equality(t).collect())


def test_shuffle_is_a_permutation(data):
    _, rows, _ = data
    a = rows.select("row_id", "level")
    for limit in (10**9, 100):
        b = M.shuffled_column(a, "row_id", "level", "s", max_rows_per_range=limit)
        assert sorted(r[0] for r in a.select("level").collect()) == sorted(r[0] for r in b.select("level").collect())
        assert b.select("row_id").distinct().count() == a.count()


def test_out_of_fold_covers_every_row_once(data):
    t, rows, _ = data
    pred = Q.logistic_out_of_fold(t)
    n = rows.count()
    assert pred.count() == n * len(Q.SEEDS) and pred.select("row_id").distinct().count() == n
    cols = [F.col(f"prob_{x}") for x in LABELS]
    from evitrust.functions import probs
    from evitrust.operators import trust
    assert trust.argmax_mismatches(pred, "y_pred", probs.arg_max(cols, LABELS)).first()["n_mismatch"] == 0


def test_every_seed_reaches_the_registered_runs(data, monkeypatch):
    t, _, _ = data
    seen = {}

    class Stop(Exception):
        pass

    def stop(name):
        def run(rows, roles, *a, **kw):
            seen[name] = ({r["seed"] for r in roles.select("seed").distinct().collect()}, a)
            raise Stop
        return run
    monkeypatch.setattr(Q, "SEEDS", (42, 43, 44))
    for f in ("out_of_fold", "compare_runs", "compare_feature_sets", "forest_baseline"):
        monkeypatch.setattr(M, f, stop(f))
    from evitrust.plans import load_all
    queries = load_all()
    for name in ("model_calibration_grid", "default_model_choice", "feature_set_comparison", "feature_ablation_equality",
                 "sigmoid_calibrated_predictions", "isotonic_calibrated_predictions", "boosting_out_of_fold",
                 "entity_model_plausibility", "forest_baseline", "logistic_out_of_fold"):
        with pytest.raises(Stop):
            queries[name].run(t)
        assert [s for s, _ in seen.values()] == [{42, 43, 44}], name
        seen.clear()
    with pytest.raises(Stop):
        queries["boosting_facts"].run(t)
    assert M.RunSpec("boosting", "none") in seen["out_of_fold"][1]


def test_permutations_share_one_order(spark, monkeypatch):
    """All columns and repeats are dealt in one order, each as ``shuffled_column`` deals it."""
    from evitrust import ordering
    df = spark.createDataFrame([(i, "ab"[i % 2], "uvw"[i % 3], float(i * 7 % 31)) for i in range(60)], "row_id int, y_true string, cat string, x double")
    prep = M.fit_preparation(df, ["cat"], ["x"])
    fitted = M.fit_classifier(prep.apply(df), "logistic", ["a", "b"])
    monkeypatch.setattr(M, "ROWS_PER_HASH_RANGE", 5)
    calls, seen, plain, scores = [], {}, ordering.row_positions, M.metrics.classification_scores
    monkeypatch.setattr(ordering, "row_positions", lambda *a, **k: calls.append(a) or plain(*a, **k))
    monkeypatch.setattr(M.metrics, "classification_scores", lambda pred, *a, **k: seen.update(pred=pred) or scores(pred, *a, **k))
    M.permutation_importance(fitted, prep, df, ["cat", "x"], ["a", "b"], repeats=2).collect()
    assert len(calls) == 1
    for c in ("cat", "x"):
        for r in range(2):
            want = {x.row_id: x[c] for x in M.shuffled_column(df, "row_id", c, f"42:{c}:{r}").collect()}
            got = seen["pred"].where((F.col("_column") == c) & (F.col("_repeat") == r)).collect()
            assert {x.row_id: x[c] for x in got} == want and len(got) == 60
            other = "x" if c == "cat" else "cat"
            assert all(x[other] == ("uvw"[x.row_id % 3] if other == "cat" else float(x.row_id * 7 % 31)) for x in got)


def test_groups_are_dealt_without_sampled_cuts(spark, monkeypatch):
    """Long orders are cut by their hashes: the folds are those of one order, and no cuts are searched."""
    from evitrust import ordering
    from evitrust.operators import folds
    df = spark.createDataFrame([(g, "FOP"[g * 7 % 3 if i else g % 3]) for g in range(400) for i in range(1 + g % 4)], "grp int, y string")
    plain = {(r.seed, r.grp): r.fold for r in folds.stratified_group_folds(df, "grp", "y", ["F", "O", "P"], [1, 2], 5).collect()}

    def searched(*a, **k):
        raise AssertionError("cuts searched")
    monkeypatch.setattr(ordering, "with_ranges", searched)
    cut = {(r.seed, r.grp): r.fold for r in folds.stratified_group_folds(df, "grp", "y", ["F", "O", "P"], [1, 2], 5, max_rows_per_range=10).collect()}
    assert cut == plain and len(plain) == 800
