"""Models of all folds together, against fits of one fold and plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evitrust.operators import fold_models as FM, modeling as M

LABELS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    n = 600
    x = rng.normal(size=(n, 2)) * [3, 1] + [50, 0]
    cat = rng.choice(["u", "v", "w"], n, p=[.5, .3, .2])
    y = np.argmax(np.c_[x[:, 0] - 50 + rng.normal(size=n) * 3, 2 * x[:, 1] + rng.normal(size=n) * 2, (cat == "v") * 2 + rng.normal(size=n)], axis=1)
    rows = [(i, i % 60, LABELS[y[i]] if i % 50 else None, None if i % 11 == 0 else str(cat[i]),
             None if i % 7 == 0 else float(x[i, 0]), float("nan") if i % 13 == 0 else float(x[i, 1]), None) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id int, grp int, y_true string, cat string, x1 double, x2 double, nothing double")
    roles = spark.createDataFrame([(s, f, g, "test" if g % 3 == f else "calib" if (g + s) % 3 == f else "train")
                                   for s in (1, 2) for f in range(3) for g in range(60)], "seed int, fold int, grp int, role string")
    return df, roles


def table_of(data, numeric=("x1", "x2", "nothing")):
    df, roles = data
    return FM.fold_table(df, roles, ["cat"], list(numeric), LABELS, "grp", "y_true", [(s, f) for s in (1, 2) for f in range(3)])


def learnt(data, seed, fold, with_calib):
    df, roles = data
    kept = roles.where((F.col("seed") == seed) & (F.col("fold") == fold) & F.col("role").isin(["train", "calib"] if with_calib else ["train"]))
    return df.join(kept.select("grp"), "grp")


def test_preparation_matches_each_fold(data):
    ft = table_of(data)
    fits = [FM.Fit(s, w) for w in (False, True) for s in range(6)]
    for sizing in ({}, {"max_rows_per_range": 50, "group_at_most": None}):
        prep = FM.prepare(ft, fits, **sizing)
        for i, f in enumerate(fits):
            own = learnt(data, *ft.slots[f.slot], f.with_calib)
            one = M.fit_preparation(own.withColumn("x2", F.when(~F.isnan("x2"), F.col("x2"))), ["cat"], ["x1", "x2", "nothing"])
            assert np.allclose(prep.fill[i, :2], [one.medians["x1"], one.medians["x2"]]) and list(prep.used[i]) == [True, True, False]
            assert np.allclose(prep.centre[i, :2], [one.centre["x1"], one.centre["x2"]]) and np.allclose(prep.scale[i, :2], [one.scale["x1"], one.scale["x2"]])
            assert ft.categories["cat"][prep.mode[i, 0]] == one.fills["cat"] and prep.seen[i][0].all()
            weights = {r.y_true: r.weight for r in M.class_weights(own.where("y_true IS NOT NULL"), "y_true").collect()}
            assert np.allclose(prep.weight[i], [weights[x] for x in LABELS])


def test_logistic_matches_the_fit_of_one_fold(data):
    df, roles = data
    features = M.FeatureSet("f", ("cat",), ("x1", "x2"))
    df = df.withColumn("x2", F.when(~F.isnan("x2"), F.col("x2")))
    joint, status, _ = M.out_of_fold(df, roles, features, M.RunSpec("logistic"), LABELS, "grp")
    one, _, _ = M.predict_fold(df, roles, 1, 2, features, M.RunSpec("logistic"), LABELS, "grp")
    cols = [f"prob_{x}" for x in LABELS]
    a = {r.row_id: [r[c] for c in cols] for r in joint.where("seed = 1 AND fold = 2").collect()}
    b = {r.row_id: [r[c] for c in cols] for r in one.collect()}
    assert a.keys() == b.keys() and max(abs(x - y) for k in a for x, y in zip(a[k], b[k])) < 2e-3
    assert joint.count() == 2 * df.where("y_true IS NOT NULL").count() and joint.columns == one.columns


@pytest.mark.parametrize("calibration", ["sigmoid", "isotonic", "temperature"])
def test_calibration_matches_the_fit_of_one_fold(data, calibration, monkeypatch):
    monkeypatch.setattr(M, "isotonic_gate", lambda counts: None)
    df, roles = data
    df = df.withColumn("x2", F.when(~F.isnan("x2"), F.col("x2")))
    features, spec = M.FeatureSet("f", ("cat",), ("x1", "x2")), M.RunSpec("logistic", calibration)
    joint, _, _ = M.out_of_fold(df, roles, features, spec, LABELS, "grp")
    one, _, _ = M.predict_fold(df, roles, 2, 0, features, spec, LABELS, "grp")
    cols = [f"prob_{x}" for x in LABELS]
    a = {r.row_id: np.array([r[c] for c in cols]) for r in joint.where("seed = 2 AND fold = 0").collect()}
    b = {r.row_id: np.array([r[c] for c in cols]) for r in one.collect()}
    gap = np.array([np.abs(a[k] - b[k]).max() for k in b])
    assert a.keys() == b.keys() and np.quantile(gap, 0.9) < 0.02 and all(abs(v.sum() - 1) < 1e-9 for v in a.values())


def test_too_few_calibration_rows_are_reported(data):
    df, roles = data
    out = M.out_of_fold_all(df.where("row_id < 300"), roles, M.FeatureSet("f", (), ("x1",)), [M.RunSpec("logistic", "isotonic"), M.RunSpec("logistic")], LABELS, "grp")
    assert out[0][0] is None and out[0][1] == "SKIP" and "fewer than 50" in out[0][2] and out[1][1] == "OK"


def test_one_class_and_absent_class(data):
    df, roles = data
    ones = df.where("y_true = 'b'")
    for model in ("logistic", "boosting"):
        got = M.out_of_fold(ones, roles, M.FeatureSet("f", ("cat",), ("x1",)), M.RunSpec(model), LABELS, "grp")[0].collect()
        assert got and all((r.prob_a, r.prob_b, r.prob_c) == (0.0, 1.0, 0.0) for r in got)
        two = M.out_of_fold(df.where("y_true <> 'c'"), roles, M.FeatureSet("f", ("cat",), ("x1",)), M.RunSpec(model), LABELS, "grp")[0]
        assert two.where("prob_c > 0 OR abs(prob_a + prob_b - 1) > 1e-9").count() == 0


def grown(x, n_bins, n_cats, y, w, k, rounds, depth, rate, l2, least):
    """The same trees grown row by row in plain code; the scores of the rows."""
    scores = np.zeros((len(y), k))
    for _ in range(rounds):
        q = np.exp(scores - scores.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        for c in range(k):
            g, h = w * (q[:, c] - (y == c)), w * q[:, c] * (1 - q[:, c])

            def leaf(rows, level):
                best, split = 1e-9, None
                total = g[rows].sum() ** 2 / (h[rows].sum() + l2)
                if level < depth:
                    for f in range(x.shape[1]):
                        for cut in range(n_bins[f] if f < n_cats else n_bins[f] - 1):
                            left = x[rows, f] == cut if f < n_cats else x[rows, f] <= cut
                            a, b = rows[left], rows[~left]
                            if h[a].sum() < least or h[b].sum() < least:
                                continue
                            gain = g[a].sum() ** 2 / (h[a].sum() + l2) + g[b].sum() ** 2 / (h[b].sum() + l2) - total
                            if gain > best + 1e-12:
                                best, split = gain, (a, b)
                if split is None:
                    scores[rows, c] += -rate * g[rows].sum() / (h[rows].sum() + l2)
                else:
                    leaf(split[0], level + 1)
                    leaf(split[1], level + 1)
            leaf(np.arange(len(y)), 0)
    return scores


def test_boosting_matches_plain_trees(data, monkeypatch):
    monkeypatch.setattr(FM, "KEEP_EVERY", 2)
    monkeypatch.setattr(FM, "ROWS_PER_TASK", 100)
    ft = table_of(data, ("x1", "x2"))
    fits = [FM.Fit(0, True), FM.Fit(4, False)]
    prep = FM.prepare(ft, fits)
    trees = FM.fit_boosting(ft, fits, prep, max_iter=5, depth=3, bins=8)
    local = sorted(ft.table.collect(), key=lambda r: r.row_id)
    cats, nums = np.array([r.cats for r in local]), np.array([r.nums for r in local])
    roles, y = np.array([r.roles for r in local]), np.array([r.y for r in local])
    got = {}
    for r in FM.predictions(ft, fits, prep, trees).collect():
        got.setdefault(r.fit, {})[r.row_id] = r.p
    for i, f in enumerate(fits):
        filled = np.where(np.isnan(nums), prep.fill[i], nums)
        x = np.column_stack([np.where(cats < 0, prep.mode[i], cats), *[np.searchsorted(e, filled[:, c]) for c, e in enumerate(trees.edges)]])
        n_bins = [len(ft.categories["cat"]), *[len(e) + 1 for e in trees.edges]]
        m = f.learns(roles) & (y >= 0)
        want = grown(x[m], n_bins, 1, y[m], prep.weight[i][y[m]], 3, 5, 3, 0.1, 1.0, 1.0)
        mine = FM._scores(trees, i, x[m], None, 0, 5)
        assert np.allclose(mine, want, atol=1e-9)
        assert len(got[i]) == sum((roles[:, f.slot] == 3) | ((roles[:, f.slot] == 2) & (not f.with_calib)))


def test_boosting_reads_rows_folded_by_their_codes(data):
    """Twice the rows are the same number of folded rows, with twice the counts."""
    df, roles = data
    fits = [FM.Fit(0, True), FM.Fit(4, False)]
    seen = []
    for rows in (df, df.unionByName(df.withColumn("row_id", F.col("row_id") + 600))):
        ft = table_of((rows, roles), ("x1", "x2"))
        edges = FM._edges(table_of(data, ("x1", "x2")), 4)
        folded, n = FM.folded_rows(ft, fits, edges)
        found = {(r.y, tuple(r.bins)): r.n for r in folded.collect()}
        assert len(found) == n < 300 and sum(v[0] for v in found.values()) == ft.table.where("y >= 0 AND roles[0] IN (1, 2)").count()
        seen.append(found)
    assert seen[1] == {k: [2 * x for x in v] for k, v in seen[0].items()}


def brute_isotonic(points):
    """Max over starts of min over ends of the mean of a stretch."""
    x = sorted(points)
    s = np.r_[0, np.cumsum([p[1] * p[2] for p in x])]
    w = np.r_[0, np.cumsum([p[2] for p in x])]
    mean = lambda a, b: (s[b] - s[a]) / (w[b] - w[a])
    return {x[i][0]: max(min(mean(a, b) for b in range(i + 1, len(x) + 1)) for a in range(i + 1)) for i in range(len(x))}


@pytest.mark.parametrize("per_range", [10, 10**6])
def test_isotonic_pools_match_brute_force(spark, per_range):
    rng = np.random.default_rng(2)
    rows = [(k, round(float(s), 2), bool(rng.random() < s)) for k in range(2) for s in rng.random(200)]
    df = spark.createDataFrame(rows, "k int, score double, hit boolean")
    got = {}
    for r in FM.isotonic_pools(df, ["k"], per_range).collect():
        got.setdefault(r.k, []).append((r.lo, r.hi, r["mean"]))
    for k in range(2):
        by = {}
        for _, s, h in [r for r in rows if r[0] == k]:
            by.setdefault(s, []).append(h)
        want = brute_isotonic([(s, sum(h) / len(h), len(h)) for s, h in by.items()])
        for s, v in want.items():
            assert [m for lo, hi, m in got[k] if lo <= s <= hi] == [pytest.approx(v)]


def test_forests_of_all_folds_match_the_fit_of_one_fold(data, monkeypatch):
    """All trees of all folds take one job a level, no fit of Spark ML, and predict as well as a forest of Spark ML does."""
    df, roles = data
    df = df.withColumn("x2", F.when(~F.isnan("x2"), F.col("x2")))
    features = M.FeatureSet("f", ("cat",), ("x1", "x2", "nothing"))
    spec = M.RunSpec("forest", "none", (("trees", 30), ("depth", 5)))
    cols = [f"prob_{x}" for x in LABELS]
    one, _, _ = M.predict_fold(df, roles, 1, 0, M.FeatureSet("f", ("cat",), ("x1", "x2")), spec, LABELS, "grp")
    one = {r.row_id: [r[c] for c in cols] for r in one.collect()}

    def alone(*a, **k):
        raise AssertionError("fitted fold by fold")
    monkeypatch.setattr(M, "predict_fold_all", alone)
    joint, status, _ = M.out_of_fold(df, roles, features, spec, LABELS, "grp")
    rows = joint.collect()
    assert status == "OK" and len(rows) == joint.select("row_id", "seed", "fold").distinct().count() == 2 * 588
    assert all(abs(sum(r[c] for c in cols) - 1) < 1e-6 for r in rows)
    own = {r.row_id: [r[c] for c in cols] for r in rows if (r.seed, r.fold) == (1, 0)}
    assert own.keys() == one.keys()
    gap = np.array([np.abs(np.subtract(own[i], one[i])).max() for i in own])
    assert gap.mean() < 0.12
    again = {(r.row_id, r.seed): r.prob_a for r in M.out_of_fold(df.repartition(3), roles, features, spec, LABELS, "grp")[0].collect()}
    assert all(again[r.row_id, r.seed] == pytest.approx(r.prob_a, abs=1e-9) for r in rows)


def test_bootstrap_draws_a_poisson_number_of_each_folded_row():
    n = np.repeat([1, 7, 5000], 4000)
    sample = FM._Bootstrap(np.arange(len(n)), np.zeros((len(n), 1), np.int64), n)
    drawn = sample.drawn(42, 3)
    for mean in (1, 7, 5000):
        some = drawn[n == mean]
        assert abs(some.mean() - mean) < 4 * np.sqrt(mean / 4000) and 0.9 < some.var() / mean < 1.1
    assert (drawn == sample.drawn(42, 3)).all() and (drawn != sample.drawn(42, 4)).any()


def test_sigmoid_steps_read_packed_scores(spark, monkeypatch):
    """Maps of several keys: the scores are dealt out once, and the steps find the minimum that plain Newton steps find."""
    rng = np.random.default_rng(3)
    rows = [(k, float(p), bool(rng.random() < p ** (1 + k))) for k in range(3) for p in rng.random(700)] + [(9, 0.5, True), (0, None, True)]
    calib = spark.createDataFrame(rows, "k int, score double, hit boolean").repartition(4)
    monkeypatch.setattr(FM, "PACKED_ROWS", 50)
    kept, plain = [], FM.written
    monkeypatch.setattr(FM, "written", lambda df: kept.append(plain(df)) or kept[-1])
    found = {k: (a, b) for k, a, b in FM.sigmoid_maps(calib, ["k"])}
    assert found.keys() == {0, 1, 2} and len(kept) == 1 and kept[0].count() < 700
    for k in range(3):
        s, h = (np.array(x) for x in zip(*[(r[1], r[2]) for r in rows if r[0] == k and r[1] is not None]))
        n_hit, n_miss = h.sum() + (k == 0), (~h).sum()
        t = np.where(h, (n_hit + 1) / (n_hit + 2), 1 / (n_miss + 2))
        q = 1 / (1 + np.exp(-(found[k][0] * s + found[k][1])))
        assert abs(((q - t) * s).sum()) < 1e-3 and abs((q - t).sum()) < 1e-3


def test_isotonic_pools_read_their_rows_once(spark):
    """Two reads, for the keys and for the scores, however many ranges are pooled; before, every step read the rows again."""
    rng = np.random.default_rng(4)
    plain = spark.createDataFrame([(k, round(float(s), 3), bool(rng.random() < s)) for k in range(2) for s in rng.random(900)], "k int, score double, hit boolean")
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b
    df = plain.mapInArrow(counted, plain.schema)
    ranged = {(r.k, r.lo, r.hi): r["mean"] for r in FM.isotonic_pools(df, ["k"], 50).collect()}
    assert reads.value <= 2 * 1800
    whole = {(r.k, r.lo, r.hi): r["mean"] for r in FM.isotonic_pools(plain, ["k"]).collect()}
    assert ranged == pytest.approx(whole) and len(whole) > 4


def test_grid_needs_no_row_predictions(data, monkeypatch):
    """Metrics of a grid come from sums over rows, or over rows folded by their codes; they are those of the predictions."""
    df, roles = data
    features, specs = M.FeatureSet("f", ("cat",), ("x1", "x2")), [
        M.RunSpec("logistic", "none"), M.RunSpec("logistic", "sigmoid"), M.RunSpec("boosting", "temperature", (("max_iter", 3),)), M.RunSpec("logistic", "isotonic")]
    monkeypatch.setattr(M, "isotonic_gate", lambda counts: None)
    want = {}
    for spec in specs:
        pred = M.out_of_fold(df, roles, features, spec, LABELS, "grp")[0]
        scores = M.metrics.two_level_rollup(M.prediction_metrics(pred, ["seed", "fold"], LABELS), [], "seed", M.GRID_METRICS).first().asDict()
        want[spec.model, spec.calibration] = scores

    def rows(*a, **k):
        raise AssertionError("predictions of single rows")
    monkeypatch.setattr(FM, "predictions", rows)
    got = {(r["model"], r["calibration"]): r.asDict() for r in M.compare_runs(df, roles, features, specs, LABELS, "grp").collect()}
    assert got.keys() == want.keys()
    for key, scores in want.items():
        assert got[key]["status"] == "OK" and {c: got[key][c] for c in scores} == pytest.approx(scores, abs=1e-9)
    assert got["logistic", "sigmoid"]["raw_brier_mean"] != got["logistic", "none"]["raw_brier_mean"]


def test_models_of_a_grid_share_table_and_preparation(data, monkeypatch):
    """Rows are coded once and prepared once for both models; before, each model did both again."""
    df, roles = data
    tables, orders, plain, running = [], [], FM.fold_table, FM.ordering.cumulative
    monkeypatch.setattr(FM, "fold_table", lambda *a, **k: tables.append(a) or plain(*a, **k))
    monkeypatch.setattr(FM.ordering, "cumulative", lambda *a, **k: orders.append(a) or running(*a, **k))
    specs = [M.RunSpec("logistic", "none"), M.RunSpec("boosting", "none", (("max_iter", 1), ("depth", 1)))]
    got = M.compare_runs(df, roles.where("seed = 1"), M.FeatureSet("f", ("cat",), ("x1", "x2")), specs, LABELS, "grp").collect()
    assert [r.status for r in got] == ["OK", "OK"] and len(tables) == len(orders) == 1
