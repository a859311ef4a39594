"""Feature preparation, models, calibration and comparisons on order rows with customer evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evitrust.operators import folds, modeling as M, plausibility
from evitrust.plans.fixtures import LABELS
from evitrust.plans.registry import Tables, query
from evitrust.plans.trust_queries import rounded, sizing
from evitrust.sources.shared import written

ROWS = """SELECT o_orderkey AS row_id, o_custkey AS grp, o_orderstatus AS y_true, o_orderpriority AS priority,
  CASE WHEN o_orderkey % 13 <> 0 THEN c_mktsegment END AS segment, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice / 9973.0e0 END AS price,
  c_acctbal / 97.0e0 AS balance, CAST(o_orderkey % 5 AS DOUBLE) AS level FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""
CATEGORICAL, NUMERIC = ["priority", "segment"], ["price", "balance", "level"]
BASE = M.FeatureSet("ml", tuple(CATEGORICAL), ("price", "level"))
EVIDENCE = M.FeatureSet("mech", (), ("balance",))
FUSED = M.FeatureSet("fused", tuple(CATEGORICAL), tuple(NUMERIC))
SEEDS, FOLDS = (42, 43, 44), 5
MODELS = [M.RunSpec(m, c) for m in ("logistic", "boosting") for c in ("none", "sigmoid", "isotonic", "temperature")]


def rows(t: Tables) -> DataFrame:
    return t.sql(ROWS)


def outer_folds(t: Tables, seeds=None, n_splits: int | None = None) -> DataFrame:
    n_splits = n_splits or FOLDS
    return folds.stratified_group_folds(rows(t), "grp", "y_true", LABELS, list(seeds or SEEDS), n_splits, **sizing(t))


def plain_roles(t: Tables, **kw) -> DataFrame:
    f = outer_folds(t, **kw)
    n = kw.get("n_splits", FOLDS)
    slots = f.withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return slots.select("seed", F.col("_f").alias("fold"), "grp",
                        F.when(F.col("_f") == F.col("fold"), "test").otherwise("train").alias("role"))


def calibration_roles(t: Tables, seeds=None, n_splits: int | None = None) -> DataFrame:
    n_splits = n_splits or FOLDS
    return folds.calibration_roles(rows(t), outer_folds(t, seeds, n_splits), "grp", "y_true", LABELS,
                                   n_outer=n_splits, **sizing(t))


@query("imputed_scaled_features", f"""WITH r AS ({ROWS}), tr AS (SELECT * FROM r WHERE row_id%3<>0), m AS (SELECT median(price) AS mp, median(balance) AS mb, median(level) AS ml FROM tr),
 f AS (SELECT row_id, coalesce(price,mp) AS p, coalesce(balance,mb) AS b, coalesce(level,ml) AS l FROM r, m),
 s AS (SELECT avg(p) AS ap, stddev_pop(p) AS sp, avg(b) AS ab, stddev_pop(b) AS sb, avg(l) AS al, stddev_pop(l) AS sl FROM f WHERE row_id%3<>0)
 SELECT row_id, round((p-ap)/sp,6)+0 AS price, round((b-ab)/sb,6)+0 AS balance, round((l-al)/sl,6)+0 AS level FROM f, s""")
def imputed_scaled_features(t):
    df = rows(t)
    prep = M.fit_preparation(df.where("row_id % 3 <> 0"), [], NUMERIC, **sizing(t))
    out = df.select("row_id", *[e.alias(c) for c, e in prep.numeric_columns().items()])
    return rounded(out, *NUMERIC, digits=6)


@query("encoded_feature_vectors")
def encoded_feature_vectors(t):
    df = rows(t)
    prep = M.fit_preparation(df.where("row_id % 3 <> 0"), CATEGORICAL, NUMERIC, with_mean=False)
    from pyspark.ml.functions import vector_to_array
    return prep.apply(df).select("row_id", vector_to_array("features").alias("features"))


@query("class_weights", """WITH c AS (SELECT o_orderstatus, count(*) AS n FROM {orders} GROUP BY 1) SELECT o_orderstatus, n,
 round((SELECT sum(n) FROM c)/CAST((SELECT count(*) FROM c)*n AS DOUBLE),8) AS weight FROM c""")
def class_weights(t):
    return rounded(M.class_weights(t.orders, "o_orderstatus"), "weight")


@query("forest_baseline")
def forest_baseline(t):
    return M.forest_baseline(rows(t), outer_folds(t), FUSED, LABELS, "grp")


@query("logistic_out_of_fold")
def logistic_out_of_fold(t):
    return M.out_of_fold(rows(t), plain_roles(t), FUSED, M.RunSpec("logistic", "none"), LABELS, "grp")[0]


@query("boosting_out_of_fold")
def boosting_out_of_fold(t):
    return M.out_of_fold(rows(t), plain_roles(t), FUSED, M.RunSpec("boosting", "none"), LABELS, "grp")[0]


@query("single_class_fallback", """SELECT o_orderkey AS row_id, 0e0 AS "prob_F", 1e0 AS "prob_O", 0e0 AS "prob_P" FROM {orders}""")
def single_class_fallback(t):
    df = rows(t).withColumn("features", F.lit(None))
    fitted = M.fit_classifier(df.where("y_true = 'O'"), "logistic", LABELS)
    return fitted.predict(t.orders.select(F.col("o_orderkey").alias("row_id")))


@query("sigmoid_calibrated_predictions")
def sigmoid_calibrated(t):
    return M.out_of_fold(rows(t), calibration_roles(t), FUSED, M.RunSpec("logistic", "sigmoid"), LABELS, "grp")[0]


@query("isotonic_calibrated_predictions")
def isotonic_calibrated(t):
    return M.out_of_fold(rows(t), calibration_roles(t), FUSED, M.RunSpec("logistic", "isotonic"), LABELS, "grp")[0]


@query("model_calibration_grid")
def model_calibration_grid(t):
    return M.compare_runs(rows(t), calibration_roles(t), FUSED, MODELS, LABELS, "grp")


@query("default_model_choice")
def default_model_choice(t):
    return M.default_run(M.compare_runs(rows(t), calibration_roles(t), FUSED, MODELS, LABELS, "grp"))


def _facts(t: Tables, pred: DataFrame, roles: DataFrame, run: str) -> DataFrame:
    """What must hold of any predictions: each row once, probabilities that sum to one, the label of the largest, and no
    group that the model of its fold has learnt from."""
    cols = [F.col(f"prob_{x}") for x in LABELS]
    learnt = roles.where("role <> 'test'").select("seed", "fold", F.col("grp").alias("_g"))
    seen = pred.select("seed", "fold", "grp").distinct().join(
        learnt, ["seed", "fold"]).where("grp = _g").agg(F.count(F.lit(1)).alias("n_groups_in_both"))
    top = F.when(F.col("y_pred") == LABELS[0], cols[0]).when(F.col("y_pred") == LABELS[1], cols[1]).otherwise(cols[2])
    out = pred.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("row_id").alias("n_distinct"),
                   F.count_if(F.abs(sum(cols) - 1) > 1e-9).alias("n_bad_sums"),
                   F.count_if(top < F.greatest(*cols)).alias("n_bad_labels"))
    return out.join(F.broadcast(seen)).withColumn("run", F.lit(run))  # one row each


def _facts_sql(run: str) -> str:
    return f"""SELECT '{run}' AS run, count(*) AS n_rows, count(*) AS n_distinct, CAST(0 AS BIGINT) AS n_bad_sums, CAST(0 AS BIGINT) AS n_bad_labels,
 CAST(0 AS BIGINT) AS n_groups_in_both FROM {{orders}}"""


def _register_facts(name: str, spec: M.RunSpec) -> None:
    @query(name, _facts_sql(name))
    def facts(t):
        one = SEEDS[:1]  # the SQL twin counts each row once
        roles = plain_roles(t, seeds=one) if spec.calibration == "none" else calibration_roles(t, one)
        pred, _, _ = M.out_of_fold(rows(t), roles, FUSED, spec, LABELS, "grp")
        return _facts(t, pred, roles, name)


for _name, _spec in {
        "logistic_facts": M.RunSpec("logistic", "none"), "forest_facts": M.RunSpec("forest", "none"),
        "boosting_facts": M.RunSpec("boosting", "none"), "sigmoid_facts": M.RunSpec("logistic", "sigmoid"),
        "isotonic_facts": M.RunSpec("logistic", "isotonic"), "temperature_facts": M.RunSpec("logistic", "temperature")}.items():
    _register_facts(_name, _spec)


@query("saturated_logistic", """WITH n AS (SELECT o_orderpriority AS p, o_orderstatus AS s, CAST(count(*) AS DOUBLE) AS c FROM {orders} GROUP BY 1,2),
 k AS (SELECT DISTINCT p FROM n), f AS (SELECT p, coalesce(sum(c) FILTER (s='F'),0) AS f, coalesce(sum(c) FILTER (s='O'),0) AS o, coalesce(sum(c) FILTER (s='P'),0) AS q FROM n GROUP BY p)
 SELECT p AS priority, round(f/(f+o+q),3) AS "prob_F", round(o/(f+o+q),3) AS "prob_O", round(q/(f+o+q),3) AS "prob_P" FROM f""")
def saturated_logistic(t):
    """One category as the only feature, no penalty, no class weights: the model gives the class shares of each category."""
    df = t.orders.select(F.col("o_orderstatus").alias("y_true"), F.col("o_orderpriority").alias("priority"))
    prep = M.fit_preparation(df, ["priority"], [])
    fitted = M.fit_classifier(prep.apply(df), "logistic", LABELS, balanced=False)
    out = fitted.predict(prep.apply(df.select("priority").distinct()))
    return rounded(out.select("priority", *[f"prob_{x}" for x in LABELS]), *[f"prob_{x}" for x in LABELS], digits=3)


@query("isotonic_of_two_scores", """SELECT CASE WHEN o_orderkey%3=0 THEN 0.2e0 ELSE 0.7e0 END AS score,
 round(avg(CASE WHEN o_orderstatus='O' THEN 1e0 ELSE 0e0 END),8) AS mean FROM {orders} GROUP BY 1""")
def isotonic_of_two_scores(t):
    """On two scores in rising order of their means, the step map gives the mean of each."""
    two = F.when(F.col("o_orderkey") % 3 == 0, 0.2).otherwise(0.7)
    hit = (F.col("o_orderstatus") == "O").cast("double")
    means = {r["s"]: r["m"] for r in t.orders.groupBy(two.alias("s")).agg(F.avg(hit).alias("m")).collect()}  # two rows
    up = means[0.2] <= means[0.7]
    df = t.orders.select(two.alias("score"), hit.alias("hit"))
    return rounded(M.isotonic_means(df, "score", "hit", increasing=up), "mean")


@query("feature_set_comparison")
def feature_set_comparison(t):
    spec = M.RunSpec("logistic", "none")
    return M.compare_feature_sets(rows(t), plain_roles(t), [BASE, EVIDENCE, FUSED], spec, LABELS, "grp")


@query("feature_ablation_equality")
def feature_ablation_equality(t):
    df = rows(t).withColumn("empty", F.lit(None).cast("double"))
    with_empty = M.FeatureSet("ml_plus_empty", BASE.categorical, (*BASE.numeric, "empty"))
    scores = M.compare_feature_sets(df, plain_roles(t), [BASE, with_empty],
                                    M.RunSpec("logistic", "none"), LABELS, "grp")
    return M.equal_configs(scores, "ml", "ml_plus_empty")


@query("shuffled_column", """WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS i FROM {orders}), b AS (SELECT o_totalprice,
 row_number() OVER (ORDER BY md5('42:price:0:'||CAST(o_orderkey AS VARCHAR)), o_orderkey) AS i FROM {orders}) SELECT o_orderkey, o_totalprice FROM a JOIN b ON a.i=b.i""")
def shuffled_column(t):
    return M.shuffled_column(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice", "42:price:0", **sizing(t))


@query("permutation_importance")
def permutation_importance(t):
    df = written(rows(t).join(outer_folds(t, SEEDS[:1]).drop("seed"), "grp"))  # read by every step of the fit
    train, test = df.where("fold <> 0"), df.where("fold = 0")
    prep = M.fit_preparation(train, CATEGORICAL, NUMERIC)
    fitted = M.fit_classifier(prep.apply(train), "logistic", LABELS)
    return M.permutation_importance(fitted, prep, test, [*CATEGORICAL, *NUMERIC], LABELS, **sizing(t))


@query("entity_model_plausibility")
def entity_model_plausibility(t):
    """Entity-level model per fold on evidence columns, joined to that fold's predictions."""
    entity = t.customer.select(F.col("c_custkey").alias("grp"), (F.col("c_acctbal") / 97.0).alias("x1"),
                               F.when(F.col("c_custkey") % 5 != 0, (F.col("c_nationkey") * 1.0)).alias("x2"))
    from evitrust.operators import harmonize
    labels = harmonize.majority_label(rows(t), "grp", "y_true", {"F": 0, "O": 1, "P": 2}).select("grp", F.col("label").alias("y_true"))
    entity = entity.join(labels, "grp").withColumn("row_id", F.col("grp"))
    feature_set = M.FeatureSet("evidence", (), ("x1", "x2"))
    roles = plain_roles(t)
    pred, _, _ = M.out_of_fold(rows(t), roles, BASE, M.RunSpec("logistic", "none"), LABELS, "grp")
    mech, _, _ = M.out_of_fold(entity, roles, feature_set, M.RunSpec("logistic", "none"), LABELS, "grp")
    missing = entity.select("grp", (F.col("x2").isNull().cast("double") / 2).alias("mech_missing_frac"))
    table = mech.select("seed", "fold", "grp", *[F.col(f"prob_{x}").alias(f"p_mech_{x}") for x in LABELS]).join(missing, "grp")
    return plausibility.plausibility_scores(pred, table, ["seed", "fold", "grp"], LABELS)
