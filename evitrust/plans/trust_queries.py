"""Selective prediction, percentiles, trust policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evitrust import contracts
from evitrust.functions import probs
from evitrust.operators import curves, late_fusion, metrics, plausibility, trust
from evitrust.plans.fixtures import LABELS, PREDICTIONS, PREDICTIONS_B, PROBS
from evitrust.plans.registry import Tables, query

ROUND = 8


def rounded(df: DataFrame, *columns: str, digits: int = ROUND) -> DataFrame:
    """Round result columns so both engines agree on the last bits; -0.0 becomes 0.0."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def sizing(t: Tables, table: str = "orders") -> dict:
    """No group has more rows than the base table (a count from parquet footers)."""
    if t.rows_per_range:
        return {"max_rows_per_range": t.rows_per_range}
    return {"group_at_most": getattr(t, table).count()}


def predictions(t: Tables) -> DataFrame:
    return t.sql(PREDICTIONS)


RATE_ROWS = "(VALUES " + ",".join(f"(CAST({r} AS DOUBLE))" for r in curves.DEFAULT_RATES) + ") r(rate)"


def curve_cte(scored: str, keys: str, rates: str = RATE_ROWS) -> str:
    """CTE chain up to ``curve``; ``scored`` yields keys, row_id, y_true, y_pred, u (untrust)."""
    k = keys
    on = " AND ".join(f"x.{c.strip()} = y.{c.strip()}" for c in keys.split(","))
    return f"""
    sc AS ({scored}),
    pos AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY u DESC, row_id) AS p,
                   count(*) OVER (PARTITION BY {k}) AS n FROM sc),
    kept AS (SELECT pos.*, rate FROM pos, {rates} WHERE p > floor(rate*n)),
    tot AS (SELECT {k}, rate, max(n) AS n_total, count(*) AS n_kept FROM kept GROUP BY {k}, rate),
    rec AS (SELECT {k}, rate, avg(r) AS ba FROM (
              SELECT {k}, rate, y_true, avg(CASE WHEN y_pred=y_true THEN 1e0 ELSE 0e0 END) AS r
              FROM kept GROUP BY {k}, rate, y_true) GROUP BY {k}, rate),
    f1 AS (SELECT {k}, rate, sum(f)/3e0 AS mf FROM (
              SELECT {k}, rate, lab, CASE WHEN sum(tp)*2+sum(fp)+sum(fn) > 0
                     THEN 2e0*sum(tp)/(2*sum(tp)+sum(fp)+sum(fn)) ELSE 0e0 END AS f
              FROM (SELECT {k}, rate, lab,
                      CASE WHEN y_true=lab AND y_pred=lab THEN 1 ELSE 0 END AS tp,
                      CASE WHEN y_true<>lab AND y_pred=lab THEN 1 ELSE 0 END AS fp,
                      CASE WHEN y_true=lab AND y_pred<>lab THEN 1 ELSE 0 END AS fn
                    FROM kept, (VALUES ('F'),('O'),('P')) l(lab)) GROUP BY {k}, rate, lab)
            GROUP BY {k}, rate),
    curve AS (SELECT {', '.join('x.' + c.strip() for c in k.split(','))}, x.rate AS abstention_rate,
                     x.n_kept/CAST(x.n_total AS DOUBLE) AS coverage, x.n_total, x.n_kept,
                     y.ba AS balanced_accuracy, z.mf AS macro_f1
              FROM tot x JOIN rec y ON {on} AND x.rate=y.rate
              JOIN f1 z ON {on.replace('y.', 'z.')} AND x.rate=z.rate)"""


CONF_SCORED = "SELECT seed, fold, row_id, y_true, y_pred, -confidence AS u FROM pred"
CURVE_OUT = """SELECT seed, fold, abstention_rate, round(coverage,8) AS coverage, n_total, n_kept,
 round(balanced_accuracy,8) AS balanced_accuracy, round(macro_f1,8) AS macro_f1 FROM curve"""


def confidence_curve(t: Tables) -> DataFrame:
    pred = predictions(t).withColumn("untrust", -F.col("confidence"))
    return curves.abstention_curve(pred, ["seed", "fold"], "untrust", LABELS, **sizing(t))


@query("abstention_curve", f"WITH pred AS ({PREDICTIONS}), {curve_cte(CONF_SCORED, 'seed, fold')} {CURVE_OUT}")
def abstention_curve(t):
    return rounded(confidence_curve(t), "coverage", "balanced_accuracy", "macro_f1")


# --- curve summaries -------------------------------------------------------------------------

SUMMARY_CTE = """summary AS (SELECT {k} abstention_rate, avg(coverage) AS coverage_mean,
  coalesce(stddev_samp(coverage),0) AS coverage_std, avg(balanced_accuracy) AS balanced_accuracy_mean,
  coalesce(stddev_samp(balanced_accuracy),0) AS balanced_accuracy_std, avg(macro_f1) AS macro_f1_mean,
  coalesce(stddev_samp(macro_f1),0) AS macro_f1_std, count(*) AS n_groups FROM curve GROUP BY {g})"""


def summary_cte(keys: str = "") -> str:
    k = keys + ", " if keys else ""
    return SUMMARY_CTE.format(k=k, g=k + "abstention_rate")


CONF_CURVE = f"WITH pred AS ({PREDICTIONS}), {curve_cte(CONF_SCORED, 'seed, fold')}"


@query("curve_summary", f"""{CONF_CURVE}, {summary_cte()} SELECT abstention_rate,
 round(coverage_mean,8) AS coverage_mean, round(coverage_std,8) AS coverage_std,
 round(balanced_accuracy_mean,8) AS balanced_accuracy_mean, round(balanced_accuracy_std,8) AS balanced_accuracy_std,
 round(macro_f1_mean,8) AS macro_f1_mean, round(macro_f1_std,8) AS macro_f1_std, n_groups FROM summary""")
def curve_summary(t):
    s = curves.summarize_curve(confidence_curve(t))
    return rounded(s, *[c for c in s.columns if c.endswith(("_mean", "_std"))])


@query("curve_best_rate", f"""{CONF_CURVE}, {summary_cte()} SELECT abstention_rate, round(coverage_mean,8) AS coverage_mean,
 round(balanced_accuracy_mean,8) AS balanced_accuracy_mean FROM summary
 ORDER BY summary.balanced_accuracy_mean DESC, abstention_rate LIMIT 1""")
def curve_best_rate(t):
    best = curves.best_rate(curves.summarize_curve(confidence_curve(t)))
    return rounded(best.select("abstention_rate", "coverage_mean", "balanced_accuracy_mean"),
                   "coverage_mean", "balanced_accuracy_mean")


@query("curve_delta_vs_rate_zero", f"""{CONF_CURVE}, {summary_cte()} SELECT abstention_rate,
 round(balanced_accuracy_mean - (SELECT b.balanced_accuracy_mean FROM summary b WHERE b.abstention_rate=0),8)
   AS delta_vs_baseline FROM summary""")
def curve_delta(t):
    d = curves.delta_vs_rate_zero(curves.summarize_curve(confidence_curve(t)))
    return rounded(d.select("abstention_rate", "delta_vs_baseline"), "delta_vs_baseline")


@query("rate_zero_sanity_check", f"""{CONF_CURVE},
 plain AS (SELECT seed, fold, avg(r) AS ba FROM (SELECT seed, fold, y_true,
   avg(CASE WHEN y_pred=y_true THEN 1e0 ELSE 0e0 END) AS r FROM pred GROUP BY ALL) GROUP BY ALL)
 SELECT c.seed, c.fold, round(c.balanced_accuracy,8) AS curve_balanced_accuracy,
 round(p.ba,8) AS plain_balanced_accuracy, 0e0 AS gap
 FROM curve c JOIN plain p ON c.seed=p.seed AND c.fold=p.fold WHERE abstention_rate=0""")
def rate_zero(t):
    out = curves.rate_zero_check(confidence_curve(t), predictions(t), ["seed", "fold"], LABELS)
    return rounded(out, "curve_balanced_accuracy", "plain_balanced_accuracy", "gap")


COV_CTE = """placed AS (SELECT *, row_number() OVER (PARTITION BY seed, fold ORDER BY confidence DESC, row_id) AS p,
   count(*) OVER (PARTITION BY seed, fold) AS n FROM pred),
 kept AS (SELECT placed.*, coverage FROM placed, (VALUES (CAST(0.5 AS DOUBLE)),(CAST(0.7 AS DOUBLE)),
   (CAST(0.9 AS DOUBLE)),(CAST(1.0 AS DOUBLE))) c(coverage) WHERE p <= ceil(coverage*n))"""


@query("coverage_target_curve", f"""WITH pred AS ({PREDICTIONS}), {COV_CTE}
 SELECT seed, fold, coverage, CAST(sum(n) AS BIGINT) AS n_kept, round(avg(r),8) AS balanced_accuracy FROM (
   SELECT seed, fold, coverage, y_true, count(*) AS n, avg(CASE WHEN y_pred=y_true THEN 1e0 ELSE 0e0 END) AS r
   FROM kept GROUP BY ALL) GROUP BY seed, fold, coverage""")
def coverage_target_curve(t):
    pred = predictions(t).withColumn("y_pred", probs.arg_max([F.col(c) for c in PROBS], LABELS))
    out = curves.coverage_curve(pred, ["seed", "fold"], "confidence", [0.5, 0.7, 0.9, 1.0], LABELS,
                                **sizing(t))
    return rounded(out.select("seed", "fold", "coverage", "n_kept", "balanced_accuracy"), "balanced_accuracy")


# --- percentiles, scores, policies ----------------------------------------------------------

PCT_CTE = f"""pred AS ({PREDICTIONS}),
 pct AS (SELECT *,
   (rank() OVER (PARTITION BY seed, fold ORDER BY confidence)
     + (count(*) OVER (PARTITION BY seed, fold, confidence)-1)/2e0)/count(*) OVER (PARTITION BY seed, fold) AS conf_percentile,
   (rank() OVER (PARTITION BY seed, fold ORDER BY ood_score)
     + (count(*) OVER (PARTITION BY seed, fold, ood_score)-1)/2e0)/count(*) OVER (PARTITION BY seed, fold) AS ood_percentile
   FROM pred)"""


def with_pct(t: Tables) -> DataFrame:
    return trust.with_percentiles(predictions(t), **sizing(t))


@query("score_percentiles", f"""WITH {PCT_CTE} SELECT row_id, seed, fold, round(conf_percentile,8) AS conf_percentile,
 round(ood_percentile,8) AS ood_percentile FROM pct""")
def score_percentiles(t):
    return rounded(with_pct(t).select("row_id", "seed", "fold", "conf_percentile", "ood_percentile"),
                   "conf_percentile", "ood_percentile")


@query("trust_scores", f"""WITH {PCT_CTE}, u AS (SELECT *, 0.25e0*ood_percentile + (1-0.25e0)*(1-conf_percentile) AS uc,
   1-missing_frac AS pl FROM pct)
 SELECT row_id, seed, fold, round(1-conf_percentile,10) AS untrust_conf, round(ood_percentile,10) AS untrust_ood,
 round(uc,10) AS untrust_combined, round(1-uc,10) AS score_combined, round((1-uc)*pl,10) AS score_combined_plus_mech,
 round((1-uc)*(0.05e0+pl),10) AS score_combined_plus_mech_eps FROM u""")
def trust_scores(t):
    df = with_pct(t).withColumn("mech_plausibility", 1 - F.col("missing_frac"))
    out = trust.with_trust_scores(df, 0.25)
    cols = ["untrust_conf", "untrust_ood", "untrust_combined", "score_combined",
            "score_combined_plus_mech", "score_combined_plus_mech_eps"]
    return rounded(out.select("row_id", "seed", "fold", *cols), *cols, digits=10)


@query("trust_rows", f"""WITH {PCT_CTE}, u AS (SELECT *, 0.5e0*ood_percentile + (1-0.5e0)*(1-conf_percentile) AS uc FROM pct)
 SELECT row_id, seed, fold, y_true, y_pred, CAST(y_true<>y_pred AS INT) AS error, round(confidence,8) AS confidence,
 round(ood_score,8) AS ood_score, round(ood_percentile,8) AS ood_percentile, round(conf_percentile,8) AS conf_percentile,
 round(uc,8) AS untrust, row_number() OVER (PARTITION BY seed, fold ORDER BY uc DESC, row_id) AS policy_rank FROM u""")
def trust_row_table(t):
    out = trust.trust_rows(with_pct(t), 0.5, **sizing(t))
    return rounded(out, "confidence", "ood_score", "ood_percentile", "conf_percentile", "untrust")


POLICY_SCORED = " UNION ALL ".join(
    ["SELECT 'confidence' AS policy, CAST(NULL AS DOUBLE) AS alpha, seed, fold, row_id, y_true, y_pred, 1-conf_percentile AS u FROM pct",
     "SELECT 'ood', CAST(NULL AS DOUBLE), seed, fold, row_id, y_true, y_pred, ood_percentile FROM pct"]
    + [f"SELECT 'combined@{a}', CAST({a} AS DOUBLE), seed, fold, row_id, y_true, y_pred, "
       f"{a}e0*ood_percentile + (1-{a}e0)*(1-conf_percentile) FROM pct" for a in trust.ALPHAS])
POLICY_CURVE = f"WITH {PCT_CTE}, {curve_cte(POLICY_SCORED, 'policy, seed, fold')}"
POLICY_ALPHA = "CASE WHEN policy LIKE 'combined@%' THEN TRY_CAST(replace(policy,'combined@','') AS DOUBLE) END"


def policy_curve(t: Tables) -> DataFrame:
    return trust.policy_curves(with_pct(t), LABELS, **sizing(t))


@query("policy_alpha_sweep", f"""{POLICY_CURVE} SELECT alpha, round(b0,8) AS bal_acc_0, round(b1,8) AS bal_acc_10,
 round(b3,8) AS bal_acc_30, round(b5,8) AS bal_acc_50 FROM (SELECT {POLICY_ALPHA} AS alpha,
  avg(balanced_accuracy) FILTER (abstention_rate=0) AS b0,
  avg(balanced_accuracy) FILTER (abstention_rate=CAST(0.1 AS DOUBLE)) AS b1,
  avg(balanced_accuracy) FILTER (abstention_rate=CAST(0.3 AS DOUBLE)) AS b3,
  avg(balanced_accuracy) FILTER (abstention_rate=CAST(0.5 AS DOUBLE)) AS b5
  FROM curve WHERE policy LIKE 'combined@%' GROUP BY ALL)""")
def policy_alpha_sweep(t):
    c = policy_curve(t)
    s = trust.sweep_table(c.where(F.col("policy") == "combined"), "alpha")
    return rounded(s, *[x for x in s.columns if x.startswith("bal_acc")])


ALPHA_PICK = f"""alphas AS (SELECT {POLICY_ALPHA} AS alpha,
  round(avg(balanced_accuracy) FILTER (abstention_rate=CAST(0.1 AS DOUBLE)),12) AS b1,
  round(avg(balanced_accuracy) FILTER (abstention_rate=CAST(0.3 AS DOUBLE)),12) AS b3,
  round(avg(balanced_accuracy) FILTER (abstention_rate=CAST(0.5 AS DOUBLE)),12) AS b5
  FROM curve WHERE policy LIKE 'combined@%' GROUP BY ALL),
 best AS (SELECT alpha FROM alphas ORDER BY b3 DESC, b1 DESC, b5 DESC, alpha LIMIT 1)"""


@query("policy_selected_alpha", f"""{POLICY_CURVE}, {ALPHA_PICK} SELECT alpha FROM best""")
def policy_selected_alpha(t):
    return trust.alpha_or_default(trust.select_alpha(policy_curve(t)))


@query("policy_chosen_curves", f"""{POLICY_CURVE}, {ALPHA_PICK}
 SELECT CASE WHEN policy LIKE 'combined@%' THEN 'combined' ELSE policy END AS policy, {POLICY_ALPHA} AS alpha, seed, fold,
 abstention_rate, round(coverage,8) AS coverage, n_total, n_kept, round(balanced_accuracy,8) AS balanced_accuracy,
 round(macro_f1,8) AS macro_f1 FROM curve
 WHERE policy NOT LIKE 'combined@%' OR {POLICY_ALPHA} = (SELECT alpha FROM best)""")
def policy_chosen_curves(t):
    # the sweep is small (policies x folds x rates) and read twice
    curve = policy_curve(t).persist()
    return rounded(trust.chosen_policy_curves(curve), "coverage", "balanced_accuracy", "macro_f1")


@query("policy_comparison", f"""{POLICY_CURVE}, {summary_cte('policy')}
 SELECT c.abstention_rate, round(c.balanced_accuracy_mean,8) AS confidence_bal_acc,
 round(o.balanced_accuracy_mean,8) AS ood_bal_acc, round(o.balanced_accuracy_mean-c.balanced_accuracy_mean,8) AS difference
 FROM summary c JOIN summary o ON c.abstention_rate=o.abstention_rate
 WHERE c.policy='confidence' AND o.policy='ood'
 AND c.abstention_rate IN (CAST(0.1 AS DOUBLE), CAST(0.3 AS DOUBLE), CAST(0.5 AS DOUBLE))""")
def policy_comparison(t):
    curve = trust.policy_curves(with_pct(t), LABELS, alphas=(), **sizing(t))
    s = curves.summarize_curve(curve, ["policy"])
    out = trust.compare_policies(s.where("policy = 'confidence'"), s.where("policy = 'ood'"),
                                 "confidence", "ood")
    return rounded(out, "confidence_bal_acc", "ood_bal_acc", "difference")


VARIANT_SCORED = " UNION ALL ".join(
    f"SELECT '{v}' AS variant, seed, fold, row_id, y_true, y_pred, {e} AS u FROM u0" for v, e in [
        ("confidence", "1-conf_percentile"), ("ood", "ood_percentile"), ("combined", "uc"),
        ("combined_plus_mech", "1-(1-uc)*pl"), ("combined_plus_mech_eps", "1-(1-uc)*(0.05e0+pl)")])
VARIANT_RATES = "(VALUES (CAST(0.1 AS DOUBLE)),(CAST(0.3 AS DOUBLE)),(CAST(0.5 AS DOUBLE))) r(rate)"
VARIANT_CURVE = f"""WITH {PCT_CTE}, u0 AS (SELECT *, 0.5e0*ood_percentile + (1-0.5e0)*(1-conf_percentile) AS uc,
   1-missing_frac AS pl FROM pct), {curve_cte(VARIANT_SCORED, 'variant, seed, fold', VARIANT_RATES)},
 vs AS (SELECT CASE abstention_rate WHEN CAST(0.1 AS DOUBLE) THEN 0.9e0 WHEN CAST(0.3 AS DOUBLE) THEN 0.7e0 ELSE 0.5e0 END
   AS coverage_target, variant, avg(balanced_accuracy) AS bm, coalesce(stddev_samp(balanced_accuracy),0) AS bs,
   avg(coverage) AS cm, coalesce(stddev_samp(coverage),0) AS cs, count(*) AS n_groups FROM curve GROUP BY ALL)"""


def variant_curve(t: Tables) -> DataFrame:
    df = with_pct(t).withColumn("mech_plausibility", 1 - F.col("missing_frac"))
    return trust.variant_curves(trust.with_trust_scores(df, 0.5), LABELS,
                                **sizing(t))


@query("variant_summary", f"""{VARIANT_CURVE} SELECT v.coverage_target, v.variant, round(v.bm,8) AS balanced_accuracy_mean,
 round(v.bs,8) AS balanced_accuracy_std, round(v.cm,8) AS coverage_mean, round(v.cs,8) AS coverage_std, v.n_groups,
 round(v.bm-b.bm,8) AS delta_vs_combined FROM vs v JOIN vs b ON v.coverage_target=b.coverage_target AND b.variant='combined'""")
def variant_summary(t):
    s = trust.summarize_variants(variant_curve(t))
    return rounded(s, *[c for c in s.columns if c.endswith(("_mean", "_std", "_combined"))])


@query("variant_winners", f"""{VARIANT_CURVE} SELECT coverage_target, variant, round(bm,8) AS balanced_accuracy_mean FROM (
 SELECT *, row_number() OVER (PARTITION BY coverage_target ORDER BY bm DESC, variant) AS rn FROM vs) WHERE rn=1""")
def variant_winners(t):
    return rounded(trust.best_variants(trust.summarize_variants(variant_curve(t))), "balanced_accuracy_mean")


@query("direction_fix", f"""WITH pred AS ({PREDICTIONS}), m AS (SELECT
   avg(ood_score) FILTER (y_true=y_pred) AS ok, avg(ood_score) FILTER (y_true<>y_pred) AS bad FROM pred)
 SELECT row_id, seed, fold, bad<ok AS flipped, round(CASE WHEN bad<ok THEN -ood_score ELSE ood_score END,8)+0 AS ood_score
 FROM pred, m""")
def direction_fix(t):
    df = predictions(t).withColumn("error", (F.col("y_true") != F.col("y_pred")).cast("int"))
    out = trust.fix_direction(df.withColumnRenamed("ood_score", "raw"), "raw")
    return rounded(out.select("row_id", "seed", "fold", "flipped", "ood_score"), "ood_score")


# --- joins and contracts --------------------------------------------------------------------

@query("key_alignment", f"""WITH a AS (SELECT DISTINCT row_id, seed, fold FROM ({PREDICTIONS})),
 b AS (SELECT DISTINCT row_id, seed, fold FROM ({PREDICTIONS_B}) WHERE row_id % 10 <> 3)
 SELECT coalesce(a.seed,b.seed) AS seed, coalesce(a.fold,b.fold) AS fold, count(a.row_id) AS left_rows, count(b.row_id) AS right_rows,
 count(*) FILTER (a.row_id IS NULL OR b.row_id IS NULL) AS sym_diff
 FROM a FULL JOIN b ON a.row_id=b.row_id AND a.seed=b.seed AND a.fold=b.fold GROUP BY 1,2""")
def key_alignment(t):
    left, right = predictions(t), t.sql(PREDICTIONS_B).where("row_id % 10 <> 3")
    return contracts.aligned_key_counts(left, right, ["row_id", "seed", "fold"], by=["seed", "fold"])


@query("one_to_one_join", f"""WITH a AS ({PREDICTIONS}), b AS ({PREDICTIONS_B})
 SELECT a.row_id, a.seed, a.fold, a.y_true, round(a.prob_f,8) AS prob_f, round(b.q_f,8) AS q_f FROM a
 JOIN b ON a.row_id=b.row_id AND a.seed=b.seed AND a.fold=b.fold""")
def one_to_one_join(t):
    left = predictions(t).select("row_id", "seed", "fold", "y_true", "prob_f")
    right = t.sql(PREDICTIONS_B).select("row_id", "seed", "fold", "q_f")
    return rounded(trust.align_and_merge(left, right), "prob_f", "q_f")


@query("duplicate_keys", """SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM {lineitem}
 GROUP BY 1,2 HAVING count(*)>1""")
def duplicate_keys(t):
    return contracts.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("many_to_one_join", """SELECT o_orderkey, o_custkey, c_mktsegment FROM {orders} LEFT JOIN {customer} ON o_custkey=c_custkey""")
def many_to_one_join(t):
    right = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return contracts.join_many_to_one(t.orders.select("o_orderkey", "o_custkey"), right, ["o_custkey"])


@query("test_split_filter", """SELECT o_orderkey, split_role FROM (SELECT o_orderkey,
 CASE WHEN o_orderkey % 4 = 0 THEN 'calib' ELSE 'test' END AS split_role FROM {orders}) WHERE split_role='test'""")
def test_split_filter(t):
    df = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "calib").otherwise("test")
                         .alias("split_role"))
    return contracts.test_rows(df)


# --- metrics --------------------------------------------------------------------------------

@query("classification_scores", f"""WITH pred AS ({PREDICTIONS}), l AS (SELECT seed, fold, lab,
  sum(CASE WHEN y_true=lab AND y_pred=lab THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y_true<>lab AND y_pred=lab THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN y_true=lab AND y_pred<>lab THEN 1 ELSE 0 END) AS fn FROM pred, (VALUES ('F'),('O'),('P')) v(lab) GROUP BY ALL)
 SELECT seed, fold, CAST(sum(tp+fn) AS BIGINT) AS n_rows, round(sum(tp)/CAST(sum(tp+fn) AS DOUBLE),8) AS accuracy,
 round(avg(CASE WHEN tp+fn>0 THEN tp/CAST(tp+fn AS DOUBLE) END),8) AS balanced_accuracy,
 round(sum(CASE WHEN 2*tp+fp+fn>0 THEN 2e0*tp/(2*tp+fp+fn) ELSE 0e0 END)/3e0,8) AS macro_f1 FROM l GROUP BY seed, fold""")
def classification_scores(t):
    out = metrics.classification_scores(predictions(t), ["seed", "fold"], LABELS)
    return rounded(out, "accuracy", "balanced_accuracy", "macro_f1")


@query("probability_scores", f"""WITH pred AS ({PREDICTIONS}), p AS (SELECT *,
   CASE y_true WHEN 'F' THEN prob_f WHEN 'O' THEN prob_o ELSE prob_p END AS pt FROM pred)
 SELECT seed, fold, round(avg(-ln(greatest(least(pt,1e0-2.220446049250313e-16),2.220446049250313e-16))),8) AS log_loss,
 round(avg(pow(prob_f-CASE WHEN y_true='F' THEN 1 ELSE 0 END,2)+pow(prob_o-CASE WHEN y_true='O' THEN 1 ELSE 0 END,2)
   +pow(prob_p-CASE WHEN y_true='P' THEN 1 ELSE 0 END,2)),8) AS brier FROM p GROUP BY seed, fold""")
def probability_scores(t):
    return rounded(metrics.probability_scores(predictions(t), ["seed", "fold"], PROBS, LABELS), "log_loss", "brier")


ECE_BIN = "CASE WHEN confidence>0 AND confidence<=1 THEN " + "+".join(
    f"(CASE WHEN confidence > {i}*CAST(0.1 AS DOUBLE) THEN 1 ELSE 0 END)" for i in range(10)) + " - 1 END"


@query("expected_calibration_error", f"""WITH pred AS ({PREDICTIONS}), b AS (SELECT seed, {ECE_BIN} AS bin, count(*) AS n,
  avg(CASE WHEN y_pred=y_true THEN 1e0 ELSE 0e0 END) AS a, avg(confidence) AS c FROM pred GROUP BY 1,2)
 SELECT seed, round(coalesce(sum(CASE WHEN bin IS NOT NULL THEN abs(a-c)*n END),0)/sum(n),8) AS ece FROM b GROUP BY seed""")
def expected_calibration_error(t):
    out = metrics.expected_calibration_error(predictions(t), ["seed"], "confidence",
                                             F.col("y_pred") == F.col("y_true"))
    return rounded(out, "ece")


@query("reliability_bins", f"""WITH pred AS ({PREDICTIONS}) SELECT seed, bin, count(*) AS n_rows,
  round(avg(CASE WHEN y_pred=y_true THEN 1e0 ELSE 0e0 END),8) AS accuracy, round(avg(confidence),8) AS mean_confidence
  FROM (SELECT *, {ECE_BIN} AS bin FROM pred) WHERE bin IS NOT NULL GROUP BY seed, bin""")
def reliability_bins(t):
    out = metrics.reliability_bins(predictions(t), ["seed"], "confidence", F.col("y_pred") == F.col("y_true"))
    return rounded(out, "accuracy", "mean_confidence")


@query("confusion_matrix", f"""WITH pred AS ({PREDICTIONS}), c AS (SELECT seed, y_true, y_pred, count(*) AS n FROM pred GROUP BY ALL),
 g AS (SELECT s.seed, a.x AS y_true, b.x AS y_pred FROM (SELECT DISTINCT seed FROM pred) s, (VALUES ('F'),('O'),('P')) a(x), (VALUES ('F'),('O'),('P')) b(x))
 SELECT g.seed, g.y_true, g.y_pred, coalesce(n,0) AS n, round(CASE WHEN sum(coalesce(n,0)) OVER (PARTITION BY g.seed, g.y_true)>0
   THEN coalesce(n,0)/CAST(sum(coalesce(n,0)) OVER (PARTITION BY g.seed, g.y_true) AS DOUBLE) ELSE 0 END,8) AS share
 FROM g LEFT JOIN c ON g.seed=c.seed AND g.y_true=c.y_true AND g.y_pred=c.y_pred""")
def confusion_matrix(t):
    return rounded(metrics.confusion_matrix(predictions(t), ["seed"], labels=LABELS), "share")


def auc_sql(src: str, key: str, score: str, err: str, out: str) -> str:
    return f"""SELECT {key}, CASE WHEN np*nn>0 THEN (rs-np*(np+1)/2e0)/(np*nn) END AS {out} FROM (
      SELECT {key}, sum(e) AS np, sum(1-e) AS nn, sum(e*ar) AS rs FROM (SELECT {key}, CASE WHEN {err} THEN 1e0 ELSE 0e0 END AS e,
        rank() OVER (PARTITION BY {key} ORDER BY {score}) + (count(*) OVER (PARTITION BY {key}, {score})-1)/2e0 AS ar
        FROM {src}) GROUP BY {key})"""


DIAG_SQL = f"""WITH pred AS (SELECT *, CAST(y_true<>y_pred AS INT) AS err FROM ({PREDICTIONS})),
 m AS (SELECT seed, count(*) AS n_rows, avg(ood_score) FILTER (err=0) AS mc, avg(ood_score) FILTER (err=1) AS mi,
   median(ood_score) FILTER (err=0) AS dc, median(ood_score) FILTER (err=1) AS di FROM pred GROUP BY seed),
 a AS ({auc_sql('pred', 'seed', 'ood_score', 'err=1', 'roc_auc')}),
 r AS (SELECT seed, corr(rs, re) AS spearman_r FROM (SELECT seed,
   rank() OVER (PARTITION BY seed ORDER BY ood_score)+(count(*) OVER (PARTITION BY seed, ood_score)-1)/2e0 AS rs,
   rank() OVER (PARTITION BY seed ORDER BY err)+(count(*) OVER (PARTITION BY seed, err)-1)/2e0 AS re FROM pred) GROUP BY seed)
 SELECT m.seed, n_rows, round(mc,8) AS mean_correct, round(mi,8) AS mean_incorrect, round(dc,8) AS median_correct,
 round(di,8) AS median_incorrect, round(roc_auc,8) AS roc_auc, round(spearman_r,8) AS spearman_r
 FROM m JOIN a ON m.seed=a.seed JOIN r ON m.seed=r.seed"""


@query("score_diagnostics", DIAG_SQL)
def score_diagnostics(t):
    out = metrics.score_diagnostics(predictions(t), ["seed"], "ood_score",
                                    F.col("y_true") != F.col("y_pred"), **sizing(t))
    return rounded(out, *[c for c in out.columns if c not in ("seed", "n_rows")])


@query("roc_auc", f"""WITH pred AS ({PREDICTIONS}), neg AS (SELECT *, -confidence AS u FROM pred),
 a AS ({auc_sql('neg', 'seed, fold', 'u', 'y_true<>y_pred', 'auc')}) SELECT seed, fold, round(auc,8) AS auc FROM a""")
def roc_auc(t):
    df = predictions(t).withColumn("u", -F.col("confidence"))
    out = metrics.roc_auc(df, ["seed", "fold"], "u", F.col("y_true") != F.col("y_pred"), **sizing(t))
    return rounded(out, "auc")


@query("rank_and_linear_correlation", f"""WITH pred AS ({PREDICTIONS}),
 r AS (SELECT seed, confidence, ood_score, rank() OVER (PARTITION BY seed ORDER BY confidence)+(count(*) OVER (PARTITION BY seed, confidence)-1)/2e0 AS rc,
   rank() OVER (PARTITION BY seed ORDER BY ood_score)+(count(*) OVER (PARTITION BY seed, ood_score)-1)/2e0 AS ro FROM pred)
 SELECT seed, round(corr(rc,ro),8) AS spearman, round(corr(confidence,ood_score),8) AS pearson FROM r GROUP BY seed""")
def correlations(t):
    pred = predictions(t)
    rho = metrics.spearman(pred, ["seed"], "confidence", "ood_score", **sizing(t))
    r = metrics.pearson(pred, ["seed"], "confidence", "ood_score")
    return rounded(rho.join(r, "seed"), "spearman", "pearson")


@query("two_level_rollup", f"""WITH pred AS ({PREDICTIONS}), f AS (SELECT seed, fold, avg(CASE WHEN y_true=y_pred THEN 1e0 ELSE 0e0 END) AS acc,
   avg(confidence) AS conf FROM pred GROUP BY 1,2), s AS (SELECT seed, avg(acc) AS acc, avg(conf) AS conf FROM f GROUP BY 1)
 SELECT round(avg(acc),8) AS acc_mean, round(coalesce(stddev_samp(acc),0),8) AS acc_std, round(avg(conf),8) AS conf_mean,
 round(coalesce(stddev_samp(conf),0),8) AS conf_std, count(*) AS n_seeds FROM s""")
def two_level_rollup(t):
    folds = predictions(t).groupBy("seed", "fold").agg(
        F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("acc"),
        F.avg("confidence").alias("conf"))
    out = metrics.two_level_rollup(folds, [], "seed", ["acc", "conf"])
    return rounded(out, "acc_mean", "acc_std", "conf_mean", "conf_std")


# --- probabilities, fusion, temperature ------------------------------------------------------

@query("probability_operations", f"""WITH pred AS ({PREDICTIONS}), z AS (SELECT row_id, CASE WHEN row_id%13=0 THEN 0 ELSE prob_f END AS f,
  CASE WHEN row_id%13=0 THEN 0 ELSE prob_o END AS o FROM pred), n AS (SELECT row_id,
  CASE WHEN f+o>0 THEN f/(f+o) ELSE 1/3e0 END AS f, CASE WHEN f+o>0 THEN o/(f+o) ELSE 1/3e0 END AS o,
  CASE WHEN f+o>0 THEN 0e0 ELSE 1/3e0 END AS p FROM z),
 w AS (SELECT row_id, f, o, p, pow(f,1/2e0) AS a, pow(o,1/2e0) AS b, pow(p,1/2e0) AS c FROM n)
 SELECT row_id, round(a/(a+b+c),8) AS prob_f, round(b/(a+b+c),8) AS prob_o, round(c/(a+b+c),8) AS prob_p,
 CASE WHEN a>=b AND a>=c THEN 'F' WHEN b>=c THEN 'O' ELSE 'P' END AS y_arg FROM w""")
def probability_operations(t):
    zero = F.col("row_id") % 13 == 0
    df = predictions(t).select("row_id", F.when(zero, 0.0).otherwise(F.col("prob_f")).alias("prob_f"),
                               F.when(zero, 0.0).otherwise(F.col("prob_o")).alias("prob_o"))
    df = probs.align_probabilities(df, ["f", "o", "p"])
    norm = df.select("row_id", *[c.alias(n) for c, n in zip(probs.normalized([F.col(p) for p in PROBS]), PROBS)])
    hot = norm.select("row_id", *[c.alias(n) for c, n in zip(probs.tempered([F.col(p) for p in PROBS], 2.0), PROBS)])
    out = hot.withColumn("y_arg", probs.arg_max([F.col(p) for p in PROBS], LABELS))
    return rounded(out, *PROBS)


@query("argmax_self_check", f"""SELECT count(*) AS n_rows, count(*) FILTER (y_pred <> CASE WHEN prob_f>=prob_o AND prob_f>=prob_p THEN 'F'
 WHEN prob_o>=prob_p THEN 'O' ELSE 'P' END) AS n_mismatch FROM ({PREDICTIONS})""")
def argmax_self_check(t):
    return trust.argmax_mismatches(predictions(t), "y_pred", probs.arg_max([F.col(p) for p in PROBS], LABELS))


FUSED_CTE = f"""a AS ({PREDICTIONS}), b AS ({PREDICTIONS_B}),
 fused AS (SELECT row_id, seed, fold, y_true, alpha, mf/(mf+mo+mp) AS f, mo/(mf+mo+mp) AS o, mp/(mf+mo+mp) AS p FROM (
   SELECT a.row_id, a.seed, a.fold, a.y_true, alpha, (1-alpha)*prob_f+alpha*q_f AS mf, (1-alpha)*prob_o+alpha*q_o AS mo,
     (1-alpha)*prob_p+alpha*q_p AS mp FROM a JOIN b ON a.row_id=b.row_id AND a.seed=b.seed AND a.fold=b.fold AND a.y_true=b.y_true,
     (VALUES (0e0),(0.25e0),(0.5e0),(0.75e0),(1e0)) v(alpha))),
 lab AS (SELECT *, CASE WHEN f>=o AND f>=p THEN 'F' WHEN o>=p THEN 'O' ELSE 'P' END AS yp,
   CASE y_true WHEN 'F' THEN f WHEN 'O' THEN o ELSE p END AS pt FROM fused)"""


def fused(t: Tables, alphas=tuple(late_fusion.ALPHAS)) -> DataFrame:
    return late_fusion.fused_predictions(
        predictions(t), t.sql(PREDICTIONS_B), ["row_id", "seed", "fold", "y_true"], PROBS,
        ["q_f", "q_o", "q_p"], LABELS, alphas)


SWEEP_CTE = f"""WITH {FUSED_CTE}, cls AS (SELECT alpha, seed, l,
   sum(CASE WHEN y_true=l AND yp=l THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y_true<>l AND yp=l THEN 1 ELSE 0 END) AS fp,
   sum(CASE WHEN y_true=l AND yp<>l THEN 1 ELSE 0 END) AS fn FROM lab, (VALUES ('F'),('O'),('P')) v(l) GROUP BY ALL),
 sweep AS (SELECT c.alpha, c.seed, ba, mf, ll FROM (SELECT alpha, seed, avg(CASE WHEN tp+fn>0 THEN tp/CAST(tp+fn AS DOUBLE) END) AS ba,
    sum(CASE WHEN 2*tp+fp+fn>0 THEN 2e0*tp/(2*tp+fp+fn) ELSE 0e0 END)/3e0 AS mf FROM cls GROUP BY ALL) c
  JOIN (SELECT alpha, seed, avg(-ln(greatest(pt,2.220446049250313e-16))) AS ll FROM lab GROUP BY ALL) q
  ON c.alpha=q.alpha AND c.seed=q.seed)"""


@query("late_fusion_sweep", f"""{SWEEP_CTE} SELECT alpha, seed, round(ba,8) AS balanced_accuracy, round(mf,8) AS macro_f1,
 round(ll,8) AS log_loss FROM sweep""")
def late_fusion_sweep(t):
    return rounded(late_fusion.fusion_sweep(fused(t), LABELS), "balanced_accuracy", "macro_f1", "log_loss")


@query("late_fusion_selected", f"""{SWEEP_CTE} SELECT alpha, round(avg(ba),8) AS balanced_accuracy_mean, round(avg(ll),8) AS log_loss_mean
 FROM sweep GROUP BY alpha ORDER BY avg(ba) DESC, avg(ll), alpha LIMIT 1""")
def late_fusion_selected(t):
    out = late_fusion.select_fusion(late_fusion.fusion_sweep(fused(t), LABELS))
    return rounded(out.select("alpha", "balanced_accuracy_mean", "log_loss_mean"),
                   "balanced_accuracy_mean", "log_loss_mean")


@query("late_fusion_predictions", f"""WITH {FUSED_CTE} SELECT row_id, seed, fold, y_true, alpha, round(f,8) AS "p_F", round(o,8) AS "p_O",
 round(p,8) AS "p_P", yp AS y_pred FROM lab WHERE alpha=0.25e0""")
def late_fusion_predictions(t):
    return rounded(fused(t, [0.25]), "p_F", "p_O", "p_P")


TEMP_CTE = f"""WITH pred AS ({PREDICTIONS}), c AS (SELECT seed, y_true, T, greatest(least(prob_f,1-1e-6),1e-6) AS f,
   greatest(least(prob_o,1-1e-6),1e-6) AS o, greatest(least(prob_p,1-1e-6),1e-6) AS p
   FROM pred, (VALUES (1e0),(1.5e0),(2e0),(3e0),(5e0),(10e0)) v(T)),
 s AS (SELECT seed, T, CASE y_true WHEN 'F' THEN pow(f,1/T) WHEN 'O' THEN pow(o,1/T) ELSE pow(p,1/T) END
    /(pow(f,1/T)+pow(o,1/T)+pow(p,1/T)) AS q FROM c),
 loss AS (SELECT seed, T AS temperature, avg(-ln(greatest(q,2.220446049250313e-16))) AS ll FROM s GROUP BY 1,2)"""


@query("temperature_grid", f"{TEMP_CTE} SELECT seed, temperature, round(ll,8) AS log_loss FROM loss")
def temperature_grid(t):
    return rounded(late_fusion.temperature_losses(predictions(t), ["seed"], PROBS, LABELS), "log_loss")


@query("temperature_scaled_predictions", f"""{TEMP_CTE}, best AS (SELECT seed, temperature FROM (SELECT *,
   row_number() OVER (PARTITION BY seed ORDER BY ll, temperature) AS rn FROM loss) WHERE rn=1),
 w AS (SELECT row_id, x.seed, b.temperature, pow(prob_f,1/b.temperature) AS f, pow(prob_o,1/b.temperature) AS o,
   pow(prob_p,1/b.temperature) AS p FROM pred x JOIN best b ON x.seed=b.seed)
 SELECT row_id, seed, temperature, round(f/(f+o+p),8) AS prob_f, round(o/(f+o+p),8) AS prob_o, round(p/(f+o+p),8) AS prob_p FROM w""")
def temperature_scaled(t):
    pred = predictions(t)
    best = late_fusion.select_temperature(
        late_fusion.temperature_losses(pred, ["seed"], PROBS, LABELS), ["seed"])
    out = late_fusion.apply_temperature(pred, best, ["seed"], PROBS, LABELS)
    return rounded(out.select("row_id", "seed", "temperature", *PROBS), *PROBS)


# --- plausibility ---------------------------------------------------------------------------

ENTITY_PROBS = """SELECT c_custkey AS grp, a/(a+b+c) AS "p_mech_F", b/(a+b+c) AS "p_mech_O", c/(a+b+c) AS "p_mech_P", mf AS mech_missing_frac
 FROM (SELECT c_custkey, CAST((c_custkey*17)%50+1 AS DOUBLE) AS a, CAST((c_custkey*23)%50+1 AS DOUBLE) AS b,
  CAST((c_custkey*31)%50+1 AS DOUBLE) AS c, CASE WHEN c_custkey%11=0 THEN 1e0 ELSE CAST((c_custkey*13)%7 AS DOUBLE)/7e0 END AS mf FROM customer) e"""
PLAUS_CTE = f"""pred AS ({PREDICTIONS}), e AS ({ENTITY_PROBS}),
 sc AS (SELECT p.*, mech_missing_frac, CASE y_pred WHEN 'F' THEN "p_mech_F" WHEN 'O' THEN "p_mech_O" ELSE "p_mech_P" END AS sup
   FROM pred p LEFT JOIN e ON p.grp=e.grp),
 us AS (SELECT *, 1-sup AS dis, (1-mech_missing_frac)*sup AS plaus, (1-sup)+mech_missing_frac AS dpm, y_true<>y_pred AS err
   FROM sc WHERE coalesce(mech_missing_frac,1)<1 AND sup IS NOT NULL)"""


def entity_probs(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    w = {x: (k * m % 50 + 1).cast("double") for x, m in zip(LABELS, (17, 23, 31))}
    total = w["F"] + w["O"] + w["P"]
    missing = F.when(k % 11 == 0, 1.0).otherwise((k * 13 % 7).cast("double") / 7.0)
    return t.customer.select(k.alias("grp"), *[(w[x] / total).alias(f"p_mech_{x}") for x in LABELS],
                             missing.alias("mech_missing_frac"))


def plausibility_rows(t: Tables) -> DataFrame:
    return plausibility.plausibility_scores(predictions(t), entity_probs(t), ["grp"], LABELS)


@query("plausibility_scores", f"""WITH {PLAUS_CTE} SELECT row_id, seed, fold, round(sup,8) AS mech_support, round(1-sup,8) AS mech_disagreement,
 round((1-mech_missing_frac)*sup,8) AS mech_plausibility FROM sc""")
def plausibility_scores(t):
    out = plausibility_rows(t).select("row_id", "seed", "fold", "mech_support", "mech_disagreement",
                                      "mech_plausibility")
    return rounded(out, "mech_support", "mech_disagreement", "mech_plausibility")


@query("plausibility_report", f"""WITH {PLAUS_CTE}, n AS (SELECT seed, count(*) AS n_rows FROM sc GROUP BY 1),
 m AS (SELECT seed, count(*) AS nu, avg(sup) FILTER (NOT err) AS a, median(sup) FILTER (NOT err) AS b, avg(sup) FILTER (err) AS c,
   median(sup) FILTER (err) AS d, corr(sup,dis) AS r FROM us GROUP BY 1),
 a1 AS ({auc_sql('us', 'seed', 'sup', 'err', 'x')}), a2 AS ({auc_sql('us', 'seed', 'dis', 'err', 'x')}),
 a3 AS ({auc_sql('us', 'seed', 'mech_missing_frac', 'err', 'x')}), a4 AS ({auc_sql('us', 'seed', 'plaus', 'err', 'x')}),
 a5 AS ({auc_sql('us', 'seed', 'dpm', 'err', 'x')})
 SELECT n.seed, n_rows, nu AS n_rows_usable, round(a,8) AS support_correct_mean, round(b,8) AS support_correct_median,
 round(c,8) AS support_incorrect_mean, round(d,8) AS support_incorrect_median, round(a1.x,8) AS auc_support,
 round(a2.x,8) AS auc_disagreement, round(a3.x,8) AS auc_missing, round(a4.x,8) AS auc_plausibility,
 round(a5.x,6) AS auc_disagreement_plus_missing, round(r,8) AS corr_support_disagreement
 FROM n JOIN m ON n.seed=m.seed JOIN a1 ON n.seed=a1.seed JOIN a2 ON n.seed=a2.seed JOIN a3 ON n.seed=a3.seed
 JOIN a4 ON n.seed=a4.seed JOIN a5 ON n.seed=a5.seed""")
def plausibility_report(t):
    out = plausibility.plausibility_report(plausibility_rows(t), **sizing(t))
    out = rounded(out, "auc_disagreement_plus_missing", digits=6)
    return rounded(out, *[c for c in out.columns if c not in
                          ("seed", "n_rows", "n_rows_usable", "auc_disagreement_plus_missing")])


BIN_SQL = "CASE WHEN mech_missing_frac<=0.25 THEN '<=0.25' WHEN mech_missing_frac<=0.5 THEN '0.25-0.5' WHEN mech_missing_frac<=0.75 THEN '0.5-0.75' ELSE '>0.75' END"


@query("plausibility_missingness_bins", f"""WITH {PLAUS_CTE}, ub AS (SELECT *, {BIN_SQL} AS bin FROM us),
 g AS (SELECT DISTINCT seed, b AS bin FROM sc, (VALUES ('<=0.25'),('0.25-0.5'),('0.5-0.75'),('>0.75')) v(b)),
 c AS (SELECT seed, bin, count(*) AS n FROM ub GROUP BY 1,2),
 a1 AS ({auc_sql('ub', 'seed, bin', 'sup', 'err', 'x')}), a2 AS ({auc_sql('ub', 'seed, bin', 'dis', 'err', 'x')})
 SELECT g.seed, g.bin, coalesce(n,0) AS n_rows, round(a1.x,8) AS auc_support, round(a2.x,8) AS auc_disagreement FROM g
 LEFT JOIN c ON g.seed=c.seed AND g.bin=c.bin LEFT JOIN a1 ON g.seed=a1.seed AND g.bin=a1.bin LEFT JOIN a2 ON g.seed=a2.seed AND g.bin=a2.bin""")
def missingness_bins(t):
    return rounded(plausibility.missingness_bins(plausibility_rows(t), **sizing(t)), "auc_support", "auc_disagreement")
