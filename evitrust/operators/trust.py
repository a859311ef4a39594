"""Trust scores and the policies built from confidence, distance and plausibility."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evitrust import contracts, ordering
from evitrust.operators import curves, metrics

KEYS = ["seed", "fold"]
ALPHAS = [0.0, 0.25, 0.5, 0.75, 1.0]
DEFAULT_ALPHA = 0.5
DEFAULT_EPS = 0.05
VARIANTS = ["confidence", "ood", "combined", "combined_plus_mech", "combined_plus_mech_eps"]


def align_and_merge(predictions: DataFrame, scores: DataFrame,
                    keys: Sequence[str] = ("row_id", "seed", "fold")) -> DataFrame:
    """Join two per-row tables that must have exactly the same unique keys."""
    predictions, scores = contracts.test_rows(predictions), contracts.test_rows(scores)
    contracts.require_aligned(predictions, scores, keys)
    return contracts.join_one_to_one(predictions, scores, keys)


def with_percentiles(df: DataFrame, keys: Sequence[str] = KEYS, confidence: str = "confidence",
                     ood: str = "ood_score", **sizing) -> DataFrame:
    """Average-rank percentiles of confidence and distance within each (seed, fold)."""
    out = ordering.with_average_rank(df, keys, confidence, percentile="conf_percentile", **sizing)
    return ordering.with_average_rank(out, keys, ood, percentile="ood_percentile", **sizing)


def combined_untrust(alpha: Column | float) -> Column:
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return a * F.col("ood_percentile") + (1 - a) * (1 - F.col("conf_percentile"))


def with_trust_scores(df: DataFrame, alpha: Column | float = DEFAULT_ALPHA,
                      eps: float = DEFAULT_EPS, plausibility: str = "mech_plausibility") -> DataFrame:
    """Untrust of each policy; plausibility multiplies the combined score (with and without floor)."""
    u = combined_untrust(alpha)
    out = df.withColumns({
        "untrust_conf": 1 - F.col("conf_percentile"),
        "untrust_ood": F.col("ood_percentile"),
        "untrust_combined": u,
        "score_combined": 1 - u,
    })
    if plausibility in df.columns:
        out = out.withColumns({
            "score_combined_plus_mech": F.col("score_combined") * F.col(plausibility),
            "score_combined_plus_mech_eps": F.col("score_combined") * (F.lit(eps) + F.col(plausibility)),
        })
    return out


def stack_policies(df: DataFrame, policies: Mapping[str, Column], keep: Sequence[str],
                   name: str = "policy", out: str = "untrust") -> DataFrame:
    """One copy of the slim row per policy, so that all policies share one ranking job."""
    structs = [F.struct(F.lit(p).alias(name), c.cast("double").alias(out)) for p, c in policies.items()]
    return df.select(*keep, F.explode(F.array(*structs)).alias("_p")).select(*keep, "_p.*")


def policy_curves(df: DataFrame, labels: Sequence[str], alphas: Sequence[float] = tuple(ALPHAS),
                  rates: Sequence[float] = tuple(curves.DEFAULT_RATES), keys: Sequence[str] = KEYS,
                  **sizing) -> DataFrame:
    """Curves of confidence, ood and every combined alpha. ``df`` has the percentile columns."""
    policies: dict[str, Column] = {
        "confidence": 1 - F.col("conf_percentile"),
        "ood": F.col("ood_percentile"),
    }
    for a in alphas:
        policies[f"combined@{a}"] = combined_untrust(a)
    stacked = stack_policies(df, policies, [*keys, "row_id", "y_true", "y_pred"])
    curve = curves.abstention_curve(stacked, ["policy", *keys], "untrust", labels, rates, **sizing)
    is_combined = F.col("policy").startswith("combined@")
    return curve.withColumn(
        "alpha", F.when(is_combined, F.substring_index("policy", "@", -1).try_cast("double"))
    ).withColumn("policy", F.when(is_combined, F.lit("combined")).otherwise(F.col("policy")))


def sweep_table(curve: DataFrame, candidate: str, at: Sequence[float] = (0.0, 0.1, 0.3, 0.5)) -> DataFrame:
    """Mean balanced accuracy of each candidate at a few drop rates, one row per candidate."""
    aggs = [
        F.avg(F.when(F.col("abstention_rate") == r, F.col("balanced_accuracy"))).alias(
            f"bal_acc_{int(round(r * 100))}")
        for r in at
    ]
    return curve.groupBy(candidate).agg(*aggs)


def select_alpha(curve: DataFrame) -> DataFrame:
    """Alpha with the best mean accuracy at 30 %, then 10 %, then 50 % dropped; smallest alpha on ties.

    The choice looks at the labels of the rows it is later reported on, as a what-if comparison; give
    curves of a separate set for an unbiased choice.
    """
    sweep = sweep_table(curve.where(F.col("policy") == "combined"), "alpha")
    return curves.pick_best(sweep, [], [
        F.col("bal_acc_30").desc_nulls_last(), F.col("bal_acc_10").desc_nulls_last(),
        F.col("bal_acc_50").desc_nulls_last(), F.col("alpha")])


def select_k(curve: DataFrame) -> DataFrame:
    """Neighbour count with the best accuracy at 30 %, then 50 % dropped; smallest k on ties."""
    sweep = sweep_table(curve, "k")
    return curves.pick_best(sweep, [], [
        F.col("bal_acc_30").desc_nulls_last(), F.col("bal_acc_50").desc_nulls_last(), F.col("k")])


def chosen_policy_curves(curve: DataFrame) -> DataFrame:
    """Curves of confidence, ood and the chosen alpha only."""
    best = select_alpha(curve).select(F.col("alpha").alias("_best"))
    picked = curve.where(F.col("policy") == "combined").join(
        best, F.col("alpha") == F.col("_best"), "left_semi")
    return curve.where(F.col("policy") != "combined").unionByName(picked)


def alpha_or_default(selection: DataFrame, default: float = DEFAULT_ALPHA) -> DataFrame:
    """One row with the chosen alpha, or the default when nothing was chosen."""
    return selection.agg(F.coalesce(F.first("alpha", ignorenulls=True), F.lit(default)).alias("alpha"))


def trust_rows(df: DataFrame, alpha: float, keys: Sequence[str] = KEYS, **sizing) -> DataFrame:
    """Per-row output: error flag, percentiles, untrust and its rank (most untrusted first)."""
    out = df.withColumn("error", (F.col("y_pred") != F.col("y_true")).cast("int"))
    out = out.withColumn("untrust", combined_untrust(alpha))
    out = ordering.row_positions(out, keys, "untrust", ["row_id"], descending=True,
                                 position="policy_rank", total="_n", **sizing)
    return out.select("row_id", *keys, "y_true", "y_pred", "error", "confidence", "ood_score",
                      "ood_percentile", "conf_percentile", "untrust", "policy_rank")


def variant_curves(df: DataFrame, labels: Sequence[str], keys: Sequence[str] = KEYS, **sizing) -> DataFrame:
    """Five trust variants at coverage 0.9, 0.7 and 0.5. ``df`` comes from ``with_trust_scores``."""
    policies = {
        "confidence": F.col("untrust_conf"),
        "ood": F.col("untrust_ood"),
        "combined": F.col("untrust_combined"),
        "combined_plus_mech": 1 - F.col("score_combined_plus_mech"),
        "combined_plus_mech_eps": 1 - F.col("score_combined_plus_mech_eps"),
    }
    stacked = stack_policies(df, policies, [*keys, "row_id", "y_true", "y_pred"], name="variant")
    rates = [r for r, _ in curves.COVERAGE_TARGETS]
    curve = curves.abstention_curve(stacked, ["variant", *keys], "untrust", labels, rates, **sizing)
    target = F.lit(None).cast("double")
    for rate, cov in curves.COVERAGE_TARGETS:
        target = F.when(F.col("abstention_rate") == rate, F.lit(cov)).otherwise(target)
    return curve.select(*keys, target.alias("coverage_target"), "coverage", "variant",
                        "balanced_accuracy", "n_total", "n_kept")


def summarize_variants(curve: DataFrame) -> DataFrame:
    """Mean and deviation per (coverage target, variant) plus the difference to ``combined``."""
    summary = metrics.rollup_mean_std(curve, ["coverage_target", "variant"],
                                      ["balanced_accuracy", "coverage"])
    return curves.delta_vs_variant(summary, ["coverage_target"], "variant", "combined",
                                   out="delta_vs_combined")


def best_variants(summary: DataFrame, variants: Sequence[str] = tuple(VARIANTS)) -> DataFrame:
    """Winner per coverage target; alphabetical order decides ties."""
    return curves.pick_best(
        summary.where(F.col("variant").isin(list(variants))), ["coverage_target"],
        [F.col("balanced_accuracy_mean").desc_nulls_last(), F.col("variant")],
    ).select("coverage_target", "variant", "balanced_accuracy_mean")


def fix_direction(df: DataFrame, score: str, error: str = "error", out: str = "ood_score") -> DataFrame:
    """Negate the score when incorrect rows have the lower mean, so that higher means less trust.

    Uses the error labels; pass an ``error`` column of a separate set to avoid that.
    """
    means = df.agg(
        F.avg(F.when(F.col(error) == 0, F.col(score))).alias("_ok"),
        F.avg(F.when(F.col(error) == 1, F.col(score))).alias("_bad"),
    )
    flip = F.coalesce(F.col("_bad") < F.col("_ok"), F.lit(False))
    decided = means.select(
        flip.alias("flipped"),
        F.when(flip, F.lit("incorrect mean below correct mean"))
        .otherwise(F.lit("incorrect mean not below correct mean")).alias("flip_reason"),
    )
    # ``means`` is one row, so this is a one-row nested loop, not a product of two tables.
    return df.join(F.broadcast(decided)).withColumn(
        out, F.when(F.col("flipped"), -F.col(score)).otherwise(F.col(score)))


def compare_policies(first: DataFrame, second: DataFrame, first_name: str, second_name: str) -> DataFrame:
    """Two curve summaries side by side at coverage 0.9, 0.7 and 0.5."""
    rates = [r for r, _ in curves.COVERAGE_TARGETS]
    pick = lambda d, n: d.where(F.col("abstention_rate").isin(rates)).select(
        "abstention_rate", F.col("balanced_accuracy_mean").alias(f"{n}_bal_acc"))
    joined = pick(first, first_name).join(pick(second, second_name), "abstention_rate")
    return joined.withColumn("difference", F.col(f"{second_name}_bal_acc") - F.col(f"{first_name}_bal_acc"))


def argmax_mismatches(df: DataFrame, predicted: str, expected: Column) -> DataFrame:
    """Count rows whose stored label differs from the arg-max of their probabilities (all rows)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.count_if(~F.col(predicted).eqNullSafe(expected)).alias("n_mismatch"))
