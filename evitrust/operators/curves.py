"""Selective-prediction curves: drop the least trusted rows, score the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from evitrust import ordering
from evitrust.operators import metrics

DEFAULT_RATES = [0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5]
COVERAGE_TARGETS = [(0.1, 0.9), (0.3, 0.7), (0.5, 0.5)]


def dropped_rows(rate: Column, n: Column) -> Column:
    return F.floor(rate * n)


def abstention_counts(df: DataFrame, keys: Sequence[str], untrust: str, rates: Sequence[float],
                      tie: str = "row_id", **sizing) -> DataFrame:
    """Confusion counts of the kept rows per (keys, rate).

    A row at position ``pos`` (most untrusted first) survives every rate with ``floor(rate*n) < pos``,
    a prefix of the ascending rates. So rows are counted once per length of that prefix and only the
    small table of counts is expanded to rates.
    """
    rates = sorted(set(float(r) for r in rates))
    slim = df.select(*keys, untrust, tie, "y_true", "y_pred")
    placed = ordering.row_positions(slim, keys, untrust, [tie], descending=True, **sizing)
    n_kept_rates = F.lit(0)
    for r in rates:
        n_kept_rates = n_kept_rates + F.when(
            dropped_rows(F.lit(r), F.col("n_total")) < F.col("pos"), 1).otherwise(0)
    counted = placed.groupBy(
        *keys, "n_total", n_kept_rates.alias("_k"), "y_true", "y_pred"
    ).agg(F.count(F.lit(1)).alias("n"))
    ladder = F.slice(F.array(*[F.lit(r) for r in rates]), F.lit(1), F.col("_k"))
    return (
        counted.where(F.col("_k") > 0)
        .withColumn("abstention_rate", F.explode(ladder))
        .groupBy(*keys, "n_total", "abstention_rate", "y_true", "y_pred")
        .agg(F.sum("n").alias("n"))
    )


def abstention_curve(df: DataFrame, keys: Sequence[str], untrust: str, labels: Sequence[str],
                     rates: Sequence[float] = tuple(DEFAULT_RATES), tie: str = "row_id",
                     **sizing) -> DataFrame:
    """Coverage, balanced accuracy and macro-F1 per (keys, rate). Ties are cut in ``tie`` order."""
    counts = abstention_counts(df, keys, untrust, rates, tie, **sizing)
    by = [*keys, "n_total", "abstention_rate"]
    scored = metrics.scores_from_confusion(counts, by, labels)
    return scored.select(
        *keys, "abstention_rate",
        (F.col("n_rows") / F.col("n_total")).alias("coverage"),
        "n_total", F.col("n_rows").alias("n_kept"), "balanced_accuracy", "macro_f1",
    )


def coverage_curve(df: DataFrame, keys: Sequence[str], confidence: str, coverages: Sequence[float],
                   labels: Sequence[str], tie: str = "row_id", **sizing) -> DataFrame:
    """Keep the ``ceil(coverage*n)`` most confident rows per key and score them."""
    covs = sorted(set(float(c) for c in coverages))
    slim = df.select(*keys, confidence, tie, "y_true", "y_pred")
    placed = ordering.row_positions(slim, keys, confidence, [tie], descending=True, **sizing)
    kept = lambda c: F.col("pos") <= F.ceil(F.lit(c) * F.col("n_total"))
    n_kept = F.lit(0)
    for c in covs:
        n_kept = n_kept + F.when(kept(c), 1).otherwise(0)
    counted = placed.groupBy(*keys, n_kept.alias("_k"), "y_true", "y_pred").agg(
        F.count(F.lit(1)).alias("n"))
    ladder = F.slice(F.array(*[F.lit(c) for c in reversed(covs)]), F.lit(1), F.col("_k"))
    expanded = (
        counted.where(F.col("_k") > 0).withColumn("coverage", F.explode(ladder))
        .groupBy(*keys, "coverage", "y_true", "y_pred").agg(F.sum("n").alias("n"))
    )
    scored = metrics.scores_from_confusion(expanded, [*keys, "coverage"], labels)
    return scored.select(*keys, "coverage", F.col("n_rows").alias("n_kept"), "balanced_accuracy",
                         "macro_f1")


def summarize_curve(curve: DataFrame, keys: Sequence[str] = (), at: str = "abstention_rate") -> DataFrame:
    """Mean and deviation over (seed, fold) rows for each rate."""
    return metrics.rollup_mean_std(curve, [*keys, at], ["coverage", "balanced_accuracy", "macro_f1"])


def pick_best(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key under an explicit order (the last entries make it total).

    Candidates are short lists (rates, alphas, models), already aggregated; a window is enough.
    """
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def best_rate(summary: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rate with the highest mean balanced accuracy, earliest rate first."""
    return pick_best(summary, keys,
                     [F.col("balanced_accuracy_mean").desc_nulls_last(), F.col("abstention_rate")])


def delta_vs_rate_zero(summary: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each rate's mean balanced accuracy minus the value at rate 0 of the same key."""
    w = Window.partitionBy(*(keys or [F.lit(0)]))
    base = F.max(F.when(F.col("abstention_rate") == 0.0, F.col("balanced_accuracy_mean"))).over(w)
    return summary.withColumn("delta_vs_baseline", F.col("balanced_accuracy_mean") - base)


def delta_vs_variant(summary: DataFrame, at: Sequence[str], variant: str, baseline: str,
                     metric: str = "balanced_accuracy_mean", out: str = "delta") -> DataFrame:
    """Difference of each variant's metric to the baseline variant at the same coverage."""
    base = F.max(F.when(F.col(variant) == baseline, F.col(metric))).over(Window.partitionBy(*at))
    return summary.withColumn(out, F.col(metric) - base)


def rate_zero_check(curve: DataFrame, rows: DataFrame, keys: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """At rate 0 the curve must equal the plain metric of the same rows; returns both and their gap."""
    plain = metrics.classification_scores(rows, keys, labels).select(
        *keys, F.col("balanced_accuracy").alias("plain_balanced_accuracy"))
    zero = curve.where(F.col("abstention_rate") == 0.0).select(
        *keys, F.col("balanced_accuracy").alias("curve_balanced_accuracy"))
    return zero.join(plain, list(keys)).withColumn(
        "gap", F.abs(F.col("curve_balanced_accuracy") - F.col("plain_balanced_accuracy")))
