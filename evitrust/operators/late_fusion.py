"""Mixing two prediction tables and choosing the mixing weight or a temperature."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from evitrust.functions import probs
from evitrust.operators import curves, metrics

ALPHAS = [0.0, 0.25, 0.5, 0.75, 1.0]
TEMPERATURES = [1.0, 1.5, 2.0, 3.0, 5.0, 10.0]
TEMPERATURE_CLIP = 1e-6


def _spread(df: DataFrame, name: str, values: Sequence[float]) -> DataFrame:
    return df.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))


def fused_predictions(first: DataFrame, second: DataFrame, keys: Sequence[str],
                      first_probs: Sequence[str], second_probs: Sequence[str], labels: Sequence[str],
                      alphas: Sequence[float] = tuple(ALPHAS)) -> DataFrame:
    """Every row under every alpha: mixed probabilities ``p_<label>`` and their arg-max."""
    joined = first.select(*keys, *first_probs).join(second.select(*keys, *second_probs), list(keys))
    spread = _spread(joined, "alpha", alphas)
    mix = probs.mixed([F.col(c) for c in first_probs], [F.col(c) for c in second_probs], F.col("alpha"))
    out = spread.select(*keys, "alpha", *[m.alias(f"p_{x}") for m, x in zip(mix, labels)])
    return out.withColumn("y_pred", probs.arg_max([F.col(f"p_{x}") for x in labels], labels))


def fusion_sweep(fused: DataFrame, labels: Sequence[str], keys: Sequence[str] = ("alpha", "seed")) -> DataFrame:
    """Balanced accuracy, macro-F1 and log loss per (alpha, seed)."""
    cols = [f"p_{x}" for x in labels]
    by_class = metrics.classification_scores(fused, keys, labels)
    by_prob = metrics.probability_scores(fused, keys, cols, labels)
    return by_class.join(by_prob, list(keys)).select(
        *keys, "balanced_accuracy", "macro_f1", "log_loss")


def select_fusion(sweep: DataFrame, candidate: str = "alpha") -> DataFrame:
    """Best mean balanced accuracy, then lowest log loss, then the earliest candidate."""
    summary = metrics.rollup_mean_std(sweep, [candidate], ["balanced_accuracy", "log_loss", "macro_f1"],
                                      count_as="n_seeds")
    return curves.pick_best(summary, [], [
        F.col("balanced_accuracy_mean").desc_nulls_last(), F.col("log_loss_mean").asc_nulls_last(),
        F.col(candidate)])


def temperature_losses(calib: DataFrame, keys: Sequence[str], prob_cols: Sequence[str],
                       labels: Sequence[str], grid: Sequence[float] = tuple(TEMPERATURES)) -> DataFrame:
    """Log loss of the calibration rows per (keys, temperature), probabilities clipped first."""
    clipped = calib.withColumns({
        c: F.greatest(F.least(F.col(c), F.lit(1 - TEMPERATURE_CLIP)), F.lit(TEMPERATURE_CLIP))
        for c in prob_cols})
    spread = _spread(clipped, "temperature", grid)
    scaled = probs.tempered([F.col(c) for c in prob_cols], F.col("temperature"))
    rows = spread.select(*keys, "temperature", "y_true",
                         *[s.alias(c) for s, c in zip(scaled, prob_cols)])
    p_true = metrics.true_class_probability("y_true", prob_cols, labels)
    total = sum((F.col(c) for c in prob_cols[1:]), F.col(prob_cols[0]))
    return rows.groupBy(*keys, "temperature").agg(metrics.log_loss(p_true / total).alias("log_loss"))


def select_temperature(losses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Temperature with the lowest loss; the smaller one on ties."""
    return curves.pick_best(losses, list(keys), [F.col("log_loss").asc_nulls_last(), F.col("temperature")])


def apply_temperature(df: DataFrame, chosen: DataFrame, keys: Sequence[str], prob_cols: Sequence[str],
                      labels: Sequence[str]) -> DataFrame:
    """Scale the probabilities by each key's temperature and re-derive the label."""
    joined = df.join(chosen.select(*keys, "temperature"), list(keys))
    scaled = probs.normalized(probs.tempered([F.col(c) for c in prob_cols], F.col("temperature")))
    rest = [c for c in df.columns if c not in prob_cols]
    out = joined.select(*rest, "temperature", *[s.alias(c) for s, c in zip(scaled, prob_cols)])
    return out.withColumn("y_pred_cal", probs.arg_max([F.col(c) for c in prob_cols], labels))
