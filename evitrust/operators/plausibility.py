"""Plausibility of a prediction given an entity-level model on evidence features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evitrust import contracts
from evitrust.functions import probs
from evitrust.operators import metrics
from evitrust.sources.shared import written


def plausibility_scores(predictions: DataFrame, entity_probs: DataFrame, keys: Sequence[str],
                        labels: Sequence[str], prefix: str = "p_mech_",
                        missing: str = "mech_missing_frac", validate: bool = True) -> DataFrame:
    """Join entity-level class probabilities and score support for the predicted class.

    support = p[y_pred]; disagreement = 1 - support; plausibility = (1 - missing share) * support.
    Entities without probabilities keep nulls.
    """
    joined = contracts.join_many_to_one(
        contracts.test_rows(contracts.with_default_role(predictions)), entity_probs, keys, validate)
    support = probs.probability_of(
        F.col("y_pred"), [F.col(prefix + x) for x in labels], labels)
    return joined.withColumn("mech_support", support).withColumns({
        "mech_disagreement": 1 - F.col("mech_support"),
        "mech_plausibility": (1 - F.col(missing)) * F.col("mech_support"),
    })


def usable_rows(scored: DataFrame, missing: str = "mech_missing_frac") -> DataFrame:
    """Rows whose entity has some evidence and a support value."""
    return scored.where((F.coalesce(F.col(missing), F.lit(1.0)) < 1.0) & F.col("mech_support").isNotNull())


def plausibility_report(scored: DataFrame, keys: Sequence[str] = ("seed",),
                        missing: str = "mech_missing_frac", **sizing) -> DataFrame:
    """Per key: row counts, support of correct/incorrect rows, AUC of five scores against the error,
    and the correlation of support and disagreement."""
    keys = list(keys)
    # read by nine aggregates: the joins below it, and what they broadcast, are done once
    scored = written(scored.select(
        *keys, (F.col("y_true") != F.col("y_pred")).cast("int").alias("error"), missing, "mech_support", "mech_disagreement", "mech_plausibility"))
    usable = usable_rows(scored, missing).withColumn(
        "_dis_plus_missing", F.col("mech_disagreement") + F.col(missing))
    is_error: Column = F.col("error") == 1
    total = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    diag = metrics.score_diagnostics(usable, keys, "mech_support", is_error, **sizing).select(
        *keys, F.col("n_rows").alias("n_rows_usable"),
        F.col("mean_correct").alias("support_correct_mean"),
        F.col("median_correct").alias("support_correct_median"),
        F.col("mean_incorrect").alias("support_incorrect_mean"),
        F.col("median_incorrect").alias("support_incorrect_median"),
        F.col("roc_auc").alias("auc_support"))
    scores = {"mech_disagreement": "disagreement", missing: "missing", "mech_plausibility": "plausibility",
              "_dis_plus_missing": "disagreement_plus_missing"}
    stacked = usable.select(*keys, "error", F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), F.col(c).cast("double").alias("score"))
        for c, name in scores.items()])).alias("_s")).select(*keys, "error", "_s.*")
    aucs = metrics.roc_auc(stacked, [*keys, "name"], "score", is_error, "auc", **sizing)
    wide = aucs.groupBy(*keys).agg(*[
        F.max(F.when(F.col("name") == n, F.col("auc"))).alias(f"auc_{n}") for n in scores.values()])
    corr = metrics.pearson(usable, keys, "mech_support", "mech_disagreement", "corr_support_disagreement")
    return total.join(diag, keys, "left").join(wide, keys, "left").join(corr, keys, "left")


def missingness_bins(scored: DataFrame, keys: Sequence[str] = ("seed",),
                     missing: str = "mech_missing_frac", **sizing) -> DataFrame:
    """AUC of support and disagreement per missing-share bin; empty bins stay with zero rows."""
    keys = list(keys)
    usable = usable_rows(scored, missing).withColumn(
        "bin", probs.right_closed_bin(F.col(missing), probs.MISSINGNESS_EDGES, probs.MISSINGNESS_NAMES))
    usable = usable.where(F.col("bin").isNotNull())
    is_error = F.col("y_true") != F.col("y_pred")
    frame = scored.select(*keys).distinct().withColumn(
        "bin", F.explode(F.array(*[F.lit(n) for n in probs.MISSINGNESS_NAMES])))
    counts = usable.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n_rows"))
    sup = metrics.roc_auc(usable, [*keys, "bin"], "mech_support", is_error, "auc_support", **sizing)
    dis = metrics.roc_auc(usable, [*keys, "bin"], "mech_disagreement", is_error, "auc_disagreement", **sizing)
    by = [*keys, "bin"]
    return (frame.join(counts, by, "left").fillna({"n_rows": 0})
            .join(sup, by, "left").join(dis, by, "left"))
