"""Prediction metrics as grouped aggregates over one confusion table per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evitrust import ordering

LOG_LOSS_EPS = 2.220446049250313e-16  # float64 machine epsilon


def class_labels(df: DataFrame, column: str = "y_true", at_most: int = 1000) -> list[str]:
    """Sorted class vocabulary. Refuses columns that are not a class label."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(at_most + 1).collect()
    if len(rows) > at_most:
        raise ValueError(f"{column} has more than {at_most} distinct values; not a class label")
    return sorted(r[0] for r in rows)


def confusion_counts(df: DataFrame, keys: Sequence[str], y_true: str = "y_true",
                     y_pred: str = "y_pred") -> DataFrame:
    """Rows per (keys, true class, predicted class)."""
    return df.groupBy(*keys, F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(df: DataFrame, keys: Sequence[str] = (), y_true: str = "y_true",
                     y_pred: str = "y_pred", labels: Sequence[str] | None = None) -> DataFrame:
    """Confusion counts and the share of each true class; all label pairs when labels are given."""
    counts = confusion_counts(df, keys, y_true, y_pred)
    if labels is not None:
        frame = (
            counts.select(*keys).distinct()
            .withColumn("y_true", F.explode(F.array(*[F.lit(x) for x in labels])))
            .withColumn("y_pred", F.explode(F.array(*[F.lit(x) for x in labels])))
        )
        counts = frame.join(counts, [*keys, "y_true", "y_pred"], "left").fillna({"n": 0})
    support = counts.groupBy(*keys, "y_true").agg(F.sum("n").alias("_support"))
    return counts.join(support, [*keys, "y_true"]).select(
        *keys, "y_true", "y_pred", "n",
        F.when(F.col("_support") > 0, F.col("n") / F.col("_support")).otherwise(0.0).alias("share"),
    )


def label_scores(conf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """tp, fp, fn per (keys, label) from a confusion table."""
    hit = F.col("y_true") == F.col("y_pred")
    zero = F.lit(0).cast("bigint")
    parts = F.array(
        F.struct(
            F.col("y_true").alias("label"),
            F.when(hit, F.col("n")).otherwise(zero).alias("tp"),
            zero.alias("fp"),
            F.when(hit, zero).otherwise(F.col("n")).alias("fn"),
            F.lit(1).alias("in_true"),
        ),
        F.struct(
            F.col("y_pred").alias("label"),
            zero.alias("tp"),
            F.when(hit, zero).otherwise(F.col("n")).alias("fp"),
            zero.alias("fn"),
            F.lit(0).alias("in_true"),
        ),
    )
    return (
        conf.select(*keys, F.explode(parts).alias("p")).select(*keys, "p.*")
        .groupBy(*keys, "label")
        .agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
             F.max("in_true").alias("in_true"))
    )


def scores_from_confusion(conf: DataFrame, keys: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Accuracy, balanced accuracy (classes present in y_true) and macro-F1 over a fixed label list
    (a label without rows scores 0) per key."""
    per_label = label_scores(conf, keys)
    support = F.col("tp") + F.col("fn")
    denom = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    f1 = F.when(denom > 0, 2 * F.col("tp") / F.when(denom > 0, denom)).otherwise(0.0)
    recall = F.when(support > 0, F.col("tp") / F.when(support > 0, support))
    return per_label.groupBy(*keys).agg(
        F.sum(support).alias("n_rows"),
        (F.sum("tp") / F.sum(support)).alias("accuracy"),
        F.avg(recall).alias("balanced_accuracy"),
        (F.coalesce(F.sum(F.when(F.col("label").isin(list(labels)), f1)), F.lit(0.0))
         / F.lit(float(len(labels)))).alias("macro_f1"),
    )


def classification_scores(df: DataFrame, keys: Sequence[str], labels: Sequence[str],
                          y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    return scores_from_confusion(confusion_counts(df, keys, y_true, y_pred), keys, labels)


def true_class_probability(y_true: str, prob_cols: Sequence[str], labels: Sequence[str]) -> Column:
    out = F.when(F.col(y_true) == labels[0], F.col(prob_cols[0]))
    for label, col in list(zip(labels, prob_cols))[1:]:
        out = out.when(F.col(y_true) == label, F.col(col))
    return out


def log_loss(prob: Column, eps: float = LOG_LOSS_EPS) -> Column:
    """Mean negative log of the clipped probability of the true class (aggregate)."""
    return F.avg(-F.log(F.greatest(F.least(prob, F.lit(1.0 - eps)), F.lit(eps))))


def brier_multiclass(y_true: str, prob_cols: Sequence[str], labels: Sequence[str]) -> Column:
    """Mean squared distance to the one-hot true class (aggregate)."""
    total = F.lit(0.0)
    for label, col in zip(labels, prob_cols):
        hit = F.when(F.col(y_true) == label, 1.0).otherwise(0.0)
        total = total + (F.col(col) - hit) * (F.col(col) - hit)
    return F.avg(total)


def probability_scores(df: DataFrame, keys: Sequence[str], prob_cols: Sequence[str],
                       labels: Sequence[str], y_true: str = "y_true") -> DataFrame:
    p_true = true_class_probability(y_true, prob_cols, labels)
    return df.groupBy(*keys).agg(
        log_loss(p_true).alias("log_loss"),
        brier_multiclass(y_true, prob_cols, labels).alias("brier"),
    )


def confidence_bin(conf: Column, n_bins: int = 10) -> Column:
    """Index of the (lo, hi] bin on equal edges; null for 0 and for values above 1."""
    edges = [i * (1.0 / n_bins) for i in range(n_bins)] + [1.0]
    below = F.lit(0)
    for edge in edges[:-1]:
        below = below + F.when(conf > F.lit(edge), 1).otherwise(0)
    return F.when((conf > 0.0) & (conf <= 1.0), below - 1)


def expected_calibration_error(df: DataFrame, keys: Sequence[str], confidence: str, correct: Column,
                               n_bins: int = 10) -> DataFrame:
    """Share-weighted gap between accuracy and mean confidence over equal bins."""
    bins = (
        df.groupBy(*keys, confidence_bin(F.col(confidence), n_bins).alias("_bin"))
        .agg(F.count(F.lit(1)).alias("_n"), F.avg(correct.cast("double")).alias("_acc"),
             F.avg(confidence).alias("_conf"))
    )
    return calibration_error_of_bins(bins, keys)


def calibration_error_of_bins(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same from rows (keys, _bin, _n, _acc, _conf); a null bin counts in the share only."""
    gap = F.when(F.col("_bin").isNotNull(), F.abs(F.col("_acc") - F.col("_conf")) * F.col("_n"))
    return bins.groupBy(*keys).agg(
        (F.coalesce(F.sum(gap), F.lit(0.0)) / F.sum("_n")).alias("ece"))


def reliability_bins(df: DataFrame, keys: Sequence[str], confidence: str, correct: Column,
                     n_bins: int = 10) -> DataFrame:
    return (
        df.groupBy(*keys, confidence_bin(F.col(confidence), n_bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n_rows"), F.avg(correct.cast("double")).alias("accuracy"),
             F.avg(confidence).alias("mean_confidence"))
        .where(F.col("bin").isNotNull())
    )


def roc_auc(df: DataFrame, keys: Sequence[str], score: str, positive: Column, out: str = "auc",
            **sizing) -> DataFrame:
    """Area under the ROC curve from average ranks; null where only one class is present.

    Works on one row per distinct score, so heavy ties cost nothing and no group is sorted in one task.
    """
    ranks = ordering.value_ranks(
        df, keys, score, {"_pos": F.when(positive, 1).otherwise(0).cast("bigint")}, **sizing)
    sums = ranks.groupBy(*keys).agg(
        F.sum("_pos").cast("double").alias("_np"),
        (F.sum("n") - F.sum("_pos")).cast("double").alias("_nn"),
        F.sum(F.col("_pos") * F.col("avg_rank")).alias("_rs"),
    )
    u = F.col("_rs") - F.col("_np") * (F.col("_np") + 1) / 2
    pairs = F.col("_np") * F.col("_nn")
    return sums.select(*keys, F.when(pairs > 0, u / F.when(pairs > 0, pairs)).alias(out))


def _guarded_corr(x: str, y: str) -> Column:
    """Pearson correlation, null for a constant side (``corr`` itself raises there under ANSI)."""
    n = F.count(F.lit(1)).cast("double")
    cov, vx, vy = F.covar_pop(x, y), F.var_pop(x), F.var_pop(y)
    return F.when((n > 1) & (vx > 0) & (vy > 0),
                  cov / F.when((vx > 0) & (vy > 0), F.sqrt(vx) * F.sqrt(vy)))


def pearson(df: DataFrame, keys: Sequence[str], x: str, y: str, out: str = "pearson") -> DataFrame:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    both = both.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    return both.groupBy(*keys).agg(_guarded_corr("_x", "_y").alias(out))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, out: str = "spearman",
             at_least: int = 0, **sizing) -> DataFrame:
    """Correlation of average ranks, null below ``at_least`` pairs."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    both = both.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    ranked = ordering.with_average_rank(both, keys, "_x", rank="_rx", **sizing)
    ranked = ordering.with_average_rank(ranked, keys, "_y", rank="_ry", **sizing)
    return ranked.groupBy(*keys).agg(
        F.when(F.count(F.lit(1)) >= at_least, _guarded_corr("_rx", "_ry")).alias(out))


def rollup_mean_std(df: DataFrame, keys: Sequence[str], metrics: Sequence[str],
                    count_as: str = "n_groups") -> DataFrame:
    """Mean and sample deviation (0 for a single row) of each metric per key."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"),
                 F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_std")]
    return df.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias(count_as))


def two_level_rollup(df: DataFrame, keys: Sequence[str], seed: str, metrics: Sequence[str]) -> DataFrame:
    """Fold rows -> seed means -> mean and deviation over seeds."""
    per_seed = df.groupBy(*keys, seed).agg(*[F.avg(m).alias(m) for m in metrics])
    return rollup_mean_std(per_seed, keys, metrics, count_as="n_seeds")


def score_diagnostics(df: DataFrame, keys: Sequence[str], score: str, error: Column,
                      **sizing) -> DataFrame:
    """Mean and median score of correct and incorrect rows, AUC and rank correlation against the error."""
    work = df.withColumn("_err", error.cast("int"))
    means = work.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(F.when(F.col("_err") == 0, F.col(score))).alias("mean_correct"),
        F.avg(F.when(F.col("_err") == 1, F.col(score))).alias("mean_incorrect"),
    )
    medians = ordering.grouped_median(work, [*keys, "_err"], score, "_m", **sizing)
    medians = medians.groupBy(*keys).agg(
        F.max(F.when(F.col("_err") == 0, F.col("_m"))).alias("median_correct"),
        F.max(F.when(F.col("_err") == 1, F.col("_m"))).alias("median_incorrect"),
    )
    auc = roc_auc(work, keys, score, F.col("_err") == 1, "roc_auc", **sizing)
    rho = spearman(work, keys, score, "_err", "spearman_r", **sizing)
    return means.join(medians, list(keys)).join(auc, list(keys)).join(rho, list(keys))


def split_diagnostics(df: DataFrame, keys: Sequence[str], role: str, group: str, label: str,
                      labels: Sequence[str]) -> DataFrame:
    """Rows, groups, zero-filled class counts and missing classes per (keys, role)."""
    counts = [F.count_if(F.col(label) == F.lit(c)).alias(f"n_{c}") for c in labels]
    out = df.groupBy(*keys, role).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(group).alias("n_groups"), *counts)
    absent = [F.when(F.col(f"n_{c}") == 0, F.lit(c)) for c in labels]
    return out.withColumn("missing_classes", F.concat_ws("|", *absent))


def split_overlap(df: DataFrame, keys: Sequence[str], role: str, group: str) -> DataFrame:
    """Groups that appear under more than one role, per key."""
    roles = df.groupBy(*keys, group).agg(F.count_distinct(role).alias("_roles"))
    return roles.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("_roles") > 1).alias("n_overlap"))
