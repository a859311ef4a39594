"""Agreement between sources on the same cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from evitrust import ordering
from evitrust.operators import metrics

SPEARMAN_AT_LEAST = 5
TOP_MISMATCHES = 10


def source_pairs(cells: DataFrame, pairs: Sequence[tuple[str, str]], source: str = "source",
                 value: str = "value") -> DataFrame:
    """Positive values of both sources of each named pair, one row per (comparison, cell).

    Sources become columns of one aggregate and the declared pairs are read off that row; no join of
    the long table with itself.
    """
    names = sorted({s for p in pairs for s in p})
    wide = cells.where(F.col(source).isin(names)).groupBy("entity", "channel").agg(*[
        F.max(F.when(F.col(source) == s, F.col(value))).alias(f"v_{s}") for s in names])
    long = wide.select("entity", "channel", F.explode(F.array(*[
        F.struct(F.lit(f"{a}_vs_{b}").alias("comparison"), F.col(f"v_{a}").alias("left_value"),
                 F.col(f"v_{b}").alias("right_value")) for a, b in pairs])).alias("s"))
    long = long.select("entity", "channel", "s.*").where(
        (F.col("left_value") > 0) & (F.col("right_value") > 0))
    return long.withColumns({
        "fold_diff": F.greatest("left_value", "right_value") / F.least("left_value", "right_value"),
        "abs_log10_ratio": F.abs(F.log10(F.col("left_value") / F.col("right_value"))),
    })


def _frame(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    return df.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(f"{a}_vs_{b}") for a, b in pairs])).alias("comparison"))


def fold_concordance(paired: DataFrame, pairs: Sequence[tuple[str, str]], **sizing) -> DataFrame:
    """Pairs, median, mean and largest fold difference; comparisons without overlap stay with 0 pairs."""
    stats = paired.groupBy("comparison").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg("fold_diff").alias("mean_fold_diff"),
        F.max("fold_diff").alias("max_fold_diff"))
    median = ordering.grouped_median(paired, ["comparison"], "fold_diff", "median_fold_diff", **sizing)
    return _frame(paired, pairs).join(stats, "comparison", "left").join(
        median, "comparison", "left").fillna({"n_pairs": 0})


def log_concordance(paired: DataFrame, pairs: Sequence[tuple[str, str]], **sizing) -> DataFrame:
    """Median and mean absolute log10 ratio and the rank correlation (from five pairs on).

    ``paired`` is read three times; persist it when it is expensive.
    """
    stats = paired.groupBy("comparison").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg("abs_log10_ratio").alias("mean_abs_log10_ratio"))
    median = ordering.grouped_median(paired, ["comparison"], "abs_log10_ratio",
                                     "median_abs_log10_ratio", **sizing)
    logs = paired.withColumns({"_a": F.log10("left_value"), "_b": F.log10("right_value")})
    rho = metrics.spearman(logs, ["comparison"], "_a", "_b", "spearman_log10",
                           at_least=SPEARMAN_AT_LEAST, **sizing)
    out = _frame(paired, pairs).join(stats, "comparison", "left")
    return out.join(median, "comparison", "left").join(rho, "comparison", "left").fillna({"n_pairs": 0})


def overlap_counts(paired: DataFrame, pairs: Sequence[tuple[str, str]], channels: Sequence[str]) -> DataFrame:
    """Shared cells per (comparison, channel), zero-filled."""
    frame = _frame(paired, pairs).withColumn("channel", F.explode(F.array(*[F.lit(c) for c in channels])))
    counts = paired.groupBy("comparison", "channel").agg(F.count(F.lit(1)).alias("n_pairs"))
    return frame.join(counts, ["comparison", "channel"], "left").fillna({"n_pairs": 0})


def top_mismatches(paired: DataFrame, by: str, n: int = TOP_MISMATCHES) -> DataFrame:
    """Cells with the largest difference per comparison. The rank limit is applied before the shuffle."""
    w = Window.partitionBy("comparison").orderBy(F.col(by).desc(), "entity", "channel")
    return paired.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
