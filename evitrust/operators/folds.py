"""Group-safe stratified folds as a column, nested splits, and the checks on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from evitrust import contracts, ordering
from evitrust.sources.shared import written


def group_classes(df: DataFrame, group: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per (keys, group, class): the only pass over the rows."""
    return df.where(F.col(label).isNotNull()).groupBy(*keys, group, label).agg(F.count(F.lit(1)).alias("n"))


def _majority(counts: DataFrame, keys: Sequence[str], group: str, label: str) -> DataFrame:
    return counts.groupBy(*keys, group).agg(
        F.max_by(label, F.struct(F.col("n"), F.col(label))).alias("major"), F.sum("n").alias("size"))


def _positions(work: DataFrame, keys: Sequence[str], at_most: int, max_rows_per_range: int = ordering.MAX_ROWS_PER_RANGE,
               group_at_most: int | None = None) -> DataFrame:
    """Add ``pos``, the place by falling size and then by ``_h`` within ``keys``; no key has more than ``at_most`` rows.

    The first digits of a hash are even ranges of its order, so a long order is numbered inside (size, first digits), and
    the number of rows before is added from a small table.
    """
    at_most = min(at_most, group_at_most or at_most)
    if at_most <= max_rows_per_range:
        return work.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("size"), "_h")))
    digits = 1
    while 16 ** digits * max_rows_per_range < at_most:
        digits += 1
    work = work.withColumn("_b", F.substring("_h", 1, digits))
    part = [*keys, "size", "_b"]
    earlier = Window.partitionBy(*keys).orderBy(F.desc("size"), "_b").rowsBetween(Window.unboundedPreceding, -1)
    before = work.groupBy(*part).agg(F.count(F.lit(1)).alias("_n")).select(
        *part, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = work.withColumn("_in", F.row_number().over(Window.partitionBy(*part).orderBy("_h")))
    return inside.join(before, part).withColumn("pos", F.col("_before") + F.col("_in"))


def _serpentine(groups: DataFrame, keys: Sequence[str], group: str, salt: Column, n_splits: int,
                labels: Sequence[str], out: str, at_most: int, **sizing) -> DataFrame:
    """Deal the groups of each majority class to folds 0..k-1..0, largest first, start shifted by class."""
    work = groups.withColumn("_h", F.md5(F.concat_ws(":", salt.cast("string"), F.col(group).cast("string"))))
    placed = _positions(work, [*keys, "major"], at_most, **sizing)
    step = F.pmod(F.col("pos") - 1, F.lit(2 * n_splits))
    dealt = F.when(step < n_splits, step).otherwise(2 * n_splits - 1 - step)
    shift = F.lit(len(labels))
    for i, x in enumerate(labels):
        shift = F.when(F.col("major") == x, F.lit(i)).otherwise(shift)
    return placed.select(*keys, group, F.pmod(dealt + shift, F.lit(n_splits)).cast("int").alias(out))


def stratified_group_folds(df: DataFrame, group: str, label: str, labels: Sequence[str],
                           seeds: Sequence[int], n_splits: int = 5, **sizing) -> DataFrame:
    """(seed, group, fold): every group in exactly one fold per seed, classes spread over the folds.

    The assignment is made on groups, not rows; join it back on the group to split rows.
    """
    groups = written(_majority(group_classes(df, group, label), [], group, label))   # ranks read them several times
    seeded = groups.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    return _serpentine(seeded, ["seed"], group, F.col("seed"), n_splits, labels, "fold", groups.count(), **sizing)


def with_folds(df: DataFrame, folds: DataFrame, group: str) -> DataFrame:
    """Every row once per seed, with its fold."""
    return df.join(folds, group)


def nested_splits(df: DataFrame, folds: DataFrame, group: str, label: str, labels: Sequence[str],
                  n_outer: int = 5, n_inner: int = 3, seed_offset: int = 1000, **sizing) -> DataFrame:
    """(seed, fold, group, inner) for the training groups of each outer fold.

    The inner seed is ``seed + seed_offset + fold``.
    """
    groups = written(_majority(group_classes(df, group, label), [], group, label).join(folds, group))   # ranks read them several times
    others = F.filter(F.sequence(F.lit(0), F.lit(n_outer - 1)), lambda f: f != F.col("fold"))
    train = groups.withColumn("_outer", F.explode(others)).drop("fold").withColumnRenamed("_outer", "fold")
    salt = F.col("seed") + F.lit(seed_offset) + F.col("fold")
    return _serpentine(train, ["seed", "fold"], group, salt, n_inner, labels, "inner", groups.count(), **sizing)


def fold_classes(df: DataFrame, assigned: DataFrame, group: str, label: str, keys: Sequence[str]) -> DataFrame:
    """Row counts per (keys, class) once groups are assigned."""
    counts = group_classes(df, group, label)
    return counts.join(assigned, group).groupBy(*keys, label).agg(F.sum("n").alias("n"))


def first_complete(df: DataFrame, assigned: DataFrame, group: str, label: str, labels: Sequence[str],
                   keys: Sequence[str], fold: str) -> DataFrame:
    """Per key the first fold that holds every class present under the key, else the first fold, with
    the classes missing there."""
    keys = list(keys)
    # one row a group before it meets its slots
    classes = df.where(F.col(label).isNotNull()).groupBy(group).agg(*[
        F.max((F.col(label) == x).cast("int")).alias(f"_h{i}") for i, x in enumerate(labels)])
    held = classes.join(assigned, group).groupBy(*keys, fold).agg(*[F.max(f"_h{i}").alias(f"_h{i}") for i in range(len(labels))])
    w = Window.partitionBy(*(keys or [F.lit(0)]))
    short = F.lit(0)
    names = []
    for i, x in enumerate(labels):
        held = held.withColumn(f"_a{i}", F.max(f"_h{i}").over(w))
        lacking = (F.col(f"_a{i}") == 1) & (F.col(f"_h{i}") == 0)
        short = short + lacking.cast("int")
        names.append(F.when(lacking, F.lit(x)))
    scored = held.withColumns({"_short": short, "missing_classes": F.concat_ws("|", *names)})
    best = F.min_by(F.struct(F.col(fold), F.col("missing_classes")),
                    F.struct((F.col("_short") > 0).cast("int"), F.col(fold)))
    return scored.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def calibration_roles(df: DataFrame, folds: DataFrame, group: str, label: str, labels: Sequence[str],
                      n_outer: int = 5, n_inner: int = 3, **sizing) -> DataFrame:
    """(seed, fold, group, role) with role test, calib or train."""
    folds = written(folds)    # read by the inner splits and as test roles
    inner = written(nested_splits(df, folds, group, label, labels, n_outer, n_inner, **sizing))
    chosen = F.broadcast(written(first_complete(df, inner, group, label, labels, ["seed", "fold"], "inner").select(  # one row a slot
        "seed", "fold", F.col("inner").alias("_c"))))
    train = inner.join(chosen, ["seed", "fold"]).select(
        "seed", "fold", group, F.when(F.col("inner") == F.col("_c"), "calib").otherwise("train").alias("role"))
    return train.unionByName(folds.select("seed", "fold", group, F.lit("test").alias("role")))


def folds_from_predictions(predictions: DataFrame, entities: DataFrame, group: str) -> DataFrame:
    """(seed, fold, group, role): test groups as predicted, train = all other entities.

    A group seen under several folds of a seed is test there and train elsewhere.
    """
    seen = predictions.select("seed", "fold", group).distinct()
    slots = seen.select("seed", "fold").distinct().groupBy().agg(
        F.collect_set(F.struct("seed", "fold")).alias("_slots"))  # seeds x folds, a short list
    every = entities.select(group).distinct().join(F.broadcast(slots)).select(
        group, F.explode("_slots").alias("s")).select("s.seed", "s.fold", group)
    train = every.join(seen, ["seed", "fold", group], "left_anti").withColumn("role", F.lit("train"))
    return train.unionByName(seen.withColumn("role", F.lit("test")))


def leaking_groups(df: DataFrame, group: str, keys: Sequence[str] = ("seed",), fold: str = "fold") -> DataFrame:
    """Groups found in more than one fold, per key."""
    per = df.groupBy(*keys, group).agg(F.count_distinct(fold).alias("_f"))
    return per.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_groups"),
                                  F.count_if(F.col("_f") > 1).alias("n_leaking"))


def fold_alignment(expected: DataFrame, observed: DataFrame, group: str) -> DataFrame:
    """Per (seed, fold): expected and observed test groups and how many differ."""
    return contracts.aligned_key_counts(
        expected, observed, ["seed", "fold", group], by=["seed", "fold"]
    ).withColumnsRenamed({"left_rows": "expected_count", "right_rows": "observed_count",
                          "sym_diff": "symmetric_diff"})
