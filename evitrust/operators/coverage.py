"""Which reference entities each channel and source covers, and how key sets compare."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def reference_entities(df: DataFrame, key: Column | str, out: str = "entity") -> DataFrame:
    """Distinct non-null keys of a base table."""
    c = F.col(key) if isinstance(key, str) else key
    return df.select(c.alias(out)).where(F.col(out).isNotNull()).distinct()


def channel_coverage(present: DataFrame, reference: DataFrame, channels: Sequence[str],
                     by: Sequence[str] = ()) -> DataFrame:
    """Per channel: covered and missing reference entities, rate, activity rows, entities outside the
    reference. ``present`` has (entity, channel, *by), one row per measurement.

    Rows are folded to (entity, channel) with a count before the join, and what is missing follows
    from the size of the reference set, so no product of channels and entities is built.
    """
    by = list(by)
    cells = present.where(F.col("channel").isin(list(channels))).groupBy(*by, "entity", "channel").agg(
        F.count(F.lit(1)).alias("_n"))
    known = reference.select("entity").distinct().withColumn("_in", F.lit(1))
    per = cells.join(known, "entity", "left").groupBy(*by, "channel").agg(
        F.count("_in").alias("covered"), F.count_if(F.col("_in").isNull()).alias("extra"),
        F.sum("_n").alias("activity_count"))
    frame = (present.select(*by).distinct() if by else reference.sparkSession.range(1).select())
    frame = frame.withColumn("channel", F.explode(F.array(*[F.lit(c) for c in channels])))
    size = known.agg(F.count(F.lit(1)).alias("reference_count"))
    out = frame.join(per, [*by, "channel"], "left").fillna(
        {"covered": 0, "extra": 0, "activity_count": 0})
    # ``size`` is a single row
    return out.join(F.broadcast(size)).withColumn(
        "missing", F.col("reference_count") - F.col("covered")).withColumn(
        "rate", F.when(F.col("reference_count") > 0, F.col("covered") / F.col("reference_count")).otherwise(0.0))


def missing_entities(present: DataFrame, reference: DataFrame, channels: Sequence[str]) -> DataFrame:
    """(channel, entity) pairs of the reference that have no row. A list can be as long as the
    reference set, so it stays a table."""
    frame = reference.select("entity").distinct().withColumn(
        "channel", F.explode(F.array(*[F.lit(c) for c in channels])))
    return frame.join(present.select("entity", "channel"), ["entity", "channel"], "left_anti")


def extra_entities(present: DataFrame, reference: DataFrame) -> DataFrame:
    """(channel, entity) pairs whose entity is not in the reference set."""
    return present.select("channel", "entity").distinct().join(
        reference.select("entity"), "entity", "left_anti")


def any_all_coverage(present: DataFrame, reference: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Reference entities covered in at least one channel and in every channel."""
    per = (
        present.where(F.col("channel").isin(list(channels)))
        .join(reference.select("entity").distinct(), "entity", "left_semi")
        .groupBy("entity").agg(F.count_distinct("channel").alias("_k"))
    )
    hits = per.agg(F.count(F.lit(1)).alias("covered_any"),
                   F.count_if(F.col("_k") == len(channels)).alias("covered_all"))
    size = reference.select("entity").distinct().agg(F.count(F.lit(1)).alias("reference_count"))
    return hits.join(F.broadcast(size))  # two single rows


def alias_coverage(long: DataFrame, alias: Column, value: str = "value") -> DataFrame:
    """Per channel: alias groups with at least one present value, and groups without."""
    groups = long.groupBy("channel", alias.alias("_alias")).agg(
        F.max(F.col(value).isNotNull().cast("int")).alias("_there"))
    return groups.groupBy("channel").agg(
        F.sum("_there").alias("present"), F.sum(1 - F.col("_there")).alias("missing"))


def source_counts(selected: DataFrame) -> DataFrame:
    """How often each source was selected per channel."""
    return selected.groupBy("channel", "source").agg(F.count(F.lit(1)).alias("n"))


def coverage_ranking(candidates: DataFrame, reference: DataFrame, channels: Sequence[str],
                     source: str = "source_id") -> DataFrame:
    """Coverage of several candidate sources in one job: per source the count of each channel and the
    number of channels with any coverage."""
    per = channel_coverage(candidates, reference, channels, by=[source])
    return per.groupBy(source).agg(
        *[F.max(F.when(F.col("channel") == c, F.col("covered"))).alias(f"covered_{c}") for c in channels],
        F.sum("covered").alias("covered_cells"),
        F.count_if(F.col("covered") > 0).alias("channels_with_data"))


def distinct_entities(df: DataFrame, reference: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Distinct entities per channel, all and those in the reference; zero for an empty channel."""
    pairs = df.select("channel", "entity").distinct().join(
        reference.select("entity").distinct().withColumn("_in", F.lit(1)), "entity", "left")
    per = pairs.groupBy("channel").agg(F.count(F.lit(1)).alias("n_all"), F.count("_in").alias("n_overlap"))
    frame = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in channels])).alias("channel"))
    return frame.join(per, "channel", "left").fillna({"n_all": 0, "n_overlap": 0})


def set_membership(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Each key of either side with ``matched``, ``only_left`` or ``only_right``."""
    tag = lambda d, l, r: d.select(key).where(F.col(key).isNotNull()).select(
        key, F.lit(l).alias("_l"), F.lit(r).alias("_r"))
    folded = tag(left, 1, 0).unionAll(tag(right, 0, 1)).groupBy(key).agg(
        F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    return folded.select(key, F.when(F.col("_l") + F.col("_r") == 2, "matched").when(
        F.col("_l") == 1, "only_left").otherwise("only_right").alias("side"))


def set_comparison(left: DataFrame, right: DataFrame, keys: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Counts and match rate under several key definitions (name -> left key, right key), one job."""
    stack = lambda d, i, l, r: d.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("key_name"), k[i].cast("string").alias("key")) for n, k in keys.items()
    ])).alias("s")).select("s.*", F.lit(l).alias("_l"), F.lit(r).alias("_r")).where(F.col("key").isNotNull())
    both = stack(left, 0, 1, 0).unionAll(stack(right, 1, 0, 1)).groupBy("key_name", "key").agg(
        F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    out = both.groupBy("key_name").agg(
        F.sum("_l").alias("n_left"), F.sum("_r").alias("n_right"),
        F.sum(F.col("_l") * F.col("_r")).alias("matched"))
    return out.select(
        "key_name", "n_left", "n_right", "matched",
        (F.col("n_left") - F.col("matched")).alias("only_left"),
        (F.col("n_right") - F.col("matched")).alias("only_right"),
        F.when(F.col("n_left") > 0, F.col("matched") / F.col("n_left")).otherwise(0.0).alias("match_rate"))


def missing_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of nulls per column in one pass, as (column_name, missing_rate)."""
    row = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("missing_rate")) for c in columns
    ])).alias("s")).select("s.*")


def column_profile(df: DataFrame, column: str, first: int = 10) -> DataFrame:
    """Min, max, distinct count and the lowest distinct values (a report of ``first`` entries), of the column's type."""
    distinct = df.select(F.col(column).alias("v")).where(F.col("v").isNotNull()).distinct()
    stats = distinct.agg(F.min("v").alias("min"), F.max("v").alias("max"), F.count(F.lit(1)).alias("n_distinct"))
    lowest = distinct.orderBy("v").limit(first).agg(
        F.sort_array(F.collect_list("v")).alias("first_values"))
    return stats.join(F.broadcast(lowest))  # two single rows


def category_profile(df: DataFrame, channel: str, columns: Sequence[str]) -> DataFrame:
    """Row counts per (channel, column, value), nulls as UNKNOWN."""
    long = df.select(channel, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN")).alias("value"))
        for c in columns])).alias("s")).select(channel, "s.*")
    return long.groupBy(channel, "column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def category_totals(df: DataFrame, channel: str, strict: Column) -> DataFrame:
    return df.groupBy(channel).agg(F.count(F.lit(1)).alias("total"), F.count_if(strict).alias("strict_count"))
