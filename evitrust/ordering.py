"""Ranks, running totals and exact quantiles that never need one task per group.

A window over ``partitionBy(seed, fold)`` sends a whole fold to a single task. Where the largest group has more than
``max_rows_per_range`` rows, the order columns are cut into ranges instead: rows are numbered inside (group, range), and
the size of all earlier ranges of the group is added from a small table. Cuts are tuples of (value, ties) taken from a
hashed sample, and rows are compared with them as tuples, so nulls come first, NaN comes last, ties of any type
(text included) split a frequent value, and both ways give the same rows. The number of ranges grows with the table:
beyond ``CUTS`` the ranges are cut a second time, each by cuts of its own.

``group_at_most`` is an upper bound on the largest group that the caller already knows (for example
the row count of a base table); when it is small the group sizes are not counted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from evitrust.sources.shared import written

MAX_ROWS_PER_RANGE = 250_000   # Spark may put several groups into one task
CUTS = 1_023        # cuts that one binary search looks through at most
OVERSAMPLE = 16     # sampled rows for each cut
BUCKETS = 1 << 14   # of hashed keys, whose sizes are looked at before those of the groups
ROWS_PER_TASK = 500_000


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group: a partially aggregated count, no group is collected."""
    if not keys:
        return df.count()
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def groups_fit(df: DataFrame, keys: Sequence[str], max_rows_per_range: int = MAX_ROWS_PER_RANGE,
               group_at_most: int | None = None) -> bool:
    """Is every group small enough for one task? Rows of a bucket of hashed keys bound those of its groups, so groups
    themselves are counted only where a large bucket holds several."""
    if group_at_most is not None and group_at_most <= max_rows_per_range:
        return True
    if not keys:
        return largest_group(df, keys) <= max_rows_per_range
    hashed = df.select(F.xxhash64(*keys).alias("_h"))
    sizes = hashed.groupBy(F.pmod("_h", F.lit(BUCKETS)).alias("_b")).agg(
        F.count(F.lit(1)).alias("n"), (F.min("_h") == F.max("_h")).alias("one"))
    large = sizes.where(F.col("n") > max_rows_per_range).agg(F.count(F.lit(1)).alias("n"), F.bool_or("one").alias("one")).first()
    if not large.n or large.one:
        return not large.n
    return largest_group(df, keys) <= max_rows_per_range


def dealt(df: DataFrame, keys: Sequence[str], rows: int | None) -> DataFrame:
    """A large table dealt by ``keys`` to tasks of about ``ROWS_PER_TASK`` rows, whatever number of partitions the session
    has: what a task holds then does not grow with the table. ``rows`` bounds its rows; unknown, or few, it stays as it is."""
    if not keys or not rows or rows <= ROWS_PER_TASK * df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(-(-rows // ROWS_PER_TASK), *keys)


def _search(cuts: Column, row: Column, n: int) -> Column:
    """How many of at most ``n`` sorted cuts are smaller than the row, by halving."""
    halves = [1 << i for i in reversed(range(max(n, 1).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, halves)), F.lit(0),
                       lambda low, half: F.when(F.get(cuts, low + half - 1) < row, low + half).otherwise(low))


def _spread(sample: DataFrame, n: int, group: Sequence[str] = ()) -> DataFrame:
    """One row of sorted ``cuts`` (for each group): every so-many-th of the sampled tuples ``_o``."""
    part = Window.partitionBy(*(group or [F.lit(0)]))
    numbered = sample.withColumn("_i", F.row_number().over(part.orderBy("_o"))).withColumn("_n", F.count(F.lit(1)).over(part))
    step = F.greatest(F.ceil(F.col("_n") / (n + 1)), F.lit(1))
    picked = numbered.where((F.col("_i") % step == 0) & (F.col("_i") < F.col("_n")))
    return picked.groupBy(*group).agg(F.array_sort(F.collect_set("_o")).alias("cuts"))


def with_ranges(df: DataFrame, order: Sequence[str], max_rows_per_range: int = MAX_ROWS_PER_RANGE) -> DataFrame:
    """Add ``_range`` and ``_part``: rows in order of the columns ``order`` have rising (_range, _part).

    A hashed sample of ``OVERSAMPLE`` rows a cut gives the cuts, at most ``CUTS`` in each of the two levels; they are
    one broadcast row, and beyond that one broadcast row of cuts for each first range.
    """
    ranges = 2 * -(-df.count() // max_rows_per_range)
    first = min(ranges, CUTS)
    second = min(-(-ranges // (first + 1)) - 1, CUTS)
    out = df.withColumn("_o", F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(order)]))
    wanted = OVERSAMPLE * (first + 1) * (second + 1)
    total = max(ranges * max_rows_per_range // 2, 1)
    share = min(1_000_000, max(wanted * 1_000_000 // total, 1) * 2)
    sample = out.where(F.pmod(F.xxhash64(*order), F.lit(1_000_000)) < share).select("_o")
    # cuts are written: else the plan of the rows stands in the result once more for every use of them
    one = F.broadcast(written(_spread(sample, first).withColumnRenamed("cuts", "_cuts")))
    out = out.join(one, F.lit(True), "left").withColumn("_range", _search(F.col("_cuts"), F.col("_o"), first)).drop("_cuts")
    if second < 1:
        return out.withColumn("_part", F.lit(0)).drop("_o")
    inner = sample.join(one, F.lit(True), "left").withColumn("_range", _search(F.col("_cuts"), F.col("_o"), first)).select("_range", "_o")
    own = F.broadcast(written(_spread(inner, second, ["_range"]).withColumnRenamed("_range", "_r")))
    return out.join(own, F.col("_range") == F.col("_r"), "left").withColumn(
        "_part", F.coalesce(_search(F.col("cuts"), F.col("_o"), second), F.lit(0))).drop("cuts", "_r", "_o")


def cumulative(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    weights: Mapping[str, Column],
    tie: Sequence[str] = (),
    max_rows_per_range: int = MAX_ROWS_PER_RANGE,
    group_at_most: int | None = None,
) -> DataFrame:
    """Inclusive running sums of ``weights`` in order of (value, tie) within ``keys``.

    For each ``name -> weight`` the result has ``name`` (running sum) and ``name_total`` (sum over the
    group). Nulls of ``value`` and of the ties come first, NaN comes last; (value, tie) should be unique within the
    group, columns may have any type that can be ordered.
    """
    keys, tie = list(keys), list(tie)
    names = list(weights)
    order = [value, *tie]
    work = df
    for name, weight in weights.items():
        work = work.withColumn(f"_w_{name}", weight)
    part = keys if keys else [F.lit(0)]
    if groups_fit(df, keys, max_rows_per_range, group_at_most):
        # both frames share one ordering, so one sort and one window operator do it
        ordered = Window.partitionBy(*part).orderBy(*order)
        upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
        whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        outs = {n: F.sum(f"_w_{n}").over(upto) for n in names}
        outs.update({f"{n}_total": F.sum(f"_w_{n}").over(whole) for n in names})
        work = work.withColumns(outs)
        return work.drop(*[f"_w_{n}" for n in names])

    ranged = written(with_ranges(work, order, max_rows_per_range))  # read for the sizes and for the sums
    range_cols = ["_range", "_part"]
    sizes = ranged.groupBy(*keys, *range_cols).agg(
        *[F.sum(f"_w_{n}").alias(f"_s_{n}") for n in names]
    )
    before = Window.partitionBy(*part).orderBy(*range_cols).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*part)
    offsets = sizes.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[F.col(c).alias(f"_o{c}") for c in range_cols],
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in names],
        *[F.sum(f"_s_{n}").over(whole).alias(f"{n}_total") for n in names],
    )
    inside = Window.partitionBy(*keys, *range_cols).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0)
    local = dealt(ranged, [*keys, *range_cols], ranged.count())
    for name in names:
        local = local.withColumn(f"_l_{name}", F.sum(f"_w_{name}").over(inside))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    on += [F.col(c) == F.col(f"_o{c}") for c in range_cols]
    joined = local.join(offsets, on, "inner")
    return joined.select(
        *df.columns,
        *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in names],
        *[f"{n}_total" for n in names],
    )


def falling(df: DataFrame, column: str) -> Column:
    """A key whose rising order is the falling order of a column, without loss for any type."""
    kind, x = df.select(column).schema[0].dataType, F.col(column)
    if isinstance(kind, T.IntegralType):
        return F.bitwise_not(x)                     # -x - 1, which also the smallest number has
    if isinstance(kind, T.NumericType):
        return -x
    if isinstance(kind, T.BooleanType):
        return ~x
    if isinstance(kind, T.DateType):
        return -F.unix_date(x)
    if isinstance(kind, T.TimestampType):
        return -F.unix_micros(x)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        turned = F.translate(F.hex(x), "0123456789ABCDEF", "FEDCBA9876543210")
        return F.concat(turned, F.lit("G"))         # behind every digit: a longer text comes before its beginning
    raise TypeError(f"no falling order for {kind.simpleString()}")


def row_positions(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    tie: Sequence[str],
    descending: bool = False,
    position: str = "pos",
    total: str = "n_total",
    max_rows_per_range: int = MAX_ROWS_PER_RANGE,
    group_at_most: int | None = None,
) -> DataFrame:
    """1-based position by (value, tie) within ``keys`` plus the group size. Values of any type that can be ordered are
    compared as they are; nulls come first and NaN last in both directions."""
    work = df.withColumn("_signed", falling(df, value) if descending else F.col(value))
    out = cumulative(work, keys, "_signed", {"_pos": F.lit(1).cast("bigint")}, tie, max_rows_per_range,
                     group_at_most)
    return (
        out.withColumn(position, F.col("_pos")).withColumn(total, F.col("_pos_total"))
        .drop("_signed", "_pos", "_pos_total")
    )


def value_ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    counts: Mapping[str, Column] | None = None,
    max_rows_per_range: int = MAX_ROWS_PER_RANGE,
    group_at_most: int | None = None,
) -> DataFrame:
    """One row per distinct (keys, value): its count ``n``, group size ``n_total``, average rank
    ``avg_rank``, and any extra conditional counts. Equal values are folded before they are shuffled."""
    extra = counts or {}
    folded = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in extra.items()])
    )
    if group_at_most is None:
        group_at_most = largest_group(df, keys)
    if group_at_most > max_rows_per_range:
        folded = written(folded)    # sizes, cuts and ranks each read it
    ranked = cumulative(folded, keys, value, {"_cum": F.col("n")}, (), max_rows_per_range, group_at_most)
    return (
        ranked.withColumn("avg_rank", F.col("_cum") - (F.col("n") - 1) / F.lit(2.0))
        .withColumn("n_total", F.col("_cum_total"))
        .withColumn("n_upto", F.col("_cum"))
        .drop("_cum", "_cum_total")
    )


def with_average_rank(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    rank: str | None = None,
    percentile: str | None = None,
    max_rows_per_range: int = MAX_ROWS_PER_RANGE,
    group_at_most: int | None = None,
) -> DataFrame:
    """Add the average rank of ``value`` in its group and/or that rank divided by the group size.
    Null values get null ranks."""
    if groups_fit(df, keys, max_rows_per_range, group_at_most):
        part = keys if keys else [F.lit(0)]
        ordered = Window.partitionBy(*part).orderBy(F.col(value).asc_nulls_last())
        upto = F.count(value).over(ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        size = F.count(value).over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        avg_rank = F.when(F.col(value).isNotNull(), (F.rank().over(ordered) + upto) / F.lit(2.0))
        outs = {}
        if rank:
            outs[rank] = avg_rank
        if percentile:
            outs[percentile] = F.when(F.col(value).isNotNull(), avg_rank / size)
        return df.withColumns(outs)
    df = written(df)    # read by the fold and by each join below
    ranks = value_ranks(df, keys, value, None, max_rows_per_range, group_at_most)
    cols = []
    if rank:
        cols.append(F.col("avg_rank").alias("_r_rank"))
    if percentile:
        cols.append((F.col("avg_rank") / F.col("n_total")).alias("_r_percentile"))
    ranks = written(ranks.select(*[F.col(c).alias(f"_r_{c}") for c in (*keys, value)], F.col("n").alias("_r_n"), *cols))
    on = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in (*keys, value)]
    found = [F.col(c).alias(n) for c, n in (("_r_rank", rank), ("_r_percentile", percentile)) if n]
    # A value that over max_rows_per_range rows share does not meet them in one task: there are at most
    # rows / max_rows_per_range such values, so they are broadcast. Null values have no rank and are not joined.
    hot = F.broadcast(ranks.where(F.col("_r_n") > max_rows_per_range))
    some = df.where(F.col(value).isNotNull())
    none = df.where(F.col(value).isNull()).select("*", *[F.lit(None).cast("double").alias(x) for x in (rank, percentile) if x])
    often = some.join(hot, on).select(*df.columns, *found)
    seldom = some.join(hot, on, "left_anti").join(ranks.where(F.col("_r_n") <= max_rows_per_range), on).select(*df.columns, *found)
    return often.unionByName(seldom).unionByName(none)


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    max_rows_per_range: int = MAX_ROWS_PER_RANGE,
    group_at_most: int | None = None,
    also: Mapping[str, Column] | None = None,
    deal_by: Sequence[str] = (),
) -> DataFrame:
    """Exact linearly interpolated quantiles of the non-null values per group.

    ``also`` names further aggregates of all rows of ``df``. They come from the same shuffle where groups fit a task;
    groups without a value then have them too, with null quantiles. Such groups are dealt to tasks by ``deal_by``, some of
    the keys that later steps group by (else by all keys).

    Spark's exact ``percentile`` keeps every distinct value of a group in one aggregation buffer; this
    form keeps only counts per distinct value and running totals, so a hot group is spread out.
    """
    keys = list(keys)
    fits = groups_fit(df, keys, max_rows_per_range, group_at_most)
    if fits:
        part = keys if keys else [F.lit(0)]
        present = df if also else df.where(F.col(value).isNotNull()).select(*keys, value)
        present = dealt(present, list(deal_by) or keys, group_at_most)
        ordered = Window.partitionBy(*part).orderBy(F.col(value).asc_nulls_last())
        whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ranks = present.withColumns({
            "n": F.lit(1),
            "n_upto": F.row_number().over(ordered),
            "n_total": F.count(value).over(whole),
        })
    else:
        ranks = value_ranks(df, keys, value, None, max_rows_per_range, None)
    seen_before = F.col("n_upto") - F.col("n")
    aggs, outs = [], []
    for name, p in probabilities.items():
        at = (F.col("n_total") - 1) * F.lit(float(p))
        pick = lambda idx: F.max(F.when((seen_before <= idx) & (idx < F.col("n_upto")), F.col(value)))
        aggs += [
            pick(F.floor(at)).alias(f"_lo_{name}"),
            pick(F.ceil(at)).alias(f"_hi_{name}"),
            F.max(at - F.floor(at)).alias(f"_f_{name}"),
        ]
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        outs.append((lo + (hi - lo) * F.col(f"_f_{name}")).alias(name))
    more = {name: c.alias(name) for name, c in (also or {}).items()}
    if not also or fits:
        return ranks.groupBy(*keys).agg(*aggs, *more.values()).select(*keys, *more, *outs)
    rest = df.groupBy(*keys).agg(*more.values())
    picked = ranks.groupBy(*keys).agg(*aggs).select(*[F.col(k).alias(f"_k_{k}") for k in keys], *outs)
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] or F.lit(True)
    return rest.join(picked, on, "left").select(*keys, *more, *probabilities)


def grouped_median(df: DataFrame, keys: Sequence[str], value: str, out: str = "median",
                   max_rows_per_range: int = MAX_ROWS_PER_RANGE,
                   group_at_most: int | None = None) -> DataFrame:
    return grouped_quantiles(df, keys, value, {out: 0.5}, max_rows_per_range, group_at_most)
