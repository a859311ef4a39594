"""Per-entity and per-cell summaries, source selection, gap filling and the wide feature table.

A *cell* is an (entity, channel) pair. The long cell table has one row per (entity, channel, source)
with ``value``, ``n_records``, ``prio`` (0 = best source) and ``is_strict``; everything downstream reads it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from evitrust import ordering


def _per_channel(channels: Sequence[str]) -> Column:
    return F.explode(F.array(*[F.lit(c) for c in channels]))


def most_frequent(df: DataFrame, keys: Sequence[str], column: str, out: str | None = None) -> DataFrame:
    """Most frequent non-null value per key, the lowest one on ties.

    Counted per value first, so no task sees all rows of a hot key.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(
        F.min_by(column, F.struct(-F.col("_n"), F.col(column))).alias(out or column))


def value_summary(df: DataFrame, keys: Sequence[str], value: str, prefix: str = "",
                  zero_std: bool = True, iqr: bool = True, **sizing) -> DataFrame:
    """n, mean, std, median, iqr, min and max per key. ``zero_std`` reports 0 for a single value."""
    std = F.stddev_samp(value)
    basic = {
        f"{prefix}n": F.count(value),
        f"{prefix}mean": F.avg(value),
        f"{prefix}std": F.when(F.count(value) == 1, F.lit(0.0)).otherwise(std) if zero_std else std,
        f"{prefix}min": F.min(value),
        f"{prefix}max": F.max(value),
    }
    probabilities = {f"{prefix}median": 0.5}
    if iqr:
        probabilities.update({"_q1": 0.25, "_q3": 0.75})
    q = ordering.grouped_quantiles(df, keys, value, probabilities, also=basic, **sizing)
    if iqr:
        q = q.withColumn(f"{prefix}iqr", F.col("_q3") - F.col("_q1")).drop("_q1", "_q3")
    last = [f"{prefix}median"] + [f"{prefix}iqr"] * iqr
    return q.select(*keys, *basic, *last)


def entity_summary(df: DataFrame, entity: str, names: Sequence[str], measures: Mapping[str, str],
                   lab: str, **sizing) -> DataFrame:
    """One row per entity: most frequent names, statistics of each measure (column -> output prefix),
    number of labs."""
    out = df.groupBy(entity).agg(F.count_distinct(lab).alias("labs_n"))
    for name in names:
        out = out.join(most_frequent(df, [entity], name), entity, "left")
    for column, prefix in measures.items():
        stats = value_summary(df, [entity], column, f"{prefix}_", zero_std=False, iqr=False, **sizing)
        out = out.join(stats.withColumnRenamed(f"{prefix}_n", f"{prefix}_count"), entity, "left")
    return out


def source_cells(df: DataFrame, keep: Column, value: str, source: str, prio: int, strict: bool,
                 entity: str = "entity", channel: str = "channel", **sizing) -> DataFrame:
    """Median and count per cell of the rows of one source that pass its filter."""
    rows = df.where(keep & F.col(value).isNotNull())
    found = ordering.grouped_quantiles(rows.withColumn("_v", F.col(value)), [entity, channel], "_v", {"value": 0.5},
                                       also={"n_records": F.count(F.lit(1))}, **sizing)
    return found.select(
        F.col(entity).alias("entity"), F.col(channel).alias("channel"), F.lit(source).alias("source"),
        F.lit(prio).alias("prio"), "value", "n_records", F.lit(strict).alias("is_strict"))


def cells_by_source(df: DataFrame, value: str, strict: Column, entity: str = "entity",
                    channel: str = "channel", source: str = "source", prio: str = "prio", **sizing) -> DataFrame:
    """Long cell table when the source is a column: all sources in one job."""
    rows = df.where(F.col(value).isNotNull()).select(entity, channel, source, prio, value, strict.alias("_strict"))
    keys = [entity, channel, source, prio]
    found = ordering.grouped_quantiles(rows.withColumnRenamed(value, "_v"), keys, "_v", {"value": 0.5},
                                       also={"n_records": F.count(F.lit(1)), "is_strict": F.bool_and("_strict")},
                                       deal_by=[entity, channel], **sizing)  # a cell's sources meet in one task
    return found.select(
        F.col(entity).alias("entity"), F.col(channel).alias("channel"), F.col(source).alias("source"),
        F.col(prio).alias("prio"), "value", "n_records", "is_strict")


def select_cells(cells: DataFrame) -> DataFrame:
    """Best available source per cell (lowest prio), as a partial aggregate without a sort. A relation (exact, or
    beyond a limit) stays with its cell where the cells have one."""
    carried = ["value", "source", "n_records", "is_strict", *(["relation"] if "relation" in cells.columns else [])]
    picked = cells.where(F.col("value").isNotNull()).groupBy("entity", "channel").agg(
        F.min_by(F.struct(*carried), F.struct("prio", "source")).alias("s"))
    return picked.select("entity", "channel", "s.*")


def selected_cells_of(cells: DataFrame, reference: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Every (reference entity, channel) with its selected source; ``missing`` where no source has it."""
    frame = reference.select("entity").distinct().withColumn("channel", _per_channel(channels))
    joined = frame.join(select_cells(cells), ["entity", "channel"], "left")
    relation = ["relation"] if "relation" in cells.columns else []
    return joined.select(
        "entity", "channel", "value", F.coalesce("source", F.lit("missing")).alias("source"),
        F.coalesce("n_records", F.lit(0).cast("bigint")).alias("n_records"),
        F.coalesce("is_strict", F.lit(False)).alias("is_strict"), *relation)


WIDE_MEASURES = {"ic50_uM": "value", "source": "source", "n_records": "n_records", "is_strict": "is_strict"}


def wide_features(cells: DataFrame, reference: DataFrame, channels: Sequence[str]) -> DataFrame:
    """One row per reference entity with four columns per channel (channel name kept verbatim), the
    number of channels present and missing, and the missing ones joined by ``|`` in channel order."""
    best = select_cells(cells)
    aggs = [
        F.max(F.when(F.col("channel") == c, F.col(m))).alias(f"{name}_{c}")
        for c in channels for name, m in WIDE_MEASURES.items()
    ]
    wide = best.groupBy("entity").agg(*aggs)
    joined = reference.select("entity").distinct().join(wide, "entity", "left")
    outs, present = [], F.lit(0)
    for c in channels:
        q = lambda n: F.col(f"`{n}_{c}`")
        outs += [
            q("ic50_uM").alias(f"ic50_uM_{c}"),
            F.coalesce(q("source"), F.lit("missing")).alias(f"source_{c}"),
            F.coalesce(q("n_records"), F.lit(0).cast("bigint")).alias(f"n_records_{c}"),
            F.coalesce(q("is_strict"), F.lit(False)).alias(f"is_strict_{c}"),
        ]
        present = present + F.when(q("ic50_uM").isNotNull(), 1).otherwise(0)
    absent = [F.when(F.col(f"`ic50_uM_{c}`").isNull(), F.lit(c)) for c in channels]
    return joined.select("entity", *outs, present.alias("n_channels_present"),
                         (F.lit(len(channels)) - present).alias("n_channels_missing"),
                         F.concat_ws("|", *absent).alias("missing_channels_list"))


def evidence_share(wide: DataFrame, prefix: str = "ic50_uM_") -> DataFrame:
    """Add ``channels_present`` (joined by ``|``) and ``mech_missing_frac`` over the value columns."""
    channels = [c[len(prefix):] for c in wide.columns if c.startswith(prefix)]
    if not channels:
        return wide.withColumns({"channels_present": F.lit(""), "mech_missing_frac": F.lit(1.0)})
    q = lambda c: F.col(f"`{prefix}{c}`")
    missing = F.lit(0)
    for c in channels:
        missing = missing + q(c).isNull().cast("int")
    return wide.withColumns({
        "channels_present": F.concat_ws("|", *[F.when(q(c).isNotNull(), F.lit(c)) for c in channels]),
        "mech_missing_frac": missing / F.lit(float(len(channels))),
    })


def wide_to_long(wide: DataFrame, channels: Sequence[str], prefix: str = "ic50_uM_",
                 extra: str | None = None) -> DataFrame:
    """(entity, channel, value[, extra]) for the required channels; an absent column is all null."""
    structs = []
    for c in channels:
        fields = [F.lit(c).alias("channel")]
        for name, p in [("value", prefix)] + ([(extra, extra + "_")] if extra else []):
            there = f"{p}{c}" in wide.columns
            kind = "double" if name == "value" else "string"
            fields.append((F.col(f"`{p}{c}`") if there else F.lit(None)).cast(kind).alias(name))
        structs.append(F.struct(*fields))
    return wide.select("entity", F.explode(F.array(*structs)).alias("s")).select("entity", "s.*")


def priority_violations(wide: DataFrame, cells: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Cells of a wide table whose source is not the one the priority rule gives."""
    chosen = wide_to_long(wide, channels, extra="source").select(
        "entity", "channel", F.col("source").alias("selected"))
    expected = select_cells(cells).select("entity", "channel", F.col("source").alias("expected"))
    joined = chosen.join(expected, ["entity", "channel"], "left")
    joined = joined.withColumn("expected", F.coalesce("expected", F.lit("missing")))
    return joined.where(~F.col("selected").eqNullSafe(F.col("expected")))


def gap_fill(primary: DataFrame, secondary: DataFrame, reference: DataFrame, key: str,
             n_col: str, by: Sequence[str] = ()) -> DataFrame:
    """Primary rows plus secondary rows of reference keys the primary lacks and that have data.

    With ``by`` the primary must lack the key for these columns. Columns the secondary table does not have become null.
    """
    extra = (
        secondary.where(F.col(n_col) > 0)
        .join(reference.select(key).distinct(), key, "left_semi")
        .join(primary.select(key, *by).distinct(), [key, *by], "left_anti")
    )
    return primary.unionByName(extra, allowMissingColumns=True)


def gapfill_summary(wanted: DataFrame, resolved: DataFrame, activities: DataFrame, key: str,
                    catalogue_id: str, value: str, by: Sequence[str] = (), **sizing) -> DataFrame:
    """Statistics of the convertible values of every wanted entity; n = 0 where unresolved or empty.

    ``by`` names further key columns of ``wanted`` and ``activities``.
    """
    stats = value_summary(activities.where(F.col(value).isNotNull()), [catalogue_id, *by], value, **sizing)
    joined = wanted.select(key, *by).distinct().join(resolved.select(key, catalogue_id), key, "left")
    return joined.join(stats, [catalogue_id, *by], "left").fillna({"n": 0}).select(
        key, *by, catalogue_id, "n", "mean", "std", "median", "iqr", "min", "max")


def source_set(df: DataFrame, entity: str, source: str, ranks: Mapping[str, int], sep: str = "+") -> DataFrame:
    """Sources of each entity joined in rank order."""
    aggs = F.concat_ws(sep, *[
        F.max(F.when(F.col(source) == s, F.lit(s))) for s in sorted(ranks, key=ranks.get)])
    return df.groupBy(entity).agg(aggs.alias("sources_present"))


def preferred_rows(df: DataFrame, entity: str, source: str, ranks: Mapping[str, int],
                   numeric: Sequence[str], counts: Mapping[str, str]) -> DataFrame:
    """Row of the best-ranked source per entity, the source set, and each source's counts (0 if absent).

    ``counts`` maps a count column to an output prefix. (entity, source) must be unique.
    """
    rank = F.lit(99)
    for s, r in ranks.items():
        rank = F.when(F.col(source) == s, F.lit(r)).otherwise(rank)
    ordered = sorted(ranks, key=ranks.get)
    best = F.min_by(F.struct(*numeric), F.struct(rank, F.col(source)))
    per_source = [
        F.coalesce(F.max(F.when(F.col(source) == s, F.col(c))), F.lit(0)).alias(f"{p}_{s}")
        for c, p in counts.items() for s in ordered
    ]
    sources = F.concat_ws("+", *[F.max(F.when(F.col(source) == s, F.lit(s))) for s in ordered])
    out = df.groupBy(entity).agg(sources.alias("sources_present"), best.alias("_b"), *per_source)
    rest = [c for c in out.columns if c not in (entity, "sources_present", "_b")]
    return out.select(entity, "sources_present", "_b.*", *rest)


def majority_label(df: DataFrame, entity: str, label: str, ranks: Mapping[str, int]) -> DataFrame:
    """Most frequent label per entity, the higher-ranked one on ties, with the row count and whether
    the entity has more than one label."""
    rank = F.lit(-1)
    for x, r in ranks.items():
        rank = F.when(F.col(label) == x, F.lit(r)).otherwise(rank)
    counts = df.where(F.col(label).isNotNull()).groupBy(entity, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(entity).agg(
        F.max_by(label, F.struct(F.col("n"), rank, F.col(label))).alias("label"),
        F.sum("n").alias("n_rows"), (F.count(F.lit(1)) > 1).alias("has_conflict"))


def label_conflicts(df: DataFrame, entity: str, label: str) -> DataFrame:
    """Label counts of the entities that carry more than one label, one row per (entity, label)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(entity, label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(entity)
    return counts.withColumn("_k", F.count(F.lit(1)).over(w)).where(F.col("_k") > 1).drop("_k")


def expand_targets(facts: DataFrame, panel: Mapping[str, Sequence[str]], target: str = "target") -> DataFrame:
    """Give each fact every channel its target feeds. One target may feed two channels and one channel
    may sum two targets, so facts are repeated on purpose."""
    channel_of: dict[str, list[str]] = {}
    for channel, targets in panel.items():
        for x in targets:
            channel_of.setdefault(x, []).append(channel)
    out = F.array().cast("array<string>")
    for x, channels in channel_of.items():
        out = F.when(F.col(target) == x, F.array(*[F.lit(c) for c in channels])).otherwise(out)
    return facts.withColumn("panel_channel", F.explode(out))


def target_map(facts: DataFrame, channel: str = "panel_channel", target: str = "target") -> DataFrame:
    """Targets seen per channel (a small fixed vocabulary)."""
    pairs = facts.select(channel, target).distinct()
    return pairs.groupBy(channel).agg(
        F.array_join(F.sort_array(F.collect_set(target)), "|").alias("targets"))


def align_sources(df: DataFrame, key: str, source: str, sources: Sequence[str], count: str) -> DataFrame:
    """One count column per source, 0 where a key lacks the source (an outer alignment in one pass)."""
    return df.groupBy(key).agg(*[
        F.coalesce(F.sum(F.when(F.col(source) == s, F.col(count))), F.lit(0)).cast("bigint").alias(f"{count}_{s}")
        for s in sources])
