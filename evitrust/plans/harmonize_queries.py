"""Measurement cleaning, entity and cell summaries, source selection, coverage and concordance."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from evitrust.functions import columns as C
from evitrust.operators import concordance, coverage, harmonize, metrics
from evitrust.plans.fixtures import CHANNELS, LABELS, MEASUREMENTS, PREDICTIONS, REFERENCE_ENTITIES, SOURCES
from evitrust.plans.registry import Tables, query
from evitrust.plans.trust_queries import predictions, rounded, sizing


def measurements(t: Tables) -> DataFrame:
    return t.sql(MEASUREMENTS)


def reference(t: Tables) -> DataFrame:
    return t.sql(REFERENCE_ENTITIES)


def converted(t: Tables) -> DataFrame:
    return C.convert_activities(measurements(t))


M_CTE = f"""m AS ({MEASUREMENTS}), ref AS ({REFERENCE_ENTITIES}),
 conv AS (SELECT *, CASE lower(units) WHEN 'nm' THEN standard_value/1000.0e0 WHEN 'um' THEN standard_value END AS value_um FROM m)"""
CELL_CTE = M_CTE + """,
 cells AS (SELECT entity, channel, source, prio, median(value_um) AS value, count(*) AS n_records,
   bool_and(standard_type='IC50' AND relation='=') AS is_strict FROM conv GROUP BY 1,2,3,4),
 sel AS (SELECT entity, channel, value, source, n_records, is_strict FROM (SELECT *,
   row_number() OVER (PARTITION BY entity, channel ORDER BY prio) AS rn FROM cells) WHERE rn=1),
 chans AS (SELECT 'ch'||CAST(i AS VARCHAR) AS channel, i FROM range(1,8) r(i)),
 grid AS (SELECT r.entity, c.channel, c.i, s.value, coalesce(s.source,'missing') AS source,
   coalesce(s.n_records,0) AS n_records, coalesce(s.is_strict,false) AS is_strict
   FROM (SELECT DISTINCT entity FROM ref) r CROSS JOIN chans c
   LEFT JOIN sel s ON s.entity=r.entity AND s.channel=c.channel)"""


def cells(t: Tables) -> DataFrame:
    return harmonize.cells_by_source(converted(t), "value_um", C.is_strict(), **sizing(t, "lineitem"))


# --- columns --------------------------------------------------------------------------------

@query("rename_and_project", """SELECT l_partkey AS entity, l_quantity AS conc, l_returnflag AS relation FROM {lineitem}""")
def rename_and_project(t):
    return C.project(t.lineitem, {"l_partkey": "entity", "l_quantity": "conc", "l_returnflag": "relation"},
                     ["entity", "conc", "relation"])


@query("standardize_strings", """SELECT p_partkey, trim('  '||p_name||' ') AS name, upper(trim(' '||p_type||' ')) AS kind FROM {part}""")
def standardize_strings(t):
    pad = t.part.select("p_partkey", F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("n"),
                        F.concat(F.lit(" "), "p_type", F.lit(" ")).alias("k"))
    return pad.select("p_partkey", C.standardized(F.col("n")).alias("name"),
                      C.standardized(F.col("k"), upper=True).alias("kind"))


BAD_TEXT = """CASE WHEN event_id % 17 = 0 THEN 'n/a' WHEN event_id % 19 = 0 THEN 'nan' WHEN event_id % 23 = 0 THEN ' 3.0 '
 WHEN event_id % 29 = 0 THEN '2.5' ELSE CAST(event_id AS VARCHAR(20)) END"""


@query("tolerant_casts", f"""SELECT event_id, x AS as_double, CASE WHEN x=floor(x) THEN CAST(x AS BIGINT) END AS as_long FROM (
 SELECT event_id, CASE WHEN isnan(TRY_CAST(trim(s) AS DOUBLE)) THEN NULL ELSE TRY_CAST(trim(s) AS DOUBLE) END AS x
 FROM (SELECT event_id, {BAD_TEXT} AS s FROM {{events}}))""")
def tolerant_casts(t):
    df = t.sql(f"SELECT event_id, {BAD_TEXT} AS s FROM {{events}}")
    return df.select("event_id", C.to_double(F.col("s")).alias("as_double"), C.to_long(F.col("s")).alias("as_long"))


@query("drop_null_targets", """SELECT o_orderkey, risk FROM (SELECT o_orderkey, CASE WHEN o_orderkey%7<>0 THEN o_orderstatus END AS risk
 FROM {orders}) WHERE risk IS NOT NULL""")
def drop_null_targets(t):
    return t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("risk")
                           ).dropna(subset=["risk"])


STATUS_CODES = {"=": "exact", "<": "left", ">": "right"}


@query("code_mapping", f"""WITH m AS ({MEASUREMENTS}) SELECT relation, source, CASE relation WHEN '=' THEN 'exact' WHEN '<' THEN 'left'
 WHEN '>' THEN 'right' END AS mapped, CASE source WHEN 'src_a' THEN 'alpha' ELSE source END AS source_mapped, count(*) AS n FROM m GROUP BY ALL""")
def code_mapping(t):
    m = measurements(t).groupBy("relation", "source").agg(F.count(F.lit(1)).alias("n"))
    return m.select("relation", "source", C.map_code(F.col("relation"), STATUS_CODES).alias("mapped"),
                    C.map_code(F.col("source"), {"src_a": "alpha"}).alias("source_mapped"), "n")


@query("ordered_pattern_mapping", """SELECT p_partkey, CASE WHEN starts_with(p_name,'red w') THEN 'A' WHEN starts_with(p_name,'red') THEN 'B'
 WHEN starts_with(p_name,'blue') THEN 'C' END AS by_prefix, CASE WHEN regexp_matches(p_name,'bolt|ring') THEN 'hardware'
 WHEN regexp_matches(p_name,'^red') THEN 'red' WHEN regexp_matches(p_name,'widget') THEN 'widget' END AS by_pattern FROM {part}""")
def ordered_pattern_mapping(t):
    return t.part.select(
        "p_partkey",
        C.map_by_prefix(F.col("p_name"), {"Red": "B", "red w": "A", "blue": "C"}).alias("by_prefix"),
        C.map_by_patterns(F.col("p_name"), [("BOLT|ring", "hardware"), ("^red", "red"), ("widget", "widget")]
                          ).alias("by_pattern"))


@query("unit_conversion", f"""WITH m AS ({MEASUREMENTS}), u AS (SELECT entity, channel, standard_value AS v,
  CASE entity%6 WHEN 0 THEN units WHEN 1 THEN ' mM' WHEN 2 THEN 'pM' WHEN 3 THEN 'µM' WHEN 4 THEN 'Nanomolar' ELSE 'mg/L' END AS unit FROM m)
 SELECT entity, channel, unit, round(sum(CASE lower(trim(unit)) WHEN 'nm' THEN v/1000e0 WHEN 'um' THEN v WHEN 'µm' THEN v WHEN 'mm' THEN v*1000e0
  WHEN 'pm' THEN v/1e6 WHEN 'nanomolar' THEN v/1000e0 END),6) AS total_um FROM u GROUP BY ALL""")
def unit_conversion(t):
    unit = F.element_at(F.array(F.col("units"), F.lit(" mM"), F.lit("pM"), F.lit("µM"), F.lit("Nanomolar"),
                                F.lit("mg/L")), (F.col("entity") % 6 + 1).cast("int"))
    df = measurements(t).withColumn("unit", unit)
    um = C.to_micromolar(F.col("standard_value"), F.col("unit"))
    return rounded(df.groupBy("entity", "channel", "unit").agg(F.sum(um).alias("total_um")), "total_um", digits=6)


@query("provenance_and_flags", f"""WITH m AS ({MEASUREMENTS}) SELECT entity, channel, 1 AS n_measurements, 'panel' AS origin,
  standard_type='IC50' AND relation='=' AS is_strict_row, standard_value FROM m""")
def provenance_and_flags(t):
    df = C.provenance(measurements(t), n_measurements=1, origin="panel")
    return df.withColumn("is_strict_row", C.is_strict()).select(
        "entity", "channel", "n_measurements", "origin", "is_strict_row", "standard_value")


@query("strict_and_relaxed_filters", f"""WITH {M_CTE} SELECT source, channel, count(*) FILTER (standard_type='IC50' AND relation='=') AS n_strict,
 count(*) AS n_relaxed, round(sum(value_um),6) AS total_um FROM conv WHERE standard_type IN ('IC50','Ki') AND relation IN ('=','<','>') GROUP BY 1,2""")
def strict_and_relaxed(t):
    df = C.relaxed_rows(measurements(t))
    out = df.groupBy("source", "channel").agg(
        F.count_if("is_strict_row").alias("n_strict"), F.count(F.lit(1)).alias("n_relaxed"),
        F.round(F.sum("value_um"), 6).alias("total_um"))
    return out


@query("fallback_and_imputed_flag", """SELECT o_orderkey, coalesce(CASE WHEN o_orderkey%3=0 THEN NULL ELSE o_totalprice END,
 CASE WHEN o_orderkey%6=0 THEN NULL ELSE 1.5e0 END, 1e0) AS value, CAST(o_orderkey%6=0 AS INT) AS imputed FROM {orders}""")
def fallback_and_imputed(t):
    k = F.col("o_orderkey")
    df = t.orders.select(k, F.when(k % 3 != 0, F.col("o_totalprice")).alias("median"),
                         F.when(k % 6 != 0, F.lit(1.5)).alias("mean"))
    both = C.first_present(F.col("median"), F.col("mean"))
    return df.select("o_orderkey", F.coalesce(both, F.lit(1.0)).alias("value"), C.imputed_flag(both).alias("imputed"))


# --- summaries ------------------------------------------------------------------------------

@query("entity_summary", f"""WITH {M_CTE}, md AS (SELECT entity, source FROM (SELECT entity, source, row_number() OVER (PARTITION BY entity
   ORDER BY count(*) DESC, source) AS rn FROM conv GROUP BY entity, source) WHERE rn=1)
 SELECT c.entity, md.source, count(DISTINCT c.prio) AS labs_n, count(value_um) AS ic50_count, round(avg(value_um),6) AS ic50_mean,
 round(stddev_samp(value_um),6) AS ic50_std, round(median(value_um),6) AS ic50_median, round(min(value_um),6) AS ic50_min,
 round(max(value_um),6) AS ic50_max FROM conv c JOIN md ON c.entity=md.entity GROUP BY 1,2""")
def entity_summary(t):
    out = harmonize.entity_summary(converted(t), "entity", ["source"], {"value_um": "ic50"}, "prio",
                                   **sizing(t, "lineitem"))
    return rounded(out, *[c for c in out.columns if c.startswith("ic50") and c != "ic50_count"], digits=6)


@query("value_summary", f"""WITH {M_CTE} SELECT entity, channel, count(value_um) AS n, round(avg(value_um),6) AS mean,
 round(coalesce(stddev_samp(value_um),0),6) AS std, round(median(value_um),6) AS median,
 round(quantile_cont(value_um,0.75)-quantile_cont(value_um,0.25),6) AS iqr, round(min(value_um),6) AS min, round(max(value_um),6) AS max
 FROM conv GROUP BY 1,2""")
def value_summary(t):
    out = harmonize.value_summary(converted(t), ["entity", "channel"], "value_um", **sizing(t, "lineitem"))
    return rounded(out, "mean", "std", "median", "iqr", "min", "max", digits=6)


@query("source_cell_medians", f"""WITH {CELL_CTE} SELECT entity, channel, source, prio, round(value,6) AS value, n_records, is_strict FROM cells""")
def source_cell_medians(t):
    return rounded(cells(t), "value", digits=6)


@query("filtered_source_cells", f"""WITH {M_CTE} SELECT entity, channel, 'strict' AS source, 0 AS prio, round(median(value_um),6) AS value,
 count(*) AS n_records, true AS is_strict FROM conv WHERE standard_type='IC50' AND relation='=' GROUP BY 1,2
 UNION ALL SELECT entity, channel, 'relaxed', 1, round(median(value_um),6), count(*), false FROM conv
 WHERE standard_type='IC50' AND relation<>'=' GROUP BY 1,2""")
def filtered_source_cells(t):
    df, n = C.relaxed_rows(measurements(t)), sizing(t, "lineitem")
    strict = harmonize.source_cells(df, F.col("is_strict_row"), "value_um", "strict", 0, True, **n)
    relaxed = harmonize.source_cells(df, ~F.col("is_strict_row") & (F.upper("standard_type") == "IC50"),
                                     "value_um", "relaxed", 1, False, **n)
    return rounded(strict.unionByName(relaxed), "value", digits=6)


@query("category_profile", f"""WITH m AS (SELECT channel, CASE WHEN entity%9=0 THEN NULL ELSE standard_type END AS standard_type, relation, units FROM ({MEASUREMENTS}))
 SELECT channel, column_name, value, count(*) AS n FROM (SELECT channel, 'standard_type' AS column_name, coalesce(standard_type,'UNKNOWN') AS value FROM m
 UNION ALL SELECT channel, 'relation', coalesce(relation,'UNKNOWN') FROM m UNION ALL SELECT channel, 'units', coalesce(units,'UNKNOWN') FROM m) GROUP BY ALL""")
def category_profile(t):
    df = measurements(t).withColumn("standard_type", F.when(F.col("entity") % 9 != 0, F.col("standard_type")))
    return coverage.category_profile(df, "channel", ["standard_type", "relation", "units"])


@query("category_totals", f"""WITH m AS ({MEASUREMENTS}) SELECT channel, count(*) AS total, count(*) FILTER (standard_type='IC50' AND relation='=') AS strict_count
 FROM m GROUP BY 1""")
def category_totals(t):
    return coverage.category_totals(measurements(t), "channel", C.is_strict())


RANKS = {"F": 0, "O": 1, "P": 2}
RANK_SQL = "CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END"


@query("majority_label", f"""WITH c AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM {{orders}} GROUP BY 1,2)
 SELECT o_custkey, label, n_rows, has_conflict FROM (SELECT o_custkey, o_orderstatus AS label, CAST(sum(n) OVER w AS BIGINT) AS n_rows,
  count(*) OVER w > 1 AS has_conflict, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, {RANK_SQL} DESC) AS rn FROM c
  WINDOW w AS (PARTITION BY o_custkey)) WHERE rn=1""")
def majority_label(t):
    return harmonize.majority_label(t.orders, "o_custkey", "o_orderstatus", RANKS)


@query("label_conflicts", """WITH c AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM {orders} GROUP BY 1,2)
 SELECT * FROM c WHERE o_custkey IN (SELECT o_custkey FROM c GROUP BY 1 HAVING count(*)>1)""")
def label_conflicts(t):
    return harmonize.label_conflicts(t.orders, "o_custkey", "o_orderstatus")


SRC_RANKS = {s: i for i, s in enumerate(SOURCES)}


@query("ordered_source_set", f"""WITH m AS ({MEASUREMENTS}) SELECT entity, string_agg(source, '+' ORDER BY source) AS sources_present
 FROM (SELECT DISTINCT entity, source FROM m) GROUP BY 1""")
def ordered_source_set(t):
    return harmonize.source_set(measurements(t), "entity", "source", SRC_RANKS)


PREF_CTE = f"""WITH {M_CTE}, s AS (SELECT entity, source, prio, count(*) AS n, round(avg(value_um),6) AS mean FROM conv GROUP BY 1,2,3)"""


def entity_source(t: Tables) -> DataFrame:
    out = converted(t).groupBy("entity", "source").agg(F.count(F.lit(1)).alias("n"),
                                                      F.round(F.avg("value_um"), 6).alias("mean"))
    return out


@query("preferred_source_rows", f"""{PREF_CTE} SELECT entity, string_agg(source, '+' ORDER BY prio) AS sources_present, arg_min(mean, prio) AS mean,
 {', '.join(f"coalesce(max(n) FILTER (source='{s}'),0) AS n_{s}" for s in SOURCES)} FROM s GROUP BY entity""")
def preferred_source_rows(t):
    return harmonize.preferred_rows(entity_source(t), "entity", "source", SRC_RANKS, ["mean"], {"n": "n"})


@query("aligned_source_counts", f"""{PREF_CTE} SELECT entity, {', '.join(f"CAST(coalesce(sum(n) FILTER (source='{s}'),0) AS BIGINT) AS n_{s}" for s in SOURCES)}
 FROM s GROUP BY entity""")
def aligned_source_counts(t):
    return harmonize.align_sources(entity_source(t), "entity", "source", SOURCES, "n")


# --- selection and the wide table ------------------------------------------------------------

@query("source_priority_cascade", f"WITH {CELL_CTE} SELECT entity, channel, round(value,6) AS value, source, n_records, is_strict FROM grid")
def source_priority_cascade(t):
    return rounded(harmonize.selected_cells_of(cells(t), reference(t), CHANNELS), "value", digits=6)


@query("censored_cascade", f"""WITH {CELL_CTE} SELECT entity, channel, round(value,6) AS value, source, n_records,
 CASE WHEN source<>'missing' THEN CASE WHEN n_records%2=0 THEN '=' ELSE '>' END END AS relation FROM grid""")
def censored_cascade(t):
    """The relation of a cell (exact or beyond a limit) stays with it through the choice of the source."""
    marked = cells(t).withColumn("relation", F.when(F.col("n_records") % 2 == 0, "=").otherwise(">"))
    out = harmonize.selected_cells_of(marked, reference(t), CHANNELS)
    return rounded(out.select("entity", "channel", "value", "source", "n_records", "relation"), "value", digits=6)


WIDE_SELECT = ", ".join(
    f"""max(CASE WHEN channel='{c}' THEN round(value,6) END) AS "ic50_uM_{c}", max(CASE WHEN channel='{c}' THEN source END) AS "source_{c}",
 max(CASE WHEN channel='{c}' THEN n_records END) AS "n_records_{c}", bool_or(channel='{c}' AND is_strict) AS "is_strict_{c}" """
    for c in CHANNELS)
WIDE_CTE = f"""wide AS (SELECT entity, {WIDE_SELECT}, CAST(count(value) AS INT) AS n_channels_present, CAST(7-count(value) AS INT) AS n_channels_missing,
  coalesce(string_agg(CASE WHEN value IS NULL THEN channel END, '|' ORDER BY i),'') AS missing_channels_list FROM grid GROUP BY entity)"""


def wide(t: Tables) -> DataFrame:
    return harmonize.wide_features(cells(t), reference(t), CHANNELS)


@query("wide_feature_table", f"WITH {CELL_CTE}, {WIDE_CTE} SELECT * FROM wide")
def wide_feature_table(t):
    return rounded(wide(t), *[f"ic50_uM_{c}" for c in CHANNELS], digits=6)


@query("evidence_share", f"""WITH {CELL_CTE} SELECT entity, coalesce(string_agg(CASE WHEN value IS NOT NULL THEN channel END, '|' ORDER BY i),'') AS channels_present,
 round((7-count(value))/7e0,8) AS mech_missing_frac FROM grid GROUP BY entity""")
def evidence_share(t):
    return rounded(harmonize.evidence_share(wide(t)).select("entity", "channels_present", "mech_missing_frac"),
                   "mech_missing_frac")


@query("wide_to_long", f"""WITH {CELL_CTE} SELECT entity, channel, round(value,6) AS value FROM grid
 UNION ALL SELECT DISTINCT entity, 'ch9', CAST(NULL AS DOUBLE) FROM grid""")
def wide_to_long(t):
    return rounded(harmonize.wide_to_long(wide(t), [*CHANNELS, "ch9"]), "value", digits=6)


@query("priority_rule_audit", f"""WITH {CELL_CTE} SELECT entity, channel, 'src_b' AS selected, source AS expected FROM grid
 WHERE channel='ch3' AND entity%4=0 AND source<>'src_b'""")
def priority_rule_audit(t):
    long_cells = cells(t).persist(StorageLevel.DISK_ONLY)  # read twice
    w = harmonize.wide_features(long_cells, reference(t), CHANNELS)
    tampered = w.withColumn("source_ch3", F.when(F.col("entity") % 4 == 0, "src_b").otherwise(F.col("source_ch3")))
    return harmonize.priority_violations(tampered, long_cells, CHANNELS)


@query("gap_fill", f"""WITH {M_CTE}, p AS (SELECT entity, avg(value_um) AS mean, count(*) AS n FROM conv WHERE source='src_a' AND channel='ch1' GROUP BY 1),
 s AS (SELECT entity, avg(value_um) AS mean, count(*) AS n FROM conv WHERE source<>'src_a' AND channel='ch1' GROUP BY 1)
 SELECT entity, round(mean,6) AS mean, n, 'primary' AS origin, true AS measured FROM p UNION ALL
 SELECT entity, round(mean,6), n, 'secondary', NULL FROM s WHERE entity IN (SELECT entity FROM ref) AND entity NOT IN (SELECT entity FROM p)""")
def gap_fill(t):
    one = converted(t).where("channel = 'ch1'")
    agg = lambda d, o: d.groupBy("entity").agg(F.round(F.avg("value_um"), 6).alias("mean"),
                                               F.count(F.lit(1)).alias("n")).withColumn("origin", F.lit(o))
    first = agg(one.where("source = 'src_a'"), "primary").withColumn("measured", F.lit(True))
    return harmonize.gap_fill(first, agg(one.where("source <> 'src_a'"), "secondary"), reference(t), "entity", "n")


@query("gapfill_summary", f"""WITH {M_CTE}, cat AS (SELECT p_partkey AS entity, p_partkey*10 AS catalogue_id FROM {{part}} WHERE p_partkey%5<>0),
 act AS (SELECT entity*10 AS catalogue_id, value_um FROM conv WHERE channel='ch2' AND standard_type='IC50' AND relation='=')
 SELECT r.entity, c.catalogue_id, count(value_um) AS n, round(avg(value_um),6) AS mean,
 round(CASE WHEN count(value_um)=1 THEN 0 ELSE stddev_samp(value_um) END,6) AS std, round(median(value_um),6) AS median,
 round(quantile_cont(value_um,0.75)-quantile_cont(value_um,0.25),6) AS iqr, round(min(value_um),6) AS min, round(max(value_um),6) AS max
 FROM ref r LEFT JOIN cat c ON r.entity=c.entity LEFT JOIN act a ON a.catalogue_id=c.catalogue_id GROUP BY 1,2""")
def gapfill_summary(t):
    resolved = t.part.where("p_partkey % 5 <> 0").select(
        F.col("p_partkey").alias("entity"), (F.col("p_partkey") * 10).alias("catalogue_id"))
    act = C.strict_rows(measurements(t)).where("channel = 'ch2'").select(
        (F.col("entity") * 10).alias("catalogue_id"), "value_um")
    out = harmonize.gapfill_summary(reference(t), resolved, act, "entity", "catalogue_id", "value_um",
                                    **sizing(t, "lineitem"))
    return rounded(out, "mean", "std", "median", "iqr", "min", "max", digits=6)


CHANNEL_CTE = "ch AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}')" for c in CHANNELS) + ") AS v(channel))"


@query("gap_fill_channels", f"""WITH {M_CTE}, p AS (SELECT entity, channel, avg(value_um) AS mean, count(*) AS n FROM conv WHERE source='src_a' GROUP BY 1,2),
 s AS (SELECT entity, channel, avg(value_um) AS mean, count(*) AS n FROM conv WHERE source<>'src_a' GROUP BY 1,2)
 SELECT entity, channel, round(mean,6) AS mean, n, 'primary' AS origin, true AS measured FROM p UNION ALL
 SELECT entity, channel, round(mean,6), n, 'secondary', NULL FROM s WHERE entity IN (SELECT entity FROM ref)
 AND NOT EXISTS (SELECT 1 FROM p WHERE p.entity=s.entity AND p.channel=s.channel)""")
def gap_fill_channels(t):
    """gap_fill for each channel."""
    rows = converted(t)
    agg = lambda d, o: d.groupBy("entity", "channel").agg(F.round(F.avg("value_um"), 6).alias("mean"),
                                                          F.count(F.lit(1)).alias("n")).withColumn("origin", F.lit(o))
    first = agg(rows.where("source = 'src_a'"), "primary").withColumn("measured", F.lit(True))
    return harmonize.gap_fill(first, agg(rows.where("source <> 'src_a'"), "secondary"), reference(t), "entity", "n",
                              by=["channel"])


@query("gapfill_summary_channels", f"""WITH {M_CTE}, {CHANNEL_CTE}, cat AS (SELECT p_partkey AS entity, p_partkey*10 AS catalogue_id FROM {{part}} WHERE p_partkey%5<>0),
 act AS (SELECT entity*10 AS catalogue_id, channel, value_um FROM conv WHERE standard_type='IC50' AND relation='=')
 SELECT r.entity, ch.channel, c.catalogue_id, count(value_um) AS n, round(avg(value_um),6) AS mean,
 round(CASE WHEN count(value_um)=1 THEN 0 ELSE stddev_samp(value_um) END,6) AS std, round(median(value_um),6) AS median,
 round(quantile_cont(value_um,0.75)-quantile_cont(value_um,0.25),6) AS iqr, round(min(value_um),6) AS min, round(max(value_um),6) AS max
 FROM ref r CROSS JOIN ch LEFT JOIN cat c ON r.entity=c.entity LEFT JOIN act a ON a.catalogue_id=c.catalogue_id AND a.channel=ch.channel GROUP BY 1,2,3""")
def gapfill_summary_channels(t):
    """gapfill_summary for each channel of the reference."""
    resolved = t.part.where("p_partkey % 5 <> 0").select(
        F.col("p_partkey").alias("entity"), (F.col("p_partkey") * 10).alias("catalogue_id"))
    act = C.strict_rows(measurements(t)).select((F.col("entity") * 10).alias("catalogue_id"), "channel", "value_um")
    wanted = reference(t).select("entity", F.explode(F.array(*map(F.lit, CHANNELS))).alias("channel"))
    out = harmonize.gapfill_summary(wanted, resolved, act, "entity", "catalogue_id", "value_um", by=["channel"],
                                    **sizing(t, "lineitem"))
    return rounded(out, "mean", "std", "median", "iqr", "min", "max", digits=6)


@query("feature_join", f"""WITH {CELL_CTE}, {WIDE_CTE} SELECT l_orderkey, l_partkey, n_channels_present, round("ic50_uM_ch1",6) AS ic50_ch1
 FROM {{lineitem}} LEFT JOIN wide ON l_partkey=entity""")
def feature_join(t):
    f = wide(t).select(F.col("entity").alias("l_partkey"), "n_channels_present",
                       F.round("ic50_uM_ch1", 6).alias("ic50_ch1"))
    return t.lineitem.select("l_orderkey", "l_partkey").join(f, "l_partkey", "left")


@query("semi_join_membership", f"""SELECT l_orderkey, l_partkey FROM {{lineitem}} WHERE l_partkey IN ({REFERENCE_ENTITIES})""")
def semi_join_membership(t):
    return t.lineitem.select("l_orderkey", "l_partkey").join(
        reference(t).withColumnRenamed("entity", "l_partkey"), "l_partkey", "left_semi")


PANEL = {"peak": ["src_a"], "late": ["src_a"], "slow": ["src_b", "src_c"], "fast": ["src_d"], "none": ["src_x"]}


@query("panel_target_expansion", f"""WITH {M_CTE}, p(panel_channel, source) AS (VALUES ('peak','src_a'),('late','src_a'),('slow','src_b'),('slow','src_c'),('fast','src_d'),('none','src_x'))
 SELECT panel_channel, entity, count(*) AS n, round(sum(value_um),6) AS total_um FROM conv JOIN p ON conv.source=p.source GROUP BY 1,2""")
def panel_target_expansion(t):
    rows = harmonize.expand_targets(converted(t), PANEL, "source")
    return rows.groupBy("panel_channel", "entity").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value_um"), 6).alias("total_um"))


@query("panel_target_map", f"""WITH m AS ({MEASUREMENTS}), p(panel_channel, source) AS (VALUES ('peak','src_a'),('late','src_a'),('slow','src_b'),('slow','src_c'),('fast','src_d'))
 SELECT panel_channel, string_agg(source,'|' ORDER BY source) AS targets FROM (SELECT DISTINCT p.panel_channel, p.source FROM m JOIN p ON m.source=p.source) GROUP BY 1""")
def panel_target_map(t):
    return harmonize.target_map(harmonize.expand_targets(measurements(t), PANEL, "source"), target="source")


@query("union_of_frames", """SELECT o_orderkey AS k, o_totalprice AS v FROM {orders} UNION ALL SELECT l_orderkey, l_extendedprice FROM {lineitem}""")
def union_of_frames(t):
    a = t.orders.select(F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("k"))
    return a.unionByName(t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_extendedprice").alias("v")))


# --- coverage -------------------------------------------------------------------------------

STRICT_CTE = M_CTE + """, pres AS (SELECT entity, channel, source FROM conv WHERE standard_type='IC50' AND relation='='),
 chans AS (SELECT 'ch'||CAST(i AS VARCHAR) AS channel FROM range(1,9) r(i))"""
CHANNELS8 = [*CHANNELS, "ch8"]


def strict_presence(t: Tables) -> DataFrame:
    return C.strict_rows(measurements(t)).select("entity", "channel", "source")


@query("channel_coverage", f"""WITH {STRICT_CTE}, d AS (SELECT DISTINCT entity, channel FROM pres)
 SELECT c.channel, (SELECT count(DISTINCT entity) FROM ref) AS reference_count,
 count(r.entity) AS covered, (SELECT count(DISTINCT entity) FROM ref)-count(r.entity) AS missing, count(d.entity)-count(r.entity) AS extra,
 (SELECT count(*) FROM pres p WHERE p.channel=c.channel) AS activity_count, round(count(r.entity)/CAST((SELECT count(DISTINCT entity) FROM ref) AS DOUBLE),8) AS rate
 FROM chans c LEFT JOIN d ON d.channel=c.channel LEFT JOIN ref r ON r.entity=d.entity GROUP BY c.channel""")
def channel_coverage(t):
    return rounded(coverage.channel_coverage(strict_presence(t), reference(t), CHANNELS8), "rate")


@query("missing_entities", f"""WITH {STRICT_CTE} SELECT r.entity, c.channel FROM ref r CROSS JOIN chans c
 WHERE NOT EXISTS (SELECT 1 FROM pres p WHERE p.entity=r.entity AND p.channel=c.channel)""")
def missing_entities(t):
    return coverage.missing_entities(strict_presence(t), reference(t), CHANNELS8).select("entity", "channel")


@query("extra_entities", f"""WITH {STRICT_CTE} SELECT DISTINCT channel, entity FROM pres WHERE entity NOT IN (SELECT entity FROM ref)""")
def extra_entities(t):
    return coverage.extra_entities(strict_presence(t), reference(t))


@query("any_all_channel_coverage", f"""WITH {STRICT_CTE}, k AS (SELECT entity, count(DISTINCT channel) AS k FROM pres WHERE entity IN (SELECT entity FROM ref) GROUP BY 1)
 SELECT count(*) AS covered_any, count(*) FILTER (k=7) AS covered_all, (SELECT count(DISTINCT entity) FROM ref) AS reference_count FROM k""")
def any_all(t):
    return coverage.any_all_coverage(strict_presence(t), reference(t), CHANNELS)


@query("alias_group_coverage", f"""WITH {CELL_CTE}, g AS (SELECT channel, entity%50 AS a, max(CASE WHEN value IS NOT NULL THEN 1 ELSE 0 END) AS h FROM grid
 WHERE source IN ('src_a','missing') GROUP BY 1,2) SELECT channel, CAST(sum(h) AS BIGINT) AS present, CAST(sum(1-h) AS BIGINT) AS missing FROM g GROUP BY 1""")
def alias_group_coverage(t):
    grid = harmonize.selected_cells_of(cells(t), reference(t), CHANNELS).where("source IN ('src_a', 'missing')")
    return coverage.alias_coverage(grid, F.col("entity") % 50)


@query("selected_source_counts", f"WITH {CELL_CTE} SELECT channel, source, count(*) AS n FROM grid GROUP BY 1,2")
def selected_source_counts(t):
    return coverage.source_counts(harmonize.selected_cells_of(cells(t), reference(t), CHANNELS))


@query("candidate_source_ranking", f"""WITH {STRICT_CTE}, c AS (SELECT source AS source_id, channel, count(DISTINCT p.entity) AS n FROM pres p
  WHERE entity IN (SELECT entity FROM ref) GROUP BY 1,2)
 SELECT source_id, {', '.join(f"coalesce(max(n) FILTER (channel='{c}'),0) AS covered_{c}" for c in CHANNELS)}, CAST(sum(n) AS BIGINT) AS covered_cells,
 count(*) FILTER (n>0) AS channels_with_data FROM c GROUP BY 1""")
def candidate_source_ranking(t):
    return coverage.coverage_ranking(strict_presence(t).withColumnRenamed("source", "source_id"), reference(t), CHANNELS)


@query("distinct_entities_per_channel", f"""WITH {STRICT_CTE} SELECT c.channel, count(DISTINCT p.entity) AS n_all, count(DISTINCT r.entity) AS n_overlap
 FROM chans c LEFT JOIN pres p ON p.channel=c.channel LEFT JOIN ref r ON r.entity=p.entity GROUP BY 1""")
def distinct_entities_per_channel(t):
    return coverage.distinct_entities(strict_presence(t), reference(t), CHANNELS8)


@query("missing_rates", f"""WITH {CELL_CTE}, {WIDE_CTE}, j AS (SELECT wide.* FROM {{lineitem}} LEFT JOIN wide ON l_partkey=entity)
 """ + " UNION ALL ".join(f"""SELECT 'ic50_uM_{c}' AS column_name, round(avg(CASE WHEN "ic50_uM_{c}" IS NULL THEN 1e0 ELSE 0e0 END),8) AS missing_rate FROM j"""
                          for c in CHANNELS))
def missing_rates(t):
    f = wide(t).withColumnRenamed("entity", "l_partkey")
    joined = t.lineitem.select("l_partkey").join(f, "l_partkey", "left")
    return rounded(coverage.missing_rates(joined, [f"ic50_uM_{c}" for c in CHANNELS]), "missing_rate")


def _profile_sql(table: str, column: str, text: str) -> str:
    return f"""SELECT min({column}) AS min, max({column}) AS max, count(DISTINCT {column}) AS n_distinct,
 (SELECT string_agg({text},'|' ORDER BY q) FROM (SELECT DISTINCT {column} AS q FROM {{{table}}} WHERE {column} IS NOT NULL ORDER BY 1 LIMIT 10)) AS first_values FROM {{{table}}}"""


def _profile(df: DataFrame, column: str, kind: str = "string") -> DataFrame:
    """The values as one text, so both engines can be compared."""
    as_text = F.array_join(F.transform("first_values", lambda v: v.cast(kind).cast("string")), "|")
    return coverage.column_profile(df, column).withColumn("first_values", as_text)


@query("column_profile", _profile_sql("lineitem", "l_quantity", "CAST(CAST(q AS BIGINT) AS VARCHAR)"))
def column_profile(t):
    return _profile(t.lineitem, "l_quantity", "bigint")


@query("column_profile_of_fractions", _profile_sql("lineitem", "l_discount", "CAST(CAST(q AS DECIMAL(8,4)) AS VARCHAR)"))
def column_profile_of_fractions(t):
    return _profile(t.lineitem, "l_discount", "decimal(8,4)")


@query("column_profile_of_text", _profile_sql("orders", "o_orderpriority", "q"))
def column_profile_of_text(t):
    return _profile(t.orders, "o_orderpriority")


# --- concordance ----------------------------------------------------------------------------

PAIRS = [("src_a", "src_b"), ("src_a", "src_c"), ("src_b", "src_e"), ("src_d", "src_x")]
PAIR_CTE = CELL_CTE + """, pr AS (SELECT 'src_a_vs_src_b' AS comparison,'src_a' AS a,'src_b' AS b UNION ALL SELECT 'src_a_vs_src_c','src_a','src_c'
   UNION ALL SELECT 'src_b_vs_src_e','src_b','src_e' UNION ALL SELECT 'src_d_vs_src_x','src_d','src_x'),
 paired AS (SELECT comparison, x.entity, x.channel, x.value AS l, y.value AS r, greatest(x.value,y.value)/least(x.value,y.value) AS fd,
   abs(log10(x.value/y.value)) AS lr FROM pr JOIN cells x ON x.source=pr.a JOIN cells y ON y.source=pr.b AND y.entity=x.entity AND y.channel=x.channel
   WHERE x.value>0 AND y.value>0)"""


def paired(t: Tables) -> DataFrame:
    return concordance.source_pairs(cells(t), PAIRS).persist(StorageLevel.DISK_ONLY)  # read several times


@query("fold_difference_concordance", f"""WITH {PAIR_CTE} SELECT pr.comparison, count(fd) AS n_pairs, round(median(fd),6) AS median_fold_diff, round(avg(fd),6) AS mean_fold_diff,
 round(max(fd),6) AS max_fold_diff FROM pr LEFT JOIN paired ON pr.comparison=paired.comparison GROUP BY 1""")
def fold_difference(t):
    out = concordance.fold_concordance(paired(t), PAIRS, **sizing(t, "lineitem"))
    return rounded(out, "median_fold_diff", "mean_fold_diff", "max_fold_diff", digits=6)


@query("log_ratio_concordance", f"""WITH {PAIR_CTE}, rk AS (SELECT comparison, lr,
  rank() OVER (PARTITION BY comparison ORDER BY log10(l))+(count(*) OVER (PARTITION BY comparison, log10(l))-1)/2e0 AS a,
  rank() OVER (PARTITION BY comparison ORDER BY log10(r))+(count(*) OVER (PARTITION BY comparison, log10(r))-1)/2e0 AS b FROM paired)
 SELECT pr.comparison, count(lr) AS n_pairs, round(median(lr),7) AS median_abs_log10_ratio, round(avg(lr),7) AS mean_abs_log10_ratio,
 round(CASE WHEN count(lr)>=5 THEN corr(a,b) END,6) AS spearman_log10 FROM (SELECT comparison FROM pr) pr LEFT JOIN rk ON pr.comparison=rk.comparison GROUP BY 1""")
def log_ratio(t):
    out = concordance.log_concordance(paired(t), PAIRS, **sizing(t, "lineitem"))
    out = rounded(out, "median_abs_log10_ratio", "mean_abs_log10_ratio", digits=7)
    return rounded(out, "spearman_log10", digits=6)


@query("concordance_overlap_counts", f"""WITH {PAIR_CTE} SELECT pr.comparison, c.channel, count(p.l) AS n_pairs FROM pr CROSS JOIN chans c
 LEFT JOIN paired p ON p.comparison=pr.comparison AND p.channel=c.channel GROUP BY 1,2""")
def overlap_counts(t):
    return concordance.overlap_counts(paired(t), PAIRS, CHANNELS)


@query("top_mismatches", f"""WITH {PAIR_CTE} SELECT comparison, entity, channel, round(l,6) AS left_value, round(r,6) AS right_value, CAST(rank AS INT) AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY comparison ORDER BY fd DESC, entity, channel) AS rank FROM paired) WHERE rank<=10""")
def top_mismatches(t):
    out = concordance.top_mismatches(paired(t), "fold_diff")
    return rounded(out.select("comparison", "entity", "channel", "left_value", "right_value", "rank"),
                   "left_value", "right_value", digits=6)


@query("selected_vs_source_concordance", f"""WITH {CELL_CTE}, both_ AS (SELECT s.value AS l, c.value AS r FROM sel s JOIN cells c ON s.entity=c.entity AND s.channel=c.channel
  WHERE s.source IN ('src_a','src_b') AND c.source='src_d' AND s.value>0 AND c.value>0)
 SELECT 'selected_vs_src_d' AS comparison, count(*) AS n_pairs, round(median(greatest(l,r)/least(l,r)),6) AS median_fold_diff,
 round(avg(greatest(l,r)/least(l,r)),6) AS mean_fold_diff, round(max(greatest(l,r)/least(l,r)),6) AS max_fold_diff FROM both_""")
def selected_vs_source(t):
    long_cells = cells(t).persist(StorageLevel.DISK_ONLY)  # read twice
    chosen = harmonize.select_cells(long_cells).where("source IN ('src_a', 'src_b')").withColumn("source", F.lit("selected"))
    pool = chosen.select("entity", "channel", "source", "value").unionByName(
        long_cells.where("source = 'src_d'").select("entity", "channel", "source", "value"))
    pairs = [("selected", "src_d")]
    both = concordance.source_pairs(pool, pairs).persist(StorageLevel.DISK_ONLY)  # read several times
    out = concordance.fold_concordance(both, pairs, **sizing(t, "lineitem"))
    return rounded(out, "median_fold_diff", "mean_fold_diff", "max_fold_diff", digits=6)


# --- splits ---------------------------------------------------------------------------------

ROLE = "CASE WHEN fold = 0 THEN 'test' WHEN fold = 1 THEN 'calib' ELSE 'train' END"


@query("split_diagnostics", f"""WITH p AS (SELECT *, {ROLE} AS role FROM ({PREDICTIONS})) SELECT seed, role, count(*) AS n_rows, count(DISTINCT grp) AS n_groups,
 count(*) FILTER (y_true='F') AS "n_F", count(*) FILTER (y_true='O') AS "n_O", count(*) FILTER (y_true='P') AS "n_P", count(*) FILTER (y_true='Z') AS "n_Z", 'Z' AS missing_classes FROM p GROUP BY 1,2""")
def split_diagnostics(t):
    df = predictions(t).withColumn("role", F.expr(ROLE))
    return metrics.split_diagnostics(df, ["seed"], "role", "grp", "y_true", [*LABELS, "Z"])


@query("split_overlap", f"""WITH p AS (SELECT *, {ROLE} AS role FROM ({PREDICTIONS})), g AS (SELECT seed, grp, count(DISTINCT role) AS k FROM p GROUP BY 1,2)
 SELECT seed, count(*) AS n_groups, count(*) FILTER (k>1) AS n_overlap FROM g GROUP BY 1""")
def split_overlap(t):
    return metrics.split_overlap(predictions(t).withColumn("role", F.expr(ROLE)), ["seed"], "role", "grp")
