"""Name normalization, resolution, suggestions, set comparison and group-safe folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evitrust.functions import names as N
from evitrust.operators import coverage, folds, metrics, resolve
from evitrust.plans.fixtures import LABELS, PREDICTIONS
from evitrust.plans.registry import Tables, query
from evitrust.plans.trust_queries import predictions, rounded, sizing

RAW = """SELECT p_partkey, '  ' || upper(p_name) || ' ' || p_type || '-' || CASE WHEN p_size % 2 = 0 THEN 'HCl' ELSE 'x' END
 || CASE WHEN p_size % 5 = 0 THEN ' (Groß)' ELSE '' END || ' ' AS raw FROM {part}"""
RULES = N.NameRules(
    left_out=["hcl", "sodium", "x", "economy", "small", "medium", "large", "standard", "promo"],
    typos={"redwidget": "redgadget", "bluewidget": "bluegadget"},
    identities={"redgadget": "crimsongadget", "bluebolt": "azurebolt"},
    reasons={"redgadget": "trade name"},
)


def _case(col: str, mapping: dict) -> str:
    return "CASE " + " ".join(f"WHEN {col}='{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE {col} END"


WORDS = ",".join(f"'{w}'" for w in RULES.left_out)
NORM_CTE = f"""raw AS ({RAW}), low AS (SELECT p_partkey, trim(raw) AS raw, replace(lower(trim(raw)),'ß','ss') AS f FROM raw),
 toks AS (SELECT *, regexp_replace(f,'[^a-z0-9]+','','g') AS n0, regexp_split_to_array(f,'[^a-z0-9]+') AS tk FROM low),
 kept AS (SELECT *, coalesce((SELECT string_agg(u.w,'' ORDER BY u.o) FROM (SELECT unnest(tk) AS w, generate_subscripts(tk,1) AS o) u
    WHERE u.w<>'' AND u.w NOT IN ({WORDS})),'') AS p0 FROM toks),
 typo AS (SELECT p_partkey, raw, f, {_case('n0', RULES.typos)} AS n1, CASE WHEN p0='' THEN n0 ELSE p0 END AS p00 FROM kept),
 nrm AS (SELECT p_partkey, raw, f, n1, {_case('p00', RULES.typos)} AS p1 FROM typo)"""


def raw_names(t: Tables) -> DataFrame:
    return t.sql(RAW)


@query("normalize_names", f"WITH {NORM_CTE} SELECT p_partkey, raw AS name_raw, n1 AS name_normalized, p1 AS name_parent FROM nrm")
def normalize_names(t):
    out = N.normalize_names(raw_names(t), "raw", RULES)
    return out.select("p_partkey", "name_raw", "name_normalized", "name_parent")


@query("identity_aliases", f"""WITH {NORM_CTE} SELECT p_partkey, {_case('n1', RULES.identities)} AS name_normalized, {_case('p1', RULES.identities)} AS name_parent,
 p1 IN ('redgadget','bluebolt') OR n1 IN ('redgadget','bluebolt') AS name_alias_applied,
 CASE WHEN 'redgadget' IN (p1,n1) THEN 'redgadget -> crimsongadget (trade name)' WHEN 'bluebolt' IN (p1,n1) THEN 'bluebolt -> azurebolt' ELSE '' END AS reason FROM nrm""")
def identity_aliases(t):
    out = N.normalize_names(raw_names(t), "raw", RULES, identity_aliases=True)
    return out.select("p_partkey", "name_normalized", "name_parent", "name_alias_applied",
                      F.array_join("name_alias_reason", "; ").alias("reason"))


@query("name_transform_stats", f"""WITH {NORM_CTE}, d AS (SELECT DISTINCT r.raw, n.f, n1, p1 FROM raw r JOIN nrm n ON r.p_partkey=n.p_partkey),
 s AS (SELECT count(*) AS t, count(*) FILTER (raw<>replace(lower(raw),'ß','ss')) AS a, count(*) FILTER (regexp_matches(replace(lower(raw),'ß','ss'),'[^a-z0-9]')) AS b,
  count(*) FILTER (n1<>p1) AS c FROM d)
 SELECT 'casefold' AS transform, a AS count, round(a/CAST(t AS DOUBLE),8) AS rate FROM s UNION ALL SELECT 'punctuation_or_space_removed', b, round(b/CAST(t AS DOUBLE),8) FROM s
 UNION ALL SELECT 'salt_or_drop_stripped', c, round(c/CAST(t AS DOUBLE),8) FROM s""")
def name_transform_stats(t):
    return rounded(N.transform_stats(raw_names(t), "raw", RULES), "rate")


@query("reference_entity_set", f"WITH {NORM_CTE} SELECT DISTINCT {_case('p1', RULES.identities)} AS entity FROM nrm")
def reference_entity_set(t):
    key = N.identity_alias(N.parent_name(F.col("raw"), RULES), RULES)
    return coverage.reference_entities(raw_names(t), key)


CLOSE_CTE = f"""WITH {NORM_CTE}, q AS (SELECT DISTINCT n1 AS query FROM nrm WHERE n1<>''), c AS (SELECT DISTINCT replace(p_name,' ','') AS candidate FROM {{part}}),
 s AS (SELECT query, candidate, 1-levenshtein(query,candidate)/CAST(greatest(length(query),length(candidate)) AS DOUBLE) AS score FROM q, c)"""


def _close_inputs(t: Tables):
    q = raw_names(t).select(N.normalized_name(F.col("raw"), RULES).alias("query"))
    c = t.part.select(F.replace("p_name", F.lit(" "), F.lit("")).alias("candidate"))
    return q, c


@query("closest_names", f"""{CLOSE_CTE} SELECT query, candidate, round(score,8) AS score, CAST(rank AS INT) AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, candidate) AS rank FROM s) WHERE rank<=5""")
def closest_names(t):
    q, c = _close_inputs(t)
    return rounded(resolve.closest_names(q, "query", c, "candidate", k=5, cutoff=0.0), "score")


@query("closest_names_with_cutoff", f"""{CLOSE_CTE} SELECT query, candidate, round(score,8) AS score, CAST(rank AS INT) AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, candidate) AS rank FROM s WHERE score>=0.6e0) WHERE rank<=3""")
def closest_names_with_cutoff(t):
    q, c = _close_inputs(t)
    return rounded(resolve.closest_names(q, "query", c, "candidate", k=3, cutoff=0.6), "score")


@query("resolve_names", """WITH cat AS (SELECT p_partkey AS id, p_name AS pref, p_type||' '||p_name AS s1, p_name||' '||p_brand AS s2 FROM {part}),
 k AS (SELECT id, pref AS nm, 0 AS m, 0 AS s FROM cat UNION ALL SELECT id, s1, 1, 0 FROM cat UNION ALL SELECT id, s2, 1, 1 FROM cat),
 b AS (SELECT parent, id, nm, m FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY m, id, s) AS rn FROM (
   SELECT *, regexp_replace(lower(nm),'[^a-z0-9]+','','g') AS parent FROM k)) WHERE rn=1),
 q AS (SELECT DISTINCT CASE WHEN p_size%3=0 THEN upper(p_name) WHEN p_size%3=1 THEN p_name||'-'||p_brand ELSE p_name||' '||p_type||'?' END AS name FROM {part})
 SELECT q.name, regexp_replace(lower(q.name),'[^a-z0-9]+','','g') AS query_parent, b.id, b.nm AS resolved_name,
 CASE b.m WHEN 0 THEN 'pref_name' WHEN 1 THEN 'synonym' END AS resolution_method FROM q LEFT JOIN b ON b.parent=regexp_replace(lower(q.name),'[^a-z0-9]+','','g')""")
def resolve_names(t):
    cat = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("pref"), F.array(
        F.concat_ws(" ", "p_type", "p_name"), F.concat_ws(" ", "p_name", "p_brand")).alias("syn"),
        F.col("p_partkey").alias("position"))
    q = t.sql("""SELECT DISTINCT CASE WHEN p_size%3=0 THEN upper(p_name) WHEN p_size%3=1 THEN p_name||'-'||p_brand
              ELSE p_name||' '||p_type||'?' END AS name FROM {part}""")
    keys = resolve.catalogue_keys(cat, "id", "pref", "syn", "position")
    return resolve.resolve_names(q, "name", keys)


# --- set comparison --------------------------------------------------------------------------

SIDES = f"""WITH {NORM_CTE}, a AS (SELECT n1, p1, {_case('p1', RULES.identities)} AS p2 FROM nrm WHERE p_partkey%3<>0),
 b AS (SELECT n1, p1, {_case('p1', RULES.identities)} AS p2 FROM nrm WHERE p_partkey%3<>1)"""


def _cmp(name: str, c: str) -> str:
    return f"""SELECT '{name}' AS key_name, count(a.k) AS n_left, count(b.k) AS n_right, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS matched,
     count(*) FILTER (b.k IS NULL) AS only_left, count(*) FILTER (a.k IS NULL) AS only_right,
     round(count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL)/CAST(count(a.k) AS DOUBLE),8) AS match_rate
     FROM (SELECT DISTINCT {c} AS k FROM a) a FULL JOIN (SELECT DISTINCT {c} AS k FROM b) b ON a.k=b.k"""


@query("set_comparison", f"{SIDES} {_cmp('normalized', 'n1')} UNION ALL {_cmp('parent', 'p1')} UNION ALL {_cmp('parent_identity', 'p2')}")
def set_comparison(t):
    raw = raw_names(t)
    left, right = raw.where("p_partkey % 3 <> 0"), raw.where("p_partkey % 3 <> 1")
    norm, par = N.normalized_name(F.col("raw"), RULES), N.parent_name(F.col("raw"), RULES)
    alias = N.identity_alias(par, RULES)
    out = coverage.set_comparison(left, right, {
        "normalized": (norm, norm), "parent": (par, par), "parent_identity": (alias, alias)})
    return rounded(out, "match_rate")


@query("set_membership", """WITH a AS (SELECT DISTINCT o_custkey AS k FROM {orders} WHERE o_custkey%3<>0), b AS (SELECT c_custkey AS k FROM {customer} WHERE c_custkey%2=0)
 SELECT coalesce(a.k,b.k) AS k, CASE WHEN b.k IS NULL THEN 'only_left' WHEN a.k IS NULL THEN 'only_right' ELSE 'matched' END AS side FROM a FULL JOIN b ON a.k=b.k""")
def set_membership(t):
    left = t.orders.select(F.col("o_custkey").alias("k")).where("k % 3 <> 0")
    return coverage.set_membership(left, t.customer.select(F.col("c_custkey").alias("k")).where("k % 2 = 0"), "k")


# --- folds ----------------------------------------------------------------------------------

SEEDS = [42, 43]


def serpentine_sql(src: str, keys: str, salt: str, k: int, out: str) -> str:
    """``src`` has keys, grp, major, size."""
    kk = keys + ", " if keys else ""
    return f"""SELECT {kk}grp, CAST((CASE WHEN st<{k} THEN st ELSE 2*{k}-1-st END + CASE major WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END)%{k} AS INT) AS {out}
     FROM (SELECT *, (row_number() OVER (PARTITION BY {kk}major ORDER BY size DESC, md5(CAST({salt} AS VARCHAR)||':'||CAST(grp AS VARCHAR)))-1)%(2*{k}) AS st FROM {src})"""


FOLD_CTE = f"""gc AS (SELECT o_custkey AS grp, o_orderstatus AS lab, count(*) AS n FROM orders GROUP BY 1,2),
 gm AS (SELECT grp, arg_max(lab, n*1000+ascii(lab)) AS major, CAST(sum(n) AS BIGINT) AS size FROM gc GROUP BY 1),
 gs AS (SELECT gm.*, seed FROM gm, (VALUES (42),(43)) s(seed)),
 folds AS ({serpentine_sql('gs', 'seed', 'seed', 5, 'fold')})"""


def order_groups(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("grp"),
                           F.col("o_orderstatus").alias("y_true"))


def order_folds(t: Tables) -> DataFrame:
    return folds.stratified_group_folds(order_groups(t), "grp", "y_true", LABELS, SEEDS,
                                        **sizing(t))


@query("stratified_group_folds", f"WITH {FOLD_CTE} SELECT seed, grp, fold FROM folds")
def stratified_group_folds(t):
    return order_folds(t)


@query("fold_class_counts", f"""WITH {FOLD_CTE} SELECT seed, fold, o_orderstatus AS y_true, count(*) AS n FROM orders JOIN folds ON grp=o_custkey GROUP BY 1,2,3""")
def fold_class_counts(t):
    return folds.fold_classes(order_groups(t), order_folds(t), "grp", "y_true", ["seed", "fold"])


@query("fold_leakage", f"""WITH {FOLD_CTE}, p AS (SELECT DISTINCT seed, fold, grp FROM ({PREDICTIONS})), a AS (SELECT seed, grp, count(*) AS f FROM p GROUP BY 1,2),
 b AS (SELECT seed, grp, count(DISTINCT fold) AS f FROM folds GROUP BY 1,2)
 SELECT 'by_row' AS origin, seed, count(*) AS n_groups, count(*) FILTER (f>1) AS n_leaking FROM a GROUP BY 2
 UNION ALL SELECT 'by_group', seed, count(*), count(*) FILTER (f>1) FROM b GROUP BY 2""")
def fold_leakage(t):
    bad = folds.leaking_groups(predictions(t), "grp").withColumn("origin", F.lit("by_row"))
    good = folds.leaking_groups(order_folds(t), "grp").withColumn("origin", F.lit("by_group"))
    return bad.unionByName(good)


NESTED_CTE = f"""{FOLD_CTE}, tr AS (SELECT g.grp, g.major, g.size, f.seed, o.fold FROM gm g JOIN folds f ON f.grp=g.grp,
   (VALUES (0),(1),(2),(3),(4)) o(fold) WHERE o.fold<>f.fold),
 inn AS ({serpentine_sql('tr', 'seed, fold', '(seed+1000+fold)', 3, 'inner_')}),
 ic AS (SELECT i.seed, i.fold, i.inner_, gc.lab FROM inn i JOIN gc ON gc.grp=i.grp GROUP BY ALL),
 al AS (SELECT seed, fold, count(DISTINCT lab) AS k FROM ic GROUP BY 1,2),
 ch AS (SELECT ic.seed, ic.fold, inner_, count(*)=max(k) AS full_ FROM ic JOIN al ON ic.seed=al.seed AND ic.fold=al.fold GROUP BY 1,2,3),
 pick AS (SELECT seed, fold, coalesce(min(inner_) FILTER (full_), min(inner_)) AS chosen FROM ch GROUP BY 1,2)"""


@query("nested_calibration_split", f"""WITH {NESTED_CTE} SELECT i.seed, i.fold, i.grp, CASE WHEN i.inner_=p.chosen THEN 'calib' ELSE 'train' END AS role
 FROM inn i JOIN pick p ON i.seed=p.seed AND i.fold=p.fold UNION ALL SELECT seed, fold, grp, 'test' FROM folds""")
def nested_calibration_split(t):
    return folds.calibration_roles(order_groups(t), order_folds(t), "grp", "y_true", LABELS,
                                   **sizing(t))


@query("first_complete_fold", f"""WITH {FOLD_CTE}, fc AS (SELECT seed, fold, count(DISTINCT lab) AS k, string_agg(DISTINCT lab, '') AS labs FROM folds JOIN gc ON gc.grp=folds.grp GROUP BY 1,2),
 p AS (SELECT seed, coalesce(min(fold) FILTER (k=3), min(fold)) AS fold FROM fc GROUP BY 1)
 SELECT p.seed, p.fold, concat_ws('|', CASE WHEN labs NOT LIKE '%F%' THEN 'F' END, CASE WHEN labs NOT LIKE '%O%' THEN 'O' END, CASE WHEN labs NOT LIKE '%P%' THEN 'P' END) AS missing_classes
 FROM p JOIN fc ON p.seed=fc.seed AND p.fold=fc.fold""")
def first_complete_fold(t):
    return folds.first_complete(order_groups(t), order_folds(t), "grp", "y_true", LABELS, ["seed"], "fold")


@query("folds_from_predictions", f"""WITH p AS (SELECT DISTINCT seed, fold, grp FROM ({PREDICTIONS}) WHERE grp%4<>0), s AS (SELECT DISTINCT seed, fold FROM p)
 SELECT s.seed, s.fold, c_custkey AS grp, CASE WHEN p.grp IS NULL THEN 'train' ELSE 'test' END AS role FROM s CROSS JOIN {{customer}}
 LEFT JOIN p ON p.seed=s.seed AND p.fold=s.fold AND p.grp=c_custkey""")
def folds_from_predictions(t):
    pred = predictions(t).where("grp % 4 <> 0")
    return folds.folds_from_predictions(pred, t.customer.select(F.col("c_custkey").alias("grp")), "grp")


@query("fold_alignment", f"""WITH {FOLD_CTE}, o AS (SELECT seed, grp, CASE WHEN grp%10=0 THEN (fold+1)%5 ELSE fold END AS fold FROM folds)
 SELECT coalesce(f.seed,o.seed) AS seed, coalesce(f.fold,o.fold) AS fold, count(f.grp) AS expected_count, count(o.grp) AS observed_count,
 count(*) FILTER (f.grp IS NULL OR o.grp IS NULL) AS symmetric_diff FROM folds f FULL JOIN o ON f.seed=o.seed AND f.fold=o.fold AND f.grp=o.grp GROUP BY 1,2""")
def fold_alignment(t):
    expected = order_folds(t)
    observed = expected.withColumn("fold", F.when(F.col("grp") % 10 == 0, (F.col("fold") + 1) % 5).otherwise(F.col("fold")))
    return folds.fold_alignment(expected, observed, "grp")
