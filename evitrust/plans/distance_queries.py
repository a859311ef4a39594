"""Neighbour distances, dose-response fits and rows joined with evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evitrust.functions import columns as C
from evitrust.operators import cell_index, curves, dose, fold_models, fold_neighbors, neighbors, trust
from evitrust.plans.fixtures import DOSE_RESPONSE
from evitrust.plans.registry import Tables, query
from evitrust.plans.trust_queries import curve_cte, rounded
from evitrust.sources.shared import written

# --- vectors ---------------------------------------------------------------------------------

PRED_LABEL = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"


def vectors(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Test rows (with a predicted class) and train rows."""
    v = t.embeddings.withColumn("pred", F.expr(PRED_LABEL))
    return v.where("vec_id % 5 = 0"), v.where("vec_id % 5 <> 0")


VEC_CTE = f"""v AS (SELECT vec_id, label, {PRED_LABEL} AS pred, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 te AS (SELECT * FROM v WHERE vec_id%5=0), tr AS (SELECT * FROM v WHERE vec_id%5<>0),
 cls AS (SELECT DISTINCT label FROM tr),
 pr AS (SELECT te.vec_id AS a, tr.vec_id AS b, te.label AS y, te.pred AS pred, tr.label AS l, 1-list_cosine_similarity(te.e,tr.e) AS dc, list_distance(te.e,tr.e) AS de FROM te, tr),
 rg AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dc,b) AS rc, row_number() OVER (PARTITION BY a ORDER BY de,b) AS re FROM pr),
 rk AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dc,b) AS rl FROM pr WHERE l=pred OR pred NOT IN (SELECT label FROM cls))"""


def _distance(t: Tables, method: str, k: int = 5, **kw) -> DataFrame:
    test, train = vectors(t)
    out = neighbors.distance_scores(test, train, "vec_id", "embedding", k, method, **kw)
    return rounded(out.select(F.col("test_id").alias("vec_id"), "ood_distance"), "ood_distance")


@query("knn_cosine_distance", f"WITH {VEC_CTE} SELECT a AS vec_id, round(avg(dc),8)+0 AS ood_distance FROM rg WHERE rc<=5 GROUP BY 1")
def knn_cosine(t):
    return _distance(t, "cosine")


@query("knn_euclidean_distance", f"WITH {VEC_CTE} SELECT a AS vec_id, round(avg(de),8) AS ood_distance FROM rg WHERE re<=5 GROUP BY 1")
def knn_euclidean(t):
    return _distance(t, "euclidean")


@query("knn_class_distance", f"WITH {VEC_CTE} SELECT a AS vec_id, round(avg(dc),8)+0 AS ood_distance FROM rk WHERE rl<=5 GROUP BY 1")
def knn_class(t):
    return _distance(t, "cosine_class", test_class="pred", train_class="label")


@query("knn_margin", f"""WITH {VEC_CTE}, g AS (SELECT a, avg(dc) AS d FROM rg WHERE rc<=5 GROUP BY 1), c AS (SELECT a, avg(dc) AS d FROM rk WHERE rl<=5 GROUP BY 1)
 SELECT g.a AS vec_id, round(c.d-g.d,8)+0 AS ood_distance FROM g JOIN c ON g.a=c.a""")
def knn_margin(t):
    return _distance(t, "cosine_margin", test_class="pred", train_class="label")


@query("knn_distances_many_k", f"""WITH {VEC_CTE} SELECT a AS vec_id, k, round(avg(dc),8)+0 AS ood_distance FROM rg, (VALUES (3),(5),(10)) v(k) WHERE rc<=k GROUP BY 1,2""")
def knn_many_k(t):
    test, train = vectors(t)
    near = neighbors.nearest_neighbors(test, train, "vec_id", "embedding", 10)
    out = neighbors.mean_distances(near, [3, 5, 10])
    return rounded(out.select(F.col("test_id").alias("vec_id"), "k", F.col("distance").alias("ood_distance")), "ood_distance")


K_SCORED = """SELECT k, 0 AS fold, a AS row_id, CAST(y AS VARCHAR) AS y_true, CAST(pred AS VARCHAR) AS y_pred, u FROM (
   SELECT k, a, y, pred, round(avg(dc),10) AS u FROM rg, (VALUES (3),(5),(10)) v(k) WHERE rc<=k GROUP BY ALL)"""


@query("knn_selected_k", f"""WITH {VEC_CTE}, {curve_cte(K_SCORED, 'k, fold')}, s AS (SELECT k,
  round(avg(balanced_accuracy) FILTER (abstention_rate=0),8) AS bal_acc_0, round(avg(balanced_accuracy) FILTER (abstention_rate=CAST(0.1 AS DOUBLE)),8) AS bal_acc_10,
  round(avg(balanced_accuracy) FILTER (abstention_rate=CAST(0.3 AS DOUBLE)),8) AS bal_acc_30, round(avg(balanced_accuracy) FILTER (abstention_rate=CAST(0.5 AS DOUBLE)),8) AS bal_acc_50 FROM curve GROUP BY 1)
 SELECT * FROM s ORDER BY bal_acc_30 DESC, bal_acc_50 DESC, k LIMIT 1""")
def knn_selected_k(t):
    test, train = vectors(t)
    near = neighbors.nearest_neighbors(test, train, "vec_id", "embedding", 10)
    dist = neighbors.mean_distances(near, [3, 5, 10])
    rows = dist.join(test.select(F.col("vec_id").alias("test_id"), F.col("label").cast("string").alias("y_true"),
                                 F.col("pred").cast("string").alias("y_pred")), "test_id")
    rows = rows.withColumn("distance", F.round("distance", 10)).withColumn("fold", F.lit(0))
    labels = [str(i) for i in range(10)]
    curve = curves.abstention_curve(rows.withColumnRenamed("test_id", "row_id"), ["k", "fold"], "distance", labels)
    out = trust.select_k(curve)
    return rounded(out, *[c for c in out.columns if c.startswith("bal_acc")])


@query("knn_fold_distances", """WITH v AS (SELECT vec_id, CAST(vec_id%3 AS INT) AS fold, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 r AS (SELECT a.vec_id, a.fold, 1-list_cosine_similarity(a.e,b.e) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY 1-list_cosine_similarity(a.e,b.e), b.vec_id) AS rn
  FROM v a JOIN v b ON a.fold<>b.fold) SELECT vec_id, fold, round(avg(d),8)+0 AS ood_distance FROM r WHERE rn<=5 GROUP BY 1,2""")
def knn_fold_distances(t):
    rows = t.embeddings.withColumn("fold", (F.col("vec_id") % 3).cast("int"))
    out = neighbors.fold_distance_scores(rows, "fold", [0, 1, 2], "vec_id", "embedding", 5)
    return rounded(out.select(F.col("test_id").alias("vec_id"), "fold", "ood_distance"), "ood_distance")


@query("knn_svd_distance")
def knn_svd(t):
    test, train = vectors(t)
    out = neighbors.svd_distance_scores(test, train, "vec_id", "embedding", 5, n_components=30)
    return out.select(F.col("test_id").alias("vec_id"), "ood_distance")


@query("knn_svd_margin")
def knn_svd_margin(t):
    test, train = vectors(t)
    out = neighbors.svd_distance_scores(test, train, "vec_id", "embedding", 5, suffix="_margin",
                                        test_class="pred", train_class="label")
    return out.select(F.col("test_id").alias("vec_id"), "ood_distance")


# --- dose-response ---------------------------------------------------------------------------

FIT_CTE = f"""p AS ({DOSE_RESPONSE}), g AS (SELECT entity, channel, count(DISTINCT conc) AS n_points, max(response) AS top, max(conc) AS mc, max(true_ic50) AS ti, max(true_nh) AS th FROM p GROUP BY 1,2),
 fit AS (SELECT entity, channel, CASE WHEN n_points<3 THEN 'NA' WHEN top<50 THEN '>' ELSE '=' END AS relation, n_points,
  CASE WHEN n_points<3 THEN NULL WHEN top<50 THEN mc ELSE ti END AS ic50, CASE WHEN n_points>=3 AND top>=50 THEN th END AS hill_n FROM g)"""


@query("dose_response_fit", f"WITH {FIT_CTE} SELECT entity, channel, relation, n_points, round(ic50,6) AS ic50, round(hill_n,6) AS hill_n FROM fit")
def dose_response_fit(t):
    fits = dose.fit_curves(t.sql(DOSE_RESPONSE), ["entity", "channel"], "conc", "response")
    return rounded(fits.select("entity", "channel", "relation", "n_points", "ic50", "hill_n"), "ic50", "hill_n", digits=6)


@query("fitted_source_cells", f"WITH {FIT_CTE} SELECT entity, channel, 'curve' AS source, 0 AS prio, round(ic50,6) AS value, n_points AS n_records, false AS is_strict, relation FROM fit WHERE ic50 IS NOT NULL")
def fitted_source_cells(t):
    fits = dose.fit_curves(t.sql(DOSE_RESPONSE), ["entity", "channel"], "conc", "response")
    return rounded(dose.fitted_cells(fits, "curve", 0), "value", digits=6)


@query("hill_block_prediction", """SELECT l_partkey, l_orderkey, l_linenumber, CASE WHEN l_linenumber%4<>0 THEN round(1/(1+pow((1e0+p_size)/l_quantity,1.2e0)),8) WHEN l_orderkey%2=0 THEN 0e0 END AS block FROM {lineitem} JOIN {part} ON l_partkey=p_partkey""")
def hill_block_prediction(t):
    df = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    conc = F.when(F.col("l_linenumber") % 4 != 0, F.col("l_quantity")).when(F.col("l_orderkey") % 2 == 0, 0.0)
    block = dose.hill_block(conc, 1.0 + F.col("p_size"), F.lit(1.2))
    return rounded(df.select("l_partkey", "l_orderkey", "l_linenumber", block.alias("block")), "block")


@query("row_level_fused_rows", """WITH f AS (SELECT p_partkey AS entity, CASE WHEN p_partkey%3<>0 THEN p_retailprice END AS med, CASE WHEN p_partkey%9<>0 THEN p_retailprice+1 END AS mean,
  CASE WHEN p_partkey%4<>0 THEN 1e0+p_size/50e0 END AS nh FROM {part} WHERE p_partkey%11<>0)
 SELECT l_orderkey, l_partkey, l_linenumber, coalesce(med,mean) AS ic50, coalesce(nh,1e0) AS hill_n, CAST(nh IS NULL AS INT) AS nh_imputed,
 round(1/(1+pow(coalesce(med,mean)/l_quantity,coalesce(nh,1e0))),8) AS block FROM {lineitem} LEFT JOIN f ON l_partkey=entity""")
def row_level_fused_rows(t):
    k = F.col("p_partkey")
    f = t.part.where(k % 11 != 0).select(
        k.alias("l_partkey"), F.when(k % 3 != 0, F.col("p_retailprice")).alias("med"),
        F.when(k % 9 != 0, F.col("p_retailprice") + 1).alias("mean"),
        F.when(k % 4 != 0, 1.0 + F.col("p_size") / 50.0).alias("nh"))
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity").join(f, "l_partkey", "left")
    rows = rows.withColumns({"ic50": C.first_present(F.col("med"), F.col("mean")), "nh_imputed": C.imputed_flag(F.col("nh")),
                             "hill_n": F.coalesce("nh", F.lit(1.0))})
    rows = rows.withColumn("block", dose.hill_block(F.col("l_quantity"), F.col("ic50"), F.col("hill_n")))
    return rounded(rows.select("l_orderkey", "l_partkey", "l_linenumber", "ic50", "hill_n", "nh_imputed", "block"), "block")


# --- distances on prepared features of each fold ----------------------------------------------

FOLD_ROWS = """SELECT c_custkey AS row_id, c_custkey % 40 AS grp, y_true, CASE WHEN c_custkey % 13 <> 0 THEN c_mktsegment END AS segment,
  'n' || c_nationkey AS nation, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal / 97.0e0 END AS balance, price, CAST(n AS DOUBLE) AS n
 FROM {customer} JOIN (SELECT o_custkey, min_by(o_orderstatus, o_orderkey) AS y_true, min_by(o_totalprice, o_orderkey) / 9973.0e0 AS price,
  count(*) AS n FROM {orders} GROUP BY o_custkey) ON c_custkey = o_custkey"""
FOLD_KS, FOLD_SLOTS = (3, 5, 10), [(s, f) for s in (1, 2, 3) for f in range(5)]
FOLD_PRED = "CASE WHEN (row_id + seed) % 4 = 0 THEN 'P' WHEN (row_id + seed) % 9 = 0 THEN 'F' ELSE y_true END"


def fold_rows(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, the role of each group in each slot, and predictions."""
    rows = t.sql(FOLD_ROWS)
    seeds = rows.select("grp").distinct().withColumn("seed", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    dealt = seeds.withColumn("_own", F.expr("CAST((grp DIV seed + seed) % 5 AS INT)"))
    roles = dealt.withColumn("fold", F.explode(F.array(*map(F.lit, range(5))))).select(
        "seed", "fold", "grp", F.when(F.col("fold") == F.col("_own"), "test").otherwise("train").alias("role"))
    pred = rows.join(dealt, "grp").select("row_id", "seed", F.col("_own").alias("fold"), "y_true", F.expr(FOLD_PRED).alias("y_pred"))
    return rows, roles, pred


def fold_distance_table(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows, roles, pred = fold_rows(t)
    labels = ["F", "O", "P"]
    ft = fold_models.fold_table(rows, roles, ["segment", "nation"], ["balance", "price", "n"], labels, "grp", "y_true", FOLD_SLOTS)
    fits = [fold_models.Fit(i, True) for i in range(len(FOLD_SLOTS))]
    near = fold_neighbors.neighbor_lists(ft, fits, fold_models.prepare(ft, fits), max(FOLD_KS))
    return fold_neighbors.fold_distances(near, ft, pred, FOLD_KS), pred


FOLD_CTE = f"""r AS MATERIALIZED ({FOLD_ROWS.replace('min_by', 'arg_min')}), sl AS (SELECT seed, fold FROM (VALUES (1),(2),(3)) a(seed), (VALUES (0),(1),(2),(3),(4)) b(fold)),
 g AS (SELECT r.*, seed, fold, CAST((grp // seed + seed) % 5 AS INT) = fold AS held FROM r, sl),
 md AS (SELECT seed, fold, median(balance) AS mb, median(price) AS mp, median(n) AS mn FROM g WHERE NOT held GROUP BY ALL),
 ms AS (SELECT seed, fold, segment AS sg FROM (SELECT seed, fold, segment, row_number() OVER (PARTITION BY seed, fold ORDER BY count(*) DESC, segment) AS rn
   FROM g WHERE NOT held AND segment IS NOT NULL GROUP BY seed, fold, segment) WHERE rn=1),
 nat AS (SELECT DISTINCT seed, fold, nation AS seen FROM g WHERE NOT held),
 f AS (SELECT g.seed, g.fold, row_id, held, y_true, coalesce(segment, sg) AS segment, seen AS nation, coalesce(balance, mb) AS b, coalesce(price, mp) AS p, coalesce(n, mn) AS n
   FROM g JOIN md USING (seed, fold) JOIN ms USING (seed, fold) LEFT JOIN nat ON nat.seed=g.seed AND nat.fold=g.fold AND seen=nation),
 sd AS (SELECT seed, fold, CASE WHEN stddev_pop(b)>0 THEN stddev_pop(b) ELSE 1 END AS sb, CASE WHEN stddev_pop(p)>0 THEN stddev_pop(p) ELSE 1 END AS sp, CASE WHEN stddev_pop(n)>0 THEN stddev_pop(n) ELSE 1 END AS sn FROM f WHERE NOT held GROUP BY seed, fold),
 z AS MATERIALIZED (SELECT seed, fold, row_id, held, y_true, segment, nation, b/sb AS b, p/sp AS p, n/sn AS n,
   sqrt(1+CASE WHEN nation IS NULL THEN 0 ELSE 1 END+b/sb*b/sb+p/sp*p/sp+n/sn*n/sn) AS len FROM f JOIN sd USING (seed, fold)),
 nn AS (SELECT a.seed, a.fold, a.row_id, c.y_true AS y, min(1-(CASE WHEN a.segment=c.segment THEN 1 ELSE 0 END+CASE WHEN a.nation=c.nation THEN 1 ELSE 0 END+a.b*c.b+a.p*c.p+a.n*c.n)/(a.len*c.len), 10) AS ds
   FROM z a JOIN z c ON a.seed=c.seed AND a.fold=c.fold AND a.held AND NOT c.held GROUP BY ALL),
 al AS (SELECT seed, fold, row_id, list_sort(flatten(list(ds))) AS ds FROM nn GROUP BY ALL),
 pr AS (SELECT row_id, seed, fold, y_true, {FOLD_PRED} AS y_pred FROM z WHERE held),
 ds AS (SELECT pr.*, k, list_avg(al.ds[1:k]) AS cosine, list_avg(coalesce(nn.ds, al.ds)[1:k]) AS cosine_class
   FROM pr JOIN al USING (seed, fold, row_id) LEFT JOIN nn ON nn.seed=pr.seed AND nn.fold=pr.fold AND nn.row_id=pr.row_id AND nn.y=pr.y_pred, (VALUES (3),(5),(10)) v(k))"""


@query("fold_feature_distances", f"""WITH {FOLD_CTE} SELECT row_id, seed, fold, k, round(cosine,8)+0 AS cosine, round(cosine_class,8)+0 AS cosine_class,
 round(cosine_class-cosine,8)+0 AS cosine_margin FROM ds""")
def fold_feature_distances(t):
    out, _ = fold_distance_table(t)
    return rounded(out, "cosine", "cosine_class", "cosine_margin")


FOLD_SCORED = """SELECT k, seed, fold, row_id, y_true, y_pred, CASE WHEN bad<ok THEN -d ELSE d END AS u FROM (SELECT *, round(cosine_margin,10) AS d,
   avg(CASE WHEN y_true=y_pred THEN round(cosine_margin,10) END) OVER (PARTITION BY k) AS ok,
   avg(CASE WHEN y_true<>y_pred THEN round(cosine_margin,10) END) OVER (PARTITION BY k) AS bad FROM (SELECT *, cosine_class-cosine AS cosine_margin FROM ds))"""


@query("fold_feature_selected_k", f"""WITH {FOLD_CTE}, {curve_cte(FOLD_SCORED, 'k, seed, fold')}, s AS (SELECT k,
  round(avg(balanced_accuracy) FILTER (abstention_rate=0),8) AS bal_acc_0, round(avg(balanced_accuracy) FILTER (abstention_rate=CAST(0.1 AS DOUBLE)),8) AS bal_acc_10,
  round(avg(balanced_accuracy) FILTER (abstention_rate=CAST(0.3 AS DOUBLE)),8) AS bal_acc_30, round(avg(balanced_accuracy) FILTER (abstention_rate=CAST(0.5 AS DOUBLE)),8) AS bal_acc_50 FROM curve GROUP BY 1)
 SELECT * FROM s ORDER BY bal_acc_30 DESC, bal_acc_50 DESC, k LIMIT 1""")
def fold_feature_selected_k(t):
    """Preparation, neighbours, alignment, direction and the choice of k, from rows to the chosen k."""
    out, pred = fold_distance_table(t)
    scored = out.join(pred, ["row_id", "seed", "fold"]).withColumn("raw", F.round("cosine_margin", 10)).withColumn(
        "error", (F.col("y_true") != F.col("y_pred")).cast("int"))
    scored = written(scored.select("k", "seed", "fold", "row_id", "y_true", "y_pred", "raw", "error"))
    turned = None
    for k in FOLD_KS:
        one = trust.fix_direction(scored.where(F.col("k") == k), "raw")
        turned = one if turned is None else turned.unionByName(one)
    curve = curves.abstention_curve(turned, ["k", "seed", "fold"], "ood_score", ["F", "O", "P"])
    chosen = trust.select_k(curve)
    return rounded(chosen, *[c for c in chosen.columns if c.startswith("bal_acc")])


# --- approximate neighbours ---------------------------------------------------------------------

def every_twentieth(t: Tables) -> DataFrame:
    """Exact and approximate neighbours of every 20th row among all rows (its own is the first)."""
    index = cell_index.build_index(t.embeddings, "vec_id", "embedding")
    asked = t.embeddings.where("vec_id % 20 = 0")
    probes = cell_index.probes_for(index, t.embeddings, "vec_id", "embedding", 10)
    return cell_index.recall(neighbors.nearest_neighbors(asked, t.embeddings, "vec_id", "embedding", 10),
                             cell_index.search(index, asked, "vec_id", "embedding", 10, probes))


NEAR_SQL = """SELECT a.vec_id, 1-list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d,
 row_number() OVER (PARTITION BY a.vec_id ORDER BY 1-list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), b.vec_id) AS rn
 FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0"""


@query("knn_approximate")
def knn_approximate(t):
    return every_twentieth(t).withColumnRenamed("test_id", "vec_id")


@query("knn_approximate_facts", f"""WITH n AS (SELECT vec_id, avg(d) AS d FROM ({NEAR_SQL}) WHERE rn<=10 GROUP BY 1)
 SELECT count(*) AS n_rows, round(avg(d),8) AS mean_distance, CAST(0 AS BIGINT) AS n_short, CAST(0 AS BIGINT) AS n_below_exact, true AS recall_reached FROM n""")
def knn_approximate_facts(t):
    """What must hold of the approximate search: ten rows each, none closer than the exact ones, recall of 0.9 and more."""
    out = every_twentieth(t).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("distance").alias("mean_distance"), F.count_if(F.col("n_found") < 10).alias("n_short"),
        F.count_if(F.col("approximate_distance") < F.col("distance") - 1e-9).alias("n_below_exact"),
        (F.avg("recall") >= 0.9).alias("recall_reached"))
    return rounded(out, "mean_distance")
