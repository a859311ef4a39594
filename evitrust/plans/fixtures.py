"""SQL that derives the working tables (predictions, measurements, ...) from the driver tables.

The text runs unchanged in Spark and in DuckDB once the table markers are filled in.
"""

# Out-of-fold predictions: one row per order, three classes, groups are customers.
PREDICTIONS = """
SELECT row_id, grp, seed, fold, y_true,
       wf/(wf+wo+wp) AS prob_f, wo/(wf+wo+wp) AS prob_o, wp/(wf+wo+wp) AS prob_p,
       CASE WHEN wf>=wo AND wf>=wp THEN 'F' WHEN wo>=wp THEN 'O' ELSE 'P' END AS y_pred,
       greatest(wf,wo,wp)/(wf+wo+wp) AS confidence, ood_score, missing_frac
FROM (SELECT o_orderkey AS row_id, o_custkey AS grp,
             42 + CAST(o_custkey % 3 AS INT) AS seed, CAST((o_orderkey % 5) AS INT) AS fold,
             o_orderstatus AS y_true,
             CAST((o_orderkey*37) % 101 + 1 + CASE WHEN o_orderstatus='F' THEN 60 ELSE 0 END AS DOUBLE) AS wf,
             CAST((o_orderkey*53) %  97 + 1 + CASE WHEN o_orderstatus='O' THEN 60 ELSE 0 END AS DOUBLE) AS wo,
             CAST((o_custkey *29) %  89 + 1 + CASE WHEN o_orderstatus='P' THEN 60 ELSE 0 END AS DOUBLE) AS wp,
             CAST((o_orderkey*71) % 53 AS DOUBLE)/53.0e0 AS ood_score,
             CAST((o_custkey*13) % 7 AS DOUBLE)/7.0e0   AS missing_frac
      FROM {orders}) b
"""

# A second model over the same rows (other multipliers), for late fusion.
PREDICTIONS_B = """
SELECT row_id, seed, fold, y_true,
       wf/(wf+wo+wp) AS q_f, wo/(wf+wo+wp) AS q_o, wp/(wf+wo+wp) AS q_p
FROM (SELECT o_orderkey AS row_id,
             42 + CAST(o_custkey % 3 AS INT) AS seed, CAST((o_orderkey % 5) AS INT) AS fold,
             o_orderstatus AS y_true,
             CAST((o_orderkey*41) % 101 + 1 + CASE WHEN o_orderstatus='F' THEN 60 ELSE 0 END AS DOUBLE) AS wf,
             CAST((o_orderkey*59) %  97 + 1 + CASE WHEN o_orderstatus='O' THEN 60 ELSE 0 END AS DOUBLE) AS wo,
             CAST((o_custkey *31) %  89 + 1 + CASE WHEN o_orderstatus='P' THEN 60 ELSE 0 END AS DOUBLE) AS wp
      FROM {orders}) b
"""

LABELS = ["F", "O", "P"]
PROBS = ["prob_f", "prob_o", "prob_p"]

# Channel measurements of parts by five ranked sources. The prime divisor keeps means and quartiles
# away from exact decimal halves, which engines round differently.
MEASUREMENTS = """
SELECT l_partkey AS entity,
       'ch' || CAST(l_linenumber AS VARCHAR(2)) AS channel,
       CAST(l_suppkey % 5 AS INT) AS prio,
       CASE l_suppkey % 5 WHEN 0 THEN 'src_a' WHEN 1 THEN 'src_b' WHEN 2 THEN 'src_c'
                          WHEN 3 THEN 'src_d' ELSE 'src_e' END AS source,
       CASE l_returnflag WHEN 'A' THEN '=' WHEN 'N' THEN '<' ELSE '>' END AS relation,
       CASE WHEN l_quantity <= 40 THEN 'IC50' ELSE 'Ki' END AS standard_type,
       CASE l_linestatus WHEN 'F' THEN 'nM' ELSE 'uM' END AS units,
       l_extendedprice / 9973.0e0 AS standard_value
FROM {lineitem}
"""

CHANNELS = ["ch1", "ch2", "ch3", "ch4", "ch5", "ch6", "ch7"]
SOURCES = ["src_a", "src_b", "src_c", "src_d", "src_e"]

REFERENCE_ENTITIES = "SELECT p_partkey AS entity FROM {part} WHERE p_size <= 10"

# Noise-free dose-response points whose parameters are known.
DOSE_RESPONSE = """
SELECT l_partkey AS entity, l_linenumber AS channel, l_quantity AS conc,
       1.0e0 + CAST(p_size AS DOUBLE) AS true_ic50, 1.2e0 AS true_nh,
       100.0e0/(1.0e0 + power((1.0e0 + CAST(p_size AS DOUBLE))/l_quantity, 1.2e0)) AS response
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""

# Raw names with a product type and a brand glued on.
RAW_NAMES = "SELECT p_partkey, upper(p_name) || ' ' || p_type || '-' || p_brand AS raw_name FROM {part}"
