"""Sources, sinks and the manifest, on the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Observation, functions as F, types as T

from evitrust.functions import columns as C
from evitrust.plans.registry import query
from evitrust.plans.trust_queries import rounded
from evitrust.sources import shared, sinks, tables

ORDERS_SCHEMA = T.StructType([
    T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
    T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType())])


@query("typed_table_read", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM {orders}")
def typed_table_read(t):
    there = tables.read_table(t.spark, t.path("orders"), ORDERS_SCHEMA, must_have=["o_orderkey"])
    absent = tables.read_table(t.spark, t.path("no_such_table"), ORDERS_SCHEMA, required=False)
    return there.unionByName(absent)


@query("tree_read", """SELECT 'orders.parquet' AS file_name, o_orderstatus, count(*) AS n, sum(o_custkey)::BIGINT AS key_sum FROM {orders} GROUP BY 2""")
def tree_read(t):
    rows = tables.read_tree(t.spark, t.directory, ORDERS_SCHEMA, ["file_name"], "parquet",
                            keep={"file_name": ["orders.parquet"]}, file_glob="orders*")
    return rows.groupBy("file_name", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("key_sum"))


@query("tree_read_three_levels", """SELECT 'lab '||CAST(o_custkey%3 AS VARCHAR)||'%' AS lab, o_orderstatus AS phase, count(*) AS n, sum(o_custkey)::BIGINT AS key_sum
 FROM {orders} WHERE o_orderstatus IN ('F','O') GROUP BY ALL""")
def tree_read_three_levels(t):
    """Orders written to folders whose names hold spaces and percent signs, and read back by folder and file."""
    root = f"{shared.folder(t.spark)}/tree of {uuid.uuid4().hex}"
    for lab in range(3):
        for phase in ("F", "O", "P"):
            part = t.orders.where((F.col("o_custkey") % 3 == lab) & (F.col("o_orderstatus") == phase))
            part.coalesce(1).write.parquet(f"{root}/lab {lab}%/{phase}")
    rows = tables.read_tree(t.spark, root, ORDERS_SCHEMA, ["lab", "phase", "file_name"], "parquet", keep={"phase": ["F", "O"]})
    return rows.where(F.col("file_name").startswith("part-")).groupBy("lab", "phase").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("key_sum"))


BLOB = "CASE WHEN event_id % 17 = 0 THEN '{\"k\": \"n/a\"}' ELSE props END"


@query("json_column_parse", f"""SELECT event_id, TRY_CAST(json_extract_string({BLOB}, '$.k') AS DOUBLE) AS k FROM {{events}}""")
def json_column_parse(t):
    df = t.events.select("event_id", F.expr(BLOB).alias("blob"))
    parsed = tables.parse_json_column(df, "blob", "k string")
    return parsed.select("event_id", C.to_double(F.col("parsed.k")).alias("k"))


@query("nested_activities_explode", f"""SELECT user_id AS molecule, event_type AS target, TRY_CAST(json_extract_string({BLOB}, '$.k') AS DOUBLE) AS value, event_id AS activity_id FROM {{events}}""")
def nested_activities_explode(t):
    # blobs of one molecule, target and block of ids: an array never grows with the table
    item = F.struct(
        F.lit("IC50").alias("standard_type"), F.lit("=").alias("standard_relation"),
        F.get_json_object(F.expr(BLOB), "$.k").alias("standard_value"), F.lit("nM").alias("standard_units"),
        F.lit(None).cast("string").alias("assay_chembl_id"), F.col("event_id").alias("activity_id"))
    blobs = t.events.groupBy("user_id", "event_type", F.floor(F.col("event_id") / 1000).alias("part")).agg(
        F.collect_list(item).alias("activities"))
    blobs = blobs.select(
        F.struct(F.col("event_type").alias("target_chembl_id"), F.col("user_id").cast("string").alias("molecule_chembl_id"),
                 F.lit("IC50").alias("standard_type"), F.lit("=").alias("standard_relation")).alias("query"),
        F.lit(None).cast("string").alias("retrieved_at_utc"), F.lit(None).cast("string").alias("chembl_release"), "activities")
    text = blobs.select(F.to_json(F.struct("*")).alias("blob"))
    back = tables.parse_json_column(text, "blob", tables.ACTIVITY_JSON.simpleString()).select("parsed.*")
    rows = tables.explode_activities(back)
    return rows.select(F.col("molecule_chembl_id").cast("bigint").alias("molecule"), F.col("target_chembl_id").alias("target"),
                       C.to_double(F.col("standard_value")).alias("value"), "activity_id")


@query("summary_json_rows", """SELECT c_mktsegment, '{"c_mktsegment":"'||c_mktsegment||'","n":'||CAST(count(*) AS VARCHAR)||'}' AS json FROM {customer} GROUP BY 1""")
def summary_json_rows(t):
    s = t.customer.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return sinks.summary_json(s, ["c_mktsegment"])


@query("table_fingerprints", """WITH x AS (SELECT 'orders' AS output, md5(coalesce(CAST(o_custkey AS VARCHAR),'\\N')||'|'||coalesce(CAST(o_orderdate AS VARCHAR),'\\N')||'|'||coalesce(CAST(o_orderkey AS VARCHAR),'\\N')||'|'||coalesce(CAST(o_orderpriority AS VARCHAR),'\\N')||'|'||coalesce(CAST(o_orderstatus AS VARCHAR),'\\N')||'|'||coalesce(CAST(o_totalprice AS VARCHAR),'\\N')) AS h FROM {orders}
 UNION ALL SELECT 'part', md5(coalesce(CAST(p_brand AS VARCHAR),'\\N')||'|'||coalesce(CAST(p_name AS VARCHAR),'\\N')||'|'||coalesce(CAST(p_partkey AS VARCHAR),'\\N')||'|'||coalesce(CAST(p_retailprice AS VARCHAR),'\\N')||'|'||coalesce(CAST(p_size AS VARCHAR),'\\N')||'|'||coalesce(CAST(p_type AS VARCHAR),'\\N')) FROM {part})
 SELECT output, count(*) AS n_rows, CAST(sum(CAST('0x'||substr(h,1,7) AS BIGINT)) AS BIGINT) AS sum_a, CAST(sum(CAST('0x'||substr(h,8,7) AS BIGINT)) AS BIGINT) AS sum_b FROM x GROUP BY 1""")
def table_fingerprints(t):
    a = sinks.table_fingerprint(t.orders).withColumn("output", F.lit("orders"))
    b = sinks.table_fingerprint(t.part).withColumn("output", F.lit("part"))
    return a.unionByName(b)


@query("input_manifest")
def input_manifest(t):
    """Path, size, hash, row count and fingerprint of the part files of two tables."""
    return sinks.run_manifest(t.spark, {"orders": t.path("orders"), "part": t.path("part")})


@query("sorted_write_read_back", """WITH x AS (SELECT md5(coalesce(CAST(o_custkey AS VARCHAR),'\\N')||'|'||coalesce(CAST(o_orderkey AS VARCHAR),'\\N')||'|'||coalesce(CAST(o_orderstatus AS VARCHAR),'\\N')) AS h FROM {orders})
 SELECT count(*) AS n_rows, CAST(sum(CAST('0x'||substr(h,1,7) AS BIGINT)) AS BIGINT) AS sum_a, CAST(sum(CAST('0x'||substr(h,8,7) AS BIGINT)) AS BIGINT) AS sum_b,
 CAST(0 AS BIGINT) AS n_overlapping_files FROM x""")
def sorted_write_read_back(t):
    """Orders written in key order: count and fingerprint of the write, equal to those of what is read back."""
    path, seen = f"{shared.folder(t.spark)}/evitrust-{uuid.uuid4().hex}", Observation()
    sinks.write_sorted(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), path, ["o_orderkey"], observed=seen)
    sinks.require_written(t.spark, path, seen)
    return sinks.overlapping_files(t.spark, path, "o_orderkey").agg(F.count(F.lit(1)).alias("n_overlapping_files")).select(
        *[F.lit(seen.get[c]).cast("bigint").alias(c) for c in ("n_rows", "sum_a", "sum_b")], "n_overlapping_files")
