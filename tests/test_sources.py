"""Typed readers, sinks and the manifest on small files."""

import hashlib
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import Observation, functions as F, types as T

from evitrust.contracts import ContractError
from evitrust.sources import sinks, tables


def test_csv_with_schema_and_missing_file(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("drug_name,dd_fpdc\nx,NaN\ny,2.5\n")
    schema = T.StructType([T.StructField("drug_name", T.StringType()), T.StructField("dd_fpdc", T.DoubleType())])
    df = tables.read_table(spark, str(p), schema)
    assert sorted(map(tuple, df.collect())) == [("x", None), ("y", 2.5)]
    assert tables.read_table(spark, str(tmp_path / "no.csv"), schema, required=False).count() == 0
    with pytest.raises(AnalysisException):
        tables.read_table(spark, str(tmp_path / "no.csv"), schema).count()
    with pytest.raises(ContractError):
        tables.read_table(spark, str(p), schema, must_have=["site"])
    with pytest.raises(ValueError):
        tables.read_table(spark, str(p))


def test_tree_keys_come_from_the_path(spark, tmp_path):
    for lab, phase, drug in [("L1", "hERG", "d1"), ("L2", "hERG", "d2"), ("L1", "Other", "d3")]:
        d = tmp_path / "raw" / lab / phase / drug
        d.mkdir(parents=True)
        (d / "ic50.csv").write_text("IC50\n1.5\n")
    schema = T.StructType([T.StructField("IC50", T.DoubleType())])
    df = tables.read_tree(spark, str(tmp_path / "raw"), schema, ["lab", "phase", "drug"], keep={"phase": ["hERG"]})
    assert sorted((r["lab"], r["drug"], r["IC50"]) for r in df.collect()) == [("L1", "d1", 1.5), ("L2", "d2", 1.5)]


def test_tree_of_a_root_whose_name_comes_twice(spark, tmp_path):
    for lab, phase in [("lab", "a.b"), ("lab", "axb"), ("x y", "a.b")]:
        d = tmp_path / "lab" / "in" / "lab" / lab / phase
        d.mkdir(parents=True)
        (d / "v.csv").write_text("IC50\n2.5\n")
    schema = T.StructType([T.StructField("IC50", T.DoubleType())])
    root = str(tmp_path / "lab" / "in" / "lab")
    df = tables.read_tree(spark, root, schema, ["lab", "phase"])
    assert sorted((r["lab"], r["phase"]) for r in df.collect()) == [("lab", "a.b"), ("lab", "axb"), ("x y", "a.b")]
    kept = tables.read_tree(spark, root, schema, ["lab", "phase"], keep={"lab": ["lab", "none"], "phase": ["a.b"]})
    assert [(r["lab"], r["phase"]) for r in kept.collect()] == [("lab", "a.b")]
    assert len(kept.inputFiles()) == 1
    assert tables.read_tree(spark, root, schema, ["lab"], keep={"lab": ["none"]}).count() == 0


def test_tree_of_names_with_odd_characters(spark, tmp_path):
    root = tmp_path / "a b%20c+d"
    for lab in ("lab x", "50%", "p+q", "é"):
        (root / lab / "p1").mkdir(parents=True)
        (root / lab / "p1" / "f g.csv").write_text("IC50\n2.5\n")
    df = tables.read_tree(spark, str(root), T.StructType([T.StructField("IC50", T.DoubleType())]), ["lab", "phase", "file"])
    assert sorted((r.lab, r.phase, r.file) for r in df.collect()) == [(x, "p1", "f g.csv") for x in ("50%", "lab x", "p+q", "é")]


def test_activity_json(spark, tmp_path):
    blob = {"query": {"target_chembl_id": "T1", "molecule_chembl_id": "M1"}, "chembl_release": "r",
            "activities": [{"standard_type": "IC50", "standard_value": "5", "activity_id": 1}, {"standard_type": "Ki", "activity_id": 2}]}
    (tmp_path / "m.json").write_text(json.dumps(blob, indent=1))
    rows = tables.read_activities(spark, str(tmp_path)).orderBy("activity_id").collect()
    assert [(r["molecule_chembl_id"], r["standard_type"], r["standard_value"]) for r in rows] == [("M1", "IC50", "5"), ("M1", "Ki", None)]


def test_documents(spark, tmp_path):
    (tmp_path / "d.txt").write_text("one\ntwo")
    assert tables.read_documents(spark, str(tmp_path)).first()["text"] == "one\ntwo"


def test_sorted_sink_and_manifest(spark, tmp_path):
    df = spark.range(1000).select(F.xxhash64("id").alias("k"), (F.col("id") % 3).alias("p"))
    out = str(tmp_path / "o")
    sinks.write_sorted(df, out, ["k"], "csv")
    files = sorted((tmp_path / "o").glob("part-*.csv"))
    keys = [int(line.split(",")[0]) for f in files for line in f.read_text().splitlines()[1:]]
    assert keys == sorted(keys) and len(keys) == 1000
    part = str(tmp_path / "p")
    sinks.write_sorted(df, part, ["k"], partition_by=["p"])
    assert spark.read.parquet(part).count() == 1000
    m = sinks.run_manifest(spark, {"p": part})
    total, table = m.agg(F.sum("n_rows"), F.sum("sum_a"), F.sum("sum_b")).first(), sinks.table_fingerprint(spark.read.parquet(part)).first()
    assert tuple(total) == tuple(table) and m.count() == 3
    assert [r["output"] for r in sinks.missing_outputs(m, ["p", "q"]).collect()] == ["q"]
    with pytest.raises(FileNotFoundError):
        sinks.require_outputs(m, ["q"])


def test_fingerprint_ignores_order(spark):
    a = spark.range(100).withColumn("x", F.col("id") * 2)
    assert sinks.table_fingerprint(a).first() == sinks.table_fingerprint(a.orderBy(F.desc("id")).repartition(5)).first()
    assert sinks.table_fingerprint(a).first() != sinks.table_fingerprint(a.withColumn("x", F.col("x") + 1)).first()


def test_flatten_for_csv(spark):
    df = spark.createDataFrame([(["a", "b"], {"k": 1})], "x array<string>, m map<string,int>")
    assert tuple(sinks.flatten_for_csv(df).first()) == ("a|b", '{"k":1}')


def test_summary_sink(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    sinks.write_summary(df, str(tmp_path / "s"), ["k"])
    assert spark.read.json(str(tmp_path / "s")).count() == 2


def test_observed_write(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("v")).repartition(5)
    seen, out = Observation(), str(tmp_path / "o")
    sinks.write_sorted(df, out, ["k"], observed=seen)
    assert sinks.require_written(spark, out, seen)["n_rows"] == 1000
    assert sinks.overlapping_files(spark, out, "k").count() == 0
    df.limit(10).write.mode("append").parquet(out)
    with pytest.raises(ContractError):
        sinks.require_written(spark, out, seen)
    part, seen = str(tmp_path / "p"), Observation()
    sinks.write_sorted(df.withColumn("p", F.col("k") % 3), part, ["k"], partition_by=["p"], observed=seen)
    assert seen.get["n_rows"] == 1000
    empty, seen = str(tmp_path / "e"), Observation()
    sinks.write_sorted(df.where("false"), empty, ["k"], observed=seen)
    assert sinks.require_written(spark, empty, seen) == {"n_rows": 0, "sum_a": 0, "sum_b": 0}
