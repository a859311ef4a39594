"""Deterministic sinks and the manifest of what a run wrote."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from evitrust.contracts import ContractError


def write_sorted(df: DataFrame, path: str, keys: Sequence[str], fmt: str = "parquet",
                 partition_by: Sequence[str] = (), mode: str = "overwrite", observed: Observation | None = None) -> None:
    """Write in key order. Without partition columns the files are globally ordered (a range shuffle);
    with them each file is ordered inside. ``observed`` gets the row count and the fingerprint of what the write
    itself passed on, without another pass."""
    if partition_by:
        out = df.repartition(*partition_by).sortWithinPartitions(*partition_by, *keys)
    else:
        out = df.orderBy(*keys)
    if observed is not None:
        out = out.observe(observed, *_fingerprint(df))
    writer = out.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def flatten_for_csv(df: DataFrame) -> DataFrame:
    """Arrays of text as ``a|b``, other nested values as JSON."""
    outs = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "array<string>":
            outs.append(F.array_join(c, "|").alias(name))
        elif kind.startswith(("array", "map", "struct")):
            outs.append(F.to_json(c).alias(name))
        else:
            outs.append(c)
    return df.select(*outs)


def summary_json(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One JSON text per row, keys kept next to it."""
    return df.select(*keys, F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("json"))


def write_summary(df: DataFrame, path: str, keys: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Summary rows as JSON lines in key order."""
    (df.orderBy(*keys) if keys else df).write.mode(mode).json(path)


def _fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> list[Column]:
    names = sorted(columns or df.columns)
    text = F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\\N")) for c in names])
    piece = lambda at: F.conv(F.substring(F.md5(text), at, 7), 16, 10).cast("bigint")
    return [F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(piece(1)), F.lit(0)).alias("sum_a"),
            F.coalesce(F.sum(piece(8)), F.lit(0)).alias("sum_b")]


def table_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Row count and an order-free fingerprint: sums of two 28-bit pieces of each row's md5."""
    return df.agg(*_fingerprint(df, columns))


def require_written(spark: SparkSession, path: str, observed: Observation, fmt: str = "parquet") -> dict:
    """Fail unless the table read back has the rows that its write passed on; gives count and fingerprint."""
    want, got = observed.get, table_fingerprint(spark.read.format(fmt).load(path)).first().asDict()
    if want != got:
        raise ContractError(f"{path} holds {got}, its write passed on {want}")
    return got


def overlapping_files(spark: SparkSession, path: str, key: str, fmt: str = "parquet") -> DataFrame:
    """(path, low, high, before) of files whose first key lies below the last key of the file before it, in file name
    order. One row a file is compared; none is found in a globally ordered table."""
    at = spark.read.format(fmt).load(path).select(F.col("_metadata.file_path").alias("path"), F.col(key).alias("k"))
    ends = at.groupBy("path").agg(F.min("k").alias("low"), F.max("k").alias("high"))
    return ends.withColumn("before", F.lag("high").over(Window.orderBy("path"))).where(F.col("low") < F.col("before"))


def file_fingerprints(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """(path, size_bytes, n_rows, sum_a, sum_b) of every file of a table that holds a row.

    The fingerprint is over the rows, so a file of any size is read in splits and no file is held in one row.
    """
    df = spark.read.format(fmt).load(path)
    at = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_size").alias("_size"))
    return at.groupBy("_path", "_size").agg(*_fingerprint(df)).withColumnsRenamed({"_path": "path", "_size": "size_bytes"})


def run_manifest(spark: SparkSession, outputs: Mapping[str, str], fmt: str = "parquet") -> DataFrame:
    """One row per file of every output, with its row count and fingerprint; they add up to the table's."""
    out = None
    for name, path in outputs.items():  # outputs are a short list of named tables
        rows = file_fingerprints(spark, path, fmt).withColumn("output", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def missing_outputs(manifest: DataFrame, required: Sequence[str]) -> DataFrame:
    """Required output names without any file."""
    wanted = manifest.sparkSession.createDataFrame([(r,) for r in required], "output string")
    return wanted.join(manifest.select("output"), "output", "left_anti")


def require_outputs(manifest: DataFrame, required: Sequence[str]) -> None:
    lost = [r["output"] for r in missing_outputs(manifest, required).collect()]
    if lost:
        raise FileNotFoundError(f"missing outputs: {sorted(lost)}")
