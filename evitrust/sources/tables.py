"""Typed table, tree, JSON and text sources."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from evitrust.contracts import require_columns
from evitrust.functions.columns import nan_to_null

_D, _S, _L, _I, _B = T.DoubleType(), T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()


def _schema(**columns) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in columns.items()])


ASSAY_ROWS = _schema(drug_name=_S, cell_type=_S, risk_class=_S, platform=_S, ead_type=_S,
                     concentration_level=_L, ead=_L, dd_fpdc=_D, site=_L)
ACTIVITY_ROWS = _schema(
    drug_name_parent=_S, target_channel=_S, chembl_target_id=_S, standard_type=_S, standard_relation=_S,
    standard_value=_D, standard_units=_S, value_uM=_D, assay_chembl_id=_S, activity_chembl_id=_L, source=_S,
    retrieved_at_utc=_S, chembl_release=_S, identity_alias_enabled=_B, provenance_note=_S)
CHANNEL_MEASUREMENTS = _schema(
    drug_name_raw=_S, drug_name_parent=_S, drug_name_normalized=_S, channel_key=_S, metric=_S, value=_D, units=_S,
    concentration_raw=_D, concentration_unit=_S, concentration_uM=_D, mechanistic_source=_S, lab_or_provider=_S,
    n_measurements=_I, provenance_note=_S)
PREDICTIONS = _schema(row_id=_L, seed=_I, fold=_I, split_role=_S, y_true=_S, y_pred=_S, confidence=_D)
OOD_SCORES = _schema(row_id=_L, seed=_I, fold=_I, ood_knn_distance=_D, ood_method=_S)
WORDS = _schema(page=_I, text=_S, conf=_D, x_center=_D, y_center=_D)
ACTIVITY_JSON = T.StructType([
    T.StructField("query", T.StructType([T.StructField(n, _S) for n in (
        "target_chembl_id", "molecule_chembl_id", "standard_type", "standard_relation")])),
    T.StructField("retrieved_at_utc", _S),
    T.StructField("chembl_release", _S),
    T.StructField("activities", T.ArrayType(T.StructType(
        [T.StructField(n, _S) for n in ("standard_type", "standard_relation", "standard_value", "standard_units",
                                        "assay_chembl_id")] + [T.StructField("activity_id", _L)]))),
])


def _missing_path(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str | None = None,
               required: bool = True, must_have: Sequence[str] = ()) -> DataFrame:
    """Read CSV, Parquet, ORC or JSON with a declared schema; NaN becomes null.

    ``required=False`` turns a missing path into an empty table of the schema.
    """
    fmt = fmt or next((f for f in ("csv", "json", "orc") if path.endswith("." + f)), "parquet")
    if schema is None and fmt in ("csv", "json"):
        raise ValueError(f"a {fmt} source needs a declared schema")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    try:
        df = reader.load(path)
    except AnalysisException as error:
        if required or schema is None or not _missing_path(error):
            raise
        df = spark.createDataFrame([], schema)
    require_columns(df, must_have, path)
    return nan_to_null(df)


def read_tree(spark: SparkSession, root: str, schema: T.StructType, levels: Sequence[str], fmt: str = "csv",
              keep: dict[str, Sequence[str]] | None = None, file_glob: str | None = None) -> DataFrame:
    """Read all files below ``root`` and take ``levels`` (names from the top, the file's last) as columns.

    ``keep`` filters level values. As long as the leading levels are filtered by plain names, only their folders are
    listed, so a dropped file is not read; values of later levels are filtered on the path text. A file above a level
    has ``unknown`` there.
    """
    reader = spark.read.format(fmt).schema(schema).option("recursiveFileLookup", True)
    if fmt == "csv":
        reader = reader.option("header", True)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    full = files.makeQualified(path)
    folders = [root.rstrip("/")]
    for name in levels:
        values = list((keep or {}).get(name, ()))
        if not values or any(re.search(r"[^\w.=-]", v) or v == "unknown" for v in values):
            break
        found = [f"{f}/{v}" for f in folders for v in values]
        folders = [f for f in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f))]
    if not folders:
        df = spark.createDataFrame([], schema)
        return df.select("*", *[F.lit("").alias(n) for n in levels])
    df = reader.load(folders)
    skip = len(full.toUri().getPath().rstrip("/")) + 2
    # the file path is percent-encoded, the root is not; a plus stands for itself
    file_path = F.url_decode(F.replace(F.expr("parse_url(_metadata.file_path, 'PATH')"), F.lit("+"), F.lit("%2B")))
    tail = F.split(F.substring(file_path, skip, 1_000_000), "/")
    out = df.select("*", *[F.coalesce(F.get(tail, F.lit(i)), F.lit("unknown")).alias(n) for i, n in enumerate(levels)])
    for name, values in (keep or {}).items():
        out = out.where(F.col(name).isin(list(values)))
    return out


def read_activities(spark: SparkSession, path: str) -> DataFrame:
    """Cached activity responses, one row per activity."""
    blobs = spark.read.schema(ACTIVITY_JSON).option("multiLine", True).json(path)
    return explode_activities(blobs)


def explode_activities(blobs: DataFrame) -> DataFrame:
    return blobs.select(
        F.col("query.molecule_chembl_id").alias("molecule_chembl_id"), F.col("query.target_chembl_id").alias("target_chembl_id"),
        "retrieved_at_utc", "chembl_release", F.explode("activities").alias("a"),
    ).select("molecule_chembl_id", "target_chembl_id", "retrieved_at_utc", "chembl_release", "a.*")


def parse_json_column(df: DataFrame, column: str, schema: str, out: str = "parsed") -> DataFrame:
    """Typed struct from a JSON text column; unreadable text becomes null fields."""
    return df.withColumn(out, F.from_json(column, schema))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): one row per text file, the file path as the id."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))
