"""Schema and key contracts checked before an operator runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


class ContractError(ValueError):
    """A table does not have the columns or the key properties an operator needs."""


def require_columns(df: DataFrame, columns: Sequence[str], what: str = "table") -> DataFrame:
    """Fail unless every column is there. Reads the schema only, starts no job."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ContractError(f"{what} is missing required columns: {missing}")
    return df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .where(F.col("n_rows") > 1)
    )


def require_unique(df: DataFrame, keys: Sequence[str], what: str = "table") -> DataFrame:
    """Fail when a key occurs twice; the check is one partially aggregated shuffle of the keys."""
    bad = duplicate_keys(df, keys).limit(1).collect()
    if bad:
        raise ContractError(f"{what} has duplicate keys, for example {bad[0].asDict()}")
    return df


def join_one_to_one(
    left: DataFrame, right: DataFrame, keys: Sequence[str], validate: bool = True
) -> DataFrame:
    """Inner join that refuses duplicate keys on either side."""
    if validate:
        require_unique(left, keys, "left side")
        require_unique(right, keys, "right side")
    return left.join(right, list(keys), "inner")


def join_many_to_one(
    left: DataFrame, right: DataFrame, keys: Sequence[str], validate: bool = True
) -> DataFrame:
    """Left join that refuses duplicate keys on the right side."""
    if validate:
        require_unique(right, keys, "right side")
    return left.join(right, list(keys), "left")


def require_no_nulls(df: DataFrame, column: str, what: str = "table") -> DataFrame:
    if df.where(F.col(column).isNull()).limit(1).collect():
        raise ContractError(f"{what} has null {column}")
    return df


def test_rows(df: DataFrame, role_col: str = "split_role") -> DataFrame:
    """Keep the test split when the table carries a role column, else keep everything."""
    return df.where(F.col(role_col) == "test") if role_col in df.columns else df


def with_default_role(df: DataFrame, role_col: str = "split_role") -> DataFrame:
    return df if role_col in df.columns else df.withColumn(role_col, F.lit("test"))


def aligned_key_counts(left: DataFrame, right: DataFrame, keys: Sequence[str],
                       by: Sequence[str] = ()) -> DataFrame:
    """Distinct key counts on both sides and the size of their symmetric difference.

    Both sides are tagged, stacked and folded by key, so the sets meet in one partially
    aggregated shuffle. ``by`` (a subset of the keys) reports per group of keys.
    """
    side = lambda df, l, r: df.select(*keys, F.lit(l).alias("_l"), F.lit(r).alias("_r"))
    per_key = (
        side(left, 1, 0).unionAll(side(right, 0, 1))
        .groupBy(*keys).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    )
    return per_key.groupBy(*by).agg(
        F.coalesce(F.sum("_l"), F.lit(0)).cast("bigint").alias("left_rows"),
        F.coalesce(F.sum("_r"), F.lit(0)).cast("bigint").alias("right_rows"),
        F.count_if(F.col("_l") != F.col("_r")).alias("sym_diff"),
    )


def require_aligned(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> None:
    row = aligned_key_counts(left, right, keys).first()
    if row["sym_diff"]:
        raise ContractError(f"key sets differ: {row.asDict()}")
