"""Casts, code mapping, unit conversion and filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evitrust.functions.names import lookup

# Factor to micromolar.
UNIT_FACTORS = {
    "nm": 1.0 / 1000.0, "nanomolar": 1.0 / 1000.0,
    "um": 1.0, "µm": 1.0, "μm": 1.0, "micromolar": 1.0,
    "mm": 1000.0, "millimolar": 1000.0,
    "pm": 1.0 / 1_000_000.0, "picomolar": 1.0 / 1_000_000.0,
}
# Measurement types and relations accepted by the relaxed filter.
RELAXED_TYPES = ["IC50", "Ki"]
RELAXED_RELATIONS = ["=", "<", "<=", ">", ">=", "~"]


def standardized(c: Column, upper: bool = False) -> Column:
    out = F.trim(c.cast("string"))
    return F.upper(out) if upper else out


def to_double(c: Column) -> Column:
    """Number or null; text that is no number and NaN become null."""
    x = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(x), x)


def to_long(c: Column) -> Column:
    """Whole number or null; ``3.0`` counts as 3, anything fractional or unreadable is null."""
    x = to_double(c)
    return F.when(x == F.floor(x), x.try_cast("bigint"))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in any float column becomes null, so one missing marker is left."""
    fixes = {name: F.when(~F.isnan(name), F.col(name)) for name, kind in df.dtypes if kind in ("double", "float")}
    return df.withColumns(fixes) if fixes else df


def project(df: DataFrame, renames: Mapping[str, str], order: Sequence[str] | None = None) -> DataFrame:
    """Rename by map and select in a declared order."""
    out = df.withColumnsRenamed(dict(renames))
    return out.select(*order) if order else out


def map_code(c: Column, mapping: Mapping[str, str]) -> Column:
    """Exact code mapping; unknown codes fall through."""
    return lookup(c, mapping)


def map_by_prefix(c: Column, mapping: Mapping[str, str]) -> Column:
    """Value of the longest prefix the text starts with (case ignored), null if none."""
    low = F.lower(F.trim(c))
    out = F.lit(None).cast("string")
    for key in sorted(mapping, key=len):  # the longest is tested first, so it wraps last
        out = F.when(low.startswith(key.lower()), F.lit(mapping[key])).otherwise(out)
    return out


def map_by_patterns(c: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """Value of the first regular expression that is found (case ignored), null if none."""
    out = F.lit(None).cast("string")
    for pattern, value in reversed(list(patterns)):
        out = F.when(c.rlike("(?i)" + pattern), F.lit(value)).otherwise(out)
    return out


def to_micromolar(value: Column, unit: Column) -> Column:
    """Value in micromolar; null for an unknown unit."""
    u = F.lower(F.trim(unit))
    return (
        F.when(u.isin("nm", "nanomolar"), value / 1000.0)
        .when(u.isin("um", "µm", "μm", "micromolar"), value)
        .when(u.isin("mm", "millimolar"), value * 1000.0)
        .when(u.isin("pm", "picomolar"), value / 1_000_000.0)
    )


def convert_activities(df: DataFrame, value: str = "standard_value", unit: str = "units") -> DataFrame:
    """Add ``value_um`` and keep rows whose number and unit can be read."""
    number = to_double(F.col(value))
    return df.withColumn("value_um", to_micromolar(number, F.col(unit))).where(F.col("value_um").isNotNull())


def is_strict(kind: str = "standard_type", relation: str = "relation") -> Column:
    return (F.col(kind) == "IC50") & (F.col(relation) == "=")


def strict_rows(df: DataFrame, kind: str = "standard_type", relation: str = "relation", **names) -> DataFrame:
    """Exact IC50 values with a convertible unit."""
    return convert_activities(df.where(is_strict(kind, relation)), **names)


def relaxed_rows(df: DataFrame, kind: str = "standard_type", relation: str = "relation", **names) -> DataFrame:
    """IC50 and Ki with any known relation, each row flagged strict or not."""
    kept = df.where(F.col(kind).isin(RELAXED_TYPES) & F.col(relation).isin(RELAXED_RELATIONS))
    return convert_activities(kept, **names).withColumn("is_strict_row", is_strict(kind, relation))


def first_present(*cols: Column) -> Column:
    """First non-null, non-NaN value."""
    return F.coalesce(*[F.when(~F.isnan(c), c) for c in cols])


def imputed_flag(c: Column) -> Column:
    return c.isNull().cast("int")


def provenance(df: DataFrame, **literals) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in literals.items()})
