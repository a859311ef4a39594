"""Text scalars for extracted documents: glyph repair, numbers, concentrations, headers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from evitrust.functions.names import bound

# Private-use digits U+F030..U+F039, full stop U+F02E, micro signs U+F06D and U+F0B5.
_GLYPHS = "".join(chr(0xF030 + i) for i in range(10)) + "\uf02e\uf06d\uf0b5"
_REPAIRED = "0123456789.uu"

# How numbers, concentrations and means with deviations are written.
NUMBER = r"-?\d+(?:\.\d+)?"
CONCENTRATION = r"(-?\d+(?:\.\d+)?)(\s*(?i:nM|uM|mM))"
MEAN_SEM = r"(-?\d+(?:\.\d+)?)(?:\s*±\s*(-?\d+(?:\.\d+)?))?"


def repair_glyphs(c: Column) -> Column:
    """Digits, full stops and micro signs that a PDF font mapped to private code points."""
    return F.translate(c, _GLYPHS, _REPAIRED)


def all_numbers(c: Column) -> Column:
    """Every signed decimal number in the text, as array<double>."""
    found = F.regexp_extract_all(c, F.lit(f"({NUMBER})"), F.lit(1))
    return F.transform(found, lambda x: x.cast("double"))


def concentrations(c: Column) -> Column:
    """array<struct<raw, unit, um>> for every number followed by nM, uM or mM."""
    fixed = repair_glyphs(c)
    values = F.regexp_extract_all(fixed, F.lit(CONCENTRATION), F.lit(1))
    units = F.transform(F.regexp_extract_all(fixed, F.lit(CONCENTRATION), F.lit(2)), lambda u: F.trim(u))

    def cell(v: Column, u: Column) -> Column:
        x = v.cast("double")
        um = F.when(F.lower(u) == "nm", x / 1000.0).when(F.lower(u) == "mm", x * 1000.0).otherwise(x)
        return F.struct(F.concat(v, u).alias("raw"), u.alias("unit"), um.alias("um"))

    return F.zip_with(values, units, cell)


def mean_sem_pairs(c: Column) -> Column:
    """array<struct<mean, sem>> after the word SEM (or in the whole text without it)."""
    def tail(fixed: Column) -> Column:
        at = F.instr(F.lower(fixed), "sem")
        return F.when(at > 0, F.substr(fixed, at + 3)).otherwise(fixed)

    # the text is searched once; what was found is cut at its sign
    found = F.regexp_extract_all(bound(repair_glyphs(c), tail), F.lit(MEAN_SEM), F.lit(0))
    return F.transform(found, lambda x: F.struct(
        F.trim(F.substring_index(x, "±", 1)).cast("double").alias("mean"),
        F.when(x.contains("±"), F.trim(F.substring_index(x, "±", -1)).try_cast("double")).alias("sem")))


def legacy_concentrations(c: Column) -> Column:
    """array<double> in micromolar for the older layout, which writes the micro sign."""
    fixed = F.translate(c, _GLYPHS, "0123456789.µµ")
    pattern = r"([0-9]*\.?[0-9]+)\s*(µM|uM|μM|nM)"
    values = F.regexp_extract_all(fixed, F.lit(pattern), F.lit(1))
    units = F.regexp_extract_all(fixed, F.lit(pattern), F.lit(2))
    return F.zip_with(values, units, lambda v, u: F.when(
        u == "nM", v.cast("double") / 1000.0).otherwise(v.cast("double")))


def numbers_before_plus_minus(c: Column) -> Column:
    found = F.regexp_extract_all(repair_glyphs(c), F.lit(r"([0-9]*\.?[0-9]+)\s*±"), F.lit(1))
    return F.transform(found, lambda x: x.cast("double"))


def has_digit(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\d"), F.lit(False))


def censored_number(c: Column) -> Column:
    """struct<value, relation>: first number, commas removed, relation from ``>`` or ``<``."""
    text = F.trim(c)
    digits = F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"(-?\d+\.\d+|-?\d+)", 1)
    value = digits.try_cast("double")
    relation = F.when(value.isNull(), "NA").when(text.contains(">"), ">").when(
        text.contains("<"), "<").otherwise("=")
    return F.struct(value.alias("value"), relation.alias("relation"))


def header_value_type(header: Column) -> Column:
    low = F.lower(F.coalesce(header, F.lit("")))
    return (
        F.when(low.contains("ic50"), "ic50")
        .when(low.contains("block") | low.contains("%"), "pct_block")
        .when(low.contains("cmax"), "block_cmax")
        .otherwise("unknown")
    )


def header_units(header: Column) -> Column:
    return (
        F.when(header.rlike("uM|µM|um"), "uM")
        .when(header.rlike("nM"), "nM")
        .when(header.rlike("mM"), "mM")
    )


# How micromolar is written in column names.
UNIT_HINT = r"(?i)µM|\buM\b|micromolar|micro mol|microM"


def unit_hints(df: DataFrame, key: str, columns: list[str], pattern: str = UNIT_HINT,
               at_most: int | None = None) -> DataFrame:
    """(column, key, value) of text values that mention a unit; every row is scanned.

    ``at_most`` keeps the first hits per column in key order (the size of the report).
    """
    pairs = df.select(F.col(key), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
        for c in columns])).alias("_p")).select(key, "_p.*")
    hits = pairs.where(F.col("value").rlike(pattern))
    if at_most is None:
        return hits
    w = Window.partitionBy("column_name").orderBy(key)
    return hits.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= at_most).drop("_rn")


def columns_named_with_units(df: DataFrame, pattern: str = UNIT_HINT) -> list[str]:
    """Column names that mention a unit (schema only)."""
    return [c for c in df.columns if re.search(pattern, c)]
