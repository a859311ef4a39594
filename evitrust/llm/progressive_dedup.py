"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PREFIX_CHARS = 256


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def copy_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per text held by two or more rows: text_sha256, keep_id (the largest id) and group_size.

    Lengths are counted first; among rows that share a length, hashes of the first ``prefix_chars`` characters; full
    hashes are grouped only for rows that still have a partner. What moves between tasks is (id, length, hashes), never a
    text. Groups are counts with map-side sums, so a text held by a third of all rows is no hot task.
    Null text is the empty text. Rows with a null id take part; keep_id is null only if every id of the group is.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.sha2(_text(text_col), 256).alias("text_sha256"))
    heads = docs.select(F.col(id_col).alias("_id"), F.octet_length(_text(text_col)).alias("_n"),
                        F.xxhash64(F.substring(_text(text_col), 1, prefix_chars)).alias("_head"))
    lengths = heads.groupBy("_n").count().where("count > 1").select("_n")
    same_length = heads.join(lengths, "_n", "left_semi")
    same_head = same_length.groupBy("_n", "_head").count().where("count > 1").select("_n", "_head")
    left = same_length.join(same_head, ["_n", "_head"], "left_semi").select(F.col("_id").alias("_left"))
    full = rows.join(left, F.col("_id").eqNullSafe(F.col("_left")), "left_semi")
    return (full.groupBy("text_sha256")
            .agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
            .where("group_size > 1"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """Every row with the row of its text that stays: id, keep_id, group_size, kept, text_sha256.

    Empty and null texts form one group. Repeated rows with one id and one text are all marked kept if their id is
    the largest. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    classes = copy_classes(docs, id_col, text_col, prefix_chars)
    rows = docs.select(F.col(id_col).alias(id_col), F.sha2(_text(text_col), 256).alias("text_sha256"))
    out = rows.join(classes, "text_sha256", "left")
    keep = F.when(F.col("group_size").isNull(), F.col(id_col)).otherwise(F.col("keep_id"))
    return out.select(
        id_col, keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col(id_col).eqNullSafe(keep).alias("kept"), "text_sha256")
