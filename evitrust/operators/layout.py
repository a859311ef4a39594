"""Word boxes to lines, columns and cell statistics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window, functions as F

from evitrust import ordering
from evitrust.functions import text as X
from evitrust.functions.columns import map_by_patterns
from evitrust.sources.shared import written

# Text pattern of a row label -> channel, first match wins.
CHANNEL_PATTERNS = [
    (r"kvlqt1|kv1qt1|min[km]", "IKs"),
    (r"kir2\.?1", "IK1"),
    (r"kv4\.?3|ito", "Kv4.3"),
    (r"nav1\.?5.*late", "Nav1.5_late"),
    (r"nav1\.?5.*peak", "Nav1.5_peak"),
    (r"nav1\.?5", "Nav1.5_peak"),
    (r"cav1\.?2", "Cav1.2"),
    (r"herg", "hERG"),
]


def _walk_heights(page: str, tolerance: float):
    """Streams sorted (page, stretch, height) rows; only the current line's first height is kept."""
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, anchor = None, 0.0
        for batch in batches:
            anchors = np.empty(len(batch))
            keys = zip(batch[page].tolist(), batch["_stretch"].tolist())
            for i, (key, y) in enumerate(zip(keys, batch["y_center"].tolist())):
                if key != current or y - anchor > tolerance:
                    current, anchor = key, y
                anchors[i] = anchor
            yield batch.assign(line_y=anchors)
    return walk


def assign_lines(words: DataFrame, tolerance: float = 10.0, page: str = "page") -> DataFrame:
    """Add ``line_y``: the height of the first word of the line each word belongs to.

    A word joins the line whose first word is at most ``tolerance`` above it. Only distinct heights are
    walked, split into unbroken stretches: where a band of one tolerance holds no word, a new line must
    start, so stretches do not depend on each other and spread over tasks.
    """
    band = F.floor(F.col("y_center") / F.lit(tolerance))
    heights = words.select(page, "y_center").distinct().withColumn("_band", band)
    bands = heights.select(page, "_band").distinct()
    order = Window.partitionBy(page).orderBy("_band")
    gap = F.coalesce((F.col("_band") - F.lag("_band").over(order) > 1).cast("int"), F.lit(0))
    bands = bands.withColumn("_gap", gap).withColumn(
        "_stretch", F.sum("_gap").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap")
    kinds = dict(words.dtypes)
    sorted_heights = (
        heights.join(bands, [page, "_band"]).select(page, "_stretch", "y_center")
        .repartition(page, "_stretch").sortWithinPartitions(page, "_stretch", "y_center")
    )
    walked = sorted_heights.mapInPandas(
        _walk_heights(page, tolerance), f"{page} {kinds[page]}, _stretch bigint, y_center double, line_y double")
    return words.join(walked.drop("_stretch"), [page, "y_center"])


def assign_columns(words: DataFrame, headers: DataFrame, page: str = "page", out: str = "col_no") -> DataFrame:
    """Add the 0-based column of each word: the number of midpoints between header centres left of it.

    ``headers`` has (page, x_center), a handful of rows per page.
    """
    centres = headers.groupBy(page).agg(F.sort_array(F.collect_list("x_center")).alias("_c"))
    mids = F.transform(F.slice("_c", 2, F.size("_c")), lambda x, i: (x + F.get("_c", i)) / 2)
    bounds = centres.select(page, mids.alias("_bounds"))
    return words.join(bounds, page).withColumn(
        out, F.size(F.filter("_bounds", lambda b: b < F.col("x_center")))).drop("_bounds")


def cell_statistics(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count, mean and standard error of all numbers in the words of each cell."""
    numbers = words.select(*keys, F.explode(X.all_numbers(F.col("text"))).alias("x"))
    n = F.count(F.lit(1))
    return numbers.groupBy(*keys).agg(
        n.alias("n"), F.avg("x").alias("block_mean"),
        (F.stddev_samp("x") / F.sqrt(n.cast("double"))).alias("block_sem"))


def line_texts(words: DataFrame, page: str = "page") -> DataFrame:
    """Text of each line, words in reading order."""
    return words.groupBy(page, "line_y").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("x_center", "text"))), lambda w: w["text"]), " ").alias("line_text"))


def panel_from_words(words: DataFrame, tolerance: float = 10.0, page: str = "page") -> DataFrame:
    """Channel rows of word-box pages: (page, channel, concentration, block_mean, block_sem).

    The first line that mentions ``current`` gives the concentration columns; every line that names a
    channel is a row; its words right of the first header word are the cells.
    """
    words = written(words)      # read for the heights and for the words
    n_rows = words.count()
    # large tables go to tasks of bounded size, each time by the keys of the steps that follow
    lined = assign_lines(ordering.dealt(words, [page, "y_center"], n_rows), tolerance, page)
    lined = ordering.dealt(lined, [page, "line_y"], n_rows).persist(StorageLevel.DISK_ONLY)  # read four times
    texts = line_texts(lined, page)
    head = texts.where(F.lower("line_text").contains("current")).groupBy(page).agg(F.min("line_y").alias("line_y"))
    head_words = lined.join(head, [page, "line_y"], "left_semi")
    conc = F.get(X.concentrations(F.replace("text", F.lit("µ"), F.lit("u"))), F.lit(0))
    concs = head_words.select(page, "x_center", conc.alias("c")).where(F.col("c").isNotNull())
    first_x = head_words.groupBy(page).agg(F.min("x_center").alias("_x0"))
    rows = texts.select(page, "line_y", map_by_patterns(F.col("line_text"), CHANNEL_PATTERNS).alias("channel")).where(
        F.col("channel").isNotNull())
    cells = ordering.dealt(lined.join(rows, [page, "line_y"]), [page], n_rows)
    first_x = ordering.dealt(first_x, [page], n_rows)       # both sides, else the smaller number of tasks is taken
    cells = cells.join(first_x, page).where(F.col("x_center") > F.col("_x0"))
    cells = assign_columns(cells, concs.select(page, "x_center"), page)
    stats = cell_statistics(cells, [page, "line_y", "channel", "col_no"])
    numbered = concs.groupBy(page).agg(F.sort_array(F.collect_list(F.struct("x_center", "c"))).alias("_cs"))
    return stats.join(numbered, page).withColumn("_c", F.get("_cs", F.col("col_no"))["c"]).select(
        page, "line_y", "channel", "col_no", F.col("_c.raw").alias("concentration_raw"),
        F.col("_c.um").alias("concentration_uM"), "n", "block_mean", "block_sem")
