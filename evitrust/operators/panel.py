"""Text panels (entity line, concentration line, channel lines with replicates) to long rows.

A document is one string value, so it is parsed inside its row: its lines become an array, marks of the lines are arrays
beside it, and one pass over a batch of documents folds them. Nothing is shuffled between the scan and the parsed cells,
and rows with the same id are parsed one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from evitrust.functions import text as X
from evitrust.functions.columns import map_by_prefix

# How a channel line starts -> channel name.
CHANNEL_PREFIXES = {
    "herg": "hERG",
    "nav1.5-peak": "Nav1.5_peak",
    "nav1.5-late": "Nav1.5_late",
    "cav1.2": "Cav1.2",
    "kvlqt1/mink": "IKs",
    "kir2.1": "IK1",
    "kv4.3": "Kv4.3",
}


_SPACE = " \t\n\x0b\f\r"


def numbered_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, pos, raw, norm): one row per line; ``norm`` has glyphs repaired and both ends stripped."""
    lines = docs.select(doc, F.posexplode(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n")).alias("pos", "_t"))
    return lines.select(doc, "pos", F.rtrim("_t", F.lit(_SPACE)).alias("raw"), _norm(F.col("_t")).alias("norm"))


def _norm(line: Column) -> Column:
    return F.btrim(X.repair_glyphs(line), F.lit(_SPACE))


def _line_arrays(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, _lines): the lines of ``numbered_lines`` as one array<struct<raw, norm>> for each row."""
    lines = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n")
    return docs.select(doc, F.transform(lines, lambda x: F.struct(
        F.rtrim(x, F.lit(_SPACE)).alias("raw"), _norm(x).alias("norm"))).alias("_lines"))


# What a line is to the panel fold.
_PLAIN, _HEADER, _CHANNEL, _SEM = range(4)

_EVENTS = T.ArrayType(T.StructType([T.StructField(name, T.IntegerType()) for name in ("block", "run", "pos")] + [
    T.StructField(name, T.StringType()) for name in ("entity", "channel", "header", "rep_text", "mean_line")]))


def _fold_lines(named, kinds, pieces, channels, mean_lines) -> list[tuple]:
    """Header events (run is null) and channel-line events of one document, in line order."""
    events, block, run = [], 0, 0
    last = entity = header = None
    for pos, kind in enumerate(kinds):
        if kind == _HEADER:
            block, entity, header = block + 1, last, pieces[pos]
            events.append([block, None, pos, entity, None, header, None, None])
            collected = None
        elif kind == _CHANNEL and block:
            run += 1
            collected = [pieces[pos]]
            events.append([block, run, pos, entity, channels[pos], header, collected, None])
        elif block and collected is not None:
            collected.append(pieces[pos])
            if kind == _SEM:
                events[-1][-1], collected = mean_lines[pos], None
        last = named[pos] or last
    return [(*e[:6], None if e[1] is None else " ".join(filter(None, e[6])), e[7]) for e in events]


@F.pandas_udf(_EVENTS)
def fold_panel_lines(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    """Events of each document from the marks of its lines; no text, no events."""
    for columns in batches:
        yield pd.Series([[] if row[0] is None else _fold_lines(*row) for row in zip(*columns)], dtype=object)


def panel_events(docs: DataFrame, doc: str = "doc_id", text: str = "text",
                 prefixes: Mapping[str, str] = CHANNEL_PREFIXES) -> DataFrame:
    """One row per header line (``run`` is null) and per channel line below one, without a shuffle.

    An entity is the last line with text above the header. A channel line collects replicate text up to the first SEM
    line, the next channel line or the next header.
    """
    keys = sorted(prefixes, key=len)

    def longest(low: Column, value) -> Column:
        """Value of the longest prefix; the longest is tested first, so it wraps last."""
        out = F.lit(None)
        for key in keys:
            out = F.when(low.startswith(key.lower()), F.lit(value(key))).otherwise(out)
        return out

    def read(line: Column) -> Column:
        return F.struct(F.trim(line["raw"]).alias("named"), line["norm"].alias("norm"), F.lower(line["norm"]).alias("low"))

    def find(line: Column) -> Column:
        is_header, low = line["low"].startswith("current"), line["low"]
        return F.struct(
            line["named"].alias("named"), line["norm"].alias("norm"), low.alias("low"), is_header.alias("head"),
            F.when(~is_header, longest(low, prefixes.get)).cast("string").alias("channel"),
            F.when(~is_header, longest(low, len)).cast("int").alias("cut"),
            (low.contains("sem") & ~is_header).alias("sem"))

    def mark(line: Column) -> Column:
        norm, is_channel = line["norm"], line["cut"].isNotNull()
        splits_x = line["sem"] & line["low"].contains("x")
        part = lambda i: F.trim(F.coalesce(F.get(F.split(norm, r"(?i)x\s*±\s*sem"), F.lit(i)), F.lit("")))
        return F.struct(
            line["named"].alias("named"),
            F.when(line["head"], _HEADER).when(is_channel, _CHANNEL).when(line["sem"], _SEM).otherwise(_PLAIN).alias("kind"),
            F.when(is_channel, F.trim(F.substr(norm, line["cut"] + 1))).when(splits_x, part(0))
            .when(line["sem"], F.lit("")).otherwise(norm).alias("piece"),
            line["channel"].alias("channel"),
            F.when(~line["sem"] | is_channel, None).when(splits_x, F.trim(F.concat(F.lit("X ± SEM "), part(1))))
            .otherwise(norm).alias("mean_line"))

    # One step after the other, so that nothing is computed twice for a line.
    steps = F.transform(F.transform(F.transform("_lines", read), find), mark)
    marked = _line_arrays(docs, doc, text).select(doc, steps.alias("_m"))
    fields = [F.col("_m")[name] for name in ("named", "kind", "piece", "channel", "mean_line")]
    return marked.select(doc, F.inline(fold_panel_lines(*fields)))


def _best_splits(values: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Ends of the contiguous groups of each row of ``values`` whose means are closest to ``means`` (least squares)."""
    rows, n = values.shape
    k = means.shape[1]
    cost = np.full((rows, n + 1, k + 1), np.inf)
    back = np.zeros((rows, n + 1, k + 1), dtype=np.int64)
    cost[:, 0, 0] = 0.0
    for start in range(n):
        group_means = np.cumsum(values[:, start:], axis=1) / np.arange(1, n - start + 1)
        for j in range(1, min(start + 1, k) + 1):
            trial = cost[:, start, j - 1, None] + (group_means - means[:, j - 1, None]) ** 2
            better = trial < cost[:, start + 1:, j]
            cost[:, start + 1:, j][better] = trial[better]
            back[:, start + 1:, j][better] = start
    ends = np.empty((rows, k + 1), dtype=np.int64)
    ends[:, k] = n
    for j in range(k, 0, -1):
        ends[:, j - 1] = back[np.arange(rows), ends[:, j], j]
    return ends


def _best_split(values: np.ndarray, means: np.ndarray) -> list[np.ndarray]:
    """The groups of one row of ``_best_splits``."""
    ends = _best_splits(np.asarray(values, float)[None], np.asarray(means, float)[None])[0]
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:])]


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def split_by_means(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Optimal contiguous split of each row's numbers against its reported means, null without means.

    Rows with as many numbers and as many means are split together, about a million costs at once.
    """
    for values, means in batches:
        out, alike = [None] * len(values), {}
        for i, (v, m) in enumerate(zip(values, means)):
            if v is not None and m is not None and 0 < len(m) <= len(v):
                alike.setdefault((len(v), len(m)), []).append(i)
        vs, ms = values.tolist(), means.tolist()
        for (n, k), rows in alike.items():
            step = max(1, 1_000_000 // ((n + 1) * (k + 1)))
            for at in range(0, len(rows), step):
                some = rows[at:at + step]
                v = np.array([vs[i] for i in some], dtype=float)
                ends = _best_splits(v, np.array([ms[i] for i in some], dtype=float)).tolist()
                for i, row, e in zip(some, v.tolist(), ends):
                    out[i] = [row[a:b] for a, b in zip(e[:-1], e[1:])]
        yield pd.Series(out, dtype=object)


def replicate_groups(df: DataFrame, text: str, n_groups: str, means: str) -> DataFrame:
    """Add ``groups`` (one array of numbers per concentration) and ``method``.

    Reported means decide where given (``dp_means``); else comma groups (``regex``); else equal
    parts (``fallback_equal``); else empty groups (``empty``).
    """
    k = F.col(n_groups)
    clean = F.trim(F.regexp_replace(X.repair_glyphs(F.col(text)), r"\s+", " "))
    with_means = F.size(means) == k
    work = df.withColumn("_clean", clean).withColumns({
        "_values": X.all_numbers(F.col("_clean")),
        "_comma": F.regexp_extract_all("_clean", F.lit(r"(-?\d+(?:\.\d+)?(?:\s*,\s*-?\d+(?:\.\d+)?)+)"), F.lit(1)),
    })
    usable = with_means & (k > 0) & (F.size("_values") >= k)
    work = work.withColumn("_dp", split_by_means(
        F.when(usable, F.col("_values")), F.when(usable, F.transform(means, lambda m: m["mean"]))))
    base = F.greatest(F.lit(1), F.floor(F.size("_values") / F.when(k > 0, k)).cast("int"))
    no_numbers = F.array().cast("array<double>")
    equal = F.transform(F.sequence(F.lit(0), F.greatest(k, F.lit(1)) - 1), lambda i: F.when(
        i * base < F.size("_values"), F.slice("_values", i * base + 1, base)).otherwise(no_numbers))
    empty = F.transform(F.sequence(F.lit(1), k), lambda i: no_numbers)
    by_comma = F.transform("_comma", X.all_numbers)
    method = (
        F.when(F.col("_dp").isNotNull(), "dp_means").when(F.size("_comma") == k, "regex")
        .when(F.size("_values") > 0, "fallback_equal").otherwise("empty")
    )
    return work.withColumn("method", method).withColumn(
        "groups",
        F.when(F.col("method") == "dp_means", F.col("_dp")).when(F.col("method") == "regex", by_comma)
        .when(F.col("method") == "fallback_equal", equal).otherwise(empty),
    ).drop("_clean", "_values", "_comma", "_dp")


def panel_runs(docs: DataFrame, doc: str = "doc_id", text: str = "text",
               prefixes: Mapping[str, str] = CHANNEL_PREFIXES) -> DataFrame:
    """One row per channel line: its block's entity and concentrations, replicate text, reported means."""
    return _with_values(panel_events(docs, doc, text, prefixes).where(F.col("run").isNotNull())).drop("pos", "mean_line")


def _with_values(events: DataFrame) -> DataFrame:
    means = F.when(F.col("mean_line").isNull(), F.array().cast("array<struct<mean:double,sem:double>>")).otherwise(
        X.mean_sem_pairs(F.col("mean_line")))
    return events.withColumns({"concs": X.concentrations(F.col("header")), "means": means})


def parse_panels(docs: DataFrame, doc: str = "doc_id", text: str = "text",
                 prefixes: Mapping[str, str] = CHANNEL_PREFIXES) -> DataFrame:
    """Long rows per (doc, block, channel line, concentration) with replicate statistics."""
    runs = panel_runs(docs, doc, text, prefixes).where(F.col("entity").isNotNull() & (F.size("concs") > 0))
    grouped = replicate_groups(runs.withColumn("n_conc", F.size("concs")), "rep_text", "n_conc", "means")
    cells = grouped.select(doc, "block", "run", "entity", "channel", "method", "groups", "means",
                           F.posexplode("concs").alias("conc_no", "conc"))
    group = F.coalesce(F.get("groups", F.col("conc_no")), F.array().cast("array<double>"))
    cells = cells.withColumn("replicates", group)
    n = F.size("replicates")
    total = F.aggregate("replicates", F.lit(0.0), lambda a, x: a + x)
    cells = cells.withColumn("_mean", F.when(n > 0, total / F.when(n > 0, n)))  # a column, so lambdas do not recompute it
    squares = F.aggregate("replicates", F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean")))
    mean, reported = F.col("_mean"), F.get("means", F.col("conc_no"))
    return cells.select(
        doc, "block", "run", F.col("entity").alias("name_raw"), "channel", "method", "conc_no",
        F.col("conc.raw").alias("concentration_raw"), F.col("conc.unit").alias("concentration_unit"),
        F.col("conc.um").alias("concentration_uM"),
        F.when(n > 0, F.to_json("replicates")).alias("block_pct_replicates"), n.alias("block_pct_n"),
        F.coalesce(mean, reported["mean"]).alias("block_pct_mean"),
        F.when(n > 1, F.sqrt(squares / F.when(n > 1, n - 1))).alias("block_pct_std"),
        reported["mean"].alias("block_pct_mean_reported"), reported["sem"].alias("block_pct_sem_reported"),
    )


def parse_warnings(docs: DataFrame, doc: str = "doc_id", text: str = "text",
                   prefixes: Mapping[str, str] = CHANNEL_PREFIXES) -> DataFrame:
    """(doc, block, entity, channel, issue, detail) for everything the parser had to guess or skip, from one pass."""
    events = _with_values(panel_events(docs, doc, text, prefixes)).withColumn("n_conc", F.size("concs"))
    parsed = replicate_groups(events, "rep_text", "n_conc", "means")
    is_head = F.col("run").isNull()
    read = ~is_head & F.col("entity").isNotNull() & (F.col("n_conc") > 0)
    issue = lambda when, name, detail: F.when(when, F.struct(F.lit(name).alias("issue"), detail.alias("detail")))
    sizes = F.concat(F.lit("groups="), F.size("groups"), F.lit(" conc="), F.col("n_conc"))
    how = F.concat(F.lit("method="), F.col("method"))
    issues = F.array_compact(F.array(
        issue(is_head & F.col("entity").isNull(), "missing_drug_name", F.concat(F.lit("at line "), F.col("pos"))),
        issue(is_head & F.col("entity").isNotNull() & (F.col("n_conc") == 0), "missing_concentration", F.col("header")),
        issue(read & ~F.col("method").isin("dp_means", "regex"), "replicate_group_fallback", how),
        issue(read & (F.size("groups") != F.col("n_conc")), "replicate_group_mismatch", F.concat(sizes, F.lit(" "), how)),
        issue(read & (F.size("groups") < F.col("n_conc")), "channel_cells_padded", sizes),
    ))
    entity = F.when(is_head, F.coalesce("entity", F.lit("<unknown>"))).otherwise(F.col("entity"))
    return parsed.select(doc, "block", entity.alias("entity"), "channel", F.inline(issues))


def warning_counts(warnings: DataFrame) -> DataFrame:
    return warnings.groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def latest_true(flags: pd.Series) -> pd.Series:
    """For each place of an array, the last place up to it that is true, -1 before the first."""
    return pd.Series([None if f is None else np.maximum.accumulate(
        np.where(np.asarray(f, dtype=bool), np.arange(len(f)), -1)).tolist() for f in flags], dtype=object)


def parse_legacy_panels(docs: DataFrame, doc: str = "doc_id", text: str = "text",
                        prefixes: Mapping[str, str] = CHANNEL_PREFIXES) -> DataFrame:
    """Older layout: a channel line is followed by its ``mean ± sem`` line. Rows whose number of means
    differs from the number of concentrations are dropped. Each channel line belongs to the closest
    header line above it on its page."""
    lines = F.transform("_lines", lambda x, i: F.struct(x["raw"].alias("raw"), x["norm"].alias("norm"), i.alias("pos")))
    kept = _line_arrays(docs, doc, text).select(doc, F.filter(lines, lambda x: x["norm"] != "").alias("_l"))
    headed = kept.withColumn("_h", latest_true(F.transform("_l", lambda x: F.lower(x["norm"]).startswith("current"))))

    def row(line: Column, i: Column) -> Column:
        at = F.get("_h", i)
        return F.struct(
            F.get("_l", at - 1)["raw"].alias("above"), F.get("_l", at)["norm"].alias("header"), line["pos"].alias("pos"),
            F.when(at < i, map_by_prefix(line["norm"], prefixes)).alias("channel"), F.get("_l", i + 1)["norm"].alias("next"))

    found = F.filter(F.transform("_l", row), lambda r: r["channel"].isNotNull() & r["above"].isNotNull())
    rows = headed.select(doc, F.inline(found)).withColumn("name_raw", F.trim("above"))
    rows = rows.withColumns({"concs": X.legacy_concentrations(F.col("header")),
                             "means": X.numbers_before_plus_minus(F.coalesce("next", F.lit("")))})
    rows = rows.where((F.size("concs") > 0) & (F.size("concs") == F.size("means")))
    return rows.select(doc, "name_raw", "channel", "pos",
                       F.posexplode(F.arrays_zip("concs", "means")).alias("conc_no", "z")).select(
        doc, "name_raw", "channel", "pos", "conc_no", F.col("z.concs").alias("concentration_uM"),
        F.col("z.means").alias("block_pct_mean"))


# --- tables inside text ---------------------------------------------------------------------

@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(name, T.IntegerType()) for name in ("table_no", "first", "n")])))
def true_runs(flags: pd.Series) -> pd.Series:
    """Unbroken runs of true in each array: how many false places stand before, first place, length."""
    def runs(f):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], np.asarray(f, dtype=np.int8), [0]))))
        first, n = edges[::2], edges[1::2] - edges[::2]
        before = first - (np.cumsum(n) - n)
        return list(zip(before.tolist(), first.tolist(), n.tolist()))
    return pd.Series([None if f is None else runs(f) for f in flags], dtype=object)


def detect_tables(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_parts: int = 4,
                  min_numeric: int = 2, min_rows: int = 2) -> DataFrame:
    """Runs of consecutive table-like lines as (doc, table_no, first_pos, last_pos, n_rows, n_cols)."""
    tables = _text_tables(docs, doc, text, min_parts, min_numeric, min_rows)
    return tables.select(
        doc, "table_no", F.get("rows", F.lit(0))["pos"].alias("first_pos"), F.element_at("rows", -1)["pos"].alias("last_pos"),
        F.size("rows").cast("bigint").alias("n_rows"), F.array_max(F.transform("rows", lambda r: F.size(r["parts"]))).alias("n_cols"))


def _text_tables(docs, doc, text, min_parts, min_numeric, min_rows):
    """(doc, table_no, rows array<struct<pos, parts>>): tables are found and cut inside the row of a document."""
    lines = F.filter(F.transform("_lines", lambda x, i: F.struct(
        i.alias("pos"), F.regexp_replace(x["raw"], r"^\s+", "").alias("s"))), lambda x: x["s"] != "")
    split = F.transform("_s", lambda x: F.struct(x["pos"].alias("pos"), F.split(x["s"], r"\s{2,}").alias("parts")))
    digits = lambda parts: F.size(F.filter(parts, lambda p: p.rlike(r"\d")))
    like_table = F.transform("_l", lambda x: (F.size(x["parts"]) >= min_parts) & (digits(x["parts"]) >= min_numeric))
    split_lines = _line_arrays(docs, doc, text).select(doc, lines.alias("_s")).select(doc, split.alias("_l"))
    runs = split_lines.withColumn("_runs", true_runs(like_table))
    tables = F.transform(F.filter("_runs", lambda r: r["n"] >= min_rows), lambda r: F.struct(
        r["table_no"].alias("table_no"), F.slice("_l", r["first"] + 1, r["n"]).alias("rows")))
    return runs.select(doc, F.inline(tables))


def table_cells(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_parts: int = 4,
                min_numeric: int = 2, min_rows: int = 2) -> DataFrame:
    """Cells (doc, table_no, row_no, col_no, cell_text) of the detected tables."""
    tables = _text_tables(docs, doc, text, min_parts, min_numeric, min_rows)
    rows = tables.select(doc, "table_no", F.posexplode("rows").alias("row_no", "_r"))
    return rows.select(doc, "table_no", "row_no", F.posexplode("_r.parts").alias("col_no", "cell_text"))


def table_signatures(cells: DataFrame, keys: Sequence[str] = ("table_id",)) -> DataFrame:
    """Rows, columns, share of numeric cells and header-likeness of each table of cells."""
    keys = list(keys)
    is_num = X.has_digit(F.col("cell_text"))
    per_row = cells.groupBy(*keys, "row_no").agg(
        F.count(F.lit(1)).alias("_c"), F.count_if(is_num).alias("_num"),
        F.count_if((F.coalesce(F.col("cell_text"), F.lit("")) != "") & ~is_num).alias("_words"))
    first = F.min_by(F.struct("_c", "_words"), "row_no")
    out = per_row.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("_c").alias("n_cols"), F.sum("_num").alias("_num"), first.alias("_f"))
    area = F.col("n_rows") * F.col("n_cols")
    return out.select(
        *keys, "n_rows", "n_cols", (F.col("_num") / area).alias("numeric_pct"),
        (F.col("_f._words") >= F.greatest(F.lit(1), F.floor(F.col("_f._c") / 2))).alias("header_like"))


def cells_to_long(cells: DataFrame, channels: Sequence[str] = (), key: str = "table_id") -> DataFrame:
    """Wide extracted tables to one row per readable value cell: entity from column 0, censored value,
    value type and units from the header row, concentration from the column header."""
    sig = table_signatures(cells, [key]).select(key, "header_like")
    first = cells.groupBy(key).agg(F.min("row_no").alias("_first"))
    tagged = cells.join(first, key).withColumn("_is_head", F.col("row_no") == F.col("_first"))
    head = tagged.where("_is_head")
    low, txt = F.lower("cell_text"), F.col("cell_text")
    traits = head.groupBy(key).agg(
        F.bool_or(low.contains("ic50")).alias("_ic50"),
        F.bool_or(low.contains("block") | low.contains("%")).alias("_block"), F.bool_or(low.contains("cmax")).alias("_cmax"),
        F.bool_or(txt.rlike("uM|µM|um")).alias("_um"), F.bool_or(txt.rlike("nM")).alias("_nm"),
        F.bool_or(txt.rlike("mM")).alias("_mm")).join(sig, key)
    traits = traits.select(
        key, "header_like",
        F.when(F.col("header_like") & F.col("_ic50"), "ic50").when(F.col("header_like") & F.col("_block"), "pct_block")
        .when(F.col("header_like") & F.col("_cmax"), "block_cmax").otherwise("unknown").alias("value_type"),
        F.when(F.col("header_like") & F.col("_um"), "uM").when(F.col("header_like") & F.col("_nm"), "nM")
        .when(F.col("header_like") & F.col("_mm"), "mM").alias("units"))
    labels = head.select(key, "col_no", F.trim("cell_text").alias("header_label"))
    body = tagged.join(traits, key).where(~(F.col("_is_head") & F.col("header_like")))
    names = body.where(F.col("col_no") == 0).select(key, "row_no", F.trim("cell_text").alias("name_raw")).where(
        F.col("name_raw").rlike("[a-zA-Z]"))
    values = body.where((F.col("col_no") > 0) & (F.trim("cell_text") != "")).withColumn("_v", X.censored_number(F.col("cell_text")))
    values = values.where(F.col("_v.value").isNotNull()).join(names, [key, "row_no"]).join(labels, [key, "col_no"], "left")
    label = F.coalesce("header_label", F.lit(""))
    channel = channels[0] if len(channels) == 1 else "multiple"
    return values.select(
        key, "row_no", "col_no", "name_raw", F.lit(channel).alias("channel"),
        F.lit("|".join(channels)).alias("channel_candidates"), "value_type", F.col("_v.value").alias("value"),
        F.trim("cell_text").alias("value_raw"), F.col("_v.relation").alias("relation"), "units",
        F.when(X.has_digit(label), X.censored_number(label)["value"]).alias("concentration_uM"),
        label.alias("header_label"))


# Words that show a first-column cell is a heading.
_HEADING_WORDS = ["ic50", "block", "conc", "drug", "mean", "sem"]


def candidate_entities(cells: DataFrame, key: str = "table_id", longest: int = 40) -> DataFrame:
    """(table, row, candidate) from first-column cells that read like a name."""
    first = cells.groupBy(key).agg(F.min("row_no").alias("_first"))
    tagged = cells.join(first, key)
    has_drug = tagged.where(F.col("row_no") == F.col("_first")).groupBy(key).agg(
        F.bool_or(F.lower("cell_text").contains("drug")).alias("_skip"))
    body = tagged.join(has_drug, key).where(
        (F.col("col_no") == 0) & ~(F.col("_skip") & (F.col("row_no") == F.col("_first"))))
    cell = F.trim("cell_text")
    heading = F.lit(False)
    for w in _HEADING_WORDS:
        heading = heading | F.lower(cell).contains(w)
    return body.where(cell.rlike("[a-zA-Z]") & (F.length(cell) <= longest) & ~heading).select(
        key, "row_no", cell.alias("candidate"))


# --- term mentions --------------------------------------------------------------------------

def term_mentions(docs: DataFrame, terms: Sequence[str], doc: str = "doc_id", text: str = "text",
                  squeeze: bool = False) -> DataFrame:
    """(doc, term) for each term found in the whole text: case ignored, or letters and digits only.

    ``squeeze`` takes letters and digits of the text and of the terms and reports the term as it was given; otherwise a
    term is reported in lower case. The term list is an argument, so it fits the driver; its length changes nothing.
    """
    plain = lambda x: re.sub("[^a-z0-9]+", "", x.lower()) if squeeze else x.lower()
    wanted = sorted({(t if squeeze else t.lower(), plain(t)) for t in terms if plain(t)})
    low = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "") if squeeze else F.lower(text)
    if not wanted:
        return docs.select(doc, F.lit("").alias("term")).where("false")
    pairs = F.arrays_zip(F.lit([t for t, _ in wanted]).alias("term"), F.lit([k for _, k in wanted]).alias("key"))
    found = F.filter(F.col("_pairs"), lambda p: F.contains(F.col("_low"), p["key"]))
    return docs.select(doc, low.alias("_low"), pairs.alias("_pairs")).select(
        doc, F.explode(found).alias("_hit")).select(doc, F.col("_hit.term").alias("term"))


def term_coverage(mentions: DataFrame, terms: Sequence[str], doc: str = "doc_id") -> DataFrame:
    """Documents per term, zero for a term without mention."""
    per = mentions.groupBy("term").agg(F.count_distinct(doc).alias("n_docs"))
    frame = mentions.sparkSession.createDataFrame([(t.lower(),) for t in sorted(set(terms))], "term string")
    return frame.join(per, "term", "left").fillna({"n_docs": 0})
