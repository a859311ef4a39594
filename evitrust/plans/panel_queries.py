"""Text scalars, panel parsing, extracted tables, term mentions and word-box layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evitrust.functions import text as X
from evitrust.operators import layout, panel
from evitrust.plans.registry import Tables, query
from evitrust.plans.trust_queries import rounded

# --- rendered panels -------------------------------------------------------------------------

CHANNEL_WORDS = ["hERG", "Nav1.5-peak", "Nav1.5-late", "Cav1.2", "KvLQT1/mink", "Kir2.1", "Kv4.3"]
CHANNEL_NAMES = ["hERG", "Nav1.5_peak", "Nav1.5_late", "Cav1.2", "IKs", "IK1", "Kv4.3"]

# One row per (part, channel): start ``b`` and half step ``h`` of its replicate numbers.
SOURCE_CELLS = """SELECT p_partkey AS part, l_linenumber AS line, max(p_size) AS size, max(p_name) AS name,
  CAST(count(*) AS INT) % 7 + 1 AS b, CAST(sum(l_suppkey) % 3 AS INT) AS h FROM {part} JOIN {lineitem} ON l_partkey = p_partkey
  GROUP BY p_partkey, l_linenumber"""


def rendered_panels(t: Tables) -> DataFrame:
    """Two parts per document. Lines 3 and 6 report means, 1, 4 and 7 use comma groups, 2 and 5 neither.
    Sizes divisible by 17 lose their concentrations; even sizes use private-use digits."""
    cells = t.sql(SOURCE_CELLS)
    value = lambda i, plus: (F.lit(i * 20) + F.col("b") + (2 * F.col("h") if plus else F.lit(0))).cast("string")
    pairs = [(value(i, False), value(i, True)) for i in range(3)]
    comma = F.concat_ws(" ", *[F.concat(a, F.lit(", "), b) for a, b in pairs])
    plain = F.concat_ws(" ", *[x for p in pairs for x in p])
    means = F.concat_ws(" ", *[F.concat((F.lit(i * 20) + F.col("b") + F.col("h")).cast("string"), F.lit(" ± 0.5")) for i in range(3)])
    word = F.element_at(F.array(*[F.lit(w) for w in CHANNEL_WORDS]), F.col("line"))
    body = F.when(F.col("line") % 3 == 0, F.concat(word, F.lit(" "), plain, F.lit("\nX ± SEM "), means)).when(
        F.col("line") % 3 == 1, F.concat(word, F.lit("\n"), comma, F.lit("\nSEM n.a."))
    ).otherwise(F.concat(word, F.lit(" "), plain, F.lit("\nSEM n.a.")))
    conc = F.concat(F.col("size"), F.lit(" uM "), F.col("size") * 3, F.lit(" uM "), F.col("size") * 10, F.lit(".5 nM"))
    private = "".join(chr(0xF030 + i) for i in range(10))
    conc = F.when(F.col("size") % 2 == 0, F.translate(conc, "0123456789", private)).otherwise(conc)
    head = F.concat(F.upper("name"), F.lit("-"), F.col("part"), F.lit("\n\nCurrent block "),
                    F.when(F.col("size") % 17 == 0, F.lit("not given")).otherwise(conc))
    blocks = cells.groupBy("part", head.alias("head")).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("line", body.alias("s")))), lambda x: x["s"]), "\n").alias("body"))
    docs = blocks.groupBy(F.floor(F.col("part") / 2).alias("doc_id")).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("part", F.concat("head", F.lit("\n"), "body").alias("s")))),
        lambda x: x["s"]), "\n\n").alias("text"))
    return docs


NAME_CASE = "CASE line " + " ".join(f"WHEN {i + 1} THEN '{n}'" for i, n in enumerate(CHANNEL_NAMES)) + " END"
PANEL_CTE = f"""src AS ({SOURCE_CELLS}), cell AS (SELECT part, line, upper(name)||'-'||CAST(part AS VARCHAR) AS name_raw, {NAME_CASE} AS channel, c AS conc_no, size, b, h,
   CASE c WHEN 0 THEN CAST(size AS DOUBLE) WHEN 1 THEN CAST(size*3 AS DOUBLE) ELSE (size*10+0.5e0)/1000e0 END AS um FROM src, (VALUES (0),(1),(2)) v(c) WHERE size%17<>0)"""


@query("parse_panels", f"""WITH {PANEL_CTE} SELECT CAST(floor(part/2) AS BIGINT) AS doc_id, name_raw, channel, CAST(conc_no AS INT) AS conc_no, round(um,8) AS "concentration_uM", 2 AS block_pct_n,
 round(conc_no*20+b+h+0e0,8) AS block_pct_mean, round(h*sqrt(2e0),8) AS block_pct_std, CASE WHEN line%3=0 THEN conc_no*20+b+h+0e0 END AS block_pct_mean_reported,
 CASE WHEN line%3=0 THEN 0.5e0 END AS block_pct_sem_reported, CASE line%3 WHEN 0 THEN 'dp_means' WHEN 1 THEN 'regex' ELSE 'fallback_equal' END AS method FROM cell""")
def parse_panels(t):
    out = panel.parse_panels(rendered_panels(t)).select(
        "doc_id", "name_raw", "channel", "conc_no", "concentration_uM", "block_pct_n", "block_pct_mean", "block_pct_std",
        "block_pct_mean_reported", "block_pct_sem_reported", "method")
    return rounded(out, "concentration_uM", "block_pct_mean", "block_pct_std")


@query("panel_replicate_text", f"""WITH {PANEL_CTE} SELECT CAST(floor(part/2) AS BIGINT) AS doc_id, name_raw, channel, CAST(conc_no AS INT) AS conc_no,
 '['||CAST(conc_no*20+b AS VARCHAR)||'.0,'||CAST(conc_no*20+b+2*h AS VARCHAR)||'.0]' AS block_pct_replicates FROM cell""")
def panel_replicate_text(t):
    return panel.parse_panels(rendered_panels(t)).select("doc_id", "name_raw", "channel", "conc_no", "block_pct_replicates")


@query("panel_warning_counts", f"""WITH src AS ({SOURCE_CELLS}) SELECT 'replicate_group_fallback' AS issue, count(*) AS n FROM src WHERE line%3=2 AND size%17<>0
 UNION ALL SELECT 'missing_concentration', count(DISTINCT part) FROM src WHERE size%17=0""")
def panel_warning_counts(t):
    return panel.warning_counts(panel.parse_warnings(rendered_panels(t)))


@query("parse_legacy_panels", f"""WITH {PANEL_CTE} SELECT CAST(floor(part/2) AS BIGINT) AS doc_id, name_raw, channel, CAST(conc_no AS INT) AS conc_no, round(um,8) AS "concentration_uM",
 conc_no*20+b+h+0e0 AS block_pct_mean FROM cell WHERE line%3=0""")
def parse_legacy_panels(t):
    out = panel.parse_legacy_panels(rendered_panels(t))
    return rounded(out.select("doc_id", "name_raw", "channel", "conc_no", "concentration_uM", "block_pct_mean"),
                   "concentration_uM")


@query("numbered_lines", """SELECT doc_id, CAST(o-1 AS INT) AS pos, regexp_replace(l, '\\s+$', '') AS raw FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l,
 generate_subscripts(string_split(text, chr(10)),1) AS o FROM {documents})""")
def numbered_lines(t):
    return panel.numbered_lines(t.documents).select("doc_id", "pos", "raw")


# --- scalars ---------------------------------------------------------------------------------

@query("repair_glyphs", """SELECT p_partkey, CAST(p_size AS VARCHAR)||'.5 um '||p_name AS fixed FROM {part}""")
def repair_glyphs(t):
    private = "".join(chr(0xF030 + i) for i in range(10))
    broken = F.concat(F.translate(F.col("p_size").cast("string"), "0123456789", private), F.lit("5 m "), "p_name")
    return t.part.select("p_partkey", X.repair_glyphs(broken).alias("fixed"))


NUM_TEXT = "'dose '||CAST(o_orderkey%90 AS VARCHAR(20))||' nM, -'||CAST(o_custkey AS VARCHAR(20))||'.25 uM then '||CAST(o_orderkey%7 AS VARCHAR(20))||' mM; '||CAST(o_custkey%5 AS VARCHAR(20))||' ± 0.5 '||CAST(o_orderkey%11 AS VARCHAR(20))"


@query("extract_concentrations", f"""SELECT o_orderkey, u.o-1 AS i, u.raw, u.um FROM (SELECT o_orderkey, unnest([
  {{'o': 1, 'raw': CAST(o_orderkey%90 AS VARCHAR)||'nM', 'um': round((o_orderkey%90)/1000e0,8)}},
  {{'o': 2, 'raw': '-'||CAST(o_custkey AS VARCHAR)||'.25uM', 'um': -(o_custkey+0.25e0)}},
  {{'o': 3, 'raw': CAST(o_orderkey%7 AS VARCHAR)||'mM', 'um': (o_orderkey%7)*1000e0}}]) AS u FROM {{orders}})""")
def extract_concentrations(t):
    df = t.sql(f"SELECT o_orderkey, {NUM_TEXT} AS txt FROM {{orders}}")
    out = df.select("o_orderkey", F.posexplode(X.concentrations(F.col("txt"))).alias("i", "c"))
    return rounded(out.select("o_orderkey", "i", F.col("c.raw").alias("raw"), F.col("c.um").alias("um")), "um")


@query("extract_numbers_and_pairs", """SELECT o_orderkey, round(o_orderkey%90-(o_custkey+0.25e0)+o_orderkey%7+o_custkey%5+0.5e0+o_orderkey%11,8) AS total, 5 AS n_means, 1 AS n_sems FROM {orders}""")
def extract_numbers_and_pairs(t):
    df = t.sql(f"SELECT o_orderkey, {NUM_TEXT} AS txt FROM {{orders}}")
    total = F.aggregate(X.all_numbers(F.col("txt")), F.lit(0.0), lambda a, x: a + x)
    found = df.select("o_orderkey", total.alias("total"), X.mean_sem_pairs(F.col("txt")).alias("pairs"))  # searched once a row
    return rounded(found.select("o_orderkey", "total", F.size("pairs").alias("n_means"),
                                F.size(F.filter("pairs", lambda p: p["sem"].isNotNull())).alias("n_sems")), "total")


CENS = "CASE o_orderstatus WHEN 'F' THEN '> ' WHEN 'O' THEN '<' ELSE '' END || CASE WHEN o_orderkey%13=0 THEN 'n/a' ELSE CAST(o_orderkey%9 AS VARCHAR(20))||',000.5 uM' END"


@query("censored_numbers", """SELECT o_orderkey, CASE WHEN o_orderkey%13<>0 THEN (o_orderkey%9)*1000+0.5e0 END AS value,
 CASE WHEN o_orderkey%13=0 THEN 'NA' WHEN o_orderstatus='F' THEN '>' WHEN o_orderstatus='O' THEN '<' ELSE '=' END AS relation FROM {orders}""")
def censored_numbers(t):
    df = t.sql(f"SELECT o_orderkey, {CENS} AS txt FROM {{orders}}").withColumn("c", X.censored_number(F.col("txt")))
    return df.select("o_orderkey", F.col("c.value").alias("value"), F.col("c.relation").alias("relation"))


HEAD = "CASE p_partkey%6 WHEN 0 THEN 'IC50 (uM)' WHEN 1 THEN '% of control nM' WHEN 2 THEN 'Block mM' WHEN 3 THEN 'Free Cmax' WHEN 4 THEN 'µM IC50 block' ELSE p_name END"


@query("header_inference", f"""SELECT p_partkey, CASE p_partkey%6 WHEN 0 THEN 'ic50' WHEN 1 THEN 'pct_block' WHEN 2 THEN 'pct_block' WHEN 3 THEN 'block_cmax' WHEN 4 THEN 'ic50' ELSE 'unknown' END AS value_type,
 CASE p_partkey%6 WHEN 0 THEN 'uM' WHEN 1 THEN 'nM' WHEN 2 THEN 'mM' WHEN 4 THEN 'uM' WHEN 5 THEN CASE WHEN contains(p_name,'um') THEN 'uM' END END AS units FROM {{part}}""")
def header_inference(t):
    df = t.sql(f"SELECT p_partkey, {HEAD} AS h FROM {{part}}")
    return df.select("p_partkey", X.header_value_type(F.col("h")).alias("value_type"), X.header_units(F.col("h")).alias("units"))


@query("unit_hints", """WITH x AS (SELECT doc_id, 'text' AS column_name, CASE WHEN doc_id%37=0 THEN 'at 5 uM '||lang ELSE text END AS value FROM {documents}
 UNION ALL SELECT doc_id, 'source', CASE WHEN doc_id%41=0 THEN source||' micromolar' ELSE source END FROM {documents})
 SELECT doc_id, column_name, value FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY doc_id) AS rn FROM x
 WHERE regexp_matches(value,'(?i)µM|\\buM\\b|micromolar|micro mol|microM')) WHERE rn<=3""")
def unit_hints(t):
    df = t.documents.select("doc_id", F.when(F.col("doc_id") % 37 == 0, F.concat(F.lit("at 5 uM "), "lang")).otherwise(F.col("text")).alias("text"),
                            F.when(F.col("doc_id") % 41 == 0, F.concat("source", F.lit(" micromolar"))).otherwise(F.col("source")).alias("source"))
    return X.unit_hints(df, "doc_id", ["text", "source"], at_most=3)


# --- tables ----------------------------------------------------------------------------------

@query("detect_tables", """WITH d AS (SELECT doc_id, string_split(replace(text,', ','  7  '), chr(10)) AS ls FROM {documents}),
 l AS (SELECT doc_id, unnest(ls) AS s, generate_subscripts(ls,1)-1 AS pos FROM d), n AS (SELECT doc_id, pos, trim(s, ' \t\r') AS s FROM l WHERE trim(s, ' \t\r')<>''),
 p AS (SELECT *, regexp_split_to_array(s,'\\s{2,}') AS parts FROM n),
 q AS (SELECT *, len(parts)>=4 AND len(list_filter(parts, lambda x: regexp_matches(x,'[0-9]')))>=2 AS ok FROM p),
 g AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS t FROM q)
 SELECT doc_id, CAST(min(pos) AS INT) AS first_pos, CAST(max(pos) AS INT) AS last_pos, count(*) AS n_rows, CAST(max(len(parts)) AS INT) AS n_cols FROM g WHERE ok GROUP BY doc_id, t HAVING count(*)>=2""")
def detect_tables(t):
    docs = t.documents.select("doc_id", F.replace("text", F.lit(", "), F.lit("  7  ")).alias("text"))
    return panel.detect_tables(docs).drop("table_no")


TABLE_CELLS = """SELECT CAST(o_orderkey % 50 AS INT) AS table_id, CAST(o_orderkey AS INT) + 1 AS row_no, 0 AS col_no, 'drug ' || CAST(o_orderkey AS VARCHAR(20)) AS cell_text FROM {orders}
 UNION ALL SELECT CAST(o_orderkey % 50 AS INT), CAST(o_orderkey AS INT) + 1, CAST(o_custkey % 4 AS INT) + 1,
  CASE o_orderstatus WHEN 'F' THEN '>' WHEN 'O' THEN '<' ELSE '' END || CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE CAST(CAST((o_orderkey*37) % 900 AS INT) AS VARCHAR(10)) END FROM {orders}
 UNION ALL SELECT CAST(s AS INT), 0, c, h FROM (SELECT DISTINCT o_orderkey % 50 AS s FROM {orders}) x,
  (VALUES (0,'name'),(1,'IC50 uM'),(2,'block %'),(3,'10 nM'),(4,'Cmax')) v(c,h) WHERE s % 7 <> 0"""


def table_cells(t: Tables) -> DataFrame:
    return t.sql(TABLE_CELLS)


SIG_CTE = f"""c AS ({TABLE_CELLS}), rw AS (SELECT table_id, row_no, count(*) AS k, count(*) FILTER (regexp_matches(cell_text,'[0-9]')) AS num,
   count(*) FILTER (cell_text<>'' AND NOT regexp_matches(cell_text,'[0-9]')) AS wd FROM c GROUP BY 1,2),
 sig AS (SELECT table_id, count(*) AS n_rows, max(k) AS n_cols, sum(num)/CAST(count(*)*max(k) AS DOUBLE) AS numeric_pct,
   arg_min(wd,row_no) >= greatest(1, arg_min(k,row_no)//2) AS header_like, min(row_no) AS first_ FROM rw GROUP BY 1)"""


@query("table_signatures", f"WITH {SIG_CTE} SELECT table_id, n_rows, n_cols, round(numeric_pct,8) AS numeric_pct, header_like FROM sig")
def table_signatures(t):
    return rounded(panel.table_signatures(table_cells(t)), "numeric_pct")


@query("cells_to_long", f"""WITH {SIG_CTE}, v AS (SELECT c.*, s.header_like, s.first_ FROM c JOIN sig s ON c.table_id=s.table_id WHERE NOT (s.header_like AND c.row_no=s.first_)),
 h AS (SELECT c.table_id, c.col_no, trim(c.cell_text) AS lab FROM c JOIN sig s ON c.table_id=s.table_id AND c.row_no=s.first_),
 tr AS (SELECT table_id, CASE WHEN bool_or(contains(lower(lab),'ic50')) THEN 'ic50' WHEN bool_or(contains(lower(lab),'block') OR contains(lab,'%')) THEN 'pct_block'
   WHEN bool_or(contains(lower(lab),'cmax')) THEN 'block_cmax' ELSE 'unknown' END AS vt, CASE WHEN bool_or(regexp_matches(lab,'uM|µM|um')) THEN 'uM'
   WHEN bool_or(regexp_matches(lab,'nM')) THEN 'nM' WHEN bool_or(regexp_matches(lab,'mM')) THEN 'mM' END AS un FROM h GROUP BY 1)
 SELECT v.table_id, v.row_no, v.col_no, n.cell_text AS name_raw, 'multiple' AS channel, CASE WHEN v.header_like THEN tr.vt ELSE 'unknown' END AS value_type,
 CAST(regexp_extract(v.cell_text,'[0-9]+') AS DOUBLE) AS value, CASE WHEN contains(v.cell_text,'>') THEN '>' WHEN contains(v.cell_text,'<') THEN '<' ELSE '=' END AS relation,
 CASE WHEN v.header_like THEN tr.un END AS units, CASE WHEN regexp_matches(coalesce(h.lab,''),'[0-9]') THEN CAST(regexp_extract(replace(h.lab,',',''),'(-?[0-9]+\\.[0-9]+|-?[0-9]+)') AS DOUBLE) END AS "concentration_uM", coalesce(h.lab,'') AS header_label
 FROM v JOIN tr ON tr.table_id=v.table_id JOIN v n ON n.table_id=v.table_id AND n.row_no=v.row_no AND n.col_no=0 LEFT JOIN h ON h.table_id=v.table_id AND h.col_no=v.col_no
 WHERE v.col_no>0 AND regexp_matches(v.cell_text,'[0-9]')""")
def cells_to_long(t):
    return panel.cells_to_long(table_cells(t), ["hERG", "IKs"]).drop("value_raw", "channel_candidates")


@query("candidate_entities", f"""WITH c AS ({TABLE_CELLS}), x AS (SELECT table_id, row_no, CASE WHEN row_no%3=0 THEN replace(cell_text,'drug','Drug mean') ELSE replace(cell_text,'drug','cmpd') END AS cand
 FROM c WHERE col_no=0 AND row_no>0) SELECT table_id, row_no, cand AS candidate FROM x WHERE row_no%3<>0
 UNION ALL SELECT table_id, 0, 'name' FROM c WHERE row_no=0 AND col_no=0""")
def candidate_entities(t):
    c = table_cells(t).withColumn("cell_text", F.when(F.col("row_no") % 3 == 0, F.regexp_replace("cell_text", "drug", "Drug mean"))
                                  .otherwise(F.regexp_replace("cell_text", "drug", "cmpd")))
    return panel.candidate_entities(c)


# --- terms -----------------------------------------------------------------------------------

TERMS = ["the", "nicht", "eau", "Ouré", "zzz-none"]
TERM_ROWS = "(VALUES " + ",".join(f"('{x.lower()}')" for x in TERMS) + ") v(term)"


@query("term_mentions", f"SELECT doc_id, term FROM {{documents}}, {TERM_ROWS} WHERE contains(lower(text), term)")
def term_mentions(t):
    return panel.term_mentions(t.documents, TERMS)


@query("term_coverage", f"SELECT term, count(doc_id) AS n_docs FROM {TERM_ROWS} LEFT JOIN {{documents}} ON contains(lower(text), term) GROUP BY term")
def term_coverage(t):
    return panel.term_coverage(panel.term_mentions(t.documents, TERMS), TERMS)


SQUEEZED = ["li href", "The-Th", "DOCTYPE html", "enpaeux", "DL-Sotalol"]


@query("squeezed_term_mentions", f"""SELECT page_id, term FROM {{pages}}, (VALUES {','.join(f"('{x}')" for x in SQUEEZED)}) v(term)
 WHERE contains(regexp_replace(lower(html),'[^a-z0-9]+','','g'), regexp_replace(lower(term),'[^a-z0-9]+','','g'))""")
def squeezed_term_mentions(t):
    return panel.term_mentions(t.pages, SQUEEZED, "page_id", "html", squeeze=True)


MANY = [a + b for a in "aeioutnsr" for b in "abcdefghilmnoprstuvwxyz"]  # over 200 terms


@query("many_term_mentions", f"""SELECT doc_id, term FROM {{documents}}, (VALUES {','.join(f"('{x}')" for x in MANY)}) v(term) WHERE contains(lower(text), term)""")
def many_term_mentions(t):
    return panel.term_mentions(t.documents, MANY)


# --- word boxes ------------------------------------------------------------------------------

WORDS = """SELECT CAST(floor(o_orderkey / 400) AS BIGINT) AS page, o_orderkey AS word_id, CAST((o_orderkey*17) % 1000 AS DOUBLE) AS x_center,
 CAST((o_orderkey*29) % 700 AS DOUBLE) AS y_center, CASE o_orderstatus WHEN 'F' THEN '>' WHEN 'O' THEN '<' ELSE '' END
 || CAST(CAST((o_orderkey*37) % 900 AS INT) AS VARCHAR(10)) AS text FROM {orders}"""
CENTRES = [125.0, 375.0, 625.0, 875.0]


@query("assign_columns", f"""WITH w AS ({WORDS}) SELECT page, word_id, CAST((CASE WHEN x_center>250 THEN 1 ELSE 0 END)+(CASE WHEN x_center>500 THEN 1 ELSE 0 END)
 +(CASE WHEN x_center>750 THEN 1 ELSE 0 END) AS INT) AS col_no FROM w""")
def assign_columns(t):
    words = t.sql(WORDS)
    headers = words.select("page").distinct().withColumn("x_center", F.explode(F.array(*[F.lit(c) for c in CENTRES])))
    return layout.assign_columns(words, headers).select("page", "word_id", "col_no")


@query("cell_statistics", f"""WITH w AS ({WORDS}), c AS (SELECT page, CAST(floor(y_center/100) AS BIGINT) AS band, CAST(regexp_extract(text,'[0-9]+') AS DOUBLE) AS v,
  CAST((CASE WHEN x_center>250 THEN 1 ELSE 0 END)+(CASE WHEN x_center>500 THEN 1 ELSE 0 END)+(CASE WHEN x_center>750 THEN 1 ELSE 0 END) AS INT) AS col_no FROM w)
 SELECT page, band, col_no, count(*) AS n, round(avg(v),6) AS block_mean, round(stddev_samp(v)/sqrt(count(*)),6) AS block_sem FROM c GROUP BY 1,2,3""")
def cell_statistics(t):
    words = t.sql(WORDS)
    headers = words.select("page").distinct().withColumn("x_center", F.explode(F.array(*[F.lit(c) for c in CENTRES])))
    placed = layout.assign_columns(words, headers).withColumn("band", F.floor(F.col("y_center") / 100))
    return rounded(layout.cell_statistics(placed, ["page", "band", "col_no"]), "block_mean", "block_sem", digits=6)


@query("assign_lines", f"""WITH RECURSIVE w AS ({WORDS}), ys AS (SELECT DISTINCT page, y_center FROM w),
 a(page, y) AS (SELECT page, min(y_center) FROM ys GROUP BY page UNION ALL
   SELECT a.page, (SELECT min(ys.y_center) FROM ys WHERE ys.page=a.page AND ys.y_center-a.y>10) AS y FROM a
   WHERE EXISTS (SELECT 1 FROM ys WHERE ys.page=a.page AND ys.y_center-a.y>10))
 SELECT w.page, w.word_id, max(a.y) AS line_y FROM w JOIN a ON a.page=w.page AND a.y<=w.y_center GROUP BY 1,2""")
def assign_lines(t):
    return layout.assign_lines(t.sql(WORDS), 10.0).select("page", "word_id", "line_y")


def panel_words(t: Tables) -> DataFrame:
    """One page per part: a header line with three concentrations, then a label and six numbers per channel."""
    cells = t.sql(SOURCE_CELLS)
    labels = ["hERG", "Nav1.5 late", "Nav1.5", "Cav1.2", "Kv1QT1", "Kir21", "Ito"]
    box = lambda y, x, text: F.struct(y.cast("double").alias("y_center"), F.lit(float(x)).alias("x_center"),
                                      text.cast("string").alias("text"))
    y = F.col("line") * 30
    label = box(y, 0, F.element_at(F.array(*[F.lit(w) for w in labels]), F.col("line")))
    numbers = [box(y + 4, 300 + 200 * c + 5 * k, F.lit(c * 20) + F.col("b") + 2 * k * F.col("h"))
               for c in range(3) for k in range(2)]
    rows = cells.select(F.col("part").alias("page"), F.explode(F.array(label, *numbers)).alias("w"))
    heads = [box(F.lit(2), 50, F.lit("Current"))] + [
        box(F.lit(3), 300 + 200 * c, F.concat((F.col("size") * (c + 1)).cast("string"), F.lit("µM"))) for c in range(3)]
    head = cells.select("part", "size").distinct().select(F.col("part").alias("page"), F.explode(F.array(*heads)).alias("w"))
    return rows.unionByName(head).select("page", "w.*")


@query("panel_from_words", f"""WITH s AS ({SOURCE_CELLS}) SELECT part AS page, CASE line WHEN 1 THEN 'hERG' WHEN 2 THEN 'Nav1.5_late' WHEN 3 THEN 'Nav1.5_peak' WHEN 4 THEN 'Cav1.2' WHEN 5 THEN 'IKs'
  WHEN 6 THEN 'IK1' ELSE 'Kv4.3' END AS channel, CAST(c AS INT) AS col_no, CAST(size*(c+1) AS DOUBLE) AS "concentration_uM", CAST(2 AS BIGINT) AS n, round(c*20+b+h+0e0,6) AS block_mean, round(h*1e0,6) AS block_sem
 FROM s, (VALUES (0),(1),(2)) v(c)""")
def panel_from_words(t):
    out = layout.panel_from_words(panel_words(t))
    return rounded(out.select("page", "channel", "col_no", "concentration_uM", "n", "block_mean", "block_sem"),
                   "block_mean", "block_sem", digits=6)
