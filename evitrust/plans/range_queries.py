"""Queries on the way that very large groups take: orders cut into ranges of a few hundred rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from evitrust import ordering
from evitrust.plans import harmonize_queries, trust_queries  # noqa: F401  (their queries are run again here)
from evitrust.plans.registry import REGISTRY, query

ROWS = 200
TWINS = ["abstention_curve", "trust_rows", "score_percentiles", "score_diagnostics", "value_summary", "coverage_target_curve",
         "rank_and_linear_correlation"]


def _again(name: str) -> None:
    base = REGISTRY[name]
    query(f"{name}_in_ranges", base.oracle)(lambda t: base.run(t.in_ranges(ROWS)))


for _name in TWINS:
    _again(_name)

#: Nulls, NaN, ties and text as the last order column.
ODD = """SELECT o_orderstatus AS grp, 'order-' || CAST(o_orderkey AS VARCHAR(20)) AS name,
 CASE WHEN o_orderkey%7=0 THEN NULL WHEN o_orderkey%11=0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(floor(o_totalprice/20000) AS DOUBLE) END AS score
 FROM {orders}"""


@query("positions_in_ranges", f"""WITH odd AS ({ODD}) SELECT grp, name, row_number() OVER (PARTITION BY grp ORDER BY score NULLS FIRST, name) AS pos,
 count(*) OVER (PARTITION BY grp) AS n_total FROM odd""")
def positions_in_ranges(t):
    out = ordering.row_positions(t.sql(ODD), ["grp"], "score", ["name"], max_rows_per_range=ROWS)
    return out.select("grp", "name", F.col("pos").cast("bigint").alias("pos"), "n_total")


LARGE = """SELECT CAST(o_custkey % 3 AS INT) AS grp, 1152921504606846976 + CAST(o_orderkey * 7919 % 1000003 AS BIGINT) AS big, o_comment_free AS name, o_orderkey AS id
 FROM (SELECT *, o_orderpriority || CAST(o_orderkey % 7 AS VARCHAR(1)) AS o_comment_free FROM {orders}) o"""


@query("positions_of_large_integers", f"""WITH x AS ({LARGE}) SELECT id, grp, row_number() OVER (PARTITION BY grp ORDER BY big DESC, id) AS by_number,
 row_number() OVER (PARTITION BY grp ORDER BY name DESC, id) AS by_text FROM x""")
def positions_of_large_integers(t):
    """Falling order of integers that doubles do not tell apart, in ranges, and of text in plain windows."""
    x = t.sql(LARGE)
    number = ordering.row_positions(x, ["grp"], "big", ["id"], descending=True, position="by_number", max_rows_per_range=ROWS)
    text = ordering.row_positions(x, ["grp"], "name", ["id"], descending=True, position="by_text")
    return number.select("id", "grp", "by_number").join(text.select("id", "by_text"), "id")


@query("ranks_in_ranges", f"""WITH odd AS ({ODD}) SELECT grp, name, CASE WHEN score IS NOT NULL THEN rank() OVER (PARTITION BY grp ORDER BY score NULLS LAST)
 + (count(score) OVER (PARTITION BY grp, score)-1)/2e0 END AS avg_rank FROM odd""")
def ranks_in_ranges(t):
    return ordering.with_average_rank(t.sql(ODD), ["grp"], "score", rank="avg_rank", max_rows_per_range=ROWS).drop("score")
