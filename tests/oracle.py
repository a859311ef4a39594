"""Compare a registered query with its SQL twin in DuckDB, ignoring row order."""

from __future__ import annotations

import math

import duckdb

from evitrust.plans.registry import TABLES, Tables


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(v, strict):
    if v is None:
        return "\\N"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(v + 0.0) if strict else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_plain(x, strict) for x in v) + "]"
    return str(v)


def rows_of(columns, records, strict):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i], strict) for i in order) for r in records)


def compare(spark, query, sf_dir, con=None, strict=True):
    """Return a list of differences (empty when equal) and the number of rows."""
    df = query.run(Tables(spark, sf_dir))
    got = [tuple(r) for r in df.collect()]
    out = []
    con = con or connect(sf_dir)
    rel = con.execute(query.oracle)
    cols = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    want = rel.fetchall()
    if sorted(cols) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} vs {sorted(cols)}"], len(got)
    spark_types = dict(df.dtypes)
    names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN"}
    for c in cols:
        if names.get(spark_types[c], spark_types[c]) != types[c]:
            out.append(f"type of {c}: {spark_types[c]} vs {types[c]}")
    if len(got) != len(want):
        out.append(f"rows {len(got)} vs {len(want)}")
    a, b = rows_of(df.columns, got, strict), rows_of(cols, want, strict)
    if a != b:
        sa, sb = set(a), set(b)
        out.append(f"values differ: only spark {sorted(sa - sb)[:3]} only sql {sorted(sb - sa)[:3]} "
                   f"of {len(sa - sb)}/{len(sb - sa)}")
    return out, len(got)
