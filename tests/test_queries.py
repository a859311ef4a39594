"""Every registered query against its SQL twin; the ones without run, and keep what can be said without one."""

import pytest

import oracle
from evitrust.plans import Tables, load_all

QUERIES = load_all()
WITH_SQL = [n for n, q in QUERIES.items() if q.oracle]


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_sql(spark, sf_dir, con, name):
    diffs, _ = oracle.compare(spark, QUERIES[name], sf_dir, con)
    assert not diffs


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.oracle])
def test_runs_without_sql(spark, sf_dir, name):
    """Rows, no null key, probabilities between 0 and 1 that sum to one where a query gives them."""
    df = QUERIES[name].run(Tables(spark, sf_dir))
    rows = [r.asDict() for r in df.collect()]
    assert rows, name
    raw = [c for c in df.columns if c.startswith("prob_raw_")]
    for probs in (raw, [c for c in df.columns if c.startswith("prob_") and c not in raw]):
        for r in rows:
            values = [r[c] for c in probs if r[c] is not None]
            assert all(-1e-9 <= v <= 1 + 1e-9 for v in values)
            if len(values) == len(probs) > 1:
                assert abs(sum(values) - 1) < 1e-6


def test_entry_point(spark):
    import __spark_entry__ as e
    assert e.entry(spark).columns[:3] == ["seed", "fold", "abstention_rate"]
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())


def test_no_cartesian_product(spark, sf_dir):
    """No query may plan a product of two tables; one-row sides are nested loops and are allowed."""
    t = Tables(spark, sf_dir)
    for name in WITH_SQL:
        plan = QUERIES[name].run(t)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name


@pytest.mark.parametrize("name,rest", [("gap_fill", ["mean", "n", "origin"]), ("gapfill_summary", ["n", "mean", "median"])])
def test_channel_queries_hold_every_channel(spark, sf_dir, name, rest):
    t = Tables(spark, sf_dir)
    every = QUERIES[f"{name}_channels"].run(t).persist()
    assert every.select("channel").distinct().count() == 7
    one = {"gap_fill": "ch1", "gapfill_summary": "ch2"}[name]
    got = every.where(f"channel = '{one}'").select("entity", *rest)
    assert sorted(map(str, got.collect())) == sorted(map(str, QUERIES[name].run(t).select("entity", *rest).collect()))
