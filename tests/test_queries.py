"""Every query of the news engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from tidewire.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(show(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    want = db.sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["q_entity_counts", "q_entity_bridge"])
def test_texts_are_cleaned_once_for_all_terms(spark, name):
    """Three expressions clean a summary; a plan has it in the result and in two conditions that Spark derives, not once for each term."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("regexp_replace") <= 9


def test_snapshots_score_texts_once(spark):
    from tidewire.plans.tables import snapshots

    assert "regexp_replace" not in snapshots(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
