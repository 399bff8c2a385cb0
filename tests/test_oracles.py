"""Every query with SQL against DuckDB on the smallest tables, and plans that must not lose what makes them scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quire.plans import catalog

SF_DIR = os.environ.get("QUIRE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def shown(value):
    return f"{value:.9g}" if isinstance(value, float) else repr(value)


def table(arrow):
    names = sorted(arrow.column_names)
    return names, sorted("|".join(shown(row[c]) for c in names) for row in arrow.to_pylist())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, duck, name):
    mine = table(catalog.QUERIES[name](spark, SF_DIR).toArrow())
    theirs = table(duck.sql(catalog.ORACLES[name]).to_arrow_table())
    assert mine[0] == theirs[0]
    assert mine[1] == theirs[1]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_what_they_need(spark):
    text = plan(catalog.QUERIES["script_counts"](spark, SF_DIR))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text and text.count("Exchange") == 1 and "partial_sum" in text


def test_terms_meet_by_hash(spark):
    text = plan(catalog.QUERIES["term_occurrences"](spark, SF_DIR))
    assert "BroadcastHashJoin [token" in text and "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text


def test_history_needs_no_sort_of_all(spark):
    assert "TakeOrderedAndProject" in plan(catalog.QUERIES["job_history"](spark, SF_DIR))


def test_domain_precedence_is_limited_early(spark):
    assert "WindowGroupLimit" in plan(catalog.QUERIES["glossary_merge"](spark, SF_DIR))
