"""The corpus queries that have SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from quire.llm import registry

SF_DIR = os.environ.get("QUIRE_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        at = f"{SF_DIR}/{table}.parquet"
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    mine, theirs = registry.queries()[name](spark, SF_DIR).toArrow(), con.sql(registry.oracle_sql()[name]).to_arrow_table()
    assert sorted(mine.column_names) == sorted(theirs.column_names)
    shown = lambda t: sorted("|".join(f"{r[c]:.9g}" if isinstance(r[c], float) else repr(r[c]) for c in sorted(t.column_names)) for r in t.to_pylist())
    assert shown(mine) == shown(theirs)
