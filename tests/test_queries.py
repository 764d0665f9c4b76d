"""Driver queries against their SQL on the small tables. ALL_QUERIES=1 runs every one."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.oracle_check import TABLES, compare

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
SOME = ["scan_rules", "scan_profiles", "assign_ids", "score_by_source", "guard_context", "match_components", "sarif_results", "project_hash",
        "taint_paths", "validate_snippet", "cross_source_merge", "blind_spots", "chains", "pack_batches", "retrieve_docs", "call_chain", "stream_scan"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(QUERIES) if os.environ.get("ALL_QUERIES") else SOME)
def test_query(spark, con, name):
    status, _n, _took, why, _types = compare(spark, con, name, QUERIES[name], SQL.get(name), SF)
    assert status in ("OK", "ROWS", "EMPTY"), why


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 20 and "score" in df.columns
