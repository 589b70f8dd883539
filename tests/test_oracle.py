"""Every SQL-checked query against its DuckDB oracle (sf0.001), plus every rows-only query runs."""

import os
import re
import tempfile

import duckdb
import pytest

import __spark_entry__ as entry
from tools.oracle_check import TABLES, compare

SF = os.environ.get("QUARRY_TEST_SF", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()
# training-data queries have their own tests beside them
NAMES = sorted(n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"SET temp_directory = '{tempfile.mkdtemp(prefix='quarry-duck-')}'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_query_has_a_known_check_kind():
    rows_only = set(NAMES) - set(SQL)
    # non-SQL operators: ML fitting / scoring (random or iterative) and sketches
    assert rows_only <= {"approx_profile", "pcc_sketch", "automl_fit", "predict", "bagged_stack",
                         "feature_importance", "end_to_end"}


@pytest.mark.parametrize("name", [n for n in NAMES if n in SQL])
def test_query_matches_oracle(spark, duck, name):
    sdf = entry.queries()[name](spark, SF)
    res = duck.execute(SQL[name])
    msg = compare([tuple(r) for r in sdf.collect()], sdf.columns, res.fetchall(), [d[0] for d in res.description])
    assert msg is None, msg


@pytest.mark.parametrize("name", [n for n in NAMES if n not in SQL])
def test_rows_only_query_runs(spark, name):
    rows = entry.queries()[name](spark, SF).collect()
    assert rows
    for r in rows:
        assert not any(isinstance(v, float) and v != v for v in r)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "column" in df.columns
