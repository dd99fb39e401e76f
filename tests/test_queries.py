import subprocess
import sys
from pathlib import Path

import pytest
import sqlcheck

from corpusmill.plans import catalogue

needs_tables = pytest.mark.skipif(not sqlcheck.TABLES.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return sqlcheck.connect()


def test_sql_belongs_to_queries():
    assert catalogue.oracle_sql().keys() <= catalogue.queries().keys()


def test_core_stands_alone():
    """The core and the entry module import where the subpackage of the training-data operators can't be."""
    code = "import sys; sys.modules['corpusmill.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p6_found' in q and 'p1_found' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)


@needs_tables
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_against_sql(spark, con, name):
    sqlcheck.compare(spark, con, catalogue.queries()[name], catalogue.oracle_sql()[name])


@needs_tables
@pytest.mark.parametrize("name", sorted(catalogue.queries().keys() - catalogue.oracle_sql().keys()))
def test_query_without_sql_runs(spark, name):
    df = catalogue.queries()[name](spark, str(sqlcheck.TABLES))
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)
