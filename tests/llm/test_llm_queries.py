import pytest
import sqlcheck
from pyspark.sql import functions as F

from corpusmill.llm import queries as q

needs_tables = pytest.mark.skipif(not sqlcheck.TABLES.exists(), reason="no test tables")
COLUMNS = {
    "p1_found": ["item", "item_id"], "p2_found": ["record_id", "term"], "p3_found": ["disclosure_id"], "p4_found": ["record_id_a", "record_id_b"], "p5_found": ["item", "source", "item_id"],
    "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"],
}


@pytest.fixture(scope="module")
def con():
    return sqlcheck.connect()


def test_names():
    assert q.ORACLE_SQL.keys() <= q.QUERIES.keys() and COLUMNS.keys() <= q.QUERIES.keys()


@needs_tables
@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_query_against_sql(spark, con, name):
    sqlcheck.compare(spark, con, q.QUERIES[name], q.ORACLE_SQL[name])


@needs_tables
@pytest.mark.parametrize("name", sorted(q.QUERIES.keys() - q.ORACLE_SQL.keys()))
def test_query_without_sql_runs(spark, name):
    assert q.QUERIES[name](spark, str(sqlcheck.TABLES)).count() >= 0


@needs_tables
@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_no_repeats(spark, name):
    df = q.QUERIES[name](spark, str(sqlcheck.TABLES))
    assert df.columns == COLUMNS[name]
    keys = [c for c in df.columns if c != "ids"]
    assert df.groupBy(*keys).count().where("count > 1").count() == 0


@needs_tables
def test_every_document_has_ids_and_a_score(spark):
    documents = spark.read.parquet(f"{sqlcheck.TABLES}/documents.parquet")
    n = documents.count()
    assert q.p8_ids(spark, str(sqlcheck.TABLES)).where(F.col("ids").isNotNull()).count() == n
    assert q.p10_scores(spark, str(sqlcheck.TABLES)).where("score BETWEEN 0 AND 1").count() == n
