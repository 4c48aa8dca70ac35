"""Every query against its SQL on DuckDB, value by value."""

import duckdb
import pytest

import __spark_entry__ as driver
from polyprobe.plans import catalog, oracle

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    yield con
    con.close()


def _rows(frame, columns):
    def plain(v):
        if v is None or v != v:
            return "null"
        return repr(v.item() if hasattr(v, "item") else v)

    return sorted(tuple(plain(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False))


def test_every_query_has_sql():
    assert set(oracle.oracle_sql()) == set(catalog.QUERIES)
    assert set(catalog.QUERIES) <= set(driver.queries()) and set(oracle.oracle_sql()) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, sf_dir, db, name):
    ours = driver.queries()[name](spark, sf_dir)
    theirs = db.sql(driver.oracle_sql()[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert {f.name: TYPES[f.dataType.simpleString()] for f in ours.schema.fields} == {
        c: str(t) for c, t in zip(theirs.columns, theirs.types)}
    left, right = _rows(ours.toPandas(), columns), _rows(theirs.df(), columns)
    assert left
    assert left == right


def test_entry(spark):
    assert driver.entry(spark).count() > 0
