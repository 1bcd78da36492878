"""Every registered query against its check SQL, with the joins big tables get."""

import os

import pytest

import __spark_entry__ as spark_entry
from sparkmail.plans.queries import REGISTRY as QUERIES

duckdb = pytest.importorskip("duckdb")

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.fixture(autouse=True)
def without_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_every_query_has_a_check():
    assert QUERIES.keys() <= spark_entry.queries().keys() and QUERIES.keys() <= spark_entry.oracle_sql().keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "MapInArrow"):
        assert node not in plan

    cursor = duck.execute(spark_entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    picks = [columns.index(c) for c in sorted(columns)]
    expected = [tuple(r[i] for i in picks) for r in cursor.fetchall()]
    assert found and sorted(map(repr, found)) == sorted(map(repr, expected))


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0
