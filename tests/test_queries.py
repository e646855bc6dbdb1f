"""Every named query against its checking SQL, and the shape of the plans."""

import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry_points
from loadpulse.plans import all_queries

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
QUERIES = {n: q for n, q in entry_points.queries().items() if n in set(all_queries())}
CHECKS = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def checker():
    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return connection


def normal(rows, columns):
    place = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        return repr(float(v)) if isinstance(v, float) else repr(v)

    return sorted(tuple(value(row[i]) for i in place) for row in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, checker, name):
    df = QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    if name not in CHECKS:
        assert rows
        return
    result = checker.execute(CHECKS[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert normal(rows, df.columns) == normal(result.fetchall(), columns)


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["job_id", "query_action", "average_latency", "failure_percent", "timestamp"]
    rows = df.collect()
    assert len(rows) == 1000 or FOLDER != "/root/testdata/sf0.001"
    assert any(math.isnan(r.average_latency) for r in rows)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if "stream" not in n and "sink" not in n))
def test_plans_have_no_pair_joins_and_no_python(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython",
                 "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        assert node not in plan
    windows = re.findall(r"Window \[.*", plan)
    # The one window runs over the row counts of id ranges.
    assert all("_rows" in w for w in windows)


def test_flagship_plan_has_one_shuffle_after_map_side_combine(spark):
    plan = QUERIES["windowed_latency_failure"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.index("functions=[sum(") < plan.index("Exchange") < plan.index("partial_sum(")


def test_counting_pictures_reads_no_columns(spark):
    plan = QUERIES["pictures_count"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ReadSchema: struct<>", plan)


def test_star_join_does_not_shuffle_the_pictures(spark):
    plan = QUERIES["pictures_star"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 5
    assert "Exchange hashpartitioning" not in plan
