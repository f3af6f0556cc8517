"""Registered queries against their SQL twins, and the plans they compile to."""

import re

import pytest

import __spark_entry__ as entry_points
from tidemark.catalog import oracle as catalog_sql, queries as catalog
from compare import difference, oracle

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.registered(), catalog_sql.statements()
ML = [q for q in QUERIES if q.startswith("ml_")]
# No query may pair all rows of two tables.
NESTED_LOOP_OK = set()


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


def test_every_query_but_the_fitted_ones_has_a_twin():
    assert set(QUERIES) - set(SQL) == set(ML) and set(SQL) <= set(QUERIES)


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0 and df.filter("ma200 is not null").count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(SQL))
def test_plan_stays_distributed(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "Python" not in plan and "MapInPandas" not in plan and "ArrowEval" not in plan
    if name not in NESTED_LOOP_OK:
        assert "BroadcastNestedLoopJoin" not in plan
        # Ordered results aside, nothing is brought into one partition.
        assert "Exchange SinglePartition" not in plan or name == "tuner_top_row"
    reads = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    # What starts from a checkpoint reads its rows instead.
    assert (reads or "Scan ExistingRDD" in plan) and all("l_tax" not in r and "l_linestatus" not in r for r in reads)
