"""Plan-level guards for every registered query (the scale rules, checked on the physical plan)."""
from __future__ import annotations

import pytest

from conftest import SF_SMOKE
from facetspark.plans.queries import QUERIES

# no pair-emitting joins, no row-at-a-time Python
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pair_joins_or_row_udfs(spark, name):
    plan = _plan(QUERIES[name](spark, SF_SMOKE))
    assert not [op for op in FORBIDDEN if op in plan], plan


def test_scans_are_pruned_and_filtered(spark):
    """lineitem (11 columns) is read as 2 columns with null filters pushed to the scan,
    and part as the 2 columns ``split_counts`` needs."""
    q = QUERIES["split_counts"](spark, SF_SMOKE)
    formatted = q._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint>" in formatted
    assert "PushedFilters: [IsNotNull(l_suppkey), IsNotNull(l_partkey)]" in formatted
    assert "ReadSchema: struct<p_partkey:bigint,p_brand:string>" in formatted
