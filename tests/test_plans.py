"""Plan checks: no row-at-a-time Python, no cartesian products, pushdown reaches the scans."""

import pytest

from shoptally.plans.catalog import QUERIES
from tests.conftest import SF_SMALL


def plan_of(spark, key):
    df = QUERIES[key](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_python_udf_no_cartesian(spark, key):
    p = plan_of(spark, key)
    assert "BatchEvalPython" not in p, "row-at-a-time Python UDF in the plan"
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p
    if key not in ("moving_average_cost", "stock_reduce_sequential"):  # the sequential folds run as mapInPandas
        assert "MapInPandas" not in p and "FlatMapGroupsInPandas" not in p and "ArrowEvalPython" not in p


def test_period_filter_reaches_the_orders_scan(spark):
    p = plan_of(spark, "inventory_movement")
    scans = [line for line in p.splitlines() if "o_orderdate" in line and "PushedFilters" in line]
    assert any("GreaterThanOrEqual(o_orderdate" in line for line in scans), scans


def test_column_pruning_on_lineitem(spark):
    p = plan_of(spark, "top_selling_products")
    for line in p.splitlines():
        if "FileScan parquet" in line and "l_orderkey" in line:
            assert "l_comment" not in line and "l_tax" not in line


def test_month_partitions_are_pruned(spark):
    p = plan_of(spark, "typed_scan_period")
    scans = [line for line in p.splitlines() if "FileScan parquet" in line and "order_month" in line]
    assert scans and all("PartitionFilters: [" in line and "order_month" in line.split("PartitionFilters: [")[1].split("]")[0]
                         for line in scans), scans


def test_explicit_broadcasts_are_fixed_lists_only(spark):
    """broadcast() hints appear only on the fixed category lists (bounded by construction)."""
    import inspect

    import shoptally.operators.debts as d
    import shoptally.operators.listings as li
    import shoptally.operators.movement as m
    import shoptally.operators.posting as po
    import shoptally.operators.quality as q
    import shoptally.operators.reports as r
    import shoptally.sources.seeds as se

    for mod in (d, li, m, po, q, r, se):
        for line in inspect.getsource(mod).splitlines():
            if "F.broadcast(" in line:
                assert "categor" in line or "seed" in line, (mod.__name__, line)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_window_over_a_single_partition(spark, key):
    """A window without a partition key sits on an ``Exchange SinglePartition``: none may exist over data.

    The one exception is the running sum over *partition counts* inside
    ``row_number_by_id`` when it ranks a whole frame (no group): that frame
    has one row per partition, recognisable by its ``_part_rows`` column.
    """
    lines = plan_of(spark, key).splitlines()
    for i, line in enumerate(lines):
        if "Window [" in line and "WindowGroupLimit" not in line and "_blk" not in line and "_part_rows" not in line:
            below = next((x for x in lines[i + 1:] if "Exchange " in x), "")
            assert "SinglePartition" not in below, (key, line[:200])
