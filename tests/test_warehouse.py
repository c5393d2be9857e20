"""Operators give the same results on exported, typed shop tables (A1 scans + A4 sink)."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from shoptally.functions import semantics as S
from shoptally.operators import debts, listings, movement, quality, reports
from shoptally.plans.params import P
from shoptally.sources.fixtures import PlantedSales, ShopTables
from shoptally.sources.tables import SHOP_SCHEMAS, ShopWarehouse, export_shop_tables, write_result
from tests.conftest import SF_SMALL
from tests.oracle_compare import norm


def bag(df):
    cols = sorted(df.columns)
    return Counter(tuple(norm(r[c]) for c in cols) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """Derived tables and the same tables exported."""
    t = ShopTables(spark, SF_SMALL)
    root = str(tmp_path_factory.mktemp("warehouse"))
    export_shop_tables(t, root)
    return t, ShopWarehouse(spark, root)


def test_operators_on_typed_warehouse(shop):
    t, w = shop
    for name in SHOP_SCHEMAS:  # every declared table scans with its declared schema
        assert getattr(w, name).count() == getattr(t, name).count(), name
    checks = [
        lambda x: movement.inventory_movement(x, P.mv_from, P.mv_to),
        lambda x: reports.overview_report(x, P.from_dt, P.to_dt),
        lambda x: reports.customer_profit(x, P.from_dt, P.to_dt, P.top_n),
        lambda x: debts.suppliers_with_debt(x),
        lambda x: listings.serial_trace(x),
        lambda x: quality.constraint_violations(x),
        lambda x: quality.customer_code_dedupe(x),
        lambda x: quality.duplicate_sale_detect_shop(x),
        lambda x: reports.top_selling_products(x, P.from_dt, P.to_dt),
        lambda x: reports.customer_top(x, P.top_n, P.from_dt, P.to_dt),
        lambda x: listings.imports_list(x, P.from_dt, P.to_dt, P.kw_imports),
        lambda x: listings.imports_returnable(x, P.from_dt, P.to_dt),
        lambda x: listings.customer_payment_history(x, P.from_dt, P.to_dt),
        lambda x: listings.cashbook_search(x, P.cb_from, P.cb_to, None, None),
    ]
    for fn in checks:
        assert bag(fn(t)) == bag(fn(w))


def planted(spark, root):
    t = PlantedSales(spark, SF_SMALL)
    export_shop_tables(t, root, ["sales_orders", "order_items", "product_serials", "customer_wallet_transactions", "customers",
                                 "product_variants", "cashbook_entries"])
    return t, ShopWarehouse(spark, root)


def test_duplicate_sales_of_a_warehouse(spark, tmp_path):
    """Q17 and Q18 run on the declared tables, with all header fields and the serial of a line."""
    t, w = planted(spark, str(tmp_path / "w"))
    assert quality.duplicate_sale_detect_shop(w).count() > 0
    for fn in (quality.duplicate_sale_detect_shop, quality.duplicate_sale_reverse, quality.duplicate_sale_reverse_variants,
               quality.duplicate_sale_reverse_points, lambda x: quality.duplicate_sale_reverse_cashbook(x, P.as_of)):
        assert bag(fn(t)) == bag(fn(w))
    # copies with another serial are other sales: found if serials are left out
    orders, lines = quality.duplicate_sale_inputs(w)
    blind = quality.duplicate_sale_detect(orders, lines.withColumn("serial_number", F.lit(None).cast("string")), w.product_serials.select("order_id"),
                                          wallet_orders=w.customer_wallet_transactions.select("order_id"))
    assert blind.count() > quality.duplicate_sale_detect_shop(w).count()


def scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("PartitionFilters: [")[1].split("]")[0] for line in plan.splitlines() if "FileScan parquet" in line and "_month" in line]


def test_periods_skip_month_folders(spark, shop):
    """A date condition reads the folders of its months, of documents and of their lines."""
    t, w = shop
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a, b = P.from_dt, P.to_dt
        for df, n in [
            (reports.cost_of_goods_sold(w, a, b), 2), (reports.cashbook_profit_split(w, a, b), 1), (movement.inventory_movement(w, P.mv_from, P.mv_to), 8),
            (reports.top_selling_products(w, a, b), 2), (reports.customer_profit(w, a, b), 3), (reports.supplier_statistics(w, a, b), 2),
            (listings.imports_list(w, a, b, ""), 1), (listings.customer_payment_history(w, a, b), 1), (listings.supplier_payment_history(w, a, b), 1),
            (listings.cashbook_search(w, P.cb_from, P.cb_to), 1), (listings.cashbook_summary(w, P.cb_from, P.cb_to), 1),
        ]:
            filtered = [f for f in scans(df) if "_month" in f]
            assert len(filtered) >= n, (n, filtered)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    lines = spark.read.parquet(f"{w.root}/order_items")
    assert lines.count() == t.order_items.count() and lines.where("order_month is null").count() == t.order_items.join(t.sales_orders.where("order_date is not null"), "order_id", "left_anti").count()


def test_no_bound_and_a_missing_bound(spark):
    df = spark.sql("select * from values (timestamp_ntz'2024-01-31 23:59:59.5', '2024-01'), (timestamp_ntz'2024-02-01', '2024-02'), (null, null) as t(order_date, order_month)")
    count = lambda d: d.count()
    assert count(S.during(df, "order_date")) == 3 and count(S.within(df, "order_date", "2024-01-01", None)) == 0
    assert count(S.during(df, "order_date", end_exclusive="2024-02-01")) == count(S.during(df, "order_date", "2024-02-01")) == 1
    assert count(S.in_months(df, "order_date", end_exclusive="2024-02-01")) == 1 and count(S.in_months(df.drop("order_month"), "order_date", "2024-02-01")) == 3


def test_ranked_customers_filter_the_debts(shop):
    """The chosen customers meet orders and payments below the aggregate, and are worked out once."""
    _, w = shop
    for df in (reports.customer_top(w, 3), reports.customer_profit(w, P.from_dt, P.to_dt, 3)):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].splitlines()
        union = next(i for i, line in enumerate(plan) if "Union" in line)
        above = [line for line in plan[:union] if "Join" in line or "Aggregate" in line]
        assert "Join" in above[-1] and "Aggregate" in above[-2], above
        assert sum("FileScan parquet" in line and "customer_code" not in line and "order_items" in line for line in plan) == 1
        assert sum("TakeOrderedAndProject" in line for line in plan) == 1


@pytest.mark.parametrize("period", [("1994-03-10", "1994-03-20"), ("1995-11-15", "1995-12-31"), ("1997-01-31", "1997-03-01")])
def test_monthly_balances_stand_for_the_later_ledger(spark, shop, period, tmp_path):
    """The same report as the back-cast over the whole ledger; documents of later months are not read."""
    _, w = shop
    write_result(movement.monthly_net(w), str(tmp_path / "m"), "month")
    monthly = spark.read.schema(f"product_id bigint, net_qty {S.SUM_QTY}, month string").parquet(str(tmp_path / "m"))
    got = movement.inventory_movement(w, *period, monthly=monthly)
    assert bag(got) == bag(movement.inventory_movement(w, *period))
    upper = [f for f in scans(got) if "<= " in f]
    assert len(upper) == 8 and all(f"<= {period[1][:7]}" in f for f in upper), upper
