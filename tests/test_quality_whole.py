"""Rules that the derived tables don't reach: id-0 repairs of imports and returns, wallet rows, late constraints."""

import datetime as dt
from decimal import Decimal
from types import SimpleNamespace

from pyspark.sql import functions as F

from shoptally.operators import quality
from shoptally.sources.fixtures import PlantedSales
from shoptally.sources.tables import SHOP_SCHEMAS
from tests.conftest import SF_SMALL


def shop(spark, **tables):
    """Declared tables with the given rows (dicts); the others are empty."""
    def frame(name):
        schema = spark.createDataFrame([], SHOP_SCHEMAS[name]).schema
        return spark.createDataFrame([tuple(r.get(f) for f in schema.names) for r in tables.get(name, [])], schema)

    return SimpleNamespace(**{n: frame(n) for n in SHOP_SCHEMAS})


def bag(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_rekey_children(spark):
    t = shop(spark, suppliers=[{"supplier_id": 0}, {"supplier_id": 4}], supplier_debt_adjustments=[{"adjustment_id": 9, "supplier_id": 0}],
             imports=[{"import_id": 0, "supplier_id": 4}, {"import_id": 7}], import_details=[{"import_detail_id": 1, "import_id": 0}, {"import_detail_id": 2, "import_id": 7}],
             product_serials=[{"serial_id": 3, "import_id": 0}], purchase_returns=[{"return_id": 0, "import_id": 0}, {"return_id": -2}],
             purchase_return_details=[{"return_detail_id": 0, "return_id": 0}, {"return_detail_id": 5, "return_id": 0}],
             supplier_debt_discount_allocations=[{"allocation_id": 6, "adjustment_id": 9, "import_id": 0}])
    cols = "table_name", "row_key", "old_id", "new_id"
    assert bag(quality.rekey_supplier_zero(t), *cols) == [("supplier_debt_adjustments", "9", 0, 5), ("suppliers", "0", 0, 5)]
    assert bag(quality.rekey_import_zero(t), *cols) == [
        ("import_details", "1", 0, 8), ("imports", "0", 0, 8), ("product_serials", "3", 0, 8), ("purchase_returns", "0", 0, 8),
        ("supplier_debt_discount_allocations", "6", 0, 8)]
    assert bag(quality.rekey_purchase_return_zero(t), *cols) == [
        ("purchase_return_details", "0", 0, 1), ("purchase_return_details", "5", 0, 1), ("purchase_returns", "0", 0, 1)]
    assert bag(quality.rekey_purchase_return_line_zero(t), *cols) == [("purchase_return_details", "0", 0, 6)]


def test_wallet_rows_keep_customer_and_order(spark):
    twins = [{"customer_id": i, "name": "An", "phone": "1"} for i in (1, 2, 3)]
    t = shop(spark, customers=twins, customer_wallet_transactions=[{"wallet_transaction_id": 1, "customer_id": 3}])
    assert bag(quality.unreferenced_duplicate_customer(t), "customer_id") == [(1,), (2,)]
    when = dt.datetime(2024, 1, 1, 10)
    rows = [(i, "SALE", Decimal(5), when + dt.timedelta(seconds=i)) for i in (1, 2, 3)]
    o = spark.createDataFrame(rows, "order_id long, order_type string, final_amount decimal(18,0), order_date timestamp_ntz")
    o = o.withColumns({c: F.lit(None) for c, _ in quality.HEADER_KEYS if c not in o.columns})
    lines = spark.createDataFrame([(i, 7, None, 1, None, Decimal(5), None) for i in (1, 2, 3)],
                                  "order_id long, product_id long, product_variant_id long, quantity int, gift_quantity int, unit_price decimal(18,0), serial_number string")
    wallet = spark.createDataFrame([(3,)], "order_id long")
    got = quality.duplicate_sale_detect(o, lines, wallet.limit(0), wallet_orders=wallet)
    assert bag(got, "order_id", "duplicate_of") == [(1, 2), (2, 1)]
    real = PlantedSales(spark, SF_SMALL)
    hits = [r.order_id for r in quality.duplicate_sale_detect_shop(real).collect()]
    paid = spark.createDataFrame([(i,) for i in hits], "order_id long").withColumn("customer_id", F.lit(1))
    real._frames["customer_wallet_transactions"] = paid
    assert hits and quality.duplicate_sale_detect_shop(real).count() == quality.duplicate_sale_reverse(real).count() == 0


def test_late_constraints(spark):
    pay = [{"adjustment_id": i, "adjustment_type": k, "amount": Decimal(a)} for i, (k, a) in enumerate(
        [("BONUS", 1), ("ALLOWANCE", 1), ("DEDUCTION", 0), ("bonus", 1), (None, 1)])]
    alloc = [{"allocation_id": i, "adjustment_id": 1, "import_id": m, "amount": Decimal(a)} for i, (m, a) in enumerate([(1, 1), (1, 2), (2, -1)])]
    t = shop(spark, employee_payroll_adjustments=pay, supplier_debt_discount_allocations=alloc,
             supplier_debt_adjustments=[{"adjustment_id": 1, "amount": Decimal(1)}, {"adjustment_id": 2}],
             employee_payrolls=[{"payroll_id": i, "payroll_month": m, "employee_id": e} for i, (m, e) in enumerate(
                 [(dt.date(2024, 1, 1), 7), (dt.date(2024, 1, 1), 7), (dt.date(2024, 2, 1), 7), (dt.date(2024, 1, 1), 8)])],
             imports=[{"import_id": i, "import_code": f"PN{i}", "supplier_credit_applied": c} for i, c in enumerate([Decimal(-1), Decimal(0), None])],
             store_info=[{"store_name": "a", "import_price_method": 2}, {"store_name": "b", "import_price_method": 3}, {"store_name": "c"}])
    assert bag(quality.constraint_violations(t), "rule", "table_name", "row_key") == sorted([
        ("adjustment_type_valid", "employee_payroll_adjustments", "3"), ("adjustment_type_valid", "employee_payroll_adjustments", "4"),
        ("amount_positive", "employee_payroll_adjustments", "2"), ("amount_positive", "supplier_debt_adjustments", "2"),
        ("amount_positive", "supplier_debt_discount_allocations", "2"), ("allocation_unique", "supplier_debt_discount_allocations", "1|1"),
        ("credit_not_negative", "imports", "0"), ("month_employee_unique", "employee_payrolls", "2024-01-01|7"),
        ("price_method_1_2", "store_info", "b")])


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_constraints_read_each_table_once(spark, tmp_path):
    """A scan per table and one exchange, whatever the number of rules; repeated rows are reported each."""
    t = shop(spark)
    rules = {**quality._row_rules(), **quality._unique_rules()}
    for name in rules:
        getattr(t, name).write.parquet(str(tmp_path / name))
    read = SimpleNamespace(**{n: spark.read.parquet(str(tmp_path / n)) for n in rules})
    plan = _plan(quality.constraint_violations(read)).split("Initial Plan")[-1]
    assert plan.count("FileScan parquet") == len(rules) and plan.count("Exchange ") == 1
    t = shop(spark, customer_debt_discount_allocations=[{"adjustment_id": 1, "order_id": 2, "amount": Decimal(0)}] * 2)
    key = "customer_debt_discount_allocations", "1|2"
    assert bag(quality.constraint_violations(t), "rule", "table_name", "row_key") == [("allocation_unique", *key), *[("amount_positive", *key)] * 2]


def _sales(spark, heads, lines):
    when = dt.datetime(2024, 1, 1, 10)
    o = spark.createDataFrame([(i, "SALE", Decimal(a), when + dt.timedelta(seconds=s)) for i, a, s in heads],
                              "order_id long, order_type string, final_amount decimal(18,0), order_date timestamp_ntz")
    o = o.withColumns({c: F.lit(None) for c, _ in quality.HEADER_KEYS if c not in o.columns})
    schema = "order_id long, product_id long, product_variant_id long, quantity int, gift_quantity int, unit_price decimal(18,0), serial_number string"
    return o, spark.createDataFrame([(i, p, None, q, None, Decimal(5), s) for i, p, q, s in lines], schema)


def test_duplicate_sales_compare_the_lines_themselves(spark, monkeypatch):
    """A planted collision: all lines hash alike, so only the comparison of lines tells the orders apart."""
    monkeypatch.setattr(quality, "_line_hash", lambda *cols: F.lit(1).cast("long"))
    o, lines = _sales(spark, [(1, 5, 0), (2, 5, 3), (11, 6, 0), (12, 6, 3), (21, 7, 0), (22, 7, 3)],
                      [(1, 7, 1, None), (2, 8, 1, None), (11, 7, 1, "s"), (11, 7, 1, "s"), (11, 8, 1, None), (12, 8, 1, None), (12, 7, 1, "s"), (12, 7, 1, "s"),
                       (21, 7, 1, None), (21, 7, 1, None), (22, 7, 1, None), (22, 7, 1, None), (22, 7, 1, None)])
    got = quality.duplicate_sale_detect(o, lines, spark.createDataFrame([], "order_id long"), wallet_orders=None)
    assert bag(got, "order_id", "duplicate_of") == [(11, 12), (12, 11)]


def test_lines_of_other_sales_are_not_counted(spark, tmp_path):
    """Lines meet the headers that repeat within seconds before any aggregate."""
    o, lines = _sales(spark, [(1, 5, 0), (2, 5, 30), (3, 5, 61), (4, 6, 62)], [(i, 7, 1, None) for i in range(1, 5)])
    lines.write.parquet(str(tmp_path / "lines"))
    got = quality.duplicate_sale_detect(o, spark.read.parquet(str(tmp_path / "lines")), spark.createDataFrame([], "order_id long"), wallet_orders=None)
    assert bag(got, "order_id", "duplicate_of") == [(1, 2), (2, 1)]
    plan = _plan(got).split("Initial Plan")[-1].splitlines()
    scan = next(i for i, line in enumerate(plan) if "FileScan parquet" in line)
    above = [line for line in plan[:scan] if "Join" in line or "Aggregate" in line]
    assert "LeftSemi" in above[-1], above[-1]
