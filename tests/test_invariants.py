"""Invariants of SURVEY §5 (c), on the driver's smallest tables."""

import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from shoptally.operators import debts, movement, posting, quality
from shoptally.sources.fixtures import ShopTables
from tests.conftest import SF_SMALL

AS_OF = dt.datetime(2026, 8, 20, 9, 30)


@pytest.fixture(scope="module")
def t(spark):
    return ShopTables(spark, SF_SMALL)


def test_movement_balances(t):
    r = movement.inventory_movement(t, "1996-01-01", "1997-12-31")
    bad = r.where(
        F.col("opening_stock") + F.col("purchase_in_qty") + F.col("return_in_qty") - F.col("supplier_return_out_qty")
        + F.col("stocktake_adjust_qty") - F.col("sales_out_qty") != F.col("closing_stock")
    )
    assert r.count() > 0 and bad.count() == 0


def test_supplier_debt_non_negative_and_sums_to_total(t):
    d = debts.supplier_debt(t)
    assert d.where(F.col("current_debt") < 0).count() == 0
    total = debts.supplier_debt_total(t).collect()[0][0]
    assert d.agg(F.sum("current_debt")).collect()[0][0] == total


def test_post_then_cancel_restores_stock(t, spark):
    posted = posting.return_request_post(t, t.return_requests, AS_OF)
    header = posted["header"].select("return_id", "return_code", "import_id", "supplier_id", "employee_id",
                                     "return_date", "total_amount", "status", F.col("note"))
    details = posted["details"]
    # the tables after posting
    t2 = SimpleNamespace(**{k: getattr(t, k) for k in ("products", "product_variants")})
    t2.purchase_returns = t.purchase_returns.select(*header.columns).unionByName(header)
    t2.purchase_return_details = t.purchase_return_details.select(*details.columns).unionByName(details)
    req = header.select((F.col("return_id") * 10).alias("request_id"), "return_id", "employee_id",
                        F.lit(None).cast("string").alias("reason"))
    cancelled = posting.return_cancel(t2, req, AS_OF)
    assert cancelled["result"].where(F.col("error_code").isNotNull()).count() == 0
    post_d = posting.stock_deltas(posted).groupBy("kind", "id").agg(F.sum("stock_delta").alias("p"))
    cancel_d = posting.stock_deltas(cancelled).groupBy("kind", "id").agg(F.sum("stock_delta").alias("c"))
    j = post_d.join(cancel_d, ["kind", "id"], "full_outer")
    assert j.count() > 0
    assert j.where(F.coalesce(F.col("p"), F.lit(0)) + F.coalesce(F.col("c"), F.lit(0)) != 0).count() == 0


def test_payroll_sync_is_idempotent(t):
    new = quality.payroll_cashbook_missing(t)
    assert new.count() > 0
    t2 = SimpleNamespace(**{k: getattr(t, k) for k in
                            ("cashbook_categories", "employee_payroll_payments", "employee_payrolls")})
    t2.cashbook_entries = t.cashbook_entries.select("reference_code", "is_deleted").unionByName(
        new.select("reference_code", F.lit(0).alias("is_deleted")))
    assert quality.payroll_cashbook_missing(t2).count() == 0


def test_customer_codes_unique_after_repairs(t):
    backfill = quality.customer_code_backfill(t).select("customer_id", F.col("customer_code").alias("_b"))
    dedupe = quality.customer_code_dedupe(t).select("customer_id", F.col("customer_code").alias("_d"))
    fixed = (
        t.customers.join(backfill, "customer_id", "left").join(dedupe, "customer_id", "left")
        .select(F.trim(F.coalesce("_d", "_b", "customer_code")).alias("code"))
    )
    dups = fixed.groupBy("code").count().where(F.col("count") > 1)
    assert dups.count() == 0, dups.collect()[:5]


def test_return_codes_unique_after_dedupe(t):
    d = quality.return_code_dedupe(t).select("return_id", F.col("return_code").alias("_n"))
    fixed = t.purchase_returns.join(d, "return_id", "left").select(F.coalesce("_n", "return_code").alias("c"))
    assert fixed.groupBy("c").count().where(F.col("count") > 1).count() == 0
    assert fixed.where(F.length("c") > 30).count() == 0
