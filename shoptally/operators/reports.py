"""Reports: overview, supplier statistics, top sellers, customer profit, product sales.

Scale notes
-----------
* Single-row reports are built as several one-row aggregates combined with
  ``unionByName`` + one global aggregate (no cartesian product). Every
  measure over the same fact table is a conditional sum in *one* scan.
* Per-key reports aggregate facts by key first and attach dimension
  attributes afterwards, so the dimension join sees one row per key.
* Top-N uses ``orderBy(...).limit(n)`` which Spark plans as
  ``TakeOrderedAndProject``: each task keeps its own n best rows and only
  n x tasks rows reach the final merge. The key is always the last sort
  column so ties resolve the same way every run.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import semantics as S
from . import debts



_z = S.nz


def one_row(*frames: DataFrame) -> DataFrame:
    """Combine one-row frames with disjoint columns into one row.

    Each input holds exactly one row; the union is re-aggregated with
    ``max`` per column (every column is non-null in exactly one input).
    """
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    cols = [c for f in frames for c in f.columns]
    return u.agg(*[F.max(c).alias(c) for c in cols])


def line_cost(t, lines: DataFrame) -> DataFrame:
    """Attach ``unit_cost`` = NULLIF(cost_price,0) else product import price else 0."""
    prices = t.products.select("product_id", F.col("import_price").alias("_product_import_price"))
    return lines.join(prices, "product_id", "left").withColumn(
        "unit_cost", S.cost_expr("cost_price", "_product_import_price")
    )


# ---------------------------------------------------------------- R1 parts


def _sales_measures(t, start, end) -> DataFrame:
    """R1.1, R1.2, R1.7 and D4 in one pass over the orders.

    The receivables total (D4) needs every order, so the period measures
    are conditional sums in the same scan instead of a second, date-pruned
    scan of the same table.
    """
    o = t.sales_orders
    in_period = S.in_closed("order_date", start, end) & S.status_in("status", S.EFFECTIVE_SALE_STATUSES)
    sale = S.is_sale("order_type")
    return o.agg(
        F.coalesce(F.sum(F.when(in_period & sale, _z("final_amount"))), F.lit(0)).cast(S.MONEY).alias("gross_sales"),
        F.coalesce(F.sum(F.when(in_period & ~sale, F.abs(_z("final_amount")))), F.lit(0)).cast(S.MONEY)
        .alias("customer_return_amount"),
        F.count(F.when(in_period & sale, F.lit(1))).cast("int").alias("order_count"),
        F.coalesce(F.sum(F.when(debts.open_receivable_cond(), _z("final_amount") - _z("paid_amount"))), F.lit(0))
        .cast(S.MONEY).alias("total_debt_customer"),
    )


def _purchase_measures(t, start, end) -> tuple[DataFrame, DataFrame]:
    imp = S.within(t.imports, "import_date", start, end).where(S.not_cancelled_broad("status")).agg(
        F.coalesce(F.sum(_z("final_amount")), F.lit(0)).cast(S.MONEY).alias("total_purchase")
    )
    ret = S.within(t.purchase_returns, "return_date", start, end).where(S.not_cancelled_broad("status")).agg(
        F.coalesce(F.sum(_z("total_amount")), F.lit(0)).cast(S.MONEY).alias("purchase_return_amount")
    )
    return imp, ret


def cost_of_goods_sold(t, from_dt, to_dt) -> DataFrame:
    """R1.8: signed Σ unit cost x |base qty| over effective orders, clamped at 0."""
    start, end = S.parse_dt(from_dt), S.parse_dt(to_dt)
    orders = S.within(t.sales_orders, "order_date", start, end).where(S.status_in("status", S.EFFECTIVE_SALE_STATUSES)).select("order_id", "order_type")
    lines = S.in_months(t.order_items, "order_date", start, end).where(F.col("product_id").isNotNull()).join(orders, "order_id")
    lines = line_cost(t, lines)
    amount = F.col("unit_cost") * F.abs(S.base_qty("base_quantity", "quantity"))
    signed = F.when(S.is_return("order_type"), -amount).otherwise(amount)
    total = F.coalesce(F.sum(signed), F.lit(0)).cast(S.MONEY)
    return lines.agg(S.clamp0(total).cast(S.MONEY).alias("cost_of_goods_sold"))


def cashbook_profit_split(t, from_dt, to_dt) -> DataFrame:
    """R1.10: cashbook totals and profit-affecting totals, day-truncated period.

    An entry whose category is unknown counts as profit-affecting.
    """
    start, end_excl = S.day_start(from_dt), S.day_after(to_dt)
    e = S.during(t.cashbook_entries, "entry_date", start, end_exclusive=end_excl).where(F.col("is_deleted") == 0)
    cats = t.cashbook_categories.select("category_id", "affects_profit")
    j = e.join(cats, "category_id", "left")
    is_in = F.col("entry_type") == S.CASH_IN
    is_out = F.col("entry_type") == S.CASH_OUT
    affects = F.coalesce(F.col("affects_profit"), F.lit(1)) == 1

    def s(cond, name):
        return F.coalesce(F.sum(F.when(cond, F.col("amount")).otherwise(F.lit(0))), F.lit(0)).cast(S.MONEY).alias(name)

    return j.agg(
        s(is_in, "cashbook_total_income"),
        s(is_out, "cashbook_total_expense"),
        s(is_in & affects, "cashbook_income"),
        s(is_out & affects, "cashbook_expense"),
    )


def overview_report(t, from_dt, to_dt) -> DataFrame:
    """The 16-measure overview row."""
    start, end = S.parse_dt(from_dt), S.parse_dt(to_dt)
    sales = _sales_measures(t, start, end)
    imp, ret = _purchase_measures(t, start, end)
    cogs = cost_of_goods_sold(t, start, end)
    cash = cashbook_profit_split(t, start, end)
    sdebt = debts.supplier_debt_total(t)
    r = one_row(sales, imp, ret, cogs, cash, sdebt)
    net_revenue = S.clamp0(F.col("gross_sales") - F.col("customer_return_amount")).cast(S.MONEY)
    net_purchase = S.clamp0(F.col("total_purchase") - F.col("purchase_return_amount")).cast(S.MONEY)
    gross_profit = (net_revenue - F.col("cost_of_goods_sold")).cast(S.MONEY)
    return r.select(
        net_revenue.alias("total_revenue"),
        net_purchase.alias("total_cost"),
        "order_count",
        gross_profit.alias("gross_profit"),
        "cashbook_total_income",
        "cashbook_total_expense",
        "cashbook_income",
        "cashbook_expense",
        (gross_profit + F.col("cashbook_income") - F.col("cashbook_expense")).cast(S.MONEY).alias("net_profit_after_cashbook"),
        "total_debt_customer",
        "total_debt_supplier",
        "gross_sales",
        "customer_return_amount",
        "total_purchase",
        "purchase_return_amount",
        "cost_of_goods_sold",
    )


# ---------------------------------------------------------------- R3


def supplier_statistics(t, from_dt, to_dt, top: int = 50) -> DataFrame:
    """Imports and returns in the closed period plus current debt; top 50 by imports."""
    start, end = S.parse_dt(from_dt), S.parse_dt(to_dt)
    imp = (
        S.within(t.imports, "import_date", start, end).where(S.not_cancelled_broad("status"))
        .groupBy("supplier_id")
        .agg(F.sum("final_amount").alias("imp"))
    )
    ret = (
        S.within(t.purchase_returns, "return_date", start, end).where(S.not_cancelled_broad("status"))
        .groupBy("supplier_id")
        .agg(F.sum(_z("total_amount")).alias("ret"))
    )
    s = t.suppliers.select("supplier_id", "supplier_name", "phone")
    r = (
        s.join(imp, "supplier_id", "left")
        .join(ret, "supplier_id", "left")
        .join(debts.supplier_debt(t), "supplier_id", "left")
        .select(
            "supplier_id",
            F.coalesce(F.col("supplier_name"), F.lit("Không xác định")).alias("supplier_name"),
            F.coalesce(F.col("phone"), F.lit("")).alias("phone"),
            _z("imp").cast(S.SUM_MONEY).alias("total_import_amount"),
            _z("ret").cast(S.SUM_MONEY).alias("total_return_amount"),
            _z("current_debt").cast(S.SUM_MONEY).alias("current_debt"),
        )
        .where((F.col("total_import_amount") > 0) | (F.col("current_debt") > 0))
    )
    return r.orderBy(F.col("total_import_amount").desc(), F.col("supplier_id")).limit(top)


# ---------------------------------------------------------------- R4


def top_selling_products(t, from_dt, to_dt, top: int = 50) -> DataFrame:
    """Σ quantity and Σ quantity x unit price by product code and name.

    Returns (negative lines) are not filtered out, so they net against sales.
    """
    start, end = S.parse_dt(from_dt), S.parse_dt(to_dt)
    o = S.within(t.sales_orders, "order_date", start, end).where(F.col("status").isin(*S.PAID_OR_COMPLETED))
    per_product = (
        S.in_months(t.order_items, "order_date", start, end).join(o.select("order_id"), "order_id")
        .groupBy("product_id")
        .agg(
            F.sum("quantity").alias("q"),
            F.sum(F.col("quantity") * F.col("unit_price")).alias("v"),
        )
    )
    p = t.products.select("product_id", "product_code", "product_name")
    r = (
        per_product.join(p, "product_id")
        .groupBy("product_code", "product_name")
        .agg(
            F.sum("q").cast("bigint").alias("total_quantity"),
            F.sum("v").cast(S.SUM_MONEY).alias("total_revenue"),
        )
    )
    return r.orderBy(F.col("total_quantity").desc(), "product_code", "product_name").limit(top)


# ---------------------------------------------------------------- R5 / R6


def order_cost(t) -> DataFrame:
    """R6.1: Σ unit cost x |base qty| per order (all lines, unknown product allowed)."""
    lines = line_cost(t, t.order_items)
    return lines.groupBy("order_id").agg(
        F.sum(F.col("unit_cost") * F.abs(S.base_qty("base_quantity", "quantity"))).cast(S.SUM_QTY).alias("cost_of_goods_sold")
    )


def _customer_measures(t, live, **period) -> DataFrame:
    """Per customer: order count, net revenue, net cost, first/last order date over the ``live`` orders of a period.

    Revenue is per order (sign by type); cost is summed per line with the
    order's sign, which equals the per-order cost sub-query summed over
    orders. Aggregation is by customer_id only; attributes come later.
    """
    o = S.during(t.sales_orders, "order_date", **period).where(live).select(
        "order_id", "customer_id", "order_date", "order_type", "final_amount", "total_amount"
    )
    ret = S.is_return("order_type")
    amount = F.abs(F.coalesce(F.col("final_amount"), F.col("total_amount"), F.lit(0)))
    rev = o.groupBy("customer_id").agg(
        F.sum(F.when(ret, F.lit(0)).otherwise(F.lit(1))).cast("bigint").alias("total_orders"),
        F.sum(F.when(ret, -amount).otherwise(amount)).alias("rev"),
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
    )
    lines = line_cost(t, S.in_months(t.order_items, "order_date", **period).join(o.select("order_id", "customer_id", "order_type"), "order_id"))
    c = F.col("unit_cost") * F.abs(S.base_qty("base_quantity", "quantity"))
    cost = lines.groupBy("customer_id").agg(F.sum(F.when(ret, -c).otherwise(c)).alias("cost"))
    return rev.join(cost, "customer_id", "left")


def _profit_columns():
    rev = _z("rev")
    cost = _z("cost")
    gp = rev - cost
    margin = F.when(rev == 0, F.lit(0.0)).otherwise(F.round(gp.cast("double") * 100.0 / rev.cast("double"), 4))
    return [
        rev.cast(S.SUM_MONEY).alias("total_revenue"),
        cost.cast(S.SUM_QTY).alias("total_cost"),
        gp.cast(S.SUM_QTY).alias("gross_profit"),
        margin.alias("profit_margin"),
    ]


def _with_balance(t, ranked: DataFrame, owed) -> DataFrame:
    """``ranked`` with ``_balance``: Σ(final - paid) over the orders that are ``owed``, less payments.

    The chosen customers (at most the report's N) filter orders and payments
    before anything is aggregated, and their subtree is read once. Its limit
    gives the join its size: small ones are broadcast, others shuffled. Orders
    not owed count 0, which keeps a chosen customer without debts.
    """
    amounts = t.sales_orders.select(
        "customer_id", F.when(owed, _z("final_amount") - _z("paid_amount")).otherwise(F.lit(0)).alias("_amount")
    ).unionByName(t.customer_payments.select("customer_id", (-_z("amount")).alias("_amount")))
    return amounts.join(ranked, "customer_id").groupBy(*ranked.columns).agg(F.sum("_amount").alias("_balance"))


def customer_top(t, top: int = 20, from_dt=None, to_dt=None) -> DataFrame:
    """Top customers by net revenue over live orders; unclamped debt (D3).

    Either date may be None (no bound); the end bound is ``to + 1 day``
    without truncation.
    """
    end = None if to_dt is None else S.parse_dt(to_dt) + _dt.timedelta(days=1)
    m = _customer_measures(t, S.not_cancelled_broad("status"), start=from_dt, end_exclusive=end)
    c = t.customers.select("customer_id", "name", "phone", "email", "address", "points", "created_at")
    ranked = (
        m.join(c, "customer_id")
        .select(
            "customer_id",
            F.col("name").alias("customer_name"),
            "phone", "email", "address", "points", "created_at",
            "total_orders", *_profit_columns(), "first_order_date", "last_order_date",
        )
        .orderBy(F.col("total_revenue").desc(), "customer_id")
        .limit(top)
    )
    owed = S.not_cancelled_broad("status") & S.is_sale("order_type")
    return (
        _with_balance(t, ranked, owed)
        .select(*ranked.columns, F.col("_balance").cast(S.SUM_MONEY).alias("current_debt"))
        .orderBy(F.col("total_revenue").desc(), "customer_id")
    )


def customer_profit(t, from_dt, to_dt, top: int = 20) -> DataFrame:
    """Customer profit over effective orders in the closed period; top N, then clamped debt."""
    m = _customer_measures(t, S.status_in("status", S.EFFECTIVE_SALE_STATUSES) & F.lit(None not in (from_dt, to_dt)), start=from_dt, end=to_dt)
    c = t.customers.select(
        "customer_id",
        F.coalesce(S.blank_to_null("customer_code"), S.code6("KH", "customer_id")).alias("customer_code"),
        F.coalesce(F.col("name"), F.lit("")).alias("customer_name"),
        F.coalesce(F.col("phone"), F.lit("")).alias("phone"),
        F.coalesce(F.col("address"), F.lit("")).alias("address"),
        F.coalesce(F.col("points"), F.lit(0)).alias("points"),
    )
    ranked = (
        m.join(c, "customer_id")
        .select(
            "customer_id", "customer_code", "customer_name", "phone", "address", "points",
            "total_orders", *_profit_columns(), "first_order_date", "last_order_date",
        )
        .orderBy(F.col("total_revenue").desc(), "customer_id")
        .limit(top)
    )
    return (
        _with_balance(t, ranked, debts.open_receivable_cond())
        .select(*ranked.columns, S.clamp0("_balance").cast(S.SUM_MONEY).alias("current_debt"))
        .orderBy(F.col("total_revenue").desc(), "customer_name", "customer_id")
    )


# ---------------------------------------------------------------- R7 / R8


def _sold_per_product(t) -> DataFrame:
    o = t.sales_orders.where(S.not_cancelled_strict("status")).select("order_id")
    return t.order_items.join(o, "order_id").groupBy("product_id").agg(F.sum("quantity").alias("sold"))


def _product_catalogue(t) -> DataFrame:
    return t.products.join(t.categories, "category_id", "left").join(t.units, "unit_id", "left")


def _product_sales_columns():
    return [
        "product_id", "product_code", "barcode", "product_name", "category_id",
        F.coalesce(F.col("category_name"), F.lit("Chưa phân loại")).alias("category_name"),
        "unit_id",
        F.coalesce(F.col("unit_name"), F.lit("")).alias("unit_name"),
        "sell_price", "stock", "is_active", "created_at",
        F.coalesce(F.col("import_price"), F.lit(0)).cast(S.MONEY).alias("import_price"),
        F.coalesce(F.col("warranty_months"), F.lit(0)).alias("warranty_months"),
        F.coalesce(F.col("has_serial"), F.lit(0)).alias("has_serial"),
        "image_path",
        _z("sold").cast("bigint").alias("total_quantity_sold"),
    ]


def product_sales_statistics(t) -> DataFrame:
    """Every product with quantity sold on orders whose status is not 'Cancelled'."""
    return (
        _product_catalogue(t)
        .join(_sold_per_product(t), "product_id", "left")
        .select(*_product_sales_columns())
        .orderBy(F.col("total_quantity_sold").desc(), "product_id")
    )


def products_with_sold(t) -> DataFrame:
    """Full catalogue with sold quantity, ordered by name."""
    return (
        _product_catalogue(t)
        .join(_sold_per_product(t), "product_id", "left")
        .select(*_product_sales_columns())
        .orderBy("product_name", "product_id")
    )
