"""Customer and supplier debt.

The source computes each debt with correlated sub-queries per customer or
supplier. Here every formula is a set of per-key pre-aggregates (one
``groupBy`` per fact table, partial aggregation on the map side) joined on
the key, so one pass serves every customer or supplier at once and no
fact row is multiplied by a join before it is summed.

The four customer formulas disagree on purpose (order set, payments,
adjustments, clamping); each is kept as written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import semantics as S



_z = S.nz


def order_balance(t, cond, name="order_debt") -> DataFrame:
    """Σ(final - paid) per customer over the orders selected by ``cond``."""
    return (
        t.sales_orders.where(cond)
        .groupBy("customer_id")
        .agg(F.sum(_z("final_amount") - _z("paid_amount")).alias(name))
    )


def customer_payments_total(t, name="paid_total") -> DataFrame:
    return t.customer_payments.groupBy("customer_id").agg(F.sum(_z("amount")).alias(name))


def customer_adjustments_total(t, name="adjusted_total") -> DataFrame:
    return t.customer_debt_adjustments.groupBy("customer_id").agg(F.sum(_z("amount")).alias(name))


def _ledger_debt(t, customers: DataFrame | None = None) -> DataFrame:
    """Unclamped D1 per customer (orders not 'Cancelled' incl. returns - payments - adjustments).

    ``customers`` (default: the ids) carries extra columns through.
    """
    ids = t.customers.select("customer_id") if customers is None else customers
    keep = [c for c in ids.columns if c != "customer_id"]
    return (
        ids.join(order_balance(t, S.not_cancelled_isnull("status")), "customer_id", "left")
        .join(customer_payments_total(t), "customer_id", "left")
        .join(customer_adjustments_total(t), "customer_id", "left")
        .select(
            "customer_id", *keep,
            (_z("order_debt") - _z("paid_total") - _z("adjusted_total")).alias("debt"),
        )
    )


def customer_current_debt(t, customer_id=None) -> DataFrame:
    """Clamped ledger debt, one row per customer (or one customer)."""
    d = _ledger_debt(t)
    if customer_id is not None:
        d = d.where(F.col("customer_id") == F.lit(customer_id))
    return d.select("customer_id", S.clamp0("debt").cast(S.MONEY).alias("current_debt"))


def customers_with_debt(t) -> DataFrame:
    """Customers whose unclamped ledger debt is positive; debt desc, name."""
    c = t.customers.select("customer_id", "customer_code", "name", "phone", "address", "email")
    return (
        _ledger_debt(t, c).where(F.col("debt") > 0)
        .select(
            "customer_id",
            F.coalesce(F.col("customer_code"), F.lit("")).alias("customer_code"),
            F.coalesce(F.col("name"), F.lit("")).alias("customer_name"),
            F.coalesce(F.col("phone"), F.lit("")).alias("phone"),
            F.coalesce(F.col("address"), F.lit("")).alias("address"),
            F.coalesce(F.col("email"), F.lit("")).alias("email"),
            F.col("debt").cast(S.SUM_MONEY).alias("current_debt"),
            F.col("name").alias("_name"),
        )
        .orderBy(F.col("current_debt").desc(), F.col("_name").asc(), F.col("customer_id"))
        .drop("_name")
    )


def customer_debt_top_variant(t, ids: DataFrame | None = None) -> DataFrame:
    """D3: Σ(final-paid) over live non-return orders - payments, not clamped.

    ``ids`` (a frame with ``customer_id``) restricts the customers; by
    default every customer.
    """
    ids = t.customers.select("customer_id") if ids is None else ids.select("customer_id")
    od = order_balance(t, S.not_cancelled_broad("status") & S.is_sale("order_type"))
    return (
        ids.join(od, "customer_id", "left")
        .join(customer_payments_total(t), "customer_id", "left")
        .select("customer_id", (_z("order_debt") - _z("paid_total")).cast(S.SUM_MONEY).alias("current_debt"))
    )


def open_receivable_cond():
    return (
        S.status_in("status", ("Completed", "Partial"))
        & (_z("final_amount") > _z("paid_amount"))
        & S.is_sale("order_type")
    )


def customer_debt_total(t) -> DataFrame:
    """Σ(final-paid) of open receivables; payments are not subtracted."""
    return t.sales_orders.where(open_receivable_cond()).agg(
        F.coalesce(F.sum(_z("final_amount") - _z("paid_amount")), F.lit(0)).cast(S.MONEY).alias("total_debt_customer")
    )


def customer_debt_profit_variant(t, ids: DataFrame | None = None) -> DataFrame:
    """Per customer, open receivables - payments, clamped at 0."""
    ids = t.customers.select("customer_id") if ids is None else ids.select("customer_id")
    od = order_balance(t, open_receivable_cond())
    return (
        ids.join(od, "customer_id", "left")
        .join(customer_payments_total(t), "customer_id", "left")
        .select(
            "customer_id",
            S.clamp0(_z("order_debt") - _z("paid_total")).cast(S.SUM_MONEY).alias("current_debt"),
        )
    )


# ------------------------------------------------------------------ supplier


def returned_per_import(t) -> DataFrame:
    """Σ total_amount of live supplier returns per import."""
    return (
        t.purchase_returns.where(S.not_cancelled_broad("status"))
        .groupBy("import_id")
        .agg(F.sum(_z("total_amount")).alias("returned_amount"))
    )


def supplier_import_debt(t) -> DataFrame:
    """Σ per supplier of max(final - paid - returned, 0) over live imports."""
    per_import = (
        t.imports.where(S.not_cancelled_broad("status"))
        .select("import_id", "supplier_id", "final_amount", "paid_amount")
        .join(returned_per_import(t), "import_id", "left")
        .select(
            "supplier_id",
            S.clamp0(_z("final_amount") - _z("paid_amount") - _z("returned_amount")).alias("open_amount"),
        )
    )
    return per_import.groupBy("supplier_id").agg(F.sum("open_amount").alias("import_debt"))


def supplier_paid_total(t) -> DataFrame:
    return t.supplier_payments.groupBy("supplier_id").agg(F.sum(_z("amount")).alias("total_paid"))


def supplier_debt(t, supplier_id=None) -> DataFrame:
    """Per supplier, clamp(Σ clamped import debt - payments)."""
    ids = t.suppliers.select("supplier_id")
    if supplier_id is not None:
        ids = ids.where(F.col("supplier_id") == F.lit(supplier_id))
    return (
        ids.join(supplier_import_debt(t), "supplier_id", "left")
        .join(supplier_paid_total(t), "supplier_id", "left")
        .select(
            "supplier_id",
            S.clamp0(_z("import_debt") - _z("total_paid")).cast(S.SUM_MONEY).alias("current_debt"),
        )
    )


def suppliers_with_debt(t) -> DataFrame:
    """Suppliers with positive D6, contact and bank columns, by name."""
    s = t.suppliers
    d = supplier_debt(t).where(F.col("current_debt") > 0)

    def e(c):
        return F.coalesce(F.col(c), F.lit("")).alias(c)

    return (
        s.join(d, "supplier_id")
        .select(
            "supplier_id",
            e("supplier_name"), e("phone"), e("address"), e("email"), e("tax_code"),
            e("bank_name"), e("bank_account"), e("bank_owner"),
            F.coalesce(F.col("is_active"), F.lit(1)).alias("is_active"),
            "current_debt",
        )
        .orderBy("supplier_name", "supplier_id")
    )


def supplier_debt_total(t) -> DataFrame:
    """Σ over suppliers of D6 (one row)."""
    return supplier_debt(t).agg(F.coalesce(F.sum("current_debt"), F.lit(0)).cast(S.MONEY).alias("total_debt_supplier"))
