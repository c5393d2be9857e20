"""Stock movement: the five-way ledger and the back-cast movement report.

Scale notes
-----------
* The ledger is a ``unionByName`` of five narrow projections; each branch is
  one fact-to-header join whose header side is filtered first (status,
  date), so Catalyst pushes the predicates into the parquet scans.
* Opening/closing balances are *back-cast* from current stock: only
  movements dated on or after the period start can change them, so the
  ledger is cut at the start date before the union. The scan of the
  history before the period is skipped entirely (date pushdown).
* Period and after-period sums are fused into one ``groupBy(product_id)``
  with conditional sums: one shuffle on product, partial aggregation on the
  map side, so a product holding a third of all lines is pre-summed per
  task before the exchange.
* The product dimension is joined last, after aggregation; AQE picks a
  broadcast only when its measured size is under the threshold.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import semantics as S

def movement_ledger(t, since=None, until=None) -> DataFrame:
    """The ledger of stock movements (R2.1).

    PURCHASE_IN, SUPPLIER_RETURN_OUT, SALES_OUT (positive lines of paid or
    completed sales), RETURN_IN (absolute quantity of returns), STOCKTAKE
    (non-zero difference). Rows without date or product are dropped.
    ``since`` and ``until`` (optional) keep only movements on or after the one
    and before the other.
    """

    def dated(df, c):
        return S.during(df, c, since, end_exclusive=until).where(F.col(c).isNotNull())

    def lines_of(df, c):
        return S.in_months(df, c, since, end_exclusive=until).where(F.col("product_id").isNotNull())

    imports = dated(t.imports, "import_date").where(S.not_cancelled_broad("status")).select("import_id", "import_date")
    purchase_in = (
        lines_of(t.import_details, "import_date")
        .join(imports, "import_id")
        .select(
            "product_id",
            F.col("import_date").alias("movement_date"),
            S.base_qty("base_quantity", "quantity").alias("qty"),
            F.coalesce(
                F.col("total"), F.coalesce(F.col("import_price"), F.lit(0)) * F.coalesce(F.col("quantity"), F.lit(0))
            ).cast(S.MONEY).alias("amount"),
            F.lit("PURCHASE_IN").alias("movement_type"),
        )
    )

    returns = dated(t.purchase_returns, "return_date").where(S.not_cancelled_broad("status")).select(
        "return_id", "return_date"
    )
    supplier_return_out = (
        lines_of(t.purchase_return_details, "return_date")
        .join(returns, "return_id")
        .select(
            "product_id",
            F.col("return_date").alias("movement_date"),
            (-F.col("quantity").cast(S.QTY)).alias("qty"),
            F.coalesce(
                F.col("total"), F.coalesce(F.col("import_price"), F.lit(0)) * F.coalesce(F.col("quantity"), F.lit(0))
            ).cast(S.MONEY).alias("amount"),
            F.lit("SUPPLIER_RETURN_OUT").alias("movement_type"),
        )
    )

    orders = dated(t.sales_orders, "order_date").where(S.status_in("status", S.PAID_OR_COMPLETED)).select(
        "order_id", "order_date", "order_type"
    )
    # one pass over the sales lines yields both SALES_OUT and RETURN_IN rows
    lines = lines_of(t.order_items, "order_date").join(orders, "order_id")
    kind = (
        F.when(S.is_return("order_type"), F.lit("RETURN_IN"))
        .when(F.coalesce(F.col("quantity"), F.lit(0)) > 0, F.lit("SALES_OUT"))
    )
    bq = S.base_qty("base_quantity", "quantity")
    sales = (
        lines.withColumn("movement_type", kind)
        .where(F.col("movement_type").isNotNull())
        .select(
            "product_id",
            F.col("order_date").alias("movement_date"),
            F.when(F.col("movement_type") == "SALES_OUT", -bq).otherwise(F.abs(bq)).alias("qty"),
            (F.coalesce(F.col("unit_price"), F.lit(0)) * F.abs(F.coalesce(F.col("quantity"), F.lit(0))))
            .cast(S.MONEY).alias("amount"),
            "movement_type",
        )
    )

    checks = dated(t.inventory_checks, "check_date").select("check_id", "check_date")
    counted = lines_of(t.inventory_check_details, "check_date").where(F.coalesce(F.col("difference"), F.lit(0)) != 0)
    stocktake = counted.join(checks, "check_id").select(
        "product_id",
        F.col("check_date").alias("movement_date"),
        F.col("difference").cast(S.QTY).alias("qty"),
        F.lit(0).cast(S.MONEY).alias("amount"),
        F.lit("STOCKTAKE").alias("movement_type"),
    )

    return (
        purchase_in.unionByName(supplier_return_out)
        .unionByName(sales)
        .unionByName(stocktake)
    )


def movement_summary(ledger: DataFrame, start, end_exclusive) -> DataFrame:
    """Per product: in-period pivot (R2.2) and after-period net (R2.3), one pass."""
    in_period = S.in_half_open("movement_date", start, end_exclusive)
    after = F.col("movement_date") >= S.ts(end_exclusive)
    mt = F.col("movement_type")
    zero_q = F.lit(0).cast(S.QTY)
    zero_m = F.lit(0).cast(S.MONEY)

    def qsum(cond, value=F.col("qty")):
        return F.sum(F.when(cond, value).otherwise(zero_q))

    def msum(cond):
        return F.sum(F.when(cond, F.col("amount")).otherwise(zero_m))

    return ledger.groupBy("product_id").agg(
        qsum(in_period & (mt == "PURCHASE_IN")).alias("purchase_in_qty"),
        qsum(in_period & (mt == "SUPPLIER_RETURN_OUT"), F.abs("qty")).alias("supplier_return_out_qty"),
        qsum(in_period & (mt == "SALES_OUT"), F.abs("qty")).alias("sales_out_qty"),
        qsum(in_period & (mt == "RETURN_IN")).alias("return_in_qty"),
        qsum(in_period & (mt == "STOCKTAKE")).alias("stocktake_adjust_qty"),
        qsum(in_period).alias("net_period_qty"),
        msum(in_period & (mt == "PURCHASE_IN")).alias("purchase_in_value"),
        msum(in_period & (mt == "SUPPLIER_RETURN_OUT")).alias("supplier_return_out_value"),
        msum(in_period & (mt == "SALES_OUT")).alias("sales_out_value"),
        qsum(after).alias("net_after_period_qty"),
    )


def monthly_net(t) -> DataFrame:
    """Net movement per product and month ('yyyy-MM'), to be stored with ``write_result(..., "month")``."""
    return movement_ledger(t).groupBy("product_id", F.date_format("movement_date", "yyyy-MM").alias("month")).agg(
        F.sum("qty").cast(S.SUM_QTY).alias("net_qty"))


def _summary_with_months(t, start, end_exclusive, monthly: DataFrame) -> DataFrame:
    """``movement_summary`` that reads the ledger up to the end of the period's last month, and later months from ``monthly``."""
    last = end_exclusive - _dt.timedelta(microseconds=1)
    month_end = _dt.datetime(last.year + last.month // 12, last.month % 12 + 1, 1)
    near = movement_summary(movement_ledger(t, since=start, until=month_end), start, end_exclusive)
    later = monthly.where(F.col("month") > f"{last:%Y-%m}").groupBy("product_id").agg(F.sum("net_qty").alias("_later"))
    net = F.coalesce(F.col("net_after_period_qty"), F.lit(0)) + F.coalesce(F.col("_later"), F.lit(0))
    return near.join(later, "product_id", "full").withColumn("net_after_period_qty", net).drop("_later")


def inventory_movement(t, from_date, to_date, keyword: str = "", monthly: DataFrame | None = None) -> DataFrame:
    """Stock movement report (R2): opening, movements, closing per active product.

    Opening = current stock - after-period net - period net;
    closing = current stock - after-period net; closing value at import price.
    Dates are day-truncated, half-open: [from day, to day + 1).

    ``monthly``: a stored ``monthly_net``. Months after the period's last one
    are taken from it, so a report on an old period doesn't read the documents
    since. Its months must be up to date; later changes to them are not seen.
    """
    start = S.day_start(from_date)
    end_excl = S.day_after(to_date)
    if monthly is None:
        summary = movement_summary(movement_ledger(t, since=start), start, end_excl)
    else:
        summary = _summary_with_months(t, start, end_excl, monthly)

    products = t.products.where(
        (F.coalesce(F.col("is_active"), F.lit(1)) == 1)
        & S.keyword_match(keyword, "product_code", F.coalesce(F.col("barcode"), F.lit("")), "product_name")
    )
    p = (
        products.join(t.categories, "category_id", "left")
        .join(t.units, "unit_id", "left")
        .join(summary, "product_id", "left")
    )
    z = F.lit(0)
    stock = F.coalesce(F.col("stock"), z)
    after = F.coalesce(F.col("net_after_period_qty"), z)
    period = F.coalesce(F.col("net_period_qty"), z)

    def q(c):
        return F.coalesce(F.col(c), z).cast(S.QTY).alias(c)

    def m(c):
        return F.coalesce(F.col(c), z).cast(S.MONEY).alias(c)

    return p.select(
        "product_id",
        "product_code",
        F.coalesce(F.col("barcode"), F.lit("")).alias("barcode"),
        "product_name",
        F.coalesce(F.col("category_name"), F.lit("")).alias("category_name"),
        F.coalesce(F.col("unit_name"), F.lit("")).alias("unit_name"),
        (stock - after - period).cast(S.QTY).alias("opening_stock"),
        q("purchase_in_qty"),
        q("return_in_qty"),
        q("supplier_return_out_qty"),
        q("stocktake_adjust_qty"),
        q("sales_out_qty"),
        (stock - after).cast(S.QTY).alias("closing_stock"),
        stock.cast(S.QTY).alias("current_stock"),
        m("purchase_in_value"),
        m("supplier_return_out_value"),
        m("sales_out_value"),
        ((stock - after) * F.coalesce(F.col("import_price"), z)).cast(S.MONEY).alias("closing_cost_value"),
    ).orderBy("product_code", "product_name")
