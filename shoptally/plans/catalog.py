"""Registry: key -> callable(spark, sf_dir) -> DataFrame.

Each entry applies one operator to the shop tables derived from the
driver's parquet files in ``sf_dir`` with the parameters of ``params.P``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import semantics as S
from ..operators import movement
from ..sources.fixtures import PlantedSales, ShopTables, WrittenTables
from .params import P

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def query(key: str, tables=ShopTables):
    def deco(fn):
        QUERIES[key] = lambda spark, sf_dir: fn(tables(spark, sf_dir))
        QUERIES[key].__doc__ = fn.__doc__
        return fn

    return deco


@query("inventory_movement")
def _(t):
    return movement.inventory_movement(t, P.mv_from, P.mv_to)


@query("inventory_movement_monthly", WrittenTables)
def _(t):
    """R2 with the months after the period read from stored monthly balances."""
    import uuid

    from ..session import checkpoint_dir
    from ..sources.tables import write_result

    path = f"{checkpoint_dir(t.spark).rstrip('/')}/monthly-net-{uuid.uuid4().hex[:8]}"
    write_result(movement.monthly_net(t), path, "month")
    return movement.inventory_movement(t, P.mv_from, P.mv_to, monthly=t.spark.read.schema(f"product_id bigint, net_qty {S.SUM_QTY}, month string").parquet(path))


@query("movement_ledger")
def _(t):
    return movement.movement_ledger(t)


# ---------------------------------------------------------------- debts
from ..operators import debts, reports  # noqa: E402


@query("customer_current_debt")
def _(t):
    return debts.customer_current_debt(t)


@query("customers_with_debt")
def _(t):
    return debts.customers_with_debt(t)


@query("customer_debt_top_variant")
def _(t):
    return debts.customer_debt_top_variant(t)


@query("customer_debt_total")
def _(t):
    return debts.customer_debt_total(t)


@query("customer_debt_profit_variant")
def _(t):
    return debts.customer_debt_profit_variant(t)


@query("supplier_debt")
def _(t):
    return debts.supplier_debt(t)


@query("suppliers_with_debt")
def _(t):
    return debts.suppliers_with_debt(t)


@query("supplier_debt_total")
def _(t):
    return debts.supplier_debt_total(t)


# ---------------------------------------------------------------- reports
@query("overview_report")
def _(t):
    return reports.overview_report(t, P.from_dt, P.to_dt)


@query("cost_of_goods_sold")
def _(t):
    return reports.cost_of_goods_sold(t, P.from_dt, P.to_dt)


@query("cashbook_profit_split")
def _(t):
    return reports.cashbook_profit_split(t, P.cb_from, P.cb_to)


@query("supplier_statistics")
def _(t):
    return reports.supplier_statistics(t, P.from_dt, P.to_dt)


@query("top_selling_products")
def _(t):
    return reports.top_selling_products(t, P.from_dt, P.to_dt)


@query("customer_top")
def _(t):
    return reports.customer_top(t, P.top_n, P.from_dt, P.to_dt)


@query("customer_profit")
def _(t):
    return reports.customer_profit(t, P.from_dt, P.to_dt, P.top_n)


@query("order_cost")
def _(t):
    return reports.order_cost(t)


@query("product_sales_statistics")
def _(t):
    return reports.product_sales_statistics(t)


@query("products_with_sold")
def _(t):
    return reports.products_with_sold(t)


# ---------------------------------------------------------------- listings
from ..operators import listings as L  # noqa: E402

_LISTINGS = {
    "products_available": lambda t: L.products_available(t),
    "product_by_id": lambda t: L.product_by_id(t),
    "products_search": lambda t: L.products_search(t, P.kw_products),
    "products_search_in_stock": lambda t: L.products_search_in_stock(t, P.kw_in_stock, P.cat_in_stock),
    "products_search_for_import": lambda t: L.products_search_for_import(t, P.kw_for_import, P.cat_for_import),
    "imports_list": lambda t: L.imports_list(t, P.from_dt, P.to_dt, P.kw_imports, P.status_imports),
    "import_by_id": lambda t: L.import_by_id(t),
    "imports_by_supplier": lambda t: L.imports_by_supplier(t),
    "suppliers_all": lambda t: L.suppliers_all(t),
    "suppliers_search": lambda t: L.suppliers_search(t, P.kw_suppliers),
    "supplier_by_id": lambda t: L.supplier_by_id(t),
    "customer_payment_history": lambda t: L.customer_payment_history(t, P.cb_from, P.cb_to),
    "supplier_payment_history": lambda t: L.supplier_payment_history(t, P.cb_from, P.cb_to),
    "supplier_payment_list": lambda t: L.supplier_payment_list(t),
    "purchase_return_history": lambda t: L.purchase_return_history(t, P.from_dt, P.to_dt, P.kw_returns),
    "purchase_return_details": lambda t: L.purchase_return_details(t),
    "imports_returnable": lambda t: L.imports_returnable(t, P.from_dt, P.to_dt, P.kw_returnable),
    "import_lines_returnable": lambda t: L.import_lines_returnable(t),
    "cashbook_categories": lambda t: L.cashbook_categories(t, P.cb_type),
    "cashbook_search": lambda t: L.cashbook_search(t, P.cb_from, P.cb_to, None, P.kw_cashbook),
    "cashbook_summary": lambda t: L.cashbook_summary(t),
    "serials_available": lambda t: L.serials_available(t),
    "product_serial_trace": lambda t: L.product_serial_trace(t),
    "serial_trace": lambda t: L.serial_trace(t),
}
_LISTINGS |= {
    "product_by_id_one": lambda t: L.product_by_id(t, P.one_product),
    "import_by_id_one": lambda t: L.import_by_id(t, P.one_import),
    "imports_by_supplier_one": lambda t: L.imports_by_supplier(t, P.one_supplier),
    "supplier_by_id_one": lambda t: L.supplier_by_id(t, P.one_supplier),
    "serials_available_one": lambda t: L.serials_available(t, P.one_serial_product),
    "customer_current_debt_one": lambda t: debts.customer_current_debt(t, P.one_customer),
    "supplier_debt_one": lambda t: debts.supplier_debt(t, P.one_supplier),
    "imports_list_paid": lambda t: L.imports_list(t, P.from_dt, P.to_dt, P.kw_imports, "Paid"),
    "cashbook_search_in": lambda t: L.cashbook_search(t, P.cb_from, P.cb_to, " in", P.kw_cashbook),
    "cashbook_search_undated": lambda t: L.cashbook_search(t, None, None, None, P.kw_cashbook),
    "cashbook_summary_period": lambda t: L.cashbook_summary(t, P.cb_from, P.cb_to),
    "customer_top_undated": lambda t: reports.customer_top(t, P.top_n),
}
for _k, _f in _LISTINGS.items():
    query(_k)(_f)


# ---------------------------------------------------------------- quality
from ..operators import quality as Q  # noqa: E402

_QUALITY = {
    "payroll_cashbook_missing": lambda t: Q.payroll_cashbook_missing(t),
    "payroll_cashbook_void": lambda t: Q.payroll_cashbook_void(t, P.as_of),
    "cashbook_code_backfill": lambda t: Q.cashbook_code_backfill(t, P.as_of),
    "allocation_wrong_customer": lambda t: Q.allocation_wrong_customer(t),
    "allocation_over_amount": lambda t: Q.allocation_over_amount(t),
    "barcode_normalise": lambda t: Q.barcode_normalise(t),
    "barcode_duplicates": lambda t: Q.barcode_duplicates(t),
    "barcode_duplicate_products": lambda t: Q.barcode_duplicate_products(t),
    "duplicate_document_codes": lambda t: Q.duplicate_document_codes(t),
    "customer_code_backfill": lambda t: Q.customer_code_backfill(t),
    "customer_code_dedupe": lambda t: Q.customer_code_dedupe(t),
    "return_code_dedupe": lambda t: Q.return_code_dedupe(t),
    "bank_code_standardise": lambda t: Q.bank_code_standardise(t),
    "quantity_backfill": lambda t: Q.quantity_backfill(t),
    "import_quantity_backfill": lambda t: Q.import_quantity_backfill(t),
    "cost_price_backfill": lambda t: Q.cost_price_backfill(t),
    "variant_return_backfill": lambda t: Q.variant_return_backfill(t),
    "variant_return_stock_delta": lambda t: Q.variant_return_stock_delta(t),
    "duplicate_sale_detect": lambda t: Q.duplicate_sale_detect_shop(t),
    "duplicate_sale_reverse": lambda t: Q.duplicate_sale_reverse(t),
    "duplicate_sale_reverse_variants": lambda t: Q.duplicate_sale_reverse_variants(t),
    "duplicate_sale_reverse_points": lambda t: Q.duplicate_sale_reverse_points(t),
    "duplicate_sale_reverse_cashbook": lambda t: Q.duplicate_sale_reverse_cashbook(t, P.as_of),
    "unreferenced_duplicate_customer": lambda t: Q.unreferenced_duplicate_customer(t),
    "rekey_invalid_id": lambda t: Q.rekey_supplier_zero(t),
    "rekey_import_id": lambda t: Q.rekey_import_zero(t),
    "rekey_purchase_return_id": lambda t: Q.rekey_purchase_return_zero(t),
    "rekey_purchase_return_line_id": lambda t: Q.rekey_purchase_return_line_zero(t),
    "empty_stocktakes": lambda t: Q.empty_stocktakes(t),
    "blank_to_null_serial": lambda t: Q.blank_to_null_serial(t),
    "settlement_normalise": lambda t: Q.settlement_normalise(t),
    "payment_method_backfill": lambda t: Q.payment_method_backfill(t),
    "constraint_violations": lambda t: Q.constraint_violations(t),
}
for _k, _f in _QUALITY.items():
    query(_k, PlantedSales if _k.startswith("duplicate_sale_") else ShopTables)(_f)


# ---------------------------------------------------------------- posting
from ..operators import posting as T  # noqa: E402


def _stocktake_requests(t):
    return t.inventory_check_details.select("product_id", F.col("difference").alias("quantity"))


from pyspark.sql import functions as F  # noqa: E402

_POSTING = {
    "xml_line_items": lambda t: T.parse_return_items(t.return_requests),
    "return_request_validate": lambda t: T.return_request_validate(t, t.return_requests),
    "return_request_post": lambda t: T.return_request_post(t, t.return_requests, P.as_of)["header"],
    "return_request_details": lambda t: T.return_request_post(t, t.return_requests, P.as_of)["details"],
    "return_request_stock_delta": lambda t: T.stock_deltas(T.return_request_post(t, t.return_requests, P.as_of)),
    "return_request_idempotent": lambda t: T.return_request_validate(t, t.return_requests).where(
        F.col("outcome") == "existing"),
    "return_cancel": lambda t: T.return_cancel(t, t.return_cancel_requests, P.as_of)["result"],
    "return_cancel_stock_delta": lambda t: T.stock_deltas(
        {k: v for k, v in T.return_cancel(t, t.return_cancel_requests, P.as_of).items()}),
    "moving_average_cost": lambda t: T.moving_average_cost(t, T.receipts_from_imports(t), P.price_method),
    "moving_average_cost_latest": lambda t: T.moving_average_cost(t, T.receipts_from_imports(t), 2),
    "moving_average_cost_rejected": lambda t: T.receipts_rejected(t, t.receipt_requests),
    "stock_reduce": lambda t: T.stock_reduce(t, t.stock_reduce_requests),
    "stock_reduce_sequential": lambda t: T.stock_reduce_sequential(t, t.stock_reduce_requests),
    "stock_adjust": lambda t: T.stock_adjust(t, _stocktake_requests(t)),
    "order_cancel": lambda t: T.order_cancel(t, t.order_cancel_requests),
    "order_cancel_stock_delta": lambda t: T.order_cancel_stock_delta(t, t.order_cancel_requests),
    "order_delete_eligible": lambda t: T.order_delete_eligible(t, t.order_delete_requests),
    "serial_sell": lambda t: T.serial_sell(t, t.serial_sell_requests),
    "serial_update_validate": lambda t: T.serial_update_validate(t, t.serial_update_requests),
    "serial_receive": lambda t: T.serial_receive(t, t.serial_receive_requests, P.as_of),
    "serial_set_number": lambda t: T.serial_set_number(t, t.serial_update_requests),
    "cashbook_post": lambda t: T.cashbook_post(t, t.cashbook_requests),
    "cashbook_update": lambda t: T.cashbook_update(t, t.cashbook_update_requests, P.as_of),
    "cashbook_soft_delete": lambda t: T.cashbook_soft_delete(t, t.cashbook_delete_requests, P.as_of),
    "order_line_enrich": lambda t: T.order_line_enrich(t, t.order_line_requests),
    "payment_method_default": lambda t: T.payment_method_default(t.customer_payments, "payment_id"),
    "import_payment_method_default": lambda t: T.payment_method_default(t.imports, "import_id"),
}
for _k, _f in _POSTING.items():
    query(_k, WrittenTables if _k.startswith(("return_request_", "serial_update_", "serial_set_")) else ShopTables)(_f)


# ---------------------------------------------------------------- sources and sinks
from ..sources import seeds  # noqa: E402
from ..sources import tables as TB  # noqa: E402


@query("cashbook_category_seed")
def _(t):
    return seeds.cashbook_category_seed(t.cashbook_categories)


@query("typed_scan_period")
def _(t):
    """A1 + A4: write sales orders month-partitioned to the shared checkpoint
    folder, scan them back with the declared schema and a period filter
    (partition pruning on the month, row-group pruning on the date)."""
    import uuid

    from ..session import checkpoint_dir

    root = f"{checkpoint_dir(t.spark).rstrip('/')}/shop-{uuid.uuid4().hex[:8]}"
    TB.stage_partitioned(t.sales_orders, "sales_orders", root)
    a, b = S.parse_dt(P.from_dt), S.parse_dt(P.to_dt)
    return S.during(TB.read_shop_table(t.spark, root, "sales_orders", partitioned=True), "order_date", a, b)
