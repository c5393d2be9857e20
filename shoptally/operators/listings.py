"""Catalogue and document listings (L1-L24): projection, filter, join, sort.

The source's single-id look-ups (product, import, supplier, serial ...) are
the list operators with an optional id filter: ``None`` lists every id, so
one plan serves a screen look-up and a full export. Optional parameters are
turned into predicates in Python, never into ``(@x IS NULL OR ...)`` in the
plan, so the remaining predicates push down to the scans.

Dimension joins (categories, units, employees, suppliers) are plain left
joins: AQE broadcasts them when their measured size is under the broadcast
threshold and falls back to a shuffle join otherwise.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import semantics as S


_z = S.nz


def _s(c, v=""):
    return F.coalesce(S.col(c), F.lit(v))


def _eq(c, v):
    return F.lit(True) if v is None else (F.col(c) == F.lit(v))


# ---------------------------------------------------------------- products


def products_available(t) -> DataFrame:
    """L1: active products with constant unit/cost columns, by name."""
    return (
        t.products.where(F.col("is_active") == 1)
        .select(
            "product_id", "product_code", "barcode", "product_name", "category_id", "stock", "sell_price",
            "created_at", F.lit("").alias("unit"), F.lit(0).alias("cost_price"), "image_path",
            _z("warranty_months").alias("warranty_months"), _z("has_serial").alias("has_serial"),
        )
        .orderBy("product_name", "product_id")
    )


def _product_detail_columns(default_category: str | None):
    cat = F.col("category_name") if default_category is None else _s("category_name", default_category)
    return [
        "product_id", "product_code", "barcode", "product_name", "category_id", cat.alias("category_name"),
        "unit_id", _s("unit_name").alias("unit_name"), "sell_price", "stock", "is_active", "created_at",
    ]


def product_by_id(t, product_id=None) -> DataFrame:
    """L2: product with category ('Chưa phân loại' when missing) and unit."""
    p = t.products.where(_eq("product_id", product_id))
    return (
        p.join(t.categories, "category_id", "left")
        .join(t.units, "unit_id", "left")
        .select(
            *_product_detail_columns("Chưa phân loại"),
            _z("import_price").cast(S.MONEY).alias("import_price"),
            _z("warranty_months").alias("warranty_months"), _z("has_serial").alias("has_serial"), "image_path",
        )
    )


def _name_code_barcode(keyword):
    # ``@Keyword = ''`` without ISNULL/trim: a NULL keyword returns nothing
    return S.keyword_match(
        keyword, "product_name", "product_code", _s("barcode"), trim=False, null_is_empty=False
    )


def products_search(t, keyword: str) -> DataFrame:
    """L3: active products matching the keyword on name, code or barcode."""
    p = t.products.where((F.col("is_active") == 1) & _name_code_barcode(keyword))
    return (
        p.join(t.categories, "category_id", "left")
        .join(t.units, "unit_id", "left")
        .select(
            *_product_detail_columns(None), "import_price",
            _z("warranty_months").alias("warranty_months"), _z("has_serial").alias("has_serial"), "image_path",
        )
        .orderBy("product_name", "product_id")
    )


def _search_by_category(t, keyword, category_id, in_stock: bool) -> DataFrame:
    cond = (F.col("is_active") == 1) & _name_code_barcode(keyword)
    if in_stock:
        cond = cond & (F.col("stock") > 0)
    if category_id is None:
        cond = cond & F.lit(False)  # ``@CategoryId = 0 OR ...`` is unknown for NULL
    elif category_id != 0:
        cond = cond & (F.col("category_id") == F.lit(category_id))
    return (
        t.products.where(cond)
        .join(t.categories, "category_id", "left")
        .select(
            "product_id", "product_code", "barcode", "product_name", "category_id", "sell_price", "stock",
            "is_active", "created_at", "import_price", "unit_id", "warranty_months", "has_serial", "image_path",
            "category_name",
        )
        .orderBy("product_name", "product_id")
    )


def products_search_in_stock(t, keyword: str, category_id: int = 0) -> DataFrame:
    """L4: L3 restricted to stock > 0 and a category (0 = all)."""
    return _search_by_category(t, keyword, category_id, in_stock=True)


def products_search_for_import(t, keyword: str, category_id: int = 0) -> DataFrame:
    """L4 without the stock filter."""
    return _search_by_category(t, keyword, category_id, in_stock=False)


# ---------------------------------------------------------------- imports


def _import_people(t, imports: DataFrame) -> DataFrame:
    s = t.suppliers.select("supplier_id", "supplier_name", F.col("phone").alias("supplier_phone"),
                           F.col("address").alias("supplier_address"))
    e = t.employees.select("employee_id", F.col("name").alias("employee_name"))
    return imports.join(s, "supplier_id", "left").join(e, "employee_id", "left")


def imports_list(t, from_dt, to_dt, keyword, status=None) -> DataFrame:
    """Imports in the closed period, keyword over code/supplier/employee/note, status filter."""
    cond = F.lit(True) if status in (None, "", "All") else F.col("status") == F.lit(status)
    kw = S.keyword_match(keyword, "import_code", "supplier_name", "employee_name", "note", trim=False)
    return (
        _import_people(t, S.within(t.imports, "import_date", from_dt, to_dt)).where(cond & kw)
        .select(
            "import_id", "import_code", "supplier_id", "employee_id", "supplier_name", "import_date",
            "employee_name", "total_amount", "discount", "vat_amount", "final_amount", "paid_amount",
            _s("payment_method", S.DEFAULT_PAYMENT_METHOD).alias("payment_method"), "status", "note",
        )
        .orderBy(F.col("import_date").desc(), F.col("import_id").desc())
    )


def import_by_id(t, import_id=None) -> DataFrame:
    """Import header with supplier, employee and default payment method."""
    return _import_people(t, t.imports).where(_eq("import_id", import_id)).select(
        "import_id", "import_code", "supplier_id", "employee_id", "import_date", "total_amount", "vat_amount",
        "discount", "final_amount", "paid_amount",
        _s("payment_method", S.DEFAULT_PAYMENT_METHOD).alias("payment_method"), "note", "status",
        "supplier_name", "supplier_phone", "supplier_address", "employee_name",
    )


def imports_by_supplier(t, supplier_id=None) -> DataFrame:
    """Imports of a supplier (all when None) with the returned amount per import."""
    returned = (
        t.purchase_returns.where(S.not_cancelled_broad("status"))
        .groupBy("import_id")
        .agg(F.sum("total_amount").alias("ret"))
    )
    return (
        _import_people(t, t.imports).where(_eq("supplier_id", supplier_id))
        .join(returned, "import_id", "left")
        .select(
            "import_id", "import_code", "supplier_id", "employee_id", "import_date", "total_amount", "vat_amount",
            "discount", "final_amount", "paid_amount",
            _s("payment_method", S.DEFAULT_PAYMENT_METHOD).alias("payment_method"),
            _z("ret").cast(S.SUM_MONEY).alias("returned_amount"), "note", "status", "supplier_name", "employee_name",
        )
        .orderBy(F.col("import_date").desc(), "import_id")
    )


# ---------------------------------------------------------------- suppliers


def _supplier_columns():
    return [
        "supplier_id", "supplier_name", "phone", "address", "email", "tax_code",
        _s("bank_code").alias("bank_code"), "bank_name", "bank_account", "bank_owner", "is_active",
    ]


def suppliers_all(t) -> DataFrame:
    """Every supplier, by name."""
    return t.suppliers.select(*_supplier_columns()).orderBy("supplier_name", "supplier_id")


def suppliers_search(t, keyword: str) -> DataFrame:
    """Active suppliers with the keyword in name, phone or bank columns.

    There is no empty-keyword shortcut: '' matches every non-NULL column.
    """
    cond = (F.col("is_active") == 1) & S.like_any(
        keyword, "supplier_name", "phone", "bank_code", "bank_name", "bank_account", "bank_owner"
    )
    return t.suppliers.where(cond).select(*_supplier_columns()).orderBy("supplier_name", "supplier_id")


def supplier_by_id(t, supplier_id=None) -> DataFrame:
    """One supplier (all when None)."""
    return t.suppliers.where(_eq("supplier_id", supplier_id)).select(*_supplier_columns())


# ---------------------------------------------------------------- payments


def _employees(t):
    return t.employees.select("employee_id", F.col("name").alias("employee_name"))


def customer_payment_history(t, from_dt, to_dt) -> DataFrame:
    """Customer payments in [from, to] with customer (inner) and employee, newest first."""
    p = S.within(t.customer_payments, "payment_date", from_dt, to_dt)
    c = t.customers.select("customer_id", F.col("name").alias("customer_name"))
    return (
        p.join(c, "customer_id")
        .join(_employees(t), "employee_id", "left")
        .select(
            "payment_id", "customer_id", "customer_name", "payment_date", "amount", "employee_id", "employee_name",
            _s("payment_method", S.DEFAULT_PAYMENT_METHOD).alias("payment_method"), "note",
        )
        .orderBy(F.col("payment_date").desc(), "payment_id")
    )


def _supplier_payments(t, payments: DataFrame) -> DataFrame:
    s = t.suppliers.select("supplier_id", "supplier_name")
    return (
        payments
        .join(s, "supplier_id", "left")
        .join(_employees(t), "employee_id", "left")
        .select(
            "payment_id", "supplier_id", "supplier_name", "payment_date", "amount",
            _s("payment_method", S.DEFAULT_PAYMENT_METHOD).alias("payment_method"), "note",
            "employee_id", "employee_name",
        )
        .orderBy(F.col("payment_date").desc(), "payment_id")
    )


def supplier_payment_history(t, from_dt, to_dt) -> DataFrame:
    """Supplier payments in the closed period, newest first."""
    return _supplier_payments(t, S.within(t.supplier_payments, "payment_date", from_dt, to_dt))


def supplier_payment_list(t, supplier_id=None) -> DataFrame:
    """Payments of one supplier (all when None)."""
    return _supplier_payments(t, t.supplier_payments.where(_eq("supplier_id", supplier_id)))


# ---------------------------------------------------------------- supplier returns


def _variant_display(product_name, with_null_name_default: bool):
    """Product name, or 'name • variant' where variant = name, 'colour / size' or sku."""
    color = F.nullif(F.col("color_value"), F.lit(""))
    size = F.nullif(F.col("size_value"), F.lit(""))
    sep = F.when(color.isNotNull() & size.isNotNull(), F.lit(" / ")).otherwise(F.lit(""))
    # CONCAT treats NULL as '': concat_ws with an empty separator does the same
    color_size = F.nullif(F.concat_ws("", color, sep, size), F.lit(""))
    variant = F.coalesce(F.nullif(F.col("variant_name"), F.lit("")), color_size, F.col("sku_code"))
    name = _s(product_name) if with_null_name_default else F.col(product_name)
    return F.when(F.col("pv_variant_id").isNull(), name).otherwise(F.concat(name, F.lit(" • "), variant))


def _variants(t):
    return t.product_variants.select(
        F.col("variant_id").alias("pv_variant_id"), "sku_code", "variant_name", "color_value", "size_value",
        F.col("barcode").alias("pv_barcode"),
    )


def purchase_return_history(t, from_dt, to_dt, keyword: str = "") -> DataFrame:
    """Supplier returns in the closed period with settlement and status texts."""
    pr = S.within(t.purchase_returns, "return_date", from_dt, to_dt)
    i = t.imports.select("import_id", "import_code")
    s = t.suppliers.select("supplier_id", "supplier_name")
    e = _employees(t)
    u = t.users.select("employee_id", "username")
    j = (
        pr.join(i, "import_id", "left")
        .join(s, "supplier_id", "left")
        .join(e, "employee_id", "left")
        .join(u, "employee_id", "left")
        .where(S.keyword_match(keyword, "return_code", _s("import_code"), _s("supplier_name"), _s("note")))
    )
    settlement = _s("settlement_type", "DEBT_OFFSET")
    return j.select(
        "return_id", "return_code", "import_id", _s("import_code").alias("import_code"), "supplier_id",
        _s("supplier_name").alias("supplier_name"), "employee_id",
        F.coalesce(F.col("employee_name"), F.col("username"), F.lit("")).alias("employee_name"),
        "return_date", _z("total_amount").alias("total_amount"), _s("note").alias("note"),
        _s("status").alias("status"), settlement.alias("settlement_type"), _s("refund_method").alias("refund_method"),
        F.when(
            settlement == "REFUND",
            F.concat(F.lit("Nhận lại tiền - "), F.coalesce(F.nullif(F.col("refund_method"), F.lit("")), F.lit(S.DEFAULT_PAYMENT_METHOD))),
        ).otherwise(F.lit("Cấn trừ công nợ")).alias("settlement_text"),
        F.when(S.not_cancelled_broad("status"), F.lit("Hoàn tất")).otherwise(F.lit("Đã hủy")).alias("status_text"),
    ).orderBy(F.col("return_date").desc(), F.col("return_id").desc())


def purchase_return_details(t, return_id=None) -> DataFrame:
    """Lines of a supplier return (all when None) with the variant display name."""
    d = t.purchase_return_details.where(_eq("return_id", return_id))
    p = t.products.select("product_id", "product_code", F.col("barcode").alias("p_barcode"), "product_name")
    j = d.join(p, "product_id", "left").join(_variants(t), F.col("variant_id") == F.col("pv_variant_id"), "left")
    has_v = F.col("pv_variant_id").isNotNull()
    return j.select(
        "return_detail_id", "return_id", "import_detail_id", "product_id", "variant_id",
        _s(F.when(has_v, F.col("sku_code")).otherwise(F.col("product_code"))).alias("product_code"),
        _s(F.when(has_v, F.nullif(F.col("pv_barcode"), F.lit(""))).otherwise(F.col("p_barcode"))).alias("barcode"),
        _variant_display("product_name", True).alias("product_name"),
        _z("quantity").alias("quantity"), _z("import_price").alias("import_price"),
        F.coalesce(F.col("total"), _z("import_price") * _z("quantity")).cast(S.MONEY).alias("total"),
        _s("reason").alias("reason"),
    ).orderBy("return_detail_id")


def returned_qty_per_import_line(t) -> DataFrame:
    """Σ quantity returned per import line over live returns."""
    live = t.purchase_returns.where(S.not_cancelled_broad("status")).select("return_id")
    return (
        t.purchase_return_details.join(live, "return_id")
        .groupBy("import_detail_id")
        .agg(F.sum("quantity").alias("returned_qty"))
    )


def imports_returnable(t, from_dt, to_dt, keyword: str = "") -> DataFrame:
    """Completed/Paid imports in the period with at least one line not fully returned."""
    i = S.within(t.imports, "import_date", from_dt, to_dt).where(S.status_in("status", S.PAID_OR_COMPLETED))
    s = t.suppliers.select("supplier_id", "supplier_name")
    open_lines = (  # distinct import ids: the semi join's right side has no hot key
        t.import_details.join(returned_qty_per_import_line(t), "import_detail_id", "left")
        .where(_z("quantity") > _z("returned_qty"))
        .select("import_id")
        .distinct()
    )
    returned = (
        t.purchase_returns.where(S.not_cancelled_broad("status"))
        .groupBy("import_id")
        .agg(F.sum("total_amount").alias("ret"))
    )
    j = (
        i.join(s, "supplier_id", "left")
        .where(S.keyword_match(keyword, "import_code", _s("supplier_name")))
        .join(open_lines, "import_id", "left_semi")
        .join(returned, "import_id", "left")
    )
    return j.select(
        "import_id", "import_code", "supplier_id", _s("supplier_name").alias("supplier_name"), "import_date",
        "final_amount", "status",
        F.when(F.col("status") == "Paid", F.lit("Tất toán"))
        .when(F.col("status") == "Completed", F.lit("Còn nợ"))
        .otherwise(F.col("status")).alias("status_text"),
        _z("ret").cast(S.SUM_MONEY).alias("returned_amount"),
        (_z("final_amount") - _z("ret")).cast(S.SUM_MONEY).alias("available_amount"),
    ).orderBy(F.col("import_date").desc(), F.col("import_id").desc())


def import_lines_returnable(t, import_id=None) -> DataFrame:
    """Import lines with imported, returned and maximum returnable quantity (> 0 only)."""
    d = t.import_details.where(_eq("import_id", import_id))
    p = t.products.select("product_id", "product_code", F.col("barcode").alias("p_barcode"), "product_name")
    # the lines are exchanged while narrow: the long names of their products come last
    j = (
        d.select("import_detail_id", "import_id", "product_id", "variant_id", "quantity", "import_price")
        .join(returned_qty_per_import_line(t), "import_detail_id", "left")
        .where(_z("quantity") > _z("returned_qty"))
        .join(_variants(t), F.col("variant_id") == F.col("pv_variant_id"), "left")
        .join(p, "product_id")
    )
    has_v = F.col("pv_variant_id").isNotNull()
    return j.select(
        "import_detail_id", "import_id", "product_id", "variant_id",
        F.when(has_v, F.col("sku_code")).otherwise(F.col("product_code")).alias("product_code"),
        _s(F.when(has_v, F.nullif(F.col("pv_barcode"), F.lit(""))).otherwise(F.col("p_barcode"))).alias("barcode"),
        _variant_display("product_name", False).alias("product_name"),
        _z("quantity").alias("imported_qty"),
        _z("returned_qty").cast("bigint").alias("returned_qty"),
        (_z("quantity") - _z("returned_qty")).cast("bigint").alias("max_return_qty"),
        F.lit(0).alias("return_qty"),
        _z("import_price").alias("import_price"),
        F.lit(0).cast(S.MONEY).alias("return_amount"),
        F.lit("").alias("reason"),
    ).orderBy("import_detail_id")


# ---------------------------------------------------------------- cashbook


def _norm_type(entry_type):
    if entry_type is None:
        return None
    v = entry_type.strip().upper()
    return v or None


def cashbook_categories(t, entry_type=None) -> DataFrame:
    """Active categories, optionally of one type (normalised by trim/upper)."""
    ty = _norm_type(entry_type)
    cond = F.col("is_active") == 1
    if ty is not None:
        cond = cond & (F.col("category_type") == F.lit(ty))
    return (
        t.cashbook_categories.where(cond)
        .select("category_id", "category_type", "category_name", "is_system", "is_active", "sort_order")
        .orderBy("category_type", "sort_order", "category_name")
    )


def _live_entries(t, from_dt, to_dt) -> DataFrame:
    end = None if to_dt is None else S.parse_dt(to_dt) + _dt.timedelta(days=1)
    return S.during(t.cashbook_entries, "entry_date", from_dt, end_exclusive=end).where(F.col("is_deleted") == 0)


def cashbook_search(t, from_dt=None, to_dt=None, entry_type=None, keyword=None) -> DataFrame:
    """Live entries, optional period / type / keyword over six columns, newest first."""
    cond = F.lit(True)
    ty = _norm_type(entry_type)
    if ty is not None:
        cond = cond & (F.col("entry_type") == F.lit(ty))
    kw = None if keyword is None else (keyword.strip() or None)
    if kw is not None:
        cond = cond & S.like_any(
            kw, "entry_code", "category_name", "payment_method", "reference_code", "description", "created_by"
        )
    return (
        _live_entries(t, from_dt, to_dt).where(cond)
        .select(
            "entry_id", "entry_code", "entry_date", "entry_type", "category_id", "category_name", "amount",
            "payment_method", "description", "reference_code", "created_by", "created_at", "updated_at",
        )
        .orderBy(F.col("entry_date").desc(), F.col("entry_id").desc())
    )


def cashbook_summary(t, from_dt=None, to_dt=None) -> DataFrame:
    """Total in, total out, balance and entry count of live entries."""
    e = _live_entries(t, from_dt, to_dt)
    is_in = F.col("entry_type") == S.CASH_IN
    zero = F.lit(0)
    return e.agg(
        F.coalesce(F.sum(F.when(is_in, F.col("amount")).otherwise(zero)), zero).cast(S.SUM_MONEY).alias("total_in"),
        F.coalesce(F.sum(F.when(F.col("entry_type") == S.CASH_OUT, F.col("amount")).otherwise(zero)), zero)
        .cast(S.SUM_MONEY).alias("total_out"),
        F.coalesce(F.sum(F.when(is_in, F.col("amount")).otherwise(-F.col("amount"))), zero)
        .cast(S.SUM_MONEY).alias("balance"),
        F.count(F.lit(1)).cast("int").alias("entry_count"),
    )


# ---------------------------------------------------------------- serials


def serials_available(t, product_id=None) -> DataFrame:
    """In-stock serials with a known number, newest first."""
    return (
        t.product_serials.where(
            _eq("product_id", product_id) & (F.col("status") == 0) & F.col("serial_number").isNotNull()
        )
        .select("serial_id", "product_id", "import_id", "serial_number", "status", "sell_price_override", "note",
                "created_at")
        .orderBy(F.col("serial_id").desc())
    )


def product_serial_trace(t, product_id=None) -> DataFrame:
    """Serials of a product through import (inner), supplier and sale, dd/MM/yyyy dates."""
    ps = t.product_serials.where(_eq("product_id", product_id))
    i = t.imports.select("import_id", "import_code", "import_date", "supplier_id")
    s = t.suppliers.select("supplier_id", "supplier_name")
    o = t.sales_orders.select("order_id", "order_code", "order_date")
    j = ps.join(i, "import_id").join(s, "supplier_id", "left").join(o, "order_id", "left")
    return j.select(
        "serial_id", "import_id", "order_id", "product_id",
        _s("serial_number", "Chưa cập nhật").alias("serial_number"),
        "import_code",
        F.date_format("import_date", "dd/MM/yyyy").alias("import_date_text"),
        _s("supplier_name", "Không xác định").alias("supplier_name"),
        "sell_price_override",
        _s("product_color").alias("product_color"),
        _s("note").alias("note"),
        F.when(F.col("status") == 0, F.lit("🟢 Trong kho")).otherwise(F.lit("🔴 Đã bán")).alias("status_text"),
        _s("order_code").alias("order_code"),
        F.when(F.col("order_date").isNotNull(), F.date_format("order_date", "dd/MM/yyyy"))
        .otherwise(F.lit("")).alias("order_date_text"),
    ).orderBy(F.col("serial_id").desc())


def serial_trace(t, serial_number=None) -> DataFrame:
    """One row per serial number across product, import, supplier, order and customer.

    The source returns TOP 1 for a serial without an order; we keep the row
    with the smallest serial_id. ``None`` traces every serial number.
    """
    cond = F.col("serial_number").isNotNull()
    if serial_number is not None:
        cond = F.col("serial_number") == F.lit(serial_number)
    ps = t.product_serials.where(cond)
    p = t.products.select("product_id", "product_name")
    i = t.imports.select("import_id", "import_code", "import_date", "supplier_id")
    s = t.suppliers.select("supplier_id", "supplier_name")
    o = t.sales_orders.select("order_id", "order_code", "order_date", "customer_id")
    c = t.customers.select("customer_id", F.col("name").alias("customer_name"))
    # first serial per number: min over a struct led by serial_id is a
    # plain aggregate, so it is pre-combined per task (a hot serial number
    # never lands in one task as a whole group)
    keep = ["serial_id", "product_id", "import_id", "order_id", "status", "created_at", "sell_price_override",
            "product_color", "note", "product_name"]
    first = (
        ps.join(p, "product_id")
        .groupBy("serial_number")
        .agg(F.min(F.struct(*keep)).alias("r"))
        .select("serial_number", "r.*")
    )
    # imports and orders take their party's name first: they are fewer than the serials
    traced = first.join(i.join(s, "supplier_id", "left"), "import_id", "left")
    orders = o.join(c, "customer_id", "left").select("order_id", "order_code", "order_date", "customer_name")
    # serials without an order (most) would all meet in one task of the join
    unsold = traced.where("order_id IS NULL").withColumns(
        {f.name: F.lit(None).cast(f.dataType) for f in orders.schema if f.name != "order_id"})
    j = traced.where("order_id IS NOT NULL").join(orders, "order_id", "left").unionByName(unsold, allowMissingColumns=True)
    return j.select(
        "serial_id", "product_id", "serial_number", "import_id", "order_id", "status", "created_at",
        "sell_price_override", "product_color", "note", "product_name", "supplier_name", "import_date",
        "import_code", "customer_name", "order_date", "order_code",
    )
