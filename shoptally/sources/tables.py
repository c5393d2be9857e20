"""Typed scans of shop tables (A1) and the result sink (A4).

Each shop table has a declared schema (money ``decimal(18,0)``, quantities
``decimal(18,3)``, naive ``timestamp_ntz`` times), so a scan never infers
types. Fact tables are written partitioned by month: a period filter then
prunes whole folders (the source's date indexes become partition pruning),
and the parquet min/max statistics serve the remaining day-level filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.semantics import month_column

# Declared schemas of the shop tables (the data model of SURVEY §1.1, reduced
# to the columns the operators read): money decimal(18,0), quantities
# decimal(18,3), naive timestamp_ntz times.
SHOP_SCHEMAS = {
"products": "product_id bigint, product_code string, barcode string, product_name string, category_id int, unit_id int, sell_price decimal(18,2), import_price decimal(18,0), stock int, is_active int, product_location string, created_at timestamp_ntz, warranty_months int, has_serial int, image_path string",
    "categories": "category_id int, category_name string",
    "units": "unit_id int, unit_name string",
    "sales_orders": "order_id bigint, order_code string, customer_id bigint, order_date timestamp_ntz, order_type string, status string, final_amount decimal(18,0), paid_amount decimal(18,0), employee_id int, total_amount decimal(18,0), cashier_id int, discount decimal(18,0), vat_amount decimal(18,0), payment_method string, points_used int, points_earned int",
    "order_items": "order_id bigint, product_id bigint, quantity int, unit_price decimal(18,0), cost_price decimal(18,0), base_quantity decimal(18,3), gift_quantity int, input_quantity decimal(18,3), unit_conversion_to_base decimal(18,6), product_variant_id bigint, serial_number string",
    "customers": "customer_id bigint, customer_code string, name string, phone string, points int, address string, email string, created_at timestamp_ntz",
    "customer_payments": "payment_id bigint, customer_id bigint, payment_date timestamp_ntz, amount decimal(18,0), payment_method string, employee_id bigint, note string",
    "customer_debt_adjustments": "adjustment_id bigint, customer_id bigint, adjustment_date timestamp_ntz, amount decimal(18,0)",
    "customer_debt_discount_allocations": "adjustment_id bigint, order_id bigint, amount decimal(18,0)",
    "employees": "employee_id bigint, name string",
    "users": "user_id bigint, username string, employee_id bigint",
    "suppliers": "supplier_id bigint, supplier_name string, phone string, address string, email string, tax_code string, bank_code string, bank_name string, bank_account string, bank_owner string, is_active int",
    "import_details": "import_detail_id bigint, import_id bigint, product_id bigint, variant_id bigint, quantity int, base_quantity decimal(18,3), import_price decimal(18,0), total decimal(18,0), rf string, line_date timestamp_ntz, input_quantity decimal(18,3), unit_conversion_to_base decimal(18,6)",
    "imports": "import_id bigint, import_code string, supplier_id bigint, import_date timestamp_ntz, final_amount decimal(18,0), paid_amount decimal(18,0), status string, employee_id int, payment_method string, note string, total_amount decimal(18,0), vat_amount decimal(18,0), discount decimal(18,0), supplier_credit_applied decimal(18,0)",
    "purchase_return_details": "return_detail_id bigint, return_id bigint, import_detail_id bigint, product_id bigint, variant_id bigint, quantity int, import_price decimal(18,0), total decimal(18,0), reason string",
    "purchase_returns": "return_id bigint, return_code string, import_id bigint, supplier_id bigint, employee_id int, return_date timestamp_ntz, total_amount decimal(18,0), status string, settlement_type string, refund_method string, note string",
    "supplier_payments": "payment_id bigint, supplier_id bigint, payment_date timestamp_ntz, amount decimal(18,0), payment_method string, employee_id bigint, note string",
    "cashbook_categories": "category_id int, category_type string, category_name string, affects_profit int, is_active int, sort_order int, is_system int",
    "cashbook_entries": "entry_id bigint, entry_date timestamp_ntz, entry_type string, category_id int, amount decimal(18,0), is_deleted int, reference_code string, description string, entry_code string, payment_method string, partner_name string, created_by string, category_name string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "employee_payrolls": "payroll_id bigint, employee_name string, employee_id int, payroll_month date",
    "employee_payroll_payments": "payment_id bigint, payroll_id bigint, payment_type string, payment_date timestamp_ntz, amount decimal(18,0), payment_method string, is_void int, note string, created_by string",
    "product_variants": "variant_id bigint, product_id bigint, sku_code string, variant_name string, color_value string, size_value string, stock_base_qty decimal(18,3), barcode string",
    "product_serials": "serial_id bigint, product_id bigint, import_id bigint, serial_number string, status int, order_id bigint, sell_price_override decimal(18,0), product_color string, note string, created_at timestamp_ntz",
    "customer_wallet_transactions": "wallet_transaction_id bigint, customer_id bigint, transaction_date timestamp_ntz, transaction_type string, amount decimal(18,2), order_id bigint",
    "supplier_debt_adjustments": "adjustment_id bigint, supplier_id bigint, adjustment_date timestamp_ntz, amount decimal(18,0)",
    "supplier_debt_discount_allocations": "allocation_id bigint, adjustment_id bigint, import_id bigint, amount decimal(18,0)",
    "employee_payroll_adjustments": "adjustment_id bigint, payroll_id bigint, adjustment_type string, adjustment_date timestamp_ntz, amount decimal(18,0), is_void int",
    "store_info": "store_name string, import_price_method int",
    "inventory_checks": "check_id int, check_date timestamp_ntz",
    "inventory_check_details": "check_detail_id bigint, check_id int, product_id bigint, difference decimal(18,3)",
}

# date column of the tables that are laid out by month (folder: ``month_column``)
DATED = {
    "sales_orders": "order_date", "imports": "import_date", "purchase_returns": "return_date", "customer_payments": "payment_date",
    "supplier_payments": "payment_date", "cashbook_entries": "entry_date", "employee_payroll_payments": "payment_date",
    "inventory_checks": "check_date",
}
# lines lie in the month of their document: table -> (documents, their key)
LINES_OF = {
    "order_items": ("sales_orders", "order_id"), "import_details": ("imports", "import_id"),
    "purchase_return_details": ("purchase_returns", "return_id"), "inventory_check_details": ("inventory_checks", "check_id"),
}
PARTITION_BY = {
    name: (month_column(date), date)
    for name, date in {**DATED, **{lines: DATED[documents] for lines, (documents, _) in LINES_OF.items()}}.items()
}


def schema_ddl(name: str, partitioned: bool = False) -> str:
    ddl = SHOP_SCHEMAS[name]
    if partitioned and name in PARTITION_BY:
        ddl += f", {PARTITION_BY[name][0]} string"
    return ddl


def read_shop_table(spark: SparkSession, root: str, name: str, partitioned: bool = False) -> DataFrame:
    """A1: ``spark.read.schema(declared).parquet(root/name)`` - no inference, no footer reads."""
    return spark.read.schema(schema_ddl(name, partitioned)).parquet(f"{root.rstrip('/')}/{name}")


def conform(df: DataFrame, name: str) -> DataFrame:
    """Project and cast a frame to the declared schema of shop table ``name``."""
    fields = [f.split(" ", 1) for f in (x.strip() for x in SHOP_SCHEMAS[name].split(", "))]
    return df.select(*[F.col(c).cast(ty).alias(c) for c, ty in fields])


def write_result(df: DataFrame, path: str, partition_by: str | None = None, mode: str = "overwrite",
                 max_records_per_file: int = 5_000_000) -> None:
    """A4: write a result (or a shop table) as parquet.

    With ``partition_by`` the rows are rebalanced by the partition value, so
    that a folder gets few files of the advisory size: adaptive execution
    joins small months in a task and splits a hot one over many. Sorted inside
    a task, a task keeps one open file at a time.
    """
    w = df
    if partition_by:
        w = w.hint("rebalance", F.col(partition_by)).sortWithinPartitions(partition_by)
    writer = w.write.mode(mode).option("maxRecordsPerFile", max_records_per_file)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def stage_partitioned(df: DataFrame, name: str, root: str, documents: DataFrame | None = None) -> None:
    """Write a shop table under ``root`` (month-partitioned when declared so).

    A line has the month of its document, which needs ``documents``. Rows
    without a date, and lines without a document, lie in the folder of NULL.
    """
    df, path = conform(df, name), f"{root.rstrip('/')}/{name}"
    if name not in PARTITION_BY:
        write_result(df, path)
        return
    part, date = PARTITION_BY[name]
    if name in LINES_OF:
        if documents is None:
            raise ValueError(f"the lines of {name} need their documents, {LINES_OF[name][0]}")
        key = LINES_OF[name][1]
        # one date a document, so that a repeated one repeats no line
        months = documents.groupBy(F.col(key).cast(df.schema[key].dataType).alias(key)).agg(F.date_format(F.min(date), "yyyy-MM").alias(part))
        df = df.join(months, key, "left")
    else:
        df = df.withColumn(part, F.date_format(date, "yyyy-MM"))
    write_result(df, path, part)


def export_shop_tables(tables, root: str, names=None) -> None:
    """A4: write shop tables (any object with table attributes) to ``root`` in their declared types."""
    for n in names or SHOP_SCHEMAS:
        documents = getattr(tables, LINES_OF[n][0]) if n in LINES_OF else None
        stage_partitioned(getattr(tables, n), n, root, documents)


class ShopWarehouse:
    """The shop tables of a folder of parquet tables, as typed scans (A1).

    ``ShopWarehouse(spark, root).sales_orders`` reads ``root/sales_orders``
    with the declared schema; every operator accepts it in place of the
    test fixtures.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in SHOP_SCHEMAS:
            raise AttributeError(name)
        if name not in self._frames:
            self._frames[name] = read_shop_table(self.spark, self.root, name, partitioned=name in PARTITION_BY)
        return self._frames[name]
