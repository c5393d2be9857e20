"""Shop tables derived from the driver's TPC-H-like parquet tables.

The reference ships no data, so every shop table the operators read is
derived from the given tables (``part``, ``orders``, ``lineitem``,
``events`` ...). The derivations are written once as SQL templates that run
unchanged on Spark SQL and DuckDB: Spark builds the DataFrames with
``spark.sql(template, **frames)``; the DuckDB oracle inlines the same text
as CTEs. NULLs, blanks, repeats and unmatched keys are planted on purpose
(see FIXTURES.md).

Everything here is lazy: ``ShopTables.get(name)`` returns a DataFrame whose
plan starts at the parquet scans, so Catalyst prunes columns and pushes
filters from the operators down into the driver tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import materialize_lean as materialize

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
)

# Derivation of each shop table, in dependency order. ``{x}`` names another
# driver table or an earlier shop table.
FIXTURE_SQL: dict[str, str] = {
    "products": """
select p_partkey product_id, concat('SP', right(concat('000000', cast(p_partkey as string)),6)) product_code,
 case when p_partkey % 7 = 0 then null when p_partkey % 50 = 1 then '8930000000' else concat('893', right(concat('000000', cast(p_partkey as string)),6)) end barcode,
 p_name product_name, p_size % 8 category_id, p_size % 4 unit_id, cast(p_retailprice as decimal(18,2)) sell_price,
 case when p_partkey % 13 = 0 then null else cast(floor(p_retailprice) - 200 as decimal(18,0)) end import_price,
 cast((p_partkey * 37) % 500 as int) stock, case when p_partkey % 19 = 0 then 0 when p_partkey % 23 = 0 then null else 1 end is_active,
 case when p_partkey % 10 = 0 then null else concat('Ke ', cast(p_size % 5 as string)) end product_location,
 NTZ'2020-01-01 08:00:00' created_at, case when p_partkey % 4 = 0 then null else cast(p_partkey % 3 * 12 as int) end warranty_months,
 case when p_partkey % 4 = 1 then 1 when p_partkey % 4 = 2 then null else 0 end has_serial,
 case when p_partkey % 3 = 0 then null else concat('img/', cast(p_partkey as string), '.jpg') end image_path from {part}""",
    "categories": """
select distinct p_size % 8 category_id, concat('Loai ', cast(p_size % 8 as string)) category_name from {part} where p_size % 8 < 6""",
    "units": """
select distinct p_size % 4 unit_id, concat('DVT ', cast(p_size % 4 as string)) unit_name from {part} where p_size % 4 < 3""",
    "sales_orders": """
select o_orderkey order_id, case when o_orderkey % 997 = 0 then 'HD997' else concat('HD', cast(o_orderkey as string)) end order_code, o_custkey customer_id, o_orderdate order_date,
 case when o_orderkey % 11 = 0 then 'RETURN' when o_orderkey % 13 = 0 then null else 'SALE' end order_type,
 case when o_orderkey % 29 = 0 then 'Cancelled' when o_orderkey % 31 = 0 then null when o_orderkey % 37 = 0 then 'Đã hủy' when o_orderstatus='F' then 'Paid' when o_orderstatus='O' then 'Completed' else 'Partial' end status,
 cast(floor(o_totalprice) as decimal(18,0)) final_amount,
 case when o_orderkey % 41 = 0 then null when o_orderstatus='F' then cast(floor(o_totalprice) as decimal(18,0)) when o_orderstatus='O' then cast(floor(o_totalprice/2) as decimal(18,0)) else cast(floor(o_totalprice/4) as decimal(18,0)) end paid_amount,
 cast(o_orderkey % 211 as int) employee_id, cast(ceil(o_totalprice) as decimal(18,0)) total_amount,
 cast(o_orderkey % 7 as int) cashier_id, case when o_orderkey % 2 = 0 then cast(1000 as decimal(18,0)) else null end discount, cast(0 as decimal(18,0)) vat_amount,
 case when o_orderkey % 4 = 0 then null else 'Tiền mặt' end payment_method, cast(o_orderkey % 5 as int) points_used, cast(floor(o_totalprice / 100000) as int) points_earned from {orders}""",
    "order_items": """
select l_orderkey order_id, l_partkey product_id, cast(l_quantity as int) * (case when l_orderkey % 11 = 0 then -1 else 1 end) quantity,
 cast(floor(l_extendedprice / l_quantity) as decimal(18,0)) unit_price,
 case when l_linenumber = 1 then null when l_linenumber = 2 then cast(0 as decimal(18,0)) else cast(floor(l_extendedprice / l_quantity) - 100 as decimal(18,0)) end cost_price,
 case when l_linenumber = 3 then null when l_linenumber = 4 then cast(l_quantity * 12 as decimal(18,3)) else cast(l_quantity as decimal(18,3)) end * cast(case when l_orderkey % 11 = 0 then -1 else 1 end as decimal(1,0)) base_quantity,
 case when l_linenumber = 3 and l_orderkey % 2 = 0 then 1 else null end gift_quantity,
 case when l_linenumber % 2 = 0 then cast(l_quantity as decimal(18,3)) else null end input_quantity,
 case when l_linenumber = 7 then null else cast(1 as decimal(18,6)) end unit_conversion_to_base,
 case when l_partkey % 3 = 0 then l_partkey*10 + l_linenumber % 2 else null end product_variant_id,
 case when l_linenumber = 1 and l_partkey % 2 = 0 then concat('SN', cast(l_partkey as string)) else null end serial_number from {lineitem}""",
    "customers": """
select c_custkey customer_id, case when c_custkey % 9 = 0 then null when c_custkey % 9 = 1 then '  ' when c_custkey % 50 = 2 then 'KH000002' else concat('KH', right(concat('000000', cast(c_custkey as string)),6)) end customer_code,
 c_name name, case when c_custkey % 4 = 0 then null else concat('09', cast(c_custkey as string)) end phone, cast(c_custkey % 100 as int) points,
 case when c_custkey % 3 = 0 then null else concat('Phuong ', cast(c_nationkey as string)) end address,
 case when c_custkey % 5 = 0 then null else concat('kh', cast(c_custkey as string), '@mail.vn') end email, NTZ'2021-06-01 09:00:00' created_at from {customer}
 union all select c_custkey + 1000000, null, concat(' ', c_name), case when c_custkey % 4 = 0 then null else concat('09', cast(c_custkey as string)) end, 0, null, null, NTZ'2022-01-01 10:00:00'
 from {customer} where c_custkey % 97 = 0""",
    "customer_payments": """
select event_id payment_id, user_id customer_id, ts - interval '9131' day payment_date, cast(floor(value) * 100 + 1 as decimal(18,0)) amount,
 case when event_id % 4 = 0 then null when event_id % 4 = 1 then ' ' when event_id % 4 = 2 then 'Tiền mặt' else 'Chuyển khoản' end payment_method, event_id % 211 employee_id,
 case when event_id % 6 = 0 then null else concat('Thu no ', cast(event_id % 30 as string)) end note from {events} where event_type='click'""",
    "customer_debt_adjustments": """
select event_id adjustment_id, user_id customer_id, ts - interval '9131' day adjustment_date, cast(floor(value) * 10 + 1 as decimal(18,0)) amount from {events} where event_type='view'""",
    "customer_debt_discount_allocations": """
select a.adjustment_id, o.o_orderkey order_id, cast(floor(a.amount/3) + 1 as decimal(18,0)) amount from {customer_debt_adjustments} a join {orders} o on o.o_custkey = a.customer_id and (o.o_orderkey + a.adjustment_id) % 7 = 0
 union all select a.adjustment_id, a.adjustment_id order_id, cast(1 as decimal(18,0)) amount from {customer_debt_adjustments} a where a.adjustment_id % 50 = 0""",
    "employees": """
select distinct user_id employee_id, concat('NV', cast(user_id as string)) name from {events}""",
    "users": """
select distinct user_id + 100 user_id, concat('user', cast(user_id as string)) username, user_id employee_id from {events}""",
    "suppliers": """
select s_suppkey supplier_id, s_name supplier_name, case when s_suppkey % 5 = 0 then null else concat('028', cast(s_suppkey as string)) end phone,
 concat('So ', cast(s_nationkey as string), ' Duong ', cast(s_suppkey % 7 as string)) address,
 case when s_suppkey % 3 = 0 then null else concat('ncc', cast(s_suppkey as string), '@mail.vn') end email, concat('03', cast(s_suppkey as string)) tax_code,
 case when s_suppkey % 6 = 0 then 'VCB' when s_suppkey % 6 = 1 then '  ' else null end bank_code,
 case s_suppkey % 8 when 0 then ' vietcombank ' when 1 then 'Techcombank' when 2 then 'mbbank' when 3 then '  ' when 4 then null when 5 then 'Ngan hang X' when 6 then 'VietinBank' else 'acb' end bank_name,
 case when s_suppkey % 8 = 4 then null else concat('1900', cast(s_suppkey * 7 as string)) end bank_account,
 case when s_suppkey % 8 = 4 then null else upper(s_name) end bank_owner, case when s_suppkey % 11 = 0 then 0 else 1 end is_active from {supplier}""",
    "import_details": """
select l_orderkey*1000 + row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_shipdate,l_extendedprice,l_quantity,l_discount,l_tax,l_returnflag,l_linestatus) import_detail_id, l_orderkey import_id, l_partkey product_id,
 case when l_partkey % 3 = 0 then l_partkey*10 + l_linenumber % 2 else null end variant_id, cast(l_quantity as int) quantity, case when l_linenumber = 3 then null else cast(l_quantity as decimal(18,3)) end base_quantity,
 cast(floor(l_extendedprice / l_quantity) as decimal(18,0)) import_price, case when l_linenumber = 5 then null else cast(floor(l_extendedprice) as decimal(18,0)) end total, l_returnflag rf, l_shipdate line_date,
 case when l_linenumber % 2 = 1 then cast(l_quantity as decimal(18,3)) else null end input_quantity,
 case when l_linenumber = 2 then null else cast(1 as decimal(18,6)) end unit_conversion_to_base from {lineitem}""",
    "imports": """
select l_orderkey import_id, concat('PN', cast(l_orderkey as string)) import_code, min(l_suppkey) supplier_id, min(l_shipdate) import_date,
 cast(sum(floor(l_extendedprice)) as decimal(18,0)) final_amount, case when l_orderkey % 4 = 0 then cast(sum(floor(l_extendedprice)) as decimal(18,0)) else cast(floor(sum(floor(l_extendedprice))/3) as decimal(18,0)) end paid_amount,
 case when l_orderkey % 29 = 0 then 'Cancelled' when l_orderkey % 4 = 0 then 'Paid' else 'Completed' end status, cast(l_orderkey % 211 as int) employee_id, case when l_orderkey % 2 = 0 then null else 'Chuyển khoản' end payment_method,
 case when l_orderkey % 5 = 0 then null else concat('Ghi chu ', cast(l_orderkey % 9 as string)) end note,
 cast(sum(floor(l_extendedprice)) + case when l_orderkey % 7 = 0 then 1000 else 0 end as decimal(18,0)) total_amount, cast(0 as decimal(18,0)) vat_amount,
 cast(case when l_orderkey % 7 = 0 then 1000 else 0 end as decimal(18,0)) discount,
 cast(case when l_orderkey % 97 = 0 then -1 when l_orderkey % 8 = 0 then 500 else 0 end as decimal(18,0)) supplier_credit_applied from {lineitem} group by l_orderkey""",
    "purchase_return_details": """
select case when import_detail_id = 1001 then 0 else import_detail_id end return_detail_id, import_id return_id, import_detail_id, product_id, case when import_detail_id % 5 = 0 then null else variant_id end variant_id, cast(case when import_detail_id % 2 = 0 then quantity else 1 end as int) quantity, import_price,
 cast(import_price * (case when import_detail_id % 2 = 0 then quantity else 1 end) as decimal(18,0)) total,
 case when import_detail_id % 3 = 0 then 'Hang loi' else null end reason from {import_details} where rf='R' or import_detail_id = 1001""",
    "purchase_returns": """
select d.return_id, case when d.return_id % 45 = 0 then 'TH-TRUNG-MA-PHIEU-TRA-NCC-01' else concat('TH', cast(d.return_id as string)) end return_code, d.return_id import_id, i.supplier_id, i.employee_id, i.import_date + interval '10' day return_date, cast(sum(d.total) as decimal(18,0)) total_amount,
 case when d.return_id % 15 = 0 then 'Canceled' else 'Completed' end status, case when d.return_id % 2 = 0 then 'REFUND' when d.return_id % 9 = 0 then 'CREDIT' else 'DEBT_OFFSET' end settlement_type,
 case when d.return_id % 2 = 0 then 'Tiền mặt' when d.return_id % 9 = 0 then 'Chuyển khoản' else null end refund_method,
 case when d.return_id % 4 = 0 then null else concat('Tra hang ', cast(d.return_id % 5 as string)) end note from {purchase_return_details} d join {imports} i on i.import_id = d.return_id group by d.return_id, i.supplier_id, i.employee_id, i.import_date""",
    "supplier_payments": """
select event_id payment_id, user_id supplier_id, ts - interval '9131' day payment_date, cast(floor(value) * 100 + 1 as decimal(18,0)) amount, case when event_id % 3 = 0 then null else 'Chuyển khoản' end payment_method, event_id % 211 employee_id,
 case when event_id % 5 = 0 then null else concat('Tra no ', cast(event_id % 30 as string)) end note from {events} where event_type='purchase'""",
    "cashbook_categories": """
select category_id, category_type, category_name, affects_profit, is_active, sort_order, case when category_id in (6, 7, 8) then 1 else 0 end is_system from (
select 1 category_id, 'IN' category_type, 'Thu khác' category_name, 1 affects_profit, 1 is_active, 10 sort_order union all select 2,'IN','Góp vốn',0,1,20 union all select 3,'IN','Thu nợ khách hàng',0,1,30 union all select 4,'OUT','Chi khác',1,1,10 union all select 5,'OUT','Tiền điện',1,1,30
 union all select 6,'OUT','Chi trả nhà cung cấp',0,1,90 union all select 7,'OUT','Tạm ứng lương nhân viên',1,1,95 union all select 8,'OUT','Chi lương nhân viên',1,1,96 union all select 9,'IN','Thu cũ',1,0,99
 union all select distinct 100 + ascii(event_type), case when event_type in ('click','purchase') then 'IN' else 'OUT' end, concat('Su kien ', event_type), 1, case when event_type = 'error' then 0 else 1 end, 200 from {events}) c""",
    "cashbook_entries": """
select event_id entry_id, ts - interval '9131' day entry_date, case when event_type in ('click','purchase') then 'IN' else 'OUT' end entry_type, case when event_id % 12 < 10 then cast(event_id % 12 as int) else null end category_id,
 cast(floor(value) + 1 as decimal(18,0)) amount, case when event_id % 17 = 0 then 1 else 0 end is_deleted, case when event_type='signup' and event_id % 2 = 0 then concat('PAYROLL:', cast(event_id as string)) else null end reference_code, concat('Note ', event_type) description,
 case when event_id % 10 = 0 then null when event_id % 10 = 1 then ' ' else concat('SQ', cast(event_id as string)) end entry_code,
 case when event_id % 3 = 0 then 'Tiền mặt' when event_id % 3 = 1 then 'Chuyển khoản' else null end payment_method,
 case when event_id % 5 = 0 then null else concat('Doi tac ', cast(user_id % 20 as string)) end partner_name, concat('NV', cast(event_id % 12 as string)) created_by,
 case when event_id % 12 < 10 then concat('Danh muc ', cast(event_id % 12 as string)) else null end category_name,
 ts - interval '9131' day created_at, case when event_id % 4 = 0 then ts - interval '9131' day + interval '1' hour else null end updated_at from {events} where event_type <> 'error'
 union all
select 1000000000 + o_orderkey * 2 + k, o_orderdate, 'IN', 1, cast(floor(o_totalprice) as decimal(18,0)), 0,
 concat('BH:HD', cast(o_orderkey + k * 100000000 as string)), 'Thu ban hang', concat('SQ', cast(1000000000 + o_orderkey * 2 + k as string)), 'Tiền mặt', null, 'NV1',
 'Danh muc 1', o_orderdate, null
from (select o_orderkey, o_orderdate, o_totalprice, 0 k from {orders} where o_orderkey % 100 = 0
      union all select o_orderkey, o_orderdate, o_totalprice, 1 k from {orders} where o_orderkey % 100 = 0) bh""",
    "employee_payrolls": """
select user_id payroll_id, case when user_id % 5 = 0 then '  ' else concat('NV', cast(user_id as string)) end employee_name, cast(user_id % 12 as int) employee_id,
 cast(concat('2024-0', cast(user_id % 9 + 1 as string), '-01') as date) payroll_month from (select distinct user_id from {events} where event_type='signup') u""",
    "employee_payroll_payments": """
select event_id payment_id, user_id payroll_id, case when event_id % 3 = 0 then 'ADVANCE' else 'SETTLEMENT' end payment_type, ts - interval '9131' day payment_date, cast(floor(value) * 1000 as decimal(18,0)) amount,
 case when event_id % 4 = 1 then ' ' else 'Chuyển khoản' end payment_method, case when event_id % 7 = 0 then 1 else 0 end is_void,
 case when event_id % 6 = 0 then null else concat('Ky luong ', cast(user_id % 12 + 1 as string)) end note,
 case when event_id % 5 = 0 then ' ' else concat('NV', cast(event_id % 12 as string)) end created_by from {events} where event_type='signup'""",
    "product_variants": """
select p_partkey*10 + v variant_id, p_partkey product_id, concat('SKU', cast(p_partkey*10+v as string)) sku_code, case when p_partkey % 6 = 0 then 'Bien the' when p_partkey % 6 = 3 then '' else null end variant_name,
 case when p_partkey % 2 = 0 then 'Do' else '' end color_value, case when p_partkey % 5 = 0 then null else 'XL' end size_value, cast((p_partkey * 7) % 60 - 5 as decimal(18,3)) stock_base_qty,
 case when p_partkey % 4 = 0 then concat('VB', cast(p_partkey*10+v as string)) when p_partkey % 4 = 1 then '' else null end barcode from (select p_partkey, 0 v from {part} where p_partkey % 3 = 0 union all select p_partkey, 1 v from {part} where p_partkey % 3 = 0) x""",
    "product_serials": """
select import_detail_id serial_id, product_id, import_id, case when import_detail_id % 6 = 0 then null when import_detail_id % 97 = 1 then ' ' else concat('SN', cast(import_detail_id as string)) end serial_number, case when import_detail_id % 4 = 1 then 1 else 0 end status,
 case when import_detail_id % 4 = 1 then import_id else null end order_id, case when import_detail_id % 5 = 0 then import_price else null end sell_price_override,
 case when import_detail_id % 8 = 3 then 'Den' else null end product_color, case when import_detail_id % 9 = 0 then 'Tray xuoc' else null end note, line_date created_at from {import_details}""",
    "duplicate_sale_candidates": """
select order_id, customer_id, final_amount, order_date, source_id, order_type, concat('HD', cast(order_id as string)) order_code,
 case when source_id % 3 = 0 then null when source_id % 700 = 400 and order_id <> source_id then 999 else cast(source_id % 211 as int) end employee_id, cast(source_id % 7 as int) cashier_id, final_amount + 1000 total_amount,
 case when source_id % 2 = 0 then cast(1000 as decimal(18,0)) else null end discount, cast(0 as decimal(18,0)) vat_amount, final_amount paid_amount,
 case when source_id % 5 = 0 then null else 'Paid' end status, case when source_id % 4 = 0 then null else 'Tiền mặt' end payment_method,
 cast(source_id % 5 as int) points_used, cast(floor(final_amount / 100000) as int) points_earned from (
select o_orderkey order_id, o_custkey customer_id, cast(floor(o_totalprice) as decimal(18,0)) final_amount, o_orderdate order_date, o_orderkey source_id, 'SALE' order_type from {orders}
 union all select o_orderkey + 100000000, o_custkey, cast(floor(o_totalprice) as decimal(18,0)), o_orderdate + interval '20' second, o_orderkey, 'SALE' from {orders} where o_orderkey % 100 = 0
 union all select o_orderkey + 200000000, o_custkey, cast(floor(o_totalprice) as decimal(18,0)), o_orderdate + interval '90' second, o_orderkey, 'SALE' from {orders} where o_orderkey % 150 = 0) d""",
    # lines of those sales: those of their source; some copies have another serial
    "duplicate_sale_lines": """
select d.order_id, oi.product_id, oi.product_variant_id, oi.quantity, oi.unit_price, oi.gift_quantity, oi.cost_price, oi.base_quantity, oi.input_quantity, oi.unit_conversion_to_base,
 case when d.order_id <> d.source_id and d.source_id % 300 = 0 and oi.serial_number is not null then 'SN0' else oi.serial_number end serial_number
from {duplicate_sale_candidates} d join {order_items} oi on oi.order_id = d.source_id""",
    "customer_wallet_transactions": """
select o_orderkey wallet_transaction_id, o_custkey customer_id, o_orderdate transaction_date, 'PAYMENT' transaction_type, cast(floor(o_totalprice) as decimal(18,2)) amount,
 case when o_orderkey % 3 = 0 then null else o_orderkey end order_id from {orders} where o_orderkey % 50 = 7""",
    "supplier_debt_adjustments": """
select import_id adjustment_id, supplier_id, import_date adjustment_date, cast(import_id % 90 + 1 as decimal(18,0)) amount from {imports} where import_id % 20 = 3 and supplier_id > 0""",
    "supplier_debt_discount_allocations": """
select adjustment_id allocation_id, adjustment_id, adjustment_id import_id, amount from {supplier_debt_adjustments}""",
    "employee_payroll_adjustments": """
select payment_id adjustment_id, payroll_id, case when payment_id % 12 = 0 then 'ALLOWANCE' when payment_id % 12 = 4 then 'BONUS' else 'DEDUCTION' end adjustment_type, payment_date adjustment_date,
 cast(payment_id % 500 + 1 as decimal(18,0)) amount, is_void from {employee_payroll_payments} where payment_id % 4 = 0""",
    "store_info": """
select 'Cua hang' store_name, cast(1 as int) import_price_method""",
    "inventory_checks": """
select cast(floor(event_id / 40) as int) check_id, min(ts - interval '9131' day) check_date from {events} group by cast(floor(event_id / 40) as int)""",
    "inventory_check_details": """
select event_id check_detail_id, cast(floor(event_id / 40) as int) + case when floor(event_id / 40) % 19 = 0 then 1 else 0 end check_id, user_id product_id,
 case when event_id % 31 = 0 then null else cast(cast(floor(value) as int) % 11 - 5 as decimal(18,3)) end difference from {events} where event_type='error'""",
    # ---- request batches for the posting operators (derived, so they grow with the data)
    "return_requests": """
select import_id * 4 request_id, case when import_id % 7 = 0 then concat('TH', cast(import_id as string)) else concat('RQ', cast(import_id as string)) end return_code,
 import_id, supplier_id + case when import_id % 79 = 0 then 1 else 0 end supplier_id, employee_id, concat('Yeu cau tra ', cast(import_id as string)) note,
 case when import_id % 97 = 0 then '<Details><Item ImportDetailId="1"' when import_id % 89 = 0 then '<Details></Details>' else concat('<Details>', items, '</Details>') end details_xml
from (select d.import_id, i.supplier_id, i.employee_id,
  string_agg(concat('<Item ImportDetailId="', cast(d.import_detail_id as string), '" ProductId="', cast(d.product_id + case when d.import_id % 73 = 0 then 1 else 0 end as string),
   '" VariantId="', coalesce(cast(d.variant_id as string), ''), '" Quantity="', cast(case when d.import_id % 83 = 0 then 0 when d.import_id % 71 = 0 then d.quantity + 1 else 1 end as string),
   '" ImportPrice="', cast(d.import_price as string), '" Reason="Hang loi"/>'), '') items
  from {import_details} d join {imports} i on i.import_id = d.import_id where d.rf <> 'R' group by d.import_id, i.supplier_id, i.employee_id) x
union all
select import_id * 4 + 1, case when import_id % 7 = 0 then concat('TH', cast(import_id as string)) else concat('RQ', cast(import_id as string)) end, import_id, supplier_id, employee_id, 'Gui lai',
 '<Details><Item ImportDetailId="0" ProductId="0" VariantId="" Quantity="1" ImportPrice="1" Reason=""/></Details>'
from {imports}
union all
select d.import_id * 4 + 2, concat('RR', cast(floor(d.import_id / 2) as bigint)), d.import_id, i.supplier_id, i.employee_id, 'Tra het',
 concat('<Details>', string_agg(concat('<Item ImportDetailId="', cast(d.import_detail_id as string), '" ProductId="', cast(d.product_id as string),
   '" VariantId="', coalesce(cast(d.variant_id as string), ''), '" Quantity="', cast(case when d.quantity <= 3 then d.quantity else 1 end as string), '" ImportPrice="', cast(d.import_price as string), '" Reason=""/>'), ''), '</Details>')
from {import_details} d join {imports} i on i.import_id = d.import_id where d.rf = 'N' group by d.import_id, i.supplier_id, i.employee_id""",
    "cashbook_requests": """
select event_id request_id, ts - interval '9131' day entry_date,
 case event_id % 6 when 0 then ' in ' when 1 then 'out' when 2 then 'OUT' when 3 then 'IN' when 4 then 'x' else null end entry_type,
 cast(case when event_id % 13 = 0 then 0 else floor(value) * 100 + 5 end as decimal(18,0)) amount,
 case when event_id % 5 = 0 then null else cast(event_id % 10 as int) end category_id,
 case when event_id % 3 = 0 then ' Muc rieng ' else null end category_name,
 case when event_id % 4 = 0 then ' ' else 'Chuyển khoản' end payment_method,
 concat(' Dien giai ', cast(event_id % 9 as string)) description,
 case when event_id % 2 = 0 then null else concat('REF', cast(event_id as string)) end reference_code,
 case when event_id % 7 = 0 then '  ' else 'thu ngan' end created_by from {events} where event_type = 'view'""",
    "return_cancel_requests": """
select return_id * 10 request_id, return_id, employee_id, case when return_id % 8 = 0 then '  ' else ' Nhap sai ' end reason from {purchase_returns}
union all select return_id * 10 + 1, return_id, employee_id, 'Lan hai' from {purchase_returns}
union all select return_id * 10 + 2, -(return_id + 1), employee_id, null from {purchase_returns}""",
    "receipt_requests": """
select import_detail_id request_id, product_id + case when import_detail_id % 17 = 0 then 5000000 else 0 end product_id, quantity, import_price new_price from {import_details}""",
    "stock_reduce_requests": """
select order_id, product_id, quantity from {order_items}""",
    "order_cancel_requests": """
select order_id from {sales_orders} union all select -(order_id + 1) from {sales_orders}""",
    "order_delete_requests": """
select order_id from {sales_orders} union all select -(order_id + 1) from {sales_orders}""",
    "serial_sell_requests": """
select serial_id * 10 request_id, case when serial_id % 3 = 0 then concat(' ', serial_number, ' ') when serial_id % 5 = 0 then ' ' else serial_number end serial_number,
 case when status = 1 and serial_id % 2 = 0 then order_id else serial_id % 1000 end order_id from {product_serials}
union all select serial_id * 10 + 1, serial_number, case when serial_id % 3 = 0 then serial_id % 1000 else serial_id % 997 end from {product_serials}""",
    "serial_update_requests": """
select serial_id * 10 request_id, serial_id, case when serial_id % 22 = 0 then concat('SN', cast(serial_id - 1 as string)) when serial_id % 4 = 2 then '  '
  when serial_id % 10 = 7 then concat('SNM', cast(floor(serial_id / 1000) as bigint)) else concat(' IMEI', cast(serial_id as string), ' ') end serial_number,
 case when serial_id % 33 = 0 then cast(-1 as decimal(18,0)) when serial_id % 2 = 0 then cast(serial_id % 5000 as decimal(18,0)) else null end sell_price_override,
 case when serial_id % 3 = 0 then ' Xanh ' else '' end product_color, case when serial_id % 5 = 0 then null else ' ghi chu ' end note from {product_serials}
union all select serial_id * 10 + 1, serial_id + 500, 'SNX', null, null, null from {product_serials}
union all select serial_id * 10 + 2, serial_id, concat('SNM', cast(floor(serial_id / 3000) as bigint)), null, null, null from {product_serials}""",
    "serial_receive_requests": """
select d.import_detail_id * 10 request_id, d.product_id, d.import_id, case when d.import_detail_id % 4 = 0 then '   ' when d.import_detail_id % 9 = 0 then concat('SN', cast(d.import_detail_id as string))
  else concat(' IMEI', cast(d.import_detail_id as string)) end serial_number
from {import_details} d join {products} p on p.product_id = d.product_id where p.has_serial = 1
union all select d.import_detail_id * 10 + 1, d.product_id, d.import_id, concat('IMEI', cast(d.import_detail_id as string))
from {import_details} d join {products} p on p.product_id = d.product_id where p.has_serial = 1""",
    "cashbook_update_requests": """
select request_id * 10 request_id, request_id - case when request_id % 3 = 0 then 1 else 0 end entry_id, entry_date, entry_type, amount, category_id, category_name, payment_method, description, reference_code from {cashbook_requests}
union all select entry_id * 10 + 1, entry_id, entry_date + interval '1' day, concat(' ', lower(entry_type)), amount + 1, category_id, ' Sua ', null, '', reference_code from {cashbook_entries}
union all select entry_id * 10 + 2, -(entry_id + 1), entry_date, entry_type, amount, category_id, null, null, null, null from {cashbook_entries}""",
    "cashbook_delete_requests": """
select entry_id * 10 request_id, entry_id from {cashbook_entries}
union all select entry_id * 10 + 1, entry_id from {cashbook_entries}
union all select entry_id * 10 + 2, -(entry_id + 1) from {cashbook_entries}""",
    "order_line_requests": """
select order_id, product_id, quantity, unit_price,
 case when product_id % 3 = 0 then cast(null as decimal(18,0)) when product_id % 3 = 1 then cast(0 as decimal(18,0)) else unit_price + 1000 end original_price,
 cost_price from {order_items}
union all select order_id, product_id + 1000000, quantity, unit_price, null, null from {order_items}""",
}

_STAGED_FRAMES: dict = {}
_STAGED_NAMES: dict[str, set] = {}

# fixed or tiny lists (bounded by construction, not by the data size)
SMALL_TABLES = {"categories", "units", "cashbook_categories", "employees", "users", "store_info"}

_REF = re.compile(r"\{(\w+)\}")
# the place of a line in its order
_LINE_NO = re.compile(r"row_number\(\) over \(partition by l_orderkey [^)]*\)")
# naive timestamp literal: NTZ'...' (Spark TIMESTAMP_NTZ, DuckDB TIMESTAMP)
_NTZ = re.compile(r"NTZ'")


def fixture_deps(name: str) -> list[str]:
    """Direct table references of one fixture (driver or shop tables)."""
    return _REF.findall(FIXTURE_SQL[name])


def fixture_closure(names) -> list[str]:
    """Shop tables needed for ``names`` (transitively), in FIXTURE_SQL order."""
    need: set[str] = set()

    def visit(n: str) -> None:
        if n in need or n not in FIXTURE_SQL:
            return
        need.add(n)
        for d in fixture_deps(n):
            visit(d)

    for n in names:
        visit(n)
    return [n for n in FIXTURE_SQL if n in need]


def render_plain(name: str) -> str:
    """Template with bare table names (for the DuckDB oracle CTEs)."""
    return _NTZ.sub("TIMESTAMP '", _REF.sub(lambda m: m.group(1), FIXTURE_SQL[name])).strip()


def render_spark(name: str) -> str:
    """Template for ``spark.sql(text, **frames)``."""
    return _NTZ.sub("TIMESTAMP_NTZ '", FIXTURE_SQL[name])


class ShopTables:
    """Lazy per-directory catalogue of the shop tables.

    ``tables.get("sales_orders")`` returns a DataFrame; repeated calls return
    the same object so one plan can reuse a derivation several times (Spark's
    ``ReuseExchange`` then shares the shuffle).
    """

    # sf_dir -> folder holding staged shop tables (see ``stage_shop_tables``)
    staged_dirs: dict[str, str] = {}
    # when a set, every table name asked for is recorded (plan building only)
    recorder: set | None = None

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._frames: dict[str, DataFrame] = {}
        self.staged = ShopTables.staged_dirs.get(self.sf_dir)

    def driver(self, name: str) -> DataFrame:
        key = "__driver__" + name
        if key not in self._frames:
            self._frames[key] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._frames[key]

    def get(self, name: str) -> DataFrame:
        if ShopTables.recorder is not None:
            ShopTables.recorder.add(name)
        if name in self._frames:
            return self._frames[name]
        if name not in FIXTURE_SQL:
            raise KeyError(f"unknown shop table {name!r}")
        if self.staged is not None and name in _STAGED_NAMES.get(self.staged, ()):
            path = f"{self.staged}/{name}"
            if path not in _STAGED_FRAMES:  # list the files and read the footers once per staged table
                _STAGED_FRAMES[path] = self.spark.read.parquet(path)
            df = _STAGED_FRAMES[path]
            self._frames[name] = df
            return df
        refs = {d: (self.get(d) if d in FIXTURE_SQL else self.driver(d)) for d in fixture_deps(name)}
        sql = render_spark(name)
        number = _LINE_NO.search(sql)
        if number:
            # numbered below the projection: only the window's own columns are exchanged, the
            # same ones in every branch of a plan (reused), and none that is computed from them
            refs["lineitem"] = self.spark.sql(f"select *, {number[0]} _line_no from {{lineitem}}", lineitem=refs["lineitem"])
            sql = sql.replace(number[0], "_line_no")
        df = self.spark.sql(sql, **refs)
        self._frames[name] = df
        return df

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in FIXTURE_SQL:
            raise AttributeError(name)
        return self.get(name)


class PlantedSales(ShopTables):
    """The shop tables with sales in which duplicates are planted."""

    def __getattr__(self, name: str) -> DataFrame:
        return super().__getattr__({"sales_orders": "duplicate_sale_candidates", "order_items": "duplicate_sale_lines"}.get(name, name))


class WrittenTables(ShopTables):
    """The shop tables, of which those that a query derives others from are
    written once under the shared checkpoint folder, when first asked for.

    Lazy frames derive the import lines (a window over all of ``lineitem``)
    anew in every branch and job that reads them; the written columns are
    read narrow instead, with the same rows.
    """

    written = ("import_details", "imports")

    def get(self, name: str) -> DataFrame:
        new = name not in self._frames
        df = super().get(name)
        if new and name in self.written and not (self.staged is not None and name in _STAGED_NAMES.get(self.staged, ())):
            df = self._frames[name] = materialize(df, f"shop-{name}")
        return df


def stage_shop_tables(spark: SparkSession, sf_dir: str, out_dir: str, names=None) -> str:
    """Write the derived shop tables of ``sf_dir`` to parquet under ``out_dir``.

    Afterwards every ``ShopTables(spark, sf_dir)`` reads the staged files, as
    a deployment reads its real shop tables. ``out_dir`` must be a shared
    folder on a cluster (e.g. below ``spark.checkpoint.dir``).
    """
    sf_dir = sf_dir.rstrip("/")
    t = ShopTables(spark, sf_dir)
    t.staged = None
    wanted = fixture_closure(names) if names else list(FIXTURE_SQL)
    # spread every table over the cluster's parallelism so later scans get
    # one task per core (the driver's files are single row groups and
    # cannot be split); fixed lists stay one file
    width = spark.sparkContext.defaultParallelism
    for n in wanted:  # dependency order: later tables read the staged files of earlier ones
        df = t.get(n)
        df = df.coalesce(1) if n in SMALL_TABLES else df.repartition(width)
        df.write.mode("overwrite").parquet(f"{out_dir}/{n}")
        t._frames[n] = spark.read.parquet(f"{out_dir}/{n}")
    _STAGED_NAMES[out_dir] = set(wanted)
    ShopTables.staged_dirs[sf_dir] = out_dir
    return out_dir
