"""Oracle SQL (DuckDB) for every registered key.

Each entry is plain ANSI SQL over the driver's tables: the shop tables are
inlined as CTEs from ``sources.fixtures.FIXTURE_SQL`` (only the ones a query
names, plus their dependencies, in fixture order). The bodies restate each
operator's semantics independently of the Spark code, so the driver's
side-by-side run is a real check.
"""

from __future__ import annotations

import re

from ..sources.fixtures import FIXTURE_SQL, fixture_closure, render_plain

# Report parameters shared with plans.catalog (one representative set per key).
from .params import P


def with_fixtures(body: str) -> str:
    body = body.strip()
    used = [n for n in FIXTURE_SQL if re.search(rf"\b{n}\b", body)]
    names = fixture_closure(used)
    ctes = ",\n".join(f"{n} AS ({render_plain(n)})" for n in names)
    head = "WITH"
    if body[:14].upper() == "WITH RECURSIVE":
        head, body = "WITH RECURSIVE", "WITH " + body[14:].lstrip()
    if body[:4].lower() == "with":
        body = body[4:].lstrip()
        return f"{head} {ctes},\n{body}" if ctes else f"{head} {body}"
    return f"WITH {ctes}\n{body}" if ctes else body


def ts(v: str) -> str:
    return f"TIMESTAMP '{v}'"


ORACLE: dict[str, str] = {}
BODIES: dict[str, str] = {}


def oracle(key: str):
    def deco(fn):
        BODIES[key] = fn()
        ORACLE[key] = with_fixtures(BODIES[key])
        return fn

    return deco


# ---------------------------------------------------------------- movement
_LEDGER = """
ledger AS (
  SELECT id.product_id, i.import_date AS movement_date,
         CAST(coalesce(id.base_quantity, CAST(id.quantity AS DECIMAL(18,3))) AS DECIMAL(18,3)) AS qty,
         CAST(coalesce(id.total, coalesce(id.import_price, 0) * coalesce(id.quantity, 0)) AS DECIMAL(18,0)) AS amount,
         'PURCHASE_IN' AS movement_type
  FROM import_details id JOIN imports i ON i.import_id = id.import_id
  WHERE coalesce(i.status, '') NOT IN ('Cancelled','Canceled','Đã hủy','Hủy') AND i.import_date IS NOT NULL AND id.product_id IS NOT NULL
  UNION ALL
  SELECT d.product_id, r.return_date, -CAST(d.quantity AS DECIMAL(18,3)),
         CAST(coalesce(d.total, coalesce(d.import_price, 0) * coalesce(d.quantity, 0)) AS DECIMAL(18,0)), 'SUPPLIER_RETURN_OUT'
  FROM purchase_return_details d JOIN purchase_returns r ON r.return_id = d.return_id
  WHERE coalesce(r.status, '') NOT IN ('Cancelled','Canceled','Đã hủy','Hủy') AND r.return_date IS NOT NULL AND d.product_id IS NOT NULL
  UNION ALL
  SELECT oi.product_id, o.order_date, -CAST(coalesce(oi.base_quantity, CAST(oi.quantity AS DECIMAL(18,3))) AS DECIMAL(18,3)),
         CAST(coalesce(oi.unit_price, 0) * abs(coalesce(oi.quantity, 0)) AS DECIMAL(18,0)), 'SALES_OUT'
  FROM order_items oi JOIN sales_orders o ON o.order_id = oi.order_id
  WHERE coalesce(o.status, '') IN ('Paid','Completed') AND coalesce(o.order_type, '') <> 'RETURN'
    AND o.order_date IS NOT NULL AND oi.product_id IS NOT NULL AND coalesce(oi.quantity, 0) > 0
  UNION ALL
  SELECT oi.product_id, o.order_date, abs(CAST(coalesce(oi.base_quantity, CAST(oi.quantity AS DECIMAL(18,3))) AS DECIMAL(18,3))),
         CAST(coalesce(oi.unit_price, 0) * abs(coalesce(oi.quantity, 0)) AS DECIMAL(18,0)), 'RETURN_IN'
  FROM order_items oi JOIN sales_orders o ON o.order_id = oi.order_id
  WHERE coalesce(o.status, '') IN ('Paid','Completed') AND coalesce(o.order_type, '') = 'RETURN'
    AND o.order_date IS NOT NULL AND oi.product_id IS NOT NULL
  UNION ALL
  SELECT s.product_id, ck.check_date, CAST(s.difference AS DECIMAL(18,3)), CAST(0 AS DECIMAL(18,0)), 'STOCKTAKE'
  FROM inventory_check_details s JOIN inventory_checks ck ON ck.check_id = s.check_id WHERE ck.check_date IS NOT NULL AND s.product_id IS NOT NULL AND coalesce(s.difference, 0) <> 0
)"""


@oracle("inventory_movement_monthly")
@oracle("inventory_movement")
def _():
    s, e = ts(P.mv_start), ts(P.mv_end_excl)
    return f"""
WITH {_LEDGER.strip()},
ps AS (
  SELECT product_id,
    sum(CASE WHEN movement_type='PURCHASE_IN' AND movement_date >= {s} AND movement_date < {e} THEN qty ELSE 0 END) AS pin,
    sum(CASE WHEN movement_type='SUPPLIER_RETURN_OUT' AND movement_date >= {s} AND movement_date < {e} THEN abs(qty) ELSE 0 END) AS sro,
    sum(CASE WHEN movement_type='SALES_OUT' AND movement_date >= {s} AND movement_date < {e} THEN abs(qty) ELSE 0 END) AS so,
    sum(CASE WHEN movement_type='RETURN_IN' AND movement_date >= {s} AND movement_date < {e} THEN qty ELSE 0 END) AS ri,
    sum(CASE WHEN movement_type='STOCKTAKE' AND movement_date >= {s} AND movement_date < {e} THEN qty ELSE 0 END) AS st,
    sum(CASE WHEN movement_date >= {s} AND movement_date < {e} THEN qty ELSE 0 END) AS net,
    sum(CASE WHEN movement_type='PURCHASE_IN' AND movement_date >= {s} AND movement_date < {e} THEN amount ELSE 0 END) AS pinv,
    sum(CASE WHEN movement_type='SUPPLIER_RETURN_OUT' AND movement_date >= {s} AND movement_date < {e} THEN amount ELSE 0 END) AS srov,
    sum(CASE WHEN movement_type='SALES_OUT' AND movement_date >= {s} AND movement_date < {e} THEN amount ELSE 0 END) AS sov
  FROM ledger GROUP BY product_id),
a AS (SELECT product_id, sum(qty) AS after_qty FROM ledger WHERE movement_date >= {e} GROUP BY product_id)
SELECT p.product_id, p.product_code, coalesce(p.barcode, '') AS barcode, p.product_name,
  coalesce(c.category_name, '') AS category_name, coalesce(u.unit_name, '') AS unit_name,
  CAST(coalesce(p.stock, 0) - coalesce(a.after_qty, 0) - coalesce(ps.net, 0) AS DECIMAL(18,3)) AS opening_stock,
  CAST(coalesce(ps.pin, 0) AS DECIMAL(18,3)) AS purchase_in_qty,
  CAST(coalesce(ps.ri, 0) AS DECIMAL(18,3)) AS return_in_qty,
  CAST(coalesce(ps.sro, 0) AS DECIMAL(18,3)) AS supplier_return_out_qty,
  CAST(coalesce(ps.st, 0) AS DECIMAL(18,3)) AS stocktake_adjust_qty,
  CAST(coalesce(ps.so, 0) AS DECIMAL(18,3)) AS sales_out_qty,
  CAST(coalesce(p.stock, 0) - coalesce(a.after_qty, 0) AS DECIMAL(18,3)) AS closing_stock,
  CAST(coalesce(p.stock, 0) AS DECIMAL(18,3)) AS current_stock,
  CAST(coalesce(ps.pinv, 0) AS DECIMAL(18,0)) AS purchase_in_value,
  CAST(coalesce(ps.srov, 0) AS DECIMAL(18,0)) AS supplier_return_out_value,
  CAST(coalesce(ps.sov, 0) AS DECIMAL(18,0)) AS sales_out_value,
  CAST((coalesce(p.stock, 0) - coalesce(a.after_qty, 0)) * coalesce(p.import_price, 0) AS DECIMAL(18,0)) AS closing_cost_value
FROM products p
LEFT JOIN categories c ON c.category_id = p.category_id
LEFT JOIN units u ON u.unit_id = p.unit_id
LEFT JOIN ps ON ps.product_id = p.product_id
LEFT JOIN a ON a.product_id = p.product_id
WHERE coalesce(p.is_active, 1) = 1
ORDER BY p.product_code, p.product_name"""


@oracle("movement_ledger")
def _():
    return f"WITH {_LEDGER.strip()}\nSELECT * FROM ledger"


# ---------------------------------------------------------------- helpers
import datetime as _dt  # noqa: E402

CANCELLED = "('Cancelled','Canceled','Đã hủy','Hủy')"


def day(v: str, plus_days: int = 0) -> str:
    d = _dt.datetime.fromisoformat(v)
    d = _dt.datetime(d.year, d.month, d.day) + _dt.timedelta(days=plus_days)
    return ts(d.isoformat(sep=" "))


def plus_day(v: str) -> str:
    return ts((_dt.datetime.fromisoformat(v) + _dt.timedelta(days=1)).isoformat(sep=" "))


# ---------------------------------------------------------------- debts
_ORDER_DEBT_D1 = """coalesce((SELECT sum(coalesce(o.final_amount,0) - coalesce(o.paid_amount,0)) FROM sales_orders o
     WHERE o.customer_id = c.customer_id AND coalesce(o.status,'') <> 'Cancelled'), 0)"""
_PAID = """coalesce((SELECT sum(coalesce(p.amount,0)) FROM customer_payments p WHERE p.customer_id = {k}), 0)"""
_ADJ = """coalesce((SELECT sum(coalesce(a.amount,0)) FROM customer_debt_adjustments a WHERE a.customer_id = c.customer_id), 0)"""


@oracle("customer_current_debt")
def _():
    return f"""
SELECT customer_id, CAST(CASE WHEN d > 0 THEN d ELSE 0 END AS DECIMAL(18,0)) AS current_debt
FROM (SELECT c.customer_id, {_ORDER_DEBT_D1} - {_PAID.format(k='c.customer_id')} - {_ADJ} AS d FROM customers c) x"""


@oracle("customers_with_debt")
def _():
    return f"""
SELECT c.customer_id, coalesce(c.customer_code,'') AS customer_code, coalesce(c.name,'') AS customer_name,
  coalesce(c.phone,'') AS phone, coalesce(c.address,'') AS address, coalesce(c.email,'') AS email,
  CAST(x.d AS DECIMAL(38,0)) AS current_debt
FROM customers c
JOIN (SELECT c.customer_id, {_ORDER_DEBT_D1} - {_PAID.format(k='c.customer_id')} - {_ADJ} AS d FROM customers c) x
  ON x.customer_id = c.customer_id
WHERE x.d > 0
ORDER BY current_debt DESC, c.name, c.customer_id"""


_D3_ORDERS = """coalesce((SELECT sum(coalesce(o.final_amount,0) - coalesce(o.paid_amount,0)) FROM sales_orders o
     WHERE o.customer_id = {k} AND coalesce(o.status,'') NOT IN ('Cancelled','Canceled','Đã hủy','Hủy')
       AND coalesce(o.order_type,'') <> 'RETURN'), 0)"""
_D5_ORDERS = """coalesce((SELECT sum(coalesce(o.final_amount,0) - coalesce(o.paid_amount,0)) FROM sales_orders o
     WHERE o.customer_id = {k} AND coalesce(o.status,'') IN ('Completed','Partial')
       AND coalesce(o.order_type,'') <> 'RETURN' AND coalesce(o.final_amount,0) > coalesce(o.paid_amount,0)), 0)"""


@oracle("customer_debt_top_variant")
def _():
    k = "c.customer_id"
    return f"""
SELECT c.customer_id, CAST({_D3_ORDERS.format(k=k)} - {_PAID.format(k=k)} AS DECIMAL(38,0)) AS current_debt FROM customers c"""


@oracle("customer_debt_total")
def _():
    return """
SELECT CAST(coalesce(sum(coalesce(final_amount,0) - coalesce(paid_amount,0)), 0) AS DECIMAL(18,0)) AS total_debt_customer
FROM sales_orders
WHERE coalesce(status,'') IN ('Completed','Partial') AND coalesce(final_amount,0) > coalesce(paid_amount,0)
  AND coalesce(order_type,'') <> 'RETURN'"""


@oracle("customer_debt_profit_variant")
def _():
    k = "c.customer_id"
    return f"""
SELECT c.customer_id, CAST(CASE WHEN d > 0 THEN d ELSE 0 END AS DECIMAL(38,0)) AS current_debt
FROM (SELECT c.customer_id, {_D5_ORDERS.format(k=k)} - {_PAID.format(k=k)} AS d FROM customers c) c"""


_SUPPLIER_DEBT = """
sdebt AS (
  SELECT s.supplier_id,
    coalesce((SELECT sum(CASE WHEN coalesce(i.final_amount,0) - coalesce(i.paid_amount,0) - coalesce(r.ret,0) > 0
                              THEN coalesce(i.final_amount,0) - coalesce(i.paid_amount,0) - coalesce(r.ret,0) ELSE 0 END)
              FROM imports i
              LEFT JOIN (SELECT pr.import_id, sum(coalesce(pr.total_amount,0)) AS ret FROM purchase_returns pr
                         WHERE coalesce(pr.status,'') NOT IN ('Cancelled','Canceled','Đã hủy','Hủy') GROUP BY pr.import_id) r
                ON r.import_id = i.import_id
              WHERE i.supplier_id = s.supplier_id AND coalesce(i.status,'') NOT IN ('Cancelled','Canceled','Đã hủy','Hủy')), 0)
    - coalesce((SELECT sum(coalesce(sp.amount,0)) FROM supplier_payments sp WHERE sp.supplier_id = s.supplier_id), 0) AS d
  FROM suppliers s
),
sd AS (SELECT supplier_id, CAST(CASE WHEN d > 0 THEN d ELSE 0 END AS DECIMAL(38,0)) AS current_debt FROM sdebt)"""


@oracle("supplier_debt")
def _():
    return f"WITH {_SUPPLIER_DEBT.strip()}\nSELECT * FROM sd"


@oracle("suppliers_with_debt")
def _():
    return f"""
WITH {_SUPPLIER_DEBT.strip()}
SELECT s.supplier_id, coalesce(s.supplier_name,'') AS supplier_name, coalesce(s.phone,'') AS phone,
  coalesce(s.address,'') AS address, coalesce(s.email,'') AS email, coalesce(s.tax_code,'') AS tax_code,
  coalesce(s.bank_name,'') AS bank_name, coalesce(s.bank_account,'') AS bank_account, coalesce(s.bank_owner,'') AS bank_owner,
  coalesce(s.is_active, 1) AS is_active, sd.current_debt
FROM suppliers s JOIN sd ON sd.supplier_id = s.supplier_id
WHERE sd.current_debt > 0
ORDER BY supplier_name, s.supplier_id"""


@oracle("supplier_debt_total")
def _():
    return f"WITH {_SUPPLIER_DEBT.strip()}\nSELECT CAST(coalesce(sum(current_debt), 0) AS DECIMAL(18,0)) AS total_debt_supplier FROM sd"


# ---------------------------------------------------------------- reports
def _cogs_sql(a: str, b: str) -> str:
    return f"""(SELECT CAST(coalesce(sum(CASE WHEN coalesce(o.order_type,'') = 'RETURN'
        THEN -1 * coalesce(nullif(oi.cost_price,0), coalesce(p.import_price,0)) * abs(coalesce(oi.base_quantity, CAST(oi.quantity AS DECIMAL(18,3))))
        ELSE coalesce(nullif(oi.cost_price,0), coalesce(p.import_price,0)) * abs(coalesce(oi.base_quantity, CAST(oi.quantity AS DECIMAL(18,3)))) END), 0) AS DECIMAL(18,0))
   FROM order_items oi JOIN sales_orders o ON o.order_id = oi.order_id LEFT JOIN products p ON p.product_id = oi.product_id
   WHERE o.order_date BETWEEN {a} AND {b} AND coalesce(o.status,'') IN ('Completed','Paid','Partial') AND oi.product_id IS NOT NULL)"""


def _cash_sql(a: str, b_excl: str) -> str:
    return f"""(SELECT
      CAST(coalesce(sum(CASE WHEN e.entry_type = 'IN' THEN e.amount ELSE 0 END), 0) AS DECIMAL(18,0)) AS cashbook_total_income,
      CAST(coalesce(sum(CASE WHEN e.entry_type = 'OUT' THEN e.amount ELSE 0 END), 0) AS DECIMAL(18,0)) AS cashbook_total_expense,
      CAST(coalesce(sum(CASE WHEN e.entry_type = 'IN' AND coalesce(c.affects_profit, 1) = 1 THEN e.amount ELSE 0 END), 0) AS DECIMAL(18,0)) AS cashbook_income,
      CAST(coalesce(sum(CASE WHEN e.entry_type = 'OUT' AND coalesce(c.affects_profit, 1) = 1 THEN e.amount ELSE 0 END), 0) AS DECIMAL(18,0)) AS cashbook_expense
    FROM cashbook_entries e LEFT JOIN cashbook_categories c ON c.category_id = e.category_id
    WHERE e.is_deleted = 0 AND e.entry_date >= {a} AND e.entry_date < {b_excl})"""


@oracle("cost_of_goods_sold")
def _():
    v = _cogs_sql(ts(P.from_dt), ts(P.to_dt))
    return f"SELECT CAST(CASE WHEN x < 0 THEN 0 ELSE x END AS DECIMAL(18,0)) AS cost_of_goods_sold FROM (SELECT {v} AS x) t"


@oracle("cashbook_profit_split")
def _():
    return f"SELECT * FROM {_cash_sql(day(P.cb_from), day(P.cb_to, 1))} t"


@oracle("overview_report")
def _():
    a, b = ts(P.from_dt), ts(P.to_dt)
    return f"""
WITH v AS (SELECT
  (SELECT CAST(coalesce(sum(coalesce(final_amount,0)),0) AS DECIMAL(18,0)) FROM sales_orders WHERE order_date BETWEEN {a} AND {b}
     AND coalesce(status,'') IN ('Completed','Paid','Partial') AND coalesce(order_type,'') <> 'RETURN') AS gross_sales,
  (SELECT CAST(coalesce(sum(abs(coalesce(final_amount,0))),0) AS DECIMAL(18,0)) FROM sales_orders WHERE order_date BETWEEN {a} AND {b}
     AND coalesce(status,'') IN ('Completed','Paid','Partial') AND coalesce(order_type,'') = 'RETURN') AS customer_return_amount,
  (SELECT CAST(coalesce(sum(coalesce(final_amount,0)),0) AS DECIMAL(18,0)) FROM imports WHERE import_date BETWEEN {a} AND {b}
     AND coalesce(status,'') NOT IN {CANCELLED}) AS total_purchase,
  (SELECT CAST(coalesce(sum(coalesce(total_amount,0)),0) AS DECIMAL(18,0)) FROM purchase_returns WHERE return_date BETWEEN {a} AND {b}
     AND coalesce(status,'') NOT IN {CANCELLED}) AS purchase_return_amount,
  (SELECT CAST(count(*) AS INTEGER) FROM sales_orders WHERE order_date BETWEEN {a} AND {b}
     AND coalesce(status,'') IN ('Completed','Paid','Partial') AND coalesce(order_type,'') <> 'RETURN') AS order_count,
  {_cogs_sql(a, b)} AS cogs_raw,
  (SELECT CAST(coalesce(sum(coalesce(final_amount,0) - coalesce(paid_amount,0)), 0) AS DECIMAL(18,0)) FROM sales_orders
     WHERE coalesce(status,'') IN ('Completed','Partial') AND coalesce(final_amount,0) > coalesce(paid_amount,0)
       AND coalesce(order_type,'') <> 'RETURN') AS total_debt_customer
),
{_SUPPLIER_DEBT.strip()},
cash AS {_cash_sql(day(P.from_dt), day(P.to_dt, 1))},
w AS (SELECT v.*, cash.*,
  CAST(CASE WHEN gross_sales - customer_return_amount < 0 THEN 0 ELSE gross_sales - customer_return_amount END AS DECIMAL(18,0)) AS net_revenue,
  CAST(CASE WHEN total_purchase - purchase_return_amount < 0 THEN 0 ELSE total_purchase - purchase_return_amount END AS DECIMAL(18,0)) AS net_purchase,
  CAST(CASE WHEN cogs_raw < 0 THEN 0 ELSE cogs_raw END AS DECIMAL(18,0)) AS cost_of_goods_sold,
  (SELECT CAST(coalesce(sum(current_debt),0) AS DECIMAL(18,0)) FROM sd) AS total_debt_supplier
  FROM v, cash)
SELECT net_revenue AS total_revenue, net_purchase AS total_cost, order_count,
  CAST(net_revenue - cost_of_goods_sold AS DECIMAL(18,0)) AS gross_profit,
  cashbook_total_income, cashbook_total_expense, cashbook_income, cashbook_expense,
  CAST(net_revenue - cost_of_goods_sold + cashbook_income - cashbook_expense AS DECIMAL(18,0)) AS net_profit_after_cashbook,
  total_debt_customer, total_debt_supplier, gross_sales, customer_return_amount, total_purchase, purchase_return_amount, cost_of_goods_sold
FROM w"""


@oracle("supplier_statistics")
def _():
    a, b = ts(P.from_dt), ts(P.to_dt)
    return f"""
WITH {_SUPPLIER_DEBT.strip()},
rows AS (
  SELECT s.supplier_id, coalesce(s.supplier_name, 'Không xác định') AS supplier_name, coalesce(s.phone, '') AS phone,
    CAST(coalesce((SELECT sum(i.final_amount) FROM imports i WHERE i.supplier_id = s.supplier_id AND i.import_date BETWEEN {a} AND {b}
       AND coalesce(i.status,'') NOT IN {CANCELLED}), 0) AS DECIMAL(38,0)) AS total_import_amount,
    CAST(coalesce((SELECT sum(coalesce(pr.total_amount,0)) FROM purchase_returns pr WHERE pr.supplier_id = s.supplier_id
       AND pr.return_date BETWEEN {a} AND {b} AND coalesce(pr.status,'') NOT IN {CANCELLED}), 0) AS DECIMAL(38,0)) AS total_return_amount,
    CAST(coalesce(sd.current_debt, 0) AS DECIMAL(38,0)) AS current_debt
  FROM suppliers s LEFT JOIN sd ON sd.supplier_id = s.supplier_id)
SELECT * FROM rows WHERE total_import_amount > 0 OR current_debt > 0
ORDER BY total_import_amount DESC, supplier_id LIMIT 50"""


@oracle("top_selling_products")
def _():
    a, b = ts(P.from_dt), ts(P.to_dt)
    return f"""
SELECT p.product_code, p.product_name, CAST(sum(od.quantity) AS BIGINT) AS total_quantity,
  CAST(sum(od.quantity * od.unit_price) AS DECIMAL(38,0)) AS total_revenue
FROM order_items od JOIN sales_orders o ON od.order_id = o.order_id JOIN products p ON od.product_id = p.product_id
WHERE o.order_date >= {a} AND o.order_date <= {b} AND o.status IN ('Completed','Paid')
GROUP BY p.product_code, p.product_name
ORDER BY total_quantity DESC, p.product_code, p.product_name LIMIT 50"""


_ORDER_COGS = """(SELECT oi.order_id, sum(coalesce(nullif(oi.cost_price,0), coalesce(p.import_price,0))
      * abs(CAST(coalesce(oi.base_quantity, CAST(oi.quantity AS DECIMAL(18,3))) AS DECIMAL(18,3)))) AS cogs
   FROM order_items oi LEFT JOIN products p ON p.product_id = oi.product_id GROUP BY oi.order_id)"""

_CO_MEASURES = """
    CASE WHEN coalesce(o.order_type,'') = 'RETURN' THEN -1 * abs(coalesce(o.final_amount, o.total_amount, 0))
         ELSE abs(coalesce(o.final_amount, o.total_amount, 0)) END AS rev,
    CASE WHEN coalesce(o.order_type,'') = 'RETURN' THEN -1 * coalesce(cg.cogs, 0) ELSE coalesce(cg.cogs, 0) END AS cost,
    CASE WHEN coalesce(o.order_type,'') = 'RETURN' THEN 0 ELSE 1 END AS cnt"""

_AGG_MEASURES = """
    CAST(sum(cnt) AS BIGINT) AS total_orders,
    CAST(coalesce(sum(rev), 0) AS DECIMAL(38,0)) AS total_revenue,
    CAST(coalesce(sum(cost), 0) AS DECIMAL(38,3)) AS total_cost,
    CAST(coalesce(sum(rev - cost), 0) AS DECIMAL(38,3)) AS gross_profit,
    CASE WHEN coalesce(sum(rev), 0) = 0 THEN 0.0
         ELSE round(CAST(coalesce(sum(rev - cost), 0) AS DOUBLE) * 100.0 / CAST(sum(rev) AS DOUBLE), 4) END AS profit_margin,
    min(order_date) AS first_order_date, max(order_date) AS last_order_date"""


@oracle("customer_top")
def _():
    a, b = ts(P.from_dt), plus_day(P.to_dt)
    k = "a.customer_id"
    return f"""
WITH co AS (
  SELECT c.customer_id, c.name AS customer_name, c.phone, c.email, c.address, c.points, c.created_at, o.order_id, o.order_date,
    {_CO_MEASURES.strip()}
  FROM customers c JOIN sales_orders o ON c.customer_id = o.customer_id
  LEFT JOIN {_ORDER_COGS} cg ON cg.order_id = o.order_id
  WHERE o.order_date >= {a} AND o.order_date < {b} AND coalesce(o.status,'') NOT IN {CANCELLED}),
agg AS (
  SELECT customer_id, customer_name, phone, email, address, points, created_at, {_AGG_MEASURES.strip()}
  FROM co GROUP BY customer_id, customer_name, phone, email, address, points, created_at
  ORDER BY total_revenue DESC, customer_id LIMIT {P.top_n})
SELECT a.*, CAST({_D3_ORDERS.format(k=k)} - {_PAID.format(k=k)} AS DECIMAL(38,0)) AS current_debt
FROM agg a ORDER BY total_revenue DESC, customer_id"""


@oracle("customer_profit")
def _():
    a, b = ts(P.from_dt), ts(P.to_dt)
    k = "a.customer_id"
    return f"""
WITH co AS (
  SELECT c.customer_id,
    coalesce(nullif(trim(c.customer_code), ''), 'KH' || right('000000' || CAST(c.customer_id AS VARCHAR), 6)) AS customer_code,
    coalesce(c.name, '') AS customer_name, coalesce(c.phone, '') AS phone, coalesce(c.address, '') AS address,
    coalesce(c.points, 0) AS points, o.order_id, o.order_date,
    {_CO_MEASURES.strip()}
  FROM customers c JOIN sales_orders o ON c.customer_id = o.customer_id
  LEFT JOIN {_ORDER_COGS} cg ON cg.order_id = o.order_id
  WHERE o.order_date BETWEEN {a} AND {b} AND coalesce(o.status,'') IN ('Completed','Paid','Partial')),
agg AS (
  SELECT customer_id, customer_code, customer_name, phone, address, points, {_AGG_MEASURES.strip()}
  FROM co GROUP BY customer_id, customer_code, customer_name, phone, address, points
  ORDER BY total_revenue DESC, customer_id LIMIT {P.top_n}),
d AS (SELECT a.customer_id, {_D5_ORDERS.format(k=k)} - {_PAID.format(k=k)} AS debt FROM agg a)
SELECT a.customer_id, a.customer_code, a.customer_name, a.phone, a.address,
  CAST(CASE WHEN coalesce(d.debt, 0) > 0 THEN coalesce(d.debt, 0) ELSE 0 END AS DECIMAL(38,0)) AS current_debt,
  a.points, a.total_orders, a.total_revenue, a.total_cost, a.gross_profit, a.profit_margin, a.first_order_date, a.last_order_date
FROM agg a LEFT JOIN d ON d.customer_id = a.customer_id
ORDER BY a.total_revenue DESC, a.customer_name, a.customer_id"""


@oracle("order_cost")
def _():
    return f"SELECT order_id, CAST(cogs AS DECIMAL(38,3)) AS cost_of_goods_sold FROM {_ORDER_COGS} x"


_PRODUCT_COLS = """p.product_id, p.product_code, p.barcode, p.product_name, p.category_id,
  coalesce(c.category_name, 'Chưa phân loại') AS category_name, p.unit_id, coalesce(u.unit_name, '') AS unit_name,
  p.sell_price, p.stock, p.is_active, p.created_at, CAST(coalesce(p.import_price, 0) AS DECIMAL(18,0)) AS import_price,
  coalesce(p.warranty_months, 0) AS warranty_months, coalesce(p.has_serial, 0) AS has_serial, p.image_path"""


@oracle("product_sales_statistics")
def _():
    return f"""
SELECT {_PRODUCT_COLS},
  CAST(coalesce(sum(CASE WHEN ord.status != 'Cancelled' THEN o.quantity ELSE 0 END), 0) AS BIGINT) AS total_quantity_sold
FROM products p
LEFT JOIN categories c ON p.category_id = c.category_id
LEFT JOIN units u ON p.unit_id = u.unit_id
LEFT JOIN order_items o ON p.product_id = o.product_id
LEFT JOIN sales_orders ord ON o.order_id = ord.order_id
GROUP BY ALL
ORDER BY total_quantity_sold DESC, p.product_id"""


@oracle("products_with_sold")
def _():
    return f"""
SELECT {_PRODUCT_COLS},
  CAST(coalesce((SELECT sum(oi.quantity) FROM order_items oi JOIN sales_orders o ON oi.order_id = o.order_id
                 WHERE oi.product_id = p.product_id AND o.status != 'Cancelled'), 0) AS BIGINT) AS total_quantity_sold
FROM products p
LEFT JOIN categories c ON p.category_id = c.category_id
LEFT JOIN units u ON p.unit_id = u.unit_id
ORDER BY p.product_name, p.product_id"""


# ---------------------------------------------------------------- listings
def ilike(cols, kw):
    return "(" + " OR ".join(f"coalesce({c} ILIKE '%{kw}%', false)" for c in cols) + ")"


@oracle("products_available")
def _():
    return """
SELECT product_id, product_code, barcode, product_name, category_id, stock, sell_price, created_at,
  '' AS unit, 0 AS cost_price, image_path, coalesce(warranty_months, 0) AS warranty_months, coalesce(has_serial, 0) AS has_serial
FROM products WHERE is_active = 1 ORDER BY product_name, product_id"""


_P_DETAIL = """p.product_id, p.product_code, p.barcode, p.product_name, p.category_id, {cat} AS category_name,
  p.unit_id, coalesce(u.unit_name, '') AS unit_name, p.sell_price, p.stock, p.is_active, p.created_at"""


@oracle("product_by_id")
def _():
    return f"""
SELECT {_P_DETAIL.format(cat="coalesce(c.category_name, 'Chưa phân loại')")},
  CAST(coalesce(p.import_price, 0) AS DECIMAL(18,0)) AS import_price, coalesce(p.warranty_months, 0) AS warranty_months,
  coalesce(p.has_serial, 0) AS has_serial, p.image_path
FROM products p LEFT JOIN categories c ON p.category_id = c.category_id LEFT JOIN units u ON p.unit_id = u.unit_id"""


def _pkw(kw):
    return "" if kw == "" else " AND " + ilike(["p.product_name", "p.product_code", "coalesce(p.barcode, '')"], kw)


@oracle("products_search")
def _():
    return f"""
SELECT {_P_DETAIL.format(cat="c.category_name")}, p.import_price, coalesce(p.warranty_months, 0) AS warranty_months,
  coalesce(p.has_serial, 0) AS has_serial, p.image_path
FROM products p LEFT JOIN categories c ON p.category_id = c.category_id LEFT JOIN units u ON p.unit_id = u.unit_id
WHERE p.is_active = 1 {_pkw(P.kw_products)} ORDER BY p.product_name, p.product_id"""


def _search_cat(kw, cat, in_stock):
    stock = " AND p.stock > 0" if in_stock else ""
    return f"""
SELECT p.product_id, p.product_code, p.barcode, p.product_name, p.category_id, p.sell_price, p.stock, p.is_active,
  p.created_at, p.import_price, p.unit_id, p.warranty_months, p.has_serial, p.image_path, c.category_name
FROM products p LEFT JOIN categories c ON p.category_id = c.category_id
WHERE p.is_active = 1{stock} AND ({cat} = 0 OR p.category_id = {cat}) {_pkw(kw)}
ORDER BY p.product_name, p.product_id"""


@oracle("products_search_in_stock")
def _():
    return _search_cat(P.kw_in_stock, P.cat_in_stock, True)


@oracle("products_search_for_import")
def _():
    return _search_cat(P.kw_for_import, P.cat_for_import, False)


_IMPORT_FROM = """FROM imports i LEFT JOIN suppliers s ON i.supplier_id = s.supplier_id LEFT JOIN employees e ON i.employee_id = e.employee_id"""


@oracle("imports_list")
def _():
    kw = "" if P.kw_imports in ("", None) else " AND " + ilike(["i.import_code", "s.supplier_name", "e.name", "i.note"], P.kw_imports)
    st = "" if P.status_imports in (None, "", "All") else f" AND i.status = '{P.status_imports}'"
    return f"""
SELECT i.import_id, i.import_code, i.supplier_id, i.employee_id, s.supplier_name, i.import_date, e.name AS employee_name,
  i.total_amount, i.discount, i.vat_amount, i.final_amount, i.paid_amount, coalesce(i.payment_method, 'Tiền mặt') AS payment_method,
  i.status, i.note
{_IMPORT_FROM}
WHERE i.import_date BETWEEN {ts(P.from_dt)} AND {ts(P.to_dt)}{kw}{st}
ORDER BY i.import_date DESC, i.import_id DESC"""


@oracle("import_by_id")
def _():
    return f"""
SELECT i.import_id, i.import_code, i.supplier_id, i.employee_id, i.import_date, i.total_amount, i.vat_amount, i.discount,
  i.final_amount, i.paid_amount, coalesce(i.payment_method, 'Tiền mặt') AS payment_method, i.note, i.status,
  s.supplier_name, s.phone AS supplier_phone, s.address AS supplier_address, e.name AS employee_name
{_IMPORT_FROM}"""


@oracle("imports_by_supplier")
def _():
    return f"""
SELECT i.import_id, i.import_code, i.supplier_id, i.employee_id, i.import_date, i.total_amount, i.vat_amount, i.discount,
  i.final_amount, i.paid_amount, coalesce(i.payment_method, 'Tiền mặt') AS payment_method,
  CAST(coalesce((SELECT sum(pr.total_amount) FROM purchase_returns pr WHERE pr.import_id = i.import_id
     AND coalesce(pr.status,'') NOT IN {CANCELLED}), 0) AS DECIMAL(38,0)) AS returned_amount,
  i.note, i.status, s.supplier_name, e.name AS employee_name
{_IMPORT_FROM}
ORDER BY i.import_date DESC, i.import_id"""


_SUP_COLS = """supplier_id, supplier_name, phone, address, email, tax_code, coalesce(bank_code, '') AS bank_code,
  bank_name, bank_account, bank_owner, is_active"""


@oracle("suppliers_all")
def _():
    return f"SELECT {_SUP_COLS} FROM suppliers ORDER BY supplier_name, supplier_id"


@oracle("suppliers_search")
def _():
    cond = ilike(["supplier_name", "phone", "bank_code", "bank_name", "bank_account", "bank_owner"], P.kw_suppliers)
    return f"SELECT {_SUP_COLS} FROM suppliers WHERE is_active = 1 AND {cond} ORDER BY supplier_name, supplier_id"


@oracle("supplier_by_id")
def _():
    return f"SELECT {_SUP_COLS} FROM suppliers"


@oracle("customer_payment_history")
def _():
    return f"""
SELECT p.payment_id, p.customer_id, c.name AS customer_name, p.payment_date, p.amount, p.employee_id, e.name AS employee_name,
  coalesce(p.payment_method, 'Tiền mặt') AS payment_method, p.note
FROM customer_payments p JOIN customers c ON p.customer_id = c.customer_id LEFT JOIN employees e ON p.employee_id = e.employee_id
WHERE p.payment_date >= {ts(P.cb_from)} AND p.payment_date <= {ts(P.cb_to)}
ORDER BY p.payment_date DESC, p.payment_id"""


_SP = """
SELECT p.payment_id, p.supplier_id, s.supplier_name, p.payment_date, p.amount, coalesce(p.payment_method, 'Tiền mặt') AS payment_method,
  p.note, p.employee_id, e.name AS employee_name
FROM supplier_payments p LEFT JOIN suppliers s ON p.supplier_id = s.supplier_id LEFT JOIN employees e ON p.employee_id = e.employee_id"""


@oracle("supplier_payment_history")
def _():
    return f"{_SP}\nWHERE p.payment_date BETWEEN {ts(P.cb_from)} AND {ts(P.cb_to)} ORDER BY p.payment_date DESC, p.payment_id"


@oracle("supplier_payment_list")
def _():
    return f"{_SP}\nORDER BY p.payment_date DESC, p.payment_id"


@oracle("purchase_return_history")
def _():
    kw = P.kw_returns.strip()
    cond = "" if kw == "" else " AND " + ilike(["pr.return_code", "coalesce(i.import_code, '')", "coalesce(s.supplier_name, '')", "coalesce(pr.note, '')"], kw)
    return f"""
SELECT pr.return_id, pr.return_code, pr.import_id, coalesce(i.import_code, '') AS import_code, pr.supplier_id,
  coalesce(s.supplier_name, '') AS supplier_name, pr.employee_id, coalesce(e.name, coalesce(u.username, '')) AS employee_name,
  pr.return_date, coalesce(pr.total_amount, 0) AS total_amount, coalesce(pr.note, '') AS note, coalesce(pr.status, '') AS status,
  coalesce(pr.settlement_type, 'DEBT_OFFSET') AS settlement_type, coalesce(pr.refund_method, '') AS refund_method,
  CASE WHEN coalesce(pr.settlement_type, 'DEBT_OFFSET') = 'REFUND' THEN 'Nhận lại tiền - ' || coalesce(nullif(pr.refund_method, ''), 'Tiền mặt')
       ELSE 'Cấn trừ công nợ' END AS settlement_text,
  CASE WHEN coalesce(pr.status, '') IN {CANCELLED} THEN 'Đã hủy' ELSE 'Hoàn tất' END AS status_text
FROM purchase_returns pr
LEFT JOIN imports i ON i.import_id = pr.import_id
LEFT JOIN suppliers s ON s.supplier_id = pr.supplier_id
LEFT JOIN employees e ON e.employee_id = pr.employee_id
LEFT JOIN users u ON u.employee_id = pr.employee_id
WHERE pr.return_date BETWEEN {ts(P.from_dt)} AND {ts(P.to_dt)}{cond}
ORDER BY pr.return_date DESC, pr.return_id DESC"""


_VARIANT_NAME = """COALESCE(nullif(pv.variant_name, ''),
      nullif(concat(nullif(pv.color_value, ''),
        CASE WHEN nullif(pv.color_value, '') IS NOT NULL AND nullif(pv.size_value, '') IS NOT NULL THEN ' / ' ELSE '' END,
        nullif(pv.size_value, '')), ''), pv.sku_code)"""


@oracle("purchase_return_details")
def _():
    return f"""
SELECT prd.return_detail_id, prd.return_id, prd.import_detail_id, prd.product_id, prd.variant_id,
  coalesce(CASE WHEN pv.variant_id IS NULL THEN p.product_code ELSE pv.sku_code END, '') AS product_code,
  coalesce(CASE WHEN pv.variant_id IS NULL THEN p.barcode ELSE nullif(pv.barcode, '') END, '') AS barcode,
  CASE WHEN pv.variant_id IS NULL THEN coalesce(p.product_name, '')
       ELSE coalesce(p.product_name, '') || ' • ' || {_VARIANT_NAME} END AS product_name,
  coalesce(prd.quantity, 0) AS quantity, coalesce(prd.import_price, 0) AS import_price,
  CAST(coalesce(prd.total, coalesce(prd.import_price, 0) * coalesce(prd.quantity, 0)) AS DECIMAL(18,0)) AS total,
  coalesce(prd.reason, '') AS reason
FROM purchase_return_details prd
LEFT JOIN products p ON p.product_id = prd.product_id
LEFT JOIN product_variants pv ON pv.variant_id = prd.variant_id
ORDER BY prd.return_detail_id"""


_RETURNED_QTY = """coalesce((SELECT sum(prd.quantity) FROM purchase_return_details prd JOIN purchase_returns pr ON pr.return_id = prd.return_id
        WHERE prd.import_detail_id = id.import_detail_id AND coalesce(pr.status, '') NOT IN {c}), 0)""".replace("{c}", CANCELLED)


@oracle("imports_returnable")
def _():
    kw = P.kw_returnable.strip()
    cond = "" if kw == "" else " AND " + ilike(["i.import_code", "coalesce(s.supplier_name, '')"], kw)
    ret = f"(SELECT sum(pr.total_amount) FROM purchase_returns pr WHERE pr.import_id = i.import_id AND coalesce(pr.status, '') NOT IN {CANCELLED})"
    return f"""
SELECT i.import_id, i.import_code, i.supplier_id, coalesce(s.supplier_name, '') AS supplier_name, i.import_date, i.final_amount, i.status,
  CASE WHEN i.status = 'Paid' THEN 'Tất toán' WHEN i.status = 'Completed' THEN 'Còn nợ' ELSE i.status END AS status_text,
  CAST(coalesce({ret}, 0) AS DECIMAL(38,0)) AS returned_amount,
  CAST(coalesce(i.final_amount, 0) - coalesce({ret}, 0) AS DECIMAL(38,0)) AS available_amount
FROM imports i LEFT JOIN suppliers s ON s.supplier_id = i.supplier_id
WHERE i.import_date BETWEEN {ts(P.from_dt)} AND {ts(P.to_dt)} AND coalesce(i.status, '') IN ('Completed', 'Paid'){cond}
  AND EXISTS (SELECT 1 FROM import_details id WHERE id.import_id = i.import_id AND coalesce(id.quantity, 0) > {_RETURNED_QTY})
ORDER BY i.import_date DESC, i.import_id DESC"""


@oracle("import_lines_returnable")
def _():
    return f"""
SELECT * FROM (
SELECT id.import_detail_id, id.import_id, id.product_id, id.variant_id,
  CASE WHEN pv.variant_id IS NULL THEN p.product_code ELSE pv.sku_code END AS product_code,
  coalesce(CASE WHEN pv.variant_id IS NULL THEN p.barcode ELSE nullif(pv.barcode, '') END, '') AS barcode,
  CASE WHEN pv.variant_id IS NULL THEN p.product_name ELSE p.product_name || ' • ' || {_VARIANT_NAME} END AS product_name,
  coalesce(id.quantity, 0) AS imported_qty,
  CAST({_RETURNED_QTY} AS BIGINT) AS returned_qty,
  CAST(coalesce(id.quantity, 0) - {_RETURNED_QTY} AS BIGINT) AS max_return_qty,
  0 AS return_qty, coalesce(id.import_price, 0) AS import_price, CAST(0 AS DECIMAL(18,0)) AS return_amount, '' AS reason
FROM import_details id
JOIN products p ON p.product_id = id.product_id
LEFT JOIN product_variants pv ON pv.variant_id = id.variant_id) x
WHERE imported_qty > returned_qty
ORDER BY import_detail_id"""


@oracle("cashbook_categories")
def _():
    ty = (P.cb_type or "").strip().upper()
    cond = "" if ty == "" else f" AND category_type = '{ty}'"
    return f"""
SELECT category_id, category_type, category_name, is_system, is_active, sort_order FROM cashbook_categories
WHERE is_active = 1{cond} ORDER BY category_type, sort_order, category_name"""


@oracle("cashbook_search")
def _():
    kw = P.kw_cashbook.strip()
    cond = "" if kw == "" else " AND " + ilike(
        ["entry_code", "category_name", "payment_method", "reference_code", "description", "created_by"], kw)
    return f"""
SELECT entry_id, entry_code, entry_date, entry_type, category_id, category_name, amount, payment_method, description,
  reference_code, created_by, created_at, updated_at
FROM cashbook_entries
WHERE is_deleted = 0 AND entry_date >= {ts(P.cb_from)} AND entry_date < {plus_day(P.cb_to)}{cond}
ORDER BY entry_date DESC, entry_id DESC"""


@oracle("cashbook_summary")
def _():
    return """
SELECT CAST(coalesce(sum(CASE WHEN entry_type = 'IN' THEN amount ELSE 0 END), 0) AS DECIMAL(38,0)) AS total_in,
  CAST(coalesce(sum(CASE WHEN entry_type = 'OUT' THEN amount ELSE 0 END), 0) AS DECIMAL(38,0)) AS total_out,
  CAST(coalesce(sum(CASE WHEN entry_type = 'IN' THEN amount ELSE -amount END), 0) AS DECIMAL(38,0)) AS balance,
  CAST(count(1) AS INTEGER) AS entry_count
FROM cashbook_entries WHERE is_deleted = 0"""


@oracle("serials_available")
def _():
    return """
SELECT serial_id, product_id, import_id, serial_number, status, sell_price_override, note, created_at
FROM product_serials WHERE status = 0 AND serial_number IS NOT NULL ORDER BY serial_id DESC"""


@oracle("product_serial_trace")
def _():
    return """
SELECT ps.serial_id, ps.import_id, ps.order_id, ps.product_id, coalesce(ps.serial_number, 'Chưa cập nhật') AS serial_number,
  i.import_code, strftime(i.import_date, '%d/%m/%Y') AS import_date_text, coalesce(sup.supplier_name, 'Không xác định') AS supplier_name,
  ps.sell_price_override, coalesce(ps.product_color, '') AS product_color, coalesce(ps.note, '') AS note,
  CASE WHEN ps.status = 0 THEN '🟢 Trong kho' ELSE '🔴 Đã bán' END AS status_text,
  coalesce(o.order_code, '') AS order_code,
  CASE WHEN o.order_date IS NOT NULL THEN strftime(o.order_date, '%d/%m/%Y') ELSE '' END AS order_date_text
FROM product_serials ps JOIN imports i ON ps.import_id = i.import_id
LEFT JOIN suppliers sup ON i.supplier_id = sup.supplier_id
LEFT JOIN sales_orders o ON ps.order_id = o.order_id
ORDER BY ps.serial_id DESC"""


@oracle("serial_trace")
def _():
    return """
SELECT serial_id, product_id, serial_number, import_id, order_id, status, created_at, sell_price_override, product_color, note,
  product_name, supplier_name, import_date, import_code, customer_name, order_date, order_code
FROM (
  SELECT ps.*, p.product_name, s.supplier_name, i.import_date, i.import_code, c.name AS customer_name, o.order_date, o.order_code,
    row_number() OVER (PARTITION BY ps.serial_number ORDER BY ps.serial_id) AS rn
  FROM product_serials ps JOIN products p ON ps.product_id = p.product_id
  LEFT JOIN imports i ON ps.import_id = i.import_id
  LEFT JOIN suppliers s ON i.supplier_id = s.supplier_id
  LEFT JOIN sales_orders o ON ps.order_id = o.order_id
  LEFT JOIN customers c ON o.customer_id = c.customer_id
  WHERE ps.serial_number IS NOT NULL) x
WHERE rn = 1"""


# ---------------------------------------------------------------- quality
def _blank(c):
    return f"nullif(trim(coalesce({c}, '')), '') IS NULL"


@oracle("payroll_cashbook_missing")
def _():
    return f"""
WITH cat AS (SELECT
   (SELECT min(category_id) FROM cashbook_categories WHERE category_type = 'OUT' AND category_name = 'Tạm ứng lương nhân viên') AS adv,
   (SELECT min(category_id) FROM cashbook_categories WHERE category_type = 'OUT' AND category_name = 'Chi lương nhân viên') AS sett)
SELECT pp.payment_id, pp.payment_date AS entry_date, 'OUT' AS entry_type,
  CAST(CASE WHEN pp.payment_type = 'ADVANCE' THEN cat.adv ELSE cat.sett END AS INTEGER) AS category_id,
  CASE WHEN pp.payment_type = 'ADVANCE' THEN 'Tạm ứng lương nhân viên' ELSE 'Chi lương nhân viên' END AS category_name,
  pp.amount, coalesce(nullif(trim(pp.payment_method), ''), 'Tiền mặt') AS payment_method,
  CASE WHEN pp.payment_type = 'ADVANCE' THEN 'Tạm ứng lương: ' ELSE 'Thanh toán lương: ' END
    || coalesce(nullif(trim(p.employee_name), ''), 'nhân viên') AS description,
  'PAYROLL:' || CAST(pp.payment_id AS VARCHAR) AS reference_code,
  nullif(trim(pp.created_by), '') AS created_by
FROM employee_payroll_payments pp JOIN employee_payrolls p ON p.payroll_id = pp.payroll_id, cat
WHERE pp.is_void = 0 AND pp.amount > 0 AND pp.payment_type IN ('ADVANCE', 'SETTLEMENT')
  AND NOT EXISTS (SELECT 1 FROM cashbook_entries ce WHERE ce.is_deleted = 0 AND ce.reference_code = 'PAYROLL:' || CAST(pp.payment_id AS VARCHAR))"""


@oracle("payroll_cashbook_void")
def _():
    return f"""
SELECT ce.entry_id, ce.reference_code, pp.payment_id, 1 AS is_deleted, {ts(P.as_of.isoformat(sep=' '))} AS updated_at
FROM cashbook_entries ce JOIN employee_payroll_payments pp ON ce.reference_code = 'PAYROLL:' || CAST(pp.payment_id AS VARCHAR)
WHERE ce.is_deleted = 0 AND pp.is_void = 1"""


@oracle("cashbook_code_backfill")
def _():
    return f"""
SELECT entry_id, entry_date, 'SQ' || strftime(entry_date, '%y%m%d') || right('000000' || CAST(entry_id AS VARCHAR), 6) AS entry_code,
  {ts(P.as_of.isoformat(sep=' '))} AS updated_at
FROM cashbook_entries WHERE is_deleted = 0 AND reference_code ILIKE 'PAYROLL:%' AND {_blank('entry_code')}"""


@oracle("allocation_wrong_customer")
def _():
    return """
SELECT da.adjustment_id, da.order_id, da.amount, a.customer_id AS adjustment_customer_id, o.customer_id AS order_customer_id
FROM customer_debt_discount_allocations da JOIN customer_debt_adjustments a ON a.adjustment_id = da.adjustment_id
JOIN sales_orders o ON o.order_id = da.order_id WHERE a.customer_id <> o.customer_id"""


@oracle("allocation_over_amount")
def _():
    return """
SELECT adjustment_id, adjustment_amount, CAST(allocated AS DECIMAL(38,0)) AS allocated_amount FROM (
  SELECT a.adjustment_id, a.amount AS adjustment_amount, sum(coalesce(da.amount, 0)) AS allocated
  FROM customer_debt_adjustments a LEFT JOIN customer_debt_discount_allocations da ON da.adjustment_id = a.adjustment_id
  GROUP BY a.adjustment_id, a.amount) q
WHERE allocated > adjustment_amount"""


@oracle("barcode_normalise")
def _():
    return "SELECT product_id, nullif(trim(barcode), '') AS barcode FROM products WHERE barcode IS NOT NULL"


@oracle("blank_to_null_serial")
def _():
    return f"SELECT serial_id, CAST(NULL AS VARCHAR) AS serial_number FROM product_serials WHERE {_blank('serial_number')}"


_BARCODE_DUPS = """SELECT barcode, count(*) AS product_count FROM products WHERE barcode IS NOT NULL AND trim(barcode) <> ''
  GROUP BY barcode HAVING count(*) > 1"""


@oracle("barcode_duplicates")
def _():
    return _BARCODE_DUPS + " ORDER BY barcode"


@oracle("barcode_duplicate_products")
def _():
    return f"""
SELECT p.product_id, p.product_code, p.barcode, p.product_name FROM products p JOIN ({_BARCODE_DUPS}) d ON d.barcode = p.barcode
ORDER BY p.barcode, p.product_id"""


@oracle("duplicate_document_codes")
def _():
    return """
SELECT 'order' AS document_type, order_code AS code, count(*) AS duplicate_count FROM sales_orders WHERE order_code IS NOT NULL
  GROUP BY order_code HAVING count(*) > 1
UNION ALL
SELECT 'import', import_code, count(*) FROM imports WHERE import_code IS NOT NULL GROUP BY import_code HAVING count(*) > 1"""


@oracle("customer_code_backfill")
def _():
    return f"""
SELECT customer_id, 'KH' || right('000000' || CAST(customer_id AS VARCHAR), 6) AS customer_code FROM customers WHERE {_blank('customer_code')}"""


@oracle("customer_code_dedupe")
def _():
    return f"""
SELECT customer_id, old_customer_code, 'KH' || right('000000' || CAST(customer_id AS VARCHAR), 6) || '-' || CAST(row_no AS VARCHAR) AS customer_code, row_no
FROM (SELECT customer_id, code AS old_customer_code, row_number() OVER (PARTITION BY trim(code) ORDER BY customer_id) AS row_no
      FROM (SELECT customer_id, CASE WHEN {_blank('customer_code')} THEN 'KH' || right('000000' || CAST(customer_id AS VARCHAR), 6)
                                     ELSE customer_code END AS code FROM customers) b) d
WHERE row_no > 1"""


@oracle("return_code_dedupe")
def _():
    return """
SELECT return_id, return_code AS old_return_code,
  left(return_code, 30 - length(CAST(return_id AS VARCHAR)) - 1) || '-' || CAST(return_id AS VARCHAR) AS return_code
FROM (SELECT return_id, return_code, row_number() OVER (PARTITION BY return_code ORDER BY return_id) AS rn FROM purchase_returns) d
WHERE rn > 1"""


@oracle("bank_code_standardise")
def _():
    from ..operators.quality import BANK_CODES

    whens = "\n".join(
        f"    WHEN upper(trim(coalesce(bank_name, ''))) IN ({', '.join(repr(n) for n in names)}) THEN '{code}'"
        for code, names in BANK_CODES.items()
    )
    return f"""
SELECT supplier_id, bank_name, bank_code AS old_bank_code,
  CASE
{whens}
    ELSE bank_code END AS bank_code
FROM suppliers WHERE {_blank('bank_code')}"""


@oracle("quantity_backfill")
def _():
    return """
SELECT order_id, product_id, quantity, gift_quantity,
  coalesce(input_quantity, CAST(quantity AS DECIMAL(18,3))) AS input_quantity,
  CAST(coalesce(base_quantity, CAST(CASE WHEN coalesce(quantity, 0) < 0 THEN coalesce(quantity, 0) - coalesce(gift_quantity, 0)
                                    ELSE coalesce(quantity, 0) + coalesce(gift_quantity, 0) END AS DECIMAL(18,3))) AS DECIMAL(18,3)) AS base_quantity,
  coalesce(unit_conversion_to_base, CAST(1 AS DECIMAL(18,6))) AS unit_conversion_to_base
FROM order_items WHERE input_quantity IS NULL OR base_quantity IS NULL OR unit_conversion_to_base IS NULL"""


@oracle("import_quantity_backfill")
def _():
    return """
SELECT import_detail_id, quantity,
  coalesce(input_quantity, CAST(quantity AS DECIMAL(18,3))) AS input_quantity,
  coalesce(base_quantity, CAST(quantity AS DECIMAL(18,3))) AS base_quantity,
  coalesce(unit_conversion_to_base, CAST(1 AS DECIMAL(18,6))) AS unit_conversion_to_base
FROM import_details WHERE input_quantity IS NULL OR base_quantity IS NULL OR unit_conversion_to_base IS NULL"""


@oracle("cost_price_backfill")
def _():
    return """
SELECT oi.order_id, oi.product_id, oi.quantity, oi.cost_price AS old_cost_price, CAST(coalesce(p.import_price, 0) AS DECIMAL(18,0)) AS cost_price
FROM order_items oi JOIN products p ON p.product_id = oi.product_id
WHERE coalesce(oi.cost_price, 0) = 0 AND coalesce(p.import_price, 0) > 0"""


_VARIANT_FIX = """SELECT prd.return_detail_id, prd.import_detail_id, id.variant_id FROM purchase_return_details prd
  JOIN import_details id ON id.import_detail_id = prd.import_detail_id WHERE prd.variant_id IS NULL AND id.variant_id IS NOT NULL"""


@oracle("variant_return_backfill")
def _():
    return _VARIANT_FIX


@oracle("variant_return_stock_delta")
def _():
    return f"""
WITH fixed AS ({_VARIANT_FIX}),
lines AS (SELECT prd.return_id, prd.quantity, coalesce(prd.variant_id, f.variant_id) AS variant_id
          FROM purchase_return_details prd LEFT JOIN fixed f ON f.return_detail_id = prd.return_detail_id),
r AS (SELECT l.variant_id, sum(CAST(l.quantity AS DECIMAL(18,3))) AS q FROM lines l JOIN purchase_returns pr ON pr.return_id = l.return_id
      WHERE l.variant_id IS NOT NULL AND coalesce(pr.status, '') NOT IN {CANCELLED} GROUP BY l.variant_id)
SELECT pv.variant_id, CAST(r.q AS DECIMAL(38,3)) AS return_qty, CAST(coalesce(pv.stock_base_qty, 0) - r.q AS DECIMAL(38,3)) AS stock_base_qty
FROM product_variants pv JOIN r ON r.variant_id = pv.variant_id"""


_DUP_SALES = """
lines AS (SELECT d.order_id, oi.product_id, coalesce(oi.product_variant_id, 0) AS v, oi.product_variant_id AS variant_id, oi.quantity,
                 coalesce(oi.gift_quantity, 0) AS g, oi.unit_price, coalesce(oi.serial_number, '') AS s
          FROM duplicate_sale_candidates d JOIN duplicate_sale_lines oi ON oi.order_id = d.order_id),
lg AS (SELECT order_id, product_id, v, quantity, g, unit_price, s, count(*) AS n FROM lines
       GROUP BY order_id, product_id, v, quantity, g, unit_price, s),
lc AS (SELECT order_id, count(*) AS k FROM lg GROUP BY order_id),
base AS (
  SELECT z.order_id, z.order_date, c.order_id AS cand, c.order_date AS cand_date
  FROM duplicate_sale_candidates z JOIN duplicate_sale_candidates c
    ON c.order_id <> z.order_id AND coalesce(c.customer_id, -1) = coalesce(z.customer_id, -1)
   AND coalesce(c.employee_id, -1) = coalesce(z.employee_id, -1) AND coalesce(c.cashier_id, -1) = coalesce(z.cashier_id, -1)
   AND coalesce(c.total_amount, 0) = coalesce(z.total_amount, 0) AND coalesce(c.discount, 0) = coalesce(z.discount, 0)
   AND coalesce(c.vat_amount, 0) = coalesce(z.vat_amount, 0) AND coalesce(c.paid_amount, 0) = coalesce(z.paid_amount, 0)
   AND coalesce(c.status, '') = coalesce(z.status, '') AND coalesce(c.payment_method, '') = coalesce(z.payment_method, '')
   AND coalesce(c.final_amount, 0) = coalesce(z.final_amount, 0) AND coalesce(c.order_type, '') = coalesce(z.order_type, '')
   AND abs(date_diff('second', date_trunc('second', z.order_date), date_trunc('second', c.order_date))) <= 30
  WHERE z.order_type = 'SALE' AND NOT EXISTS (SELECT 1 FROM product_serials ps WHERE ps.order_id = z.order_id)),
m AS (SELECT b.order_id, b.cand, count(*) AS matched FROM base b
      JOIN lg a ON a.order_id = b.order_id
      JOIN lg x ON x.order_id = b.cand AND x.product_id IS NOT DISTINCT FROM a.product_id AND x.v = a.v
        AND x.quantity IS NOT DISTINCT FROM a.quantity AND x.g = a.g AND x.unit_price IS NOT DISTINCT FROM a.unit_price
        AND x.s = a.s AND x.n = a.n
      GROUP BY b.order_id, b.cand),
ok AS (SELECT b.* FROM base b LEFT JOIN m ON m.order_id = b.order_id AND m.cand = b.cand
       LEFT JOIN lc kz ON kz.order_id = b.order_id LEFT JOIN lc kc ON kc.order_id = b.cand
       WHERE coalesce(m.matched, 0) = coalesce(kz.k, 0) AND coalesce(kz.k, 0) = coalesce(kc.k, 0)),
hits AS (SELECT order_id, order_date, cand AS duplicate_of, cand_date AS duplicate_of_date FROM (
   SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY cand_date, cand) AS rn FROM ok) r WHERE rn = 1)"""


@oracle("duplicate_sale_detect")
def _():
    return f"WITH {_DUP_SALES.strip()}\nSELECT * FROM hits"


@oracle("duplicate_sale_reverse")
def _():
    return f"""
WITH {_DUP_SALES.strip()},
later AS (SELECT order_id FROM hits WHERE duplicate_of_date < order_date OR (duplicate_of_date = order_date AND duplicate_of < order_id))
SELECT l.product_id, CAST(sum(CASE WHEN coalesce(l.quantity, 0) < 0 THEN coalesce(l.quantity, 0) - l.g ELSE coalesce(l.quantity, 0) + l.g END) AS BIGINT) AS quantity_to_restore
FROM lines l JOIN later ON later.order_id = l.order_id GROUP BY l.product_id"""


@oracle("unreferenced_duplicate_customer")
def _():
    return """
WITH refs AS (SELECT customer_id FROM sales_orders UNION SELECT customer_id FROM customer_payments UNION SELECT customer_id FROM customer_debt_adjustments),
c AS (SELECT customer_id, name, phone, trim(coalesce(name, '')) AS n, trim(coalesce(phone, '')) AS p,
        customer_id IN (SELECT customer_id FROM refs WHERE customer_id IS NOT NULL) AS ref FROM customers)
SELECT c.customer_id, c.name, c.phone FROM c
WHERE NOT c.ref AND EXISTS (SELECT 1 FROM c t WHERE t.n = c.n AND t.p = c.p AND t.customer_id <> c.customer_id AND (t.ref OR t.customer_id < c.customer_id))"""


@oracle("rekey_invalid_id")
def _():
    nid = "(SELECT CAST(coalesce(max(CASE WHEN supplier_id > 0 THEN supplier_id END), 0) + 1 AS BIGINT) FROM suppliers)"
    return f"""
SELECT 'suppliers' AS table_name, CAST(supplier_id AS VARCHAR) AS row_key, CAST(supplier_id AS BIGINT) AS old_id, {nid} AS new_id FROM suppliers WHERE supplier_id = 0
UNION ALL SELECT 'imports', CAST(import_id AS VARCHAR), CAST(supplier_id AS BIGINT), {nid} FROM imports WHERE supplier_id = 0
UNION ALL SELECT 'purchase_returns', CAST(return_id AS VARCHAR), CAST(supplier_id AS BIGINT), {nid} FROM purchase_returns WHERE supplier_id = 0
UNION ALL SELECT 'supplier_payments', CAST(payment_id AS VARCHAR), CAST(supplier_id AS BIGINT), {nid} FROM supplier_payments WHERE supplier_id = 0"""


def _rekey(header, key, children):
    nid = f"(SELECT CAST(coalesce(max(CASE WHEN {key} > 0 THEN {key} END), 0) + 1 AS BIGINT) FROM {header})"
    return "\nUNION ALL ".join(
        f"SELECT '{t}' AS table_name, CAST({rk} AS VARCHAR) AS row_key, CAST({key} AS BIGINT) AS old_id, {nid} AS new_id FROM {t} WHERE {key} = 0"
        for t, rk in [(header, key), *children])


@oracle("rekey_import_id")
def _():
    return _rekey("imports", "import_id", [("import_details", "import_detail_id"), ("product_serials", "serial_id"),
                                           ("purchase_returns", "return_id"), ("supplier_debt_discount_allocations", "allocation_id")])


@oracle("rekey_purchase_return_id")
def _():
    return _rekey("purchase_returns", "return_id", [("purchase_return_details", "return_detail_id")])


@oracle("rekey_purchase_return_line_id")
def _():
    return _rekey("purchase_return_details", "return_detail_id", [])


@oracle("empty_stocktakes")
def _():
    return """
SELECT ic.check_id, ic.check_date FROM inventory_checks ic
WHERE ic.check_id = 0 AND NOT EXISTS (SELECT 1 FROM inventory_check_details d WHERE d.check_id = ic.check_id)"""


@oracle("settlement_normalise")
def _():
    return """
SELECT return_id, st AS settlement_type, CASE WHEN st = 'DEBT_OFFSET' THEN NULL ELSE refund_method END AS refund_method
FROM (SELECT return_id, refund_method,
        CASE WHEN settlement_type IS NULL OR settlement_type NOT IN ('DEBT_OFFSET', 'REFUND') THEN 'DEBT_OFFSET' ELSE settlement_type END AS st
      FROM purchase_returns) x"""


@oracle("payment_method_backfill")
def _():
    return f"""
SELECT 'customer_payments' AS table_name, CAST(payment_id AS BIGINT) AS row_id, 'Tiền mặt' AS payment_method FROM customer_payments WHERE {_blank('payment_method')}
UNION ALL SELECT 'imports', CAST(import_id AS BIGINT), 'Tiền mặt' FROM imports WHERE {_blank('payment_method')}
UNION ALL SELECT 'supplier_payments', CAST(payment_id AS BIGINT), 'Tiền mặt' FROM supplier_payments WHERE {_blank('payment_method')}"""


@oracle("constraint_violations")
def _():
    def bad(rule, table, cond, key):
        return f"SELECT '{rule}' AS rule, '{table}' AS table_name, CAST({key} AS VARCHAR) AS row_key FROM {table} WHERE {cond}"

    def dup(rule, table, cols, cond="TRUE"):
        k = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in cols)
        return (f"SELECT '{rule}', '{table}', {k} FROM {table} WHERE {cond} GROUP BY {', '.join(cols)} HAVING count(*) > 1")

    parts = [
        bad("amount_positive", "cashbook_entries", "NOT coalesce(amount > 0, false)", "entry_id"),
        bad("amount_positive", "customer_debt_adjustments", "NOT coalesce(amount > 0, false)", "adjustment_id"),
        bad("amount_positive", "customer_debt_discount_allocations", "NOT coalesce(amount > 0, false)",
            "CAST(adjustment_id AS VARCHAR) || '|' || CAST(order_id AS VARCHAR)"),
        bad("entry_type_in_out", "cashbook_entries", "NOT coalesce(entry_type IN ('IN', 'OUT'), false)", "entry_id"),
        bad("category_type_in_out", "cashbook_categories", "NOT coalesce(category_type IN ('IN', 'OUT'), false)", "category_id"),
        bad("payment_type_advance_settlement", "employee_payroll_payments",
            "NOT coalesce(payment_type IN ('ADVANCE', 'SETTLEMENT'), false)", "payment_id"),
        bad("settlement_type_valid", "purchase_returns", "NOT coalesce(settlement_type IN ('DEBT_OFFSET', 'REFUND'), false)", "return_id"),
        bad("order_code_not_null", "sales_orders", "order_code IS NULL", "order_id"),
        bad("import_code_not_null", "imports", "import_code IS NULL", "import_id"),
        bad("credit_not_negative", "imports", "supplier_credit_applied < 0", "import_id"),
        dup("month_employee_unique", "employee_payrolls", ["payroll_month", "employee_id"]),
        dup("order_code_unique", "sales_orders", ["order_code"], "order_code IS NOT NULL"),
        dup("import_code_unique", "imports", ["import_code"], "import_code IS NOT NULL"),
        dup("allocation_unique", "customer_debt_discount_allocations", ["adjustment_id", "order_id"]),
        dup("sku_unique", "product_variants", ["sku_code"]),
        dup("serial_unique", "product_serials", ["serial_number"], "serial_number IS NOT NULL"),
        dup("barcode_unique", "products", ["barcode"], "barcode IS NOT NULL AND trim(barcode) <> ''"),
    ]
    return "\nUNION ALL\n".join(parts)


# ---------------------------------------------------------------- posting
_ASOF = "TIMESTAMP '2026-08-20 09:30:00'"

# XML items parsed with regular expressions (independent of Spark's from_xml)
_XML_ITEMS = """
xi AS (SELECT request_id, unnest(regexp_extract_all(details_xml, '<Item [^>]*/>')) AS it FROM return_requests),
xp AS (
  SELECT r.request_id, r.return_code, r.import_id, r.supplier_id, xi.it IS NOT NULL AS item_present,
    TRY_CAST(regexp_extract(xi.it, 'ImportDetailId="([^"]*)"', 1) AS BIGINT) AS import_detail_id,
    TRY_CAST(regexp_extract(xi.it, 'ProductId="([^"]*)"', 1) AS BIGINT) AS product_id,
    TRY_CAST(nullif(regexp_extract(xi.it, 'VariantId="([^"]*)"', 1), '') AS BIGINT) AS variant_id,
    TRY_CAST(regexp_extract(xi.it, 'Quantity="([^"]*)"', 1) AS INTEGER) AS quantity,
    TRY_CAST(regexp_extract(xi.it, 'ImportPrice="([^"]*)"', 1) AS DECIMAL(18,0)) AS import_price,
    regexp_extract(xi.it, 'Reason="([^"]*)"', 1) AS reason,
    NOT coalesce(r.details_xml LIKE '<Details>%</Details>', false) AS doc_bad
  FROM return_requests r LEFT JOIN xi ON xi.request_id = r.request_id),
items AS (
  SELECT *, doc_bad OR (item_present AND (import_detail_id IS NULL OR product_id IS NULL OR quantity IS NULL OR import_price IS NULL)) AS bad_xml
  FROM xp)"""

_RETURN_VALIDATE = _XML_ITEMS + """,
returned AS (SELECT prd.import_detail_id, sum(prd.quantity) AS q FROM purchase_return_details prd
             JOIN purchase_returns pr ON pr.return_id = prd.return_id WHERE coalesce(pr.status, '') NOT IN {c} GROUP BY prd.import_detail_id),
per_req AS (SELECT request_id, max(CASE WHEN bad_xml THEN 1 ELSE 0 END) AS f0, count(*) FILTER (WHERE item_present) AS n,
                   max(CASE WHEN item_present AND quantity <= 0 THEN 1 ELSE 0 END) AS f2 FROM items GROUP BY request_id),
chk AS (
  SELECT r.request_id, r.return_code,
    CASE WHEN pq.f0 = 1 THEN 51000 WHEN pq.n = 0 THEN 51001 WHEN pq.f2 = 1 THEN 51002
      WHEN NOT EXISTS (SELECT 1 FROM imports i WHERE i.import_id = r.import_id AND i.supplier_id = r.supplier_id
                         AND coalesce(i.status, '') IN ('Completed', 'Paid')) THEN 51003
      WHEN EXISTS (SELECT 1 FROM items d LEFT JOIN import_details id ON id.import_detail_id = d.import_detail_id
                   WHERE d.request_id = r.request_id AND d.item_present
                     AND (id.import_detail_id IS NULL OR id.import_id <> r.import_id OR id.product_id <> d.product_id
                          OR (d.variant_id IS NOT NULL AND coalesce(id.variant_id, 0) <> d.variant_id))) THEN 51004
    END AS reason_code
  FROM return_requests r JOIN per_req pq ON pq.request_id = r.request_id),
ex AS (SELECT return_code, min(return_id) AS existing_id FROM purchase_returns GROUP BY return_code),
-- requests that compete are decided in rounds; tests replay the calls one by one at the smallest size
dyn AS (SELECT c.request_id, c.return_code FROM chk c LEFT JOIN ex USING (return_code) WHERE c.reason_code IS NULL AND ex.existing_id IS NULL),
parts AS (
  SELECT d.request_id, 51005 AS code, id.import_detail_id AS rid, d.quantity AS q, coalesce(id.quantity, 0) - coalesce(rt.q, 0) AS cap
  FROM items d JOIN import_details id ON id.import_detail_id = d.import_detail_id LEFT JOIN returned rt ON rt.import_detail_id = id.import_detail_id
  WHERE d.item_present
  UNION ALL SELECT d.request_id, 51006, d.product_id, d.quantity, coalesce(p.stock, 0) FROM items d JOIN products p ON p.product_id = d.product_id WHERE d.item_present
  UNION ALL SELECT d.request_id, 51007, id.variant_id, d.quantity, coalesce(v.stock_base_qty, 0) FROM items d
  JOIN import_details id ON id.import_detail_id = d.import_detail_id JOIN product_variants v ON v.variant_id = id.variant_id WHERE d.item_present),
dem AS (SELECT request_id, code, rid, CASE WHEN code = 51005 THEN max(q) ELSE sum(q) END AS need, sum(q) AS used, min(cap) AS cap
        FROM parts WHERE request_id IN (SELECT request_id FROM dyn) GROUP BY request_id, code, rid),
scarce AS (SELECT code, rid FROM dem GROUP BY code, rid HAVING sum(used) > min(cap)),
ask AS (SELECT dem.* FROM dem JOIN scarce USING (code, rid)),
rounds(n, request_id, return_code, st) AS (
  SELECT 0, request_id, return_code, 'U' FROM dyn
  UNION ALL
  SELECT n + 1, request_id, return_code,
    CASE WHEN st <> 'U' THEN st WHEN posted < request_id THEN 'E' WHEN nxt < request_id THEN 'U' WHEN NOT maybe THEN 'R' WHEN sure THEN 'A' ELSE 'U' END
  FROM (
    SELECT s.*, coalesce(f.sure, true) AS sure, coalesce(f.maybe, true) AS maybe,
      min(CASE WHEN s.st = 'A' THEN s.request_id END) OVER (PARTITION BY s.return_code) AS posted,
      min(CASE WHEN s.st = 'U' THEN s.request_id END) OVER (PARTITION BY s.return_code) AS nxt
    FROM rounds s LEFT JOIN (
      SELECT request_id, bool_and(need + most <= cap) AS sure, bool_and(need + least <= cap) AS maybe FROM (
        SELECT a.request_id, a.need, a.cap, coalesce(sum(a.used) OVER w, 0) AS most, coalesce(sum(CASE WHEN r.st = 'A' THEN a.used ELSE 0 END) OVER w, 0) AS least
        FROM ask a JOIN rounds r ON r.request_id = a.request_id WHERE r.st IN ('A', 'U')
        WINDOW w AS (PARTITION BY a.code, a.rid ORDER BY a.request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) x GROUP BY request_id) f
      ON f.request_id = s.request_id) y
  WHERE EXISTS (SELECT 1 FROM rounds z WHERE z.st = 'U')),
fin AS (SELECT * FROM rounds WHERE n = (SELECT max(n) FROM rounds)),
why AS (SELECT request_id, min(code) AS code FROM (
    SELECT a.*, f.st, coalesce(sum(CASE WHEN f.st = 'A' THEN a.used ELSE 0 END) OVER (PARTITION BY a.code, a.rid ORDER BY a.request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS least
    FROM ask a JOIN fin f ON f.request_id = a.request_id) x WHERE st = 'R' AND need + least > cap GROUP BY request_id),
told AS (SELECT f.request_id, f.return_code, CASE f.st WHEN 'A' THEN 0 WHEN 'E' THEN 1 ELSE w.code END AS verdict FROM fin f LEFT JOIN why w ON w.request_id = f.request_id),
acc AS (SELECT request_id, return_code, (SELECT coalesce(max(return_id), 0) FROM purchase_returns) + row_number() OVER (ORDER BY request_id) AS new_id
        FROM told WHERE verdict = 0),
oc AS (SELECT c.request_id, c.return_code, ex.existing_id, a.new_id,
         CASE WHEN ex.existing_id IS NOT NULL OR a.request_id < c.request_id THEN 'existing' WHEN a.request_id = c.request_id THEN 'accepted' ELSE 'rejected' END AS outcome,
         coalesce(c.reason_code, t.verdict) AS reason_code
       FROM chk c LEFT JOIN ex ON ex.return_code = c.return_code LEFT JOIN acc a ON a.return_code = c.return_code LEFT JOIN told t ON t.request_id = c.request_id),
val AS (SELECT request_id, return_code, outcome, CASE WHEN outcome = 'rejected' THEN CAST(reason_code AS INTEGER) END AS reason_code,
          CAST(CASE WHEN outcome <> 'rejected' THEN coalesce(existing_id, new_id) END AS BIGINT) AS return_id FROM oc)""".replace("{c}", CANCELLED)


@oracle("xml_line_items")
def _():
    return f"""WITH {_XML_ITEMS.strip()}
SELECT request_id, item_present, import_detail_id, product_id, variant_id, quantity, import_price,
  CASE WHEN item_present THEN reason END AS reason, bad_xml FROM items"""


@oracle("return_request_validate")
def _():
    return f"WITH RECURSIVE {_RETURN_VALIDATE.strip()}\nSELECT * FROM val"


@oracle("return_request_idempotent")
def _():
    return f"WITH RECURSIVE {_RETURN_VALIDATE.strip()}\nSELECT * FROM val WHERE outcome = 'existing'"


@oracle("return_request_post")
def _():
    return f"""WITH RECURSIVE {_RETURN_VALIDATE.strip()}
SELECT v.return_id, r.return_code, r.import_id, r.supplier_id, r.employee_id, {_ASOF} AS return_date,
  CAST(coalesce((SELECT sum(quantity * import_price) FROM items d WHERE d.request_id = r.request_id AND d.item_present), 0) AS DECIMAL(18,0)) AS total_amount,
  r.note, 'Completed' AS status
FROM val v JOIN return_requests r ON r.request_id = v.request_id WHERE v.outcome = 'accepted'"""


@oracle("return_request_details")
def _():
    return f"""WITH RECURSIVE {_RETURN_VALIDATE.strip()}
SELECT v.return_id, d.import_detail_id, d.product_id, id.variant_id, d.quantity, d.import_price,
  CAST(d.quantity * d.import_price AS DECIMAL(18,0)) AS total, d.reason
FROM val v JOIN items d ON d.request_id = v.request_id AND d.item_present
JOIN import_details id ON id.import_detail_id = d.import_detail_id
WHERE v.outcome = 'accepted'"""


@oracle("return_request_stock_delta")
def _():
    return f"""WITH RECURSIVE {_RETURN_VALIDATE.strip()},
ok AS (SELECT d.*, id.variant_id AS line_variant FROM val v JOIN items d ON d.request_id = v.request_id AND d.item_present
       LEFT JOIN import_details id ON id.import_detail_id = d.import_detail_id WHERE v.outcome = 'accepted')
SELECT 'product' AS kind, product_id AS id, CAST(-sum(quantity) AS BIGINT) AS stock_delta FROM ok WHERE product_id IN (SELECT product_id FROM products) GROUP BY product_id
UNION ALL
SELECT 'variant', line_variant, CAST(-sum(quantity) AS BIGINT) FROM ok WHERE line_variant IN (SELECT variant_id FROM product_variants)
  AND import_detail_id IN (SELECT import_detail_id FROM import_details) GROUP BY line_variant"""


_CANCEL = """
cq AS (SELECT q.*, min(request_id) OVER (PARTITION BY return_id) AS first_req FROM return_cancel_requests q),
cj AS (SELECT q.request_id, q.return_id, q.reason, pr.status, pr.note,
         CASE WHEN pr.return_id IS NULL THEN 51020 WHEN coalesce(pr.status, '') IN {c} OR q.request_id <> q.first_req THEN 51021 END AS error_code
       FROM cq q LEFT JOIN purchase_returns pr ON pr.return_id = q.return_id)""".replace("{c}", CANCELLED)


@oracle("return_cancel")
def _():
    return f"""WITH {_CANCEL.strip()}
SELECT request_id, return_id, error_code,
  CASE WHEN error_code IS NULL THEN 'Cancelled' ELSE status END AS status,
  CASE WHEN error_code IS NULL THEN coalesce(note, '') || CASE WHEN coalesce(note, '') = '' THEN '' ELSE chr(13) || chr(10) END
       || '[ĐÃ HỦY ' || strftime({_ASOF}, '%Y-%m-%d %H:%M:%S') || '] ' || coalesce(nullif(trim(reason), ''), 'Hủy phiếu trả NCC')
       ELSE note END AS note
FROM cj"""


@oracle("return_cancel_stock_delta")
def _():
    return f"""WITH {_CANCEL.strip()},
l AS (SELECT d.* FROM purchase_return_details d JOIN cj ON cj.return_id = d.return_id AND cj.error_code IS NULL)
SELECT 'product' AS kind, product_id AS id, CAST(sum(quantity) AS BIGINT) AS stock_delta FROM l GROUP BY product_id
UNION ALL SELECT 'variant', variant_id, CAST(sum(quantity) AS BIGINT) FROM l WHERE variant_id IS NOT NULL GROUP BY variant_id"""


@oracle("moving_average_cost")
def _():
    m = P.price_method
    return f"""
WITH RECURSIVE rc AS (
  SELECT d.product_id, CAST(d.quantity AS BIGINT) AS q, CAST(d.import_price AS BIGINT) AS np,
    row_number() OVER (PARTITION BY d.product_id ORDER BY i.import_date, d.import_detail_id) AS rn
  FROM import_details d JOIN imports i ON i.import_id = d.import_id WHERE coalesce(i.status, '') NOT IN {CANCELLED}),
p0 AS (SELECT product_id, CAST(coalesce(stock, 0) AS BIGINT) AS s, CAST(coalesce(import_price, 0) AS BIGINT) AS pr FROM products
       WHERE product_id IN (SELECT product_id FROM rc)),
fold(product_id, rn, s, pr, n) AS (
  SELECT product_id, 0, s, pr, 0 FROM p0
  UNION ALL
  SELECT f.product_id, f.rn + 1,
    CASE WHEN coalesce(r.q, 0) <= 0 THEN f.s ELSE f.s + r.q END,
    CASE WHEN coalesce(r.q, 0) <= 0 OR coalesce(r.np, 0) <= 0 THEN f.pr
         WHEN {m} = 2 OR f.s <= 0 THEN r.np
         WHEN f.s * f.pr + r.q * r.np >= 0 THEN (2 * (f.s * f.pr + r.q * r.np) + (f.s + r.q)) // (2 * (f.s + r.q))
         ELSE -((2 * -(f.s * f.pr + r.q * r.np) + (f.s + r.q)) // (2 * (f.s + r.q))) END,
    f.n + CASE WHEN coalesce(r.q, 0) > 0 THEN 1 ELSE 0 END
  FROM fold f JOIN rc r ON r.product_id = f.product_id AND r.rn = f.rn + 1)
SELECT product_id, s AS stock, CAST(pr AS DECIMAL(18,0)) AS import_price, CAST(n AS BIGINT) AS receipts_applied
FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY rn DESC) AS k FROM fold) x WHERE k = 1"""


@oracle("stock_reduce")
def _():
    return """
SELECT r.product_id, CAST(r.req AS BIGINT) AS requested, CAST(p.stock AS BIGINT) AS stock_before,
  CASE WHEN p.stock IS NOT NULL AND p.stock >= r.req THEN 1 ELSE 0 END AS accepted,
  CAST(CASE WHEN p.stock IS NOT NULL AND p.stock >= r.req THEN p.stock - r.req ELSE p.stock END AS BIGINT) AS stock_after
FROM (SELECT product_id, sum(quantity) AS req FROM stock_reduce_requests WHERE coalesce(quantity, 0) > 0 GROUP BY product_id) r
LEFT JOIN products p ON p.product_id = r.product_id"""


@oracle("stock_adjust")
def _():
    return """
SELECT r.product_id, CAST(r.delta AS DECIMAL(38,3)) AS delta, CASE WHEN p.product_id IS NULL THEN 0 ELSE 1 END AS found,
  CAST(CASE WHEN p.product_id IS NOT NULL THEN coalesce(p.stock, 0) + r.delta END AS DECIMAL(38,3)) AS stock_after
FROM (SELECT product_id, sum(coalesce(difference, 0)) AS delta FROM inventory_check_details GROUP BY product_id) r
LEFT JOIN products p ON p.product_id = r.product_id"""


@oracle("order_cancel")
def _():
    return """
WITH j AS (SELECT r.order_id, o.status,
             CASE WHEN o.status IS NULL THEN 'not_found' WHEN o.status = 'Cancelled' THEN 'already_cancelled' ELSE 'cancelled' END AS outcome
           FROM (SELECT DISTINCT order_id FROM order_cancel_requests) r LEFT JOIN sales_orders o ON o.order_id = r.order_id)
SELECT j.order_id, j.outcome, j.status AS old_status,
  CAST(CASE WHEN j.outcome = 'cancelled' AND j.status IN ('Completed', 'Paid', 'Partial')
            THEN coalesce((SELECT sum(coalesce(quantity, 0)) FROM order_items oi WHERE oi.order_id = j.order_id), 0) ELSE 0 END AS BIGINT) AS restored_quantity,
  CAST(CASE WHEN j.outcome = 'cancelled' THEN (SELECT count(*) FROM product_serials ps WHERE ps.order_id = j.order_id) ELSE 0 END AS BIGINT) AS serials_freed
FROM j"""


@oracle("order_delete_eligible")
def _():
    return """
WITH j AS (SELECT r.order_id, o.status,
             CASE WHEN o.status IS NULL THEN 'not_found' WHEN o.status NOT IN ('Pending', 'Cancelled') THEN 'not_allowed' ELSE 'deleted' END AS outcome
           FROM (SELECT DISTINCT order_id FROM order_delete_requests) r LEFT JOIN sales_orders o ON o.order_id = r.order_id)
SELECT j.order_id, j.outcome, j.status,
  CAST(CASE WHEN j.outcome = 'deleted' THEN (SELECT count(*) FROM order_items oi WHERE oi.order_id = j.order_id) ELSE 0 END AS BIGINT) AS lines_deleted,
  CAST(CASE WHEN j.outcome = 'deleted' THEN (SELECT count(*) FROM product_serials ps WHERE ps.order_id = j.order_id) ELSE 0 END AS BIGINT) AS serials_freed
FROM j"""


@oracle("serial_sell")
def _():
    return """
WITH req AS (SELECT request_id, order_id, nullif(trim(serial_number), '') AS sn FROM serial_sell_requests),
cur AS (SELECT serial_number AS sn, max(CASE WHEN status = 0 THEN 1 ELSE 0 END) AS in_stock, max(CASE WHEN status = 1 THEN order_id END) AS sold_to
        FROM product_serials WHERE serial_number IS NOT NULL GROUP BY serial_number),
j AS (SELECT r.*, c.in_stock, coalesce(c.sold_to IS NOT NULL AND c.sold_to = r.order_id, false) AS init_noop
      FROM req r LEFT JOIN cur c ON c.sn = r.sn),
w AS (SELECT sn, min(request_id) AS wr, arg_min(order_id, request_id) AS wo FROM j
      WHERE sn IS NOT NULL AND in_stock = 1 AND NOT init_noop GROUP BY sn)
SELECT j.request_id, j.sn AS serial_number, j.order_id,
  CASE WHEN j.sn IS NULL THEN 'invalid' WHEN j.init_noop THEN 'noop' WHEN w.wr = j.request_id THEN 'sold'
       WHEN w.wr < j.request_id AND w.wo = j.order_id THEN 'noop' ELSE 'rejected' END AS outcome
FROM j LEFT JOIN w ON w.sn = j.sn"""


def _serial_turns(effect: str, asked: str) -> str:
    """CTEs from ``req`` (request_id, serial_id, sn, status): ``refused``, the
    requests that find their number with another serial. Every pass answers all
    requests from the stretches for which the last pass's accepted ones have
    their numbers; passes are repeated until no answer changes. An answer depends
    on earlier requests alone, so the answers that stay are those of calls one by one."""
    return f"""asks AS (SELECT request_id AS t, serial_id AS h, sn AS v, {effect} AS effect FROM req WHERE {asked}),
had AS (SELECT serial_id AS h, serial_number AS v FROM product_serials WHERE serial_number IS NOT NULL),
contested AS (SELECT v, row_number() OVER (ORDER BY v) AS n FROM (
  SELECT v FROM (SELECT h, v FROM asks UNION ALL SELECT h, v FROM had) WHERE v IS NOT NULL GROUP BY v HAVING min(h) <> max(h))),
numbered AS (
  SELECT t, h, n AS v, effect, TRUE AS ask FROM asks LEFT JOIN contested USING (v)
  UNION ALL SELECT -1, h, n, TRUE, FALSE FROM had JOIN contested USING (v)),
turn AS (
  SELECT t, h, v, effect, ask, TRUE AS ok, TRUE AS again FROM numbered WHERE h IN (SELECT h FROM numbered WHERE v IS NOT NULL)
  UNION ALL
  SELECT t, h, v, effect, ask, good, bool_or(good <> ok) OVER () FROM (
    SELECT *, NOT ask OR v IS NULL OR sum(d) OVER (PARTITION BY v ORDER BY t) = sum(d) OVER (PARTITION BY v, h ORDER BY t) AS good FROM (
      SELECT v, h, unnest([t, until, t]) AS t, unnest([1, -1, 0]) AS d, unnest([FALSE, FALSE, TRUE]) AS q, effect, ask, ok FROM (
        SELECT *, lead(t) OVER (PARTITION BY h, effect AND ok ORDER BY t) AS until FROM turn WHERE again) WHERE effect AND ok
      UNION ALL SELECT v, h, t, 0, TRUE, effect, ask, ok FROM turn WHERE again AND NOT (effect AND ok))
    WHERE t IS NOT NULL) WHERE q),
refused AS (SELECT t AS request_id FROM turn WHERE NOT again AND NOT ok)"""


@oracle("serial_update_validate")
def _():
    return f"""
WITH RECURSIVE req AS (SELECT r.request_id, r.serial_id, nullif(trim(r.serial_number), '') AS sn, r.sell_price_override,
               nullif(trim(r.product_color), '') AS pc, nullif(trim(r.note), '') AS nt, ps.status
  FROM serial_update_requests r LEFT JOIN product_serials ps ON ps.serial_id = r.serial_id),
{_serial_turns("coalesce(sell_price_override, 0) >= 0", "status = 0")}
SELECT request_id, serial_id,
  CASE WHEN status IS NULL THEN 'not_found' WHEN status <> 0 THEN 'sold' WHEN request_id IN (SELECT request_id FROM refused) THEN 'duplicate_serial'
       WHEN sell_price_override < 0 THEN 'invalid_price' ELSE 'updated' END AS outcome,
  sn AS serial_number, sell_price_override, pc AS product_color, nt AS note FROM req"""


@oracle("serial_receive")
def _():
    return f"""
WITH r AS (SELECT request_id, product_id, import_id, nullif(trim(serial_number), '') AS sn FROM serial_receive_requests),
j AS (SELECT *, sn IS NOT NULL AND (row_number() OVER (PARTITION BY sn ORDER BY request_id) > 1
        OR sn IN (SELECT serial_number FROM product_serials WHERE serial_number IS NOT NULL)) AS dup FROM r)
SELECT request_id, product_id, import_id, sn AS serial_number, CASE WHEN dup THEN 'duplicate_serial' ELSE 'accepted' END AS outcome,
  CASE WHEN NOT dup THEN 0 END AS status, CASE WHEN NOT dup THEN {_ASOF} END AS created_at FROM j"""


@oracle("cashbook_update")
def _():
    return f"""
WITH r AS (SELECT request_id, entry_id, entry_date, upper(trim(coalesce(entry_type, ''))) AS et, amount, category_id,
             nullif(trim(coalesce(category_name, '')), '') AS gname, coalesce(nullif(trim(payment_method), ''), 'Tiền mặt') AS pm,
             nullif(trim(coalesce(description, '')), '') AS descr, nullif(trim(coalesce(reference_code, '')), '') AS ref FROM cashbook_update_requests),
o AS (SELECT r.*, CASE WHEN et NOT IN ('IN', 'OUT') THEN 'invalid_type' WHEN coalesce(r.amount, 0) <= 0 THEN 'invalid_amount'
                       WHEN e.entry_id IS NULL THEN 'not_found' ELSE 'ok' END AS state, c.category_name AS cname, e.entry_code, e.created_by, e.created_at
      FROM r LEFT JOIN cashbook_categories c ON c.category_id = r.category_id AND c.category_type = r.et AND c.is_active = 1
      LEFT JOIN cashbook_entries e ON e.entry_id = r.entry_id AND e.is_deleted = 0),
p AS (SELECT *, CASE WHEN state <> 'ok' THEN state WHEN request_id = max(request_id) FILTER (state = 'ok') OVER (PARTITION BY entry_id) THEN 'updated' ELSE 'superseded' END AS outcome FROM o)
SELECT request_id, entry_id, outcome, CASE WHEN outcome = 'updated' THEN entry_code END AS entry_code, entry_date, et AS entry_type,
  CASE WHEN outcome = 'updated' AND cname IS NOT NULL THEN category_id END AS category_id,
  CASE WHEN outcome = 'updated' THEN coalesce(cname, gname, CASE WHEN et = 'IN' THEN 'Thu khác' ELSE 'Chi khác' END) END AS category_name,
  amount, pm AS payment_method, descr AS description, ref AS reference_code, CASE WHEN outcome = 'updated' THEN created_by END AS created_by,
  CASE WHEN outcome = 'updated' THEN created_at END AS created_at, CASE WHEN outcome = 'updated' THEN {_ASOF} END AS updated_at FROM p"""


@oracle("order_cancel_stock_delta")
def _():
    return """
SELECT oi.product_id, CAST(sum(coalesce(oi.quantity, 0)) AS BIGINT) AS stock_delta
FROM order_items oi JOIN sales_orders o ON o.order_id = oi.order_id
WHERE o.status IN ('Completed', 'Paid', 'Partial') AND o.order_id IN (SELECT order_id FROM order_cancel_requests) GROUP BY oi.product_id"""


@oracle("moving_average_cost_latest")
def _():
    return f"""
WITH rc AS (SELECT d.product_id, CAST(d.quantity AS BIGINT) AS q, CAST(d.import_price AS BIGINT) AS np, i.import_date AS a, d.import_detail_id AS b
  FROM import_details d JOIN imports i ON i.import_id = d.import_id WHERE coalesce(i.status, '') NOT IN {CANCELLED}),
g AS (SELECT product_id, coalesce(sum(q) FILTER (q > 0), 0) AS q, count(*) FILTER (q > 0) AS n, arg_max(np, (a, b)) FILTER (q > 0 AND np > 0) AS np FROM rc GROUP BY product_id)
SELECT p.product_id, CAST(coalesce(p.stock, 0) + g.q AS BIGINT) AS stock, CAST(coalesce(g.np, p.import_price, 0) AS DECIMAL(18,0)) AS import_price,
  CAST(g.n AS BIGINT) AS receipts_applied FROM g JOIN products p ON p.product_id = g.product_id"""


@oracle("moving_average_cost_rejected")
def _():
    return """
SELECT r.*, 'unknown_product' AS outcome FROM receipt_requests r WHERE NOT EXISTS (SELECT 1 FROM products p WHERE p.product_id = r.product_id)"""


@oracle("cashbook_post")
def _():
    return """
WITH r AS (SELECT request_id, entry_date, upper(trim(coalesce(entry_type, ''))) AS et, amount, category_id,
             nullif(trim(coalesce(category_name, '')), '') AS gname, coalesce(nullif(trim(payment_method), ''), 'Tiền mặt') AS pm,
             nullif(trim(coalesce(description, '')), '') AS descr, nullif(trim(coalesce(reference_code, '')), '') AS ref,
             nullif(trim(coalesce(created_by, '')), '') AS cb FROM cashbook_requests),
o AS (SELECT r.*, CASE WHEN et NOT IN ('IN', 'OUT') THEN 'invalid_type' WHEN coalesce(amount, 0) <= 0 THEN 'invalid_amount' ELSE 'accepted' END AS outcome,
        c.category_name AS cname
      FROM r LEFT JOIN cashbook_categories c ON c.category_id = r.category_id AND c.category_type = r.et AND c.is_active = 1),
a AS (SELECT request_id, (SELECT coalesce(max(entry_id), 0) FROM cashbook_entries) + row_number() OVER (ORDER BY request_id) AS eid
      FROM o WHERE outcome = 'accepted')
SELECT o.request_id, o.outcome, CAST(a.eid AS BIGINT) AS entry_id,
  CASE WHEN o.outcome = 'accepted' THEN 'SQ' || strftime(o.entry_date, '%y%m%d') || right('000000' || CAST(a.eid AS VARCHAR), 6) END AS entry_code,
  o.entry_date, o.et AS entry_type,
  CASE WHEN o.outcome = 'accepted' AND o.cname IS NOT NULL THEN o.category_id END AS category_id,
  CASE WHEN o.outcome = 'accepted' THEN coalesce(o.cname, o.gname, CASE WHEN o.et = 'IN' THEN 'Thu khác' ELSE 'Chi khác' END) END AS category_name,
  o.amount, o.pm AS payment_method, o.descr AS description, o.ref AS reference_code, o.cb AS created_by
FROM o LEFT JOIN a ON a.request_id = o.request_id"""


@oracle("cashbook_soft_delete")
def _():
    return f"""
SELECT q.request_id, q.entry_id,
  CASE WHEN e.entry_id IS NOT NULL AND q.request_id = f.first_req THEN 1 ELSE 0 END AS affected_rows,
  CASE WHEN e.entry_id IS NOT NULL AND q.request_id = f.first_req THEN {_ASOF} END AS updated_at
FROM cashbook_delete_requests q
LEFT JOIN (SELECT entry_id FROM cashbook_entries WHERE is_deleted = 0) e ON e.entry_id = q.entry_id
JOIN (SELECT entry_id, min(request_id) AS first_req FROM cashbook_delete_requests GROUP BY entry_id) f ON f.entry_id = q.entry_id"""


@oracle("order_line_enrich")
def _():
    return """
SELECT q.order_id, q.product_id, q.quantity, q.unit_price,
  CAST(coalesce(nullif(q.original_price, 0), CASE WHEN p.product_id IS NOT NULL THEN coalesce(CAST(p.sell_price AS DECIMAL(18,0)), q.unit_price) END,
                q.unit_price) AS DECIMAL(18,0)) AS original_price,
  CAST(coalesce(nullif(q.cost_price, 0), CASE WHEN p.product_id IS NOT NULL THEN coalesce(p.import_price, 0) END, 0) AS DECIMAL(18,0)) AS cost_price
FROM order_line_requests q LEFT JOIN products p ON p.product_id = q.product_id"""


@oracle("payment_method_default")
def _():
    return "SELECT payment_id, coalesce(nullif(trim(payment_method), ''), 'Tiền mặt') AS payment_method FROM customer_payments"


# ---------------------------------------------------------------- sources and sinks
@oracle("cashbook_category_seed")
def _():
    from ..sources.seeds import NOT_PROFIT, PROFIT, REFUND_CATEGORY, SEED_CATEGORIES

    vals = ",\n  ".join(f"({i}, '{ty}', '{n}', {so}, {ap})" for i, (ty, n, so, ap) in enumerate(SEED_CATEGORIES, start=1))
    q = lambda xs: ", ".join(f"'{x}'" for x in xs)
    ty, name, sort = REFUND_CATEGORY
    refund = f"(category_type = '{ty}' AND category_name = '{name}')"
    return f"""
WITH seed(seed_no, category_type, category_name, sort_order, affects_profit) AS (VALUES
  {vals}),
missing AS (SELECT s.* FROM seed s WHERE NOT EXISTS (SELECT 1 FROM cashbook_categories c
            WHERE c.category_type = s.category_type AND c.category_name = s.category_name)),
added AS (SELECT CAST((SELECT coalesce(max(category_id), 0) FROM cashbook_categories) + row_number() OVER (ORDER BY seed_no) AS INTEGER) AS category_id,
            category_type, category_name, 1 AS is_system, 1 AS is_active, affects_profit, sort_order FROM missing),
existing AS (SELECT category_id, category_type, category_name,
               CASE WHEN {refund} THEN 1 ELSE is_system END AS is_system,
               CASE WHEN {refund} THEN 1 ELSE is_active END AS is_active,
               CASE WHEN {refund} THEN 0 ELSE affects_profit END AS affects_profit,
               CASE WHEN {refund} THEN {sort} ELSE sort_order END AS sort_order FROM cashbook_categories),
allrows AS (SELECT * FROM existing UNION ALL SELECT * FROM added)
SELECT category_id, category_type, category_name, is_system, is_active,
  CAST(CASE WHEN category_name IN ({q(NOT_PROFIT)}) THEN 0 WHEN category_name IN ({q(PROFIT)}) THEN 1 ELSE affects_profit END AS INTEGER) AS affects_profit,
  sort_order
FROM allrows"""


@oracle("typed_scan_period")
def _():
    return f"""
SELECT order_id, order_code, customer_id, order_date, order_type, status, final_amount, paid_amount, employee_id, total_amount,
  cashier_id, discount, vat_amount, payment_method, points_used, points_earned, strftime(order_date, '%Y-%m') AS order_month
FROM sales_orders WHERE order_date BETWEEN {ts(P.from_dt)} AND {ts(P.to_dt)}"""


@oracle("serial_set_number")
def _():
    return f"""
WITH RECURSIVE req AS (SELECT r.request_id, r.serial_id, nullif(trim(r.serial_number), '') AS sn, ps.status
  FROM serial_update_requests r LEFT JOIN product_serials ps ON ps.serial_id = r.serial_id),
{_serial_turns("status = 0", "sn IS NOT NULL AND status IS NOT NULL")}
SELECT request_id, serial_id,
  CASE WHEN sn IS NULL THEN 'missing_serial' WHEN status IS NULL THEN 'not_found'
       WHEN request_id IN (SELECT request_id FROM refused) THEN 'duplicate_serial' WHEN status <> 0 THEN 'sold' ELSE 'updated' END AS outcome,
  sn AS serial_number FROM req"""


_LATER = """later AS (SELECT order_id FROM hits WHERE duplicate_of_date < order_date OR (duplicate_of_date = order_date AND duplicate_of < order_id))"""


@oracle("duplicate_sale_reverse_variants")
def _():
    return f"""
WITH {_DUP_SALES.strip()},
{_LATER},
pv AS (SELECT l.variant_id, sum(CASE WHEN coalesce(l.quantity, 0) < 0 THEN coalesce(l.quantity, 0) - l.g ELSE coalesce(l.quantity, 0) + l.g END) AS q
       FROM lines l JOIN later ON later.order_id = l.order_id WHERE l.variant_id IS NOT NULL GROUP BY l.variant_id)
SELECT v.variant_id, CAST(pv.q AS BIGINT) AS quantity_to_restore, CAST(coalesce(v.stock_base_qty, 0) + pv.q AS DECIMAL(38,3)) AS stock_base_qty
FROM product_variants v JOIN pv ON pv.variant_id = v.variant_id"""


@oracle("duplicate_sale_reverse_points")
def _():
    return f"""
WITH {_DUP_SALES.strip()},
{_LATER},
d AS (SELECT o.customer_id, sum(coalesce(o.points_used, 0) - coalesce(o.points_earned, 0)) AS delta
      FROM duplicate_sale_candidates o JOIN later ON later.order_id = o.order_id GROUP BY o.customer_id)
SELECT c.customer_id, CAST(d.delta AS BIGINT) AS points_delta, CAST(coalesce(c.points, 0) + d.delta AS BIGINT) AS points
FROM customers c JOIN d ON d.customer_id = c.customer_id"""


@oracle("duplicate_sale_reverse_cashbook")
def _():
    return f"""
WITH {_DUP_SALES.strip()},
{_LATER}
SELECT e.entry_id, e.reference_code, 1 AS is_deleted, {_ASOF} AS updated_at
FROM cashbook_entries e
WHERE coalesce(e.is_deleted, 0) = 0
  AND e.reference_code IN (SELECT 'BH:' || o.order_code FROM duplicate_sale_candidates o JOIN later ON later.order_id = o.order_id)"""


@oracle("stock_reduce_sequential")
def _():
    return """
WITH RECURSIVE rq AS (
  SELECT order_id, product_id, quantity, row_number() OVER (PARTITION BY product_id ORDER BY order_id, quantity) AS rn
  FROM stock_reduce_requests WHERE product_id IN (SELECT product_id FROM products)),
p0 AS (SELECT product_id, CAST(coalesce(stock, 0) AS BIGINT) AS s FROM products WHERE product_id IN (SELECT product_id FROM rq)),
f(product_id, rn, s, order_id, quantity, outcome) AS (
  SELECT product_id, 0, s, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM p0
  UNION ALL
  SELECT f.product_id, f.rn + 1,
    CASE WHEN coalesce(r.quantity, 0) > 0 AND f.s >= r.quantity THEN f.s - r.quantity ELSE f.s END,
    r.order_id, CAST(r.quantity AS BIGINT),
    CASE WHEN coalesce(r.quantity, 0) <= 0 THEN 'ignored' WHEN f.s >= r.quantity THEN 'accepted' ELSE 'rejected' END
  FROM f JOIN rq r ON r.product_id = f.product_id AND r.rn = f.rn + 1)
SELECT order_id, product_id, quantity, outcome, s AS stock_after FROM f WHERE rn > 0
UNION ALL
SELECT order_id, product_id, CAST(quantity AS BIGINT), CASE WHEN coalesce(quantity, 0) <= 0 THEN 'ignored' ELSE 'rejected' END, CAST(NULL AS BIGINT)
FROM stock_reduce_requests WHERE product_id NOT IN (SELECT product_id FROM products) OR product_id IS NULL"""


@oracle("import_payment_method_default")
def _():
    return "SELECT import_id, coalesce(nullif(trim(payment_method), ''), 'Tiền mặt') AS payment_method FROM imports"


# ---------------------------------------------------------------- second parameter sets
def _only(key: str, of: str, cond: str) -> None:
    ORACLE[key] = with_fixtures(f"SELECT * FROM ({BODIES[of].strip()}) q WHERE {cond}")


for _key, _cond in {
    "product_by_id": f"product_id = {P.one_product}",
    "import_by_id": f"import_id = {P.one_import}",
    "imports_by_supplier": f"supplier_id = {P.one_supplier}",
    "supplier_by_id": f"supplier_id = {P.one_supplier}",
    "serials_available": f"product_id = {P.one_serial_product}",
    "customer_current_debt": f"customer_id = {P.one_customer}",
    "supplier_debt": f"supplier_id = {P.one_supplier}",
}.items():
    _only(f"{_key}_one", _key, _cond)
_only("imports_list_paid", "imports_list", "status = 'Paid'")
_only("cashbook_search_in", "cashbook_search", "entry_type = 'IN'")

_PERIOD = f" AND entry_date >= {ts(P.cb_from)} AND entry_date < {plus_day(P.cb_to)}"
ORACLE["cashbook_summary_period"] = with_fixtures(BODIES["cashbook_summary"] + _PERIOD)
ORACLE["cashbook_search_undated"] = with_fixtures(BODIES["cashbook_search"].replace(_PERIOD, ""))
ORACLE["customer_top_undated"] = with_fixtures(BODIES["customer_top"].replace(
    f"o.order_date >= {ts(P.from_dt)} AND o.order_date < {plus_day(P.to_dt)} AND ", ""))
