"""Hand fixtures (a few rows each) for the semantic traps and custom operators."""

import datetime as dt
import random

import pytest
from decimal import Decimal
from types import SimpleNamespace

from pyspark.sql import Window
from pyspark.sql import functions as F

from shoptally.functions import semantics as S
from shoptally.functions.ranking import row_number_by_id
from shoptally.operators import debts, movement, posting, quality


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda x: tuple((v is None, v if v is not None else 0) for v in x))


def test_three_cancelled_predicates(spark):
    df = spark.createDataFrame(
        [(None,), ("Cancelled",), ("Canceled",), ("Đã hủy",), ("Hủy",), ("Paid",)], "status string"
    )
    out = df.select(
        "status",
        S.not_cancelled_broad("status").alias("broad"),
        F.coalesce(S.not_cancelled_strict("status"), F.lit(False)).alias("strict"),
        S.not_cancelled_isnull("status").alias("isnull"),
    ).collect()
    got = {r["status"]: (r["broad"], r["strict"], r["isnull"]) for r in out}
    assert got[None] == (True, False, True)
    assert got["Cancelled"] == (False, False, False)
    assert got["Canceled"] == (False, True, True)
    assert got["Đã hủy"] == (False, True, True)
    assert got["Paid"] == (True, True, True)


def test_cost_and_quantity_fallbacks(spark):
    df = spark.createDataFrame(
        [(None, Decimal(5), None, 3), (Decimal(0), Decimal(5), Decimal("2.000"), 3), (Decimal(7), Decimal(5), None, -4),
         (Decimal(0), None, None, 1)],
        "cost decimal(18,0), imp decimal(18,0), bq decimal(18,3), q int",
    )
    out = df.select(S.cost_expr("cost", "imp").alias("c"), S.base_qty("bq", "q").alias("b")).collect()
    assert [r["c"] for r in out] == [5, 5, 7, 0]
    assert [r["b"] for r in out] == [Decimal("3.000"), Decimal("2.000"), Decimal("-4.000"), Decimal("1.000")]


def test_code6_keeps_last_six_digits(spark):
    df = spark.createDataFrame([(5,), (1234567,)], "id long")
    assert [r[0] for r in df.select(S.code6("KH", "id")).collect()] == ["KH000005", "KH234567"]


def test_keyword_wildcards_and_case(spark):
    df = spark.createDataFrame([("Áo 50% off",), ("a_b",), ("axb",), ("back\\slash",), (None,)], "name string")

    def hits(kw):
        return sorted(r[0] for r in df.where(S.keyword_match(kw, "name")).collect() if r[0] is not None)

    assert hits("") == ["a_b", "axb", "back\\slash", "Áo 50% off"]
    assert hits("a_b") == ["a_b", "axb"]  # '_' is a wildcard
    assert hits("ÁO") == ["Áo 50% off"]  # case-insensitive
    assert hits("k\\s") == ["back\\slash"]  # backslash is a plain character
    assert hits("  axb ") == ["axb"]  # trimmed


def test_customer_debt_formulas_disagree_on_purpose(spark):
    o = spark.createDataFrame(
        [
            (1, 1, "SALE", "Completed", Decimal(100), Decimal(40)),
            (2, 1, "RETURN", "Completed", Decimal(30), Decimal(0)),
            (3, 1, "SALE", "Đã hủy", Decimal(50), Decimal(0)),
            (4, 1, None, None, Decimal(20), None),
            (5, 1, "SALE", "Cancelled", Decimal(999), Decimal(0)),
        ],
        "order_id long, customer_id long, order_type string, status string, final_amount decimal(18,0), paid_amount decimal(18,0)",
    )
    pay = spark.createDataFrame([(1, Decimal(10))], "customer_id long, amount decimal(18,0)")
    adj = spark.createDataFrame([(1, Decimal(5))], "customer_id long, amount decimal(18,0)")
    cust = spark.createDataFrame([(1, "A"), (2, "B")], "customer_id long, name string")
    t = SimpleNamespace(sales_orders=o, customer_payments=pay, customer_debt_adjustments=adj, customers=cust)
    d1 = dict(rows(debts.customer_current_debt(t), "customer_id", "current_debt"))
    # 60 + 30 (return counted) + 50 (other spelling) + 20 (NULL live) - 10 - 5
    assert d1 == {1: 145, 2: 0}
    d3 = dict(rows(debts.customer_debt_top_variant(t), "customer_id", "current_debt"))
    # D3: broad cancelled set, no returns: 60 + 20 - 10
    assert d3 == {1: 70, 2: 0}
    d4 = debts.customer_debt_total(t).collect()[0][0]
    assert d4 == 60  # only Completed/Partial, open, non-return; payments ignored
    d5 = dict(rows(debts.customer_debt_profit_variant(t), "customer_id", "current_debt"))
    assert d5 == {1: 50, 2: 0}


def test_supplier_debt_clamps_per_import_then_per_supplier(spark):
    imp = spark.createDataFrame(
        [(1, 7, "Completed", Decimal(100), Decimal(200)), (2, 7, "Paid", Decimal(300), Decimal(0)),
         (3, 7, "Cancelled", Decimal(500), Decimal(0)), (4, 8, "Completed", Decimal(10), Decimal(0))],
        "import_id long, supplier_id long, status string, final_amount decimal(18,0), paid_amount decimal(18,0)",
    )
    ret = spark.createDataFrame(
        [(2, "Completed", Decimal(20)), (2, "Canceled", Decimal(99))],
        "import_id long, status string, total_amount decimal(18,0)",
    )
    pay = spark.createDataFrame([(7, Decimal(50)), (8, Decimal(100))], "supplier_id long, amount decimal(18,0)")
    sup = spark.createDataFrame([(7,), (8,), (9,)], "supplier_id long")
    t = SimpleNamespace(imports=imp, purchase_returns=ret, supplier_payments=pay, suppliers=sup)
    got = dict(rows(debts.supplier_debt(t), "supplier_id", "current_debt"))
    # import 1 is overpaid (-100) and clamps to 0; import 2: 300 - 20 = 280; minus 50 paid
    assert got == {7: 230, 8: 0, 9: 0}
    assert debts.supplier_debt_total(t).collect()[0][0] == 230


def _movement_tables(spark):
    ts = dt.datetime
    products = spark.createDataFrame(
        [(1, "SP1", None, "A", 0, 0, 10, Decimal(100), 1), (2, "SP2", "B2", "B", 0, 0, 5, None, None)],
        "product_id long, product_code string, barcode string, product_name string, category_id int, unit_id int, "
        "stock int, import_price decimal(18,0), is_active int",
    )
    imports = spark.createDataFrame([(10, "Completed", ts(2024, 3, 5))], "import_id long, status string, import_date timestamp_ntz")
    details = spark.createDataFrame(
        [(10, 1, 5, None, Decimal(500), Decimal(100))],
        "import_id long, product_id long, quantity int, base_quantity decimal(18,3), total decimal(18,0), import_price decimal(18,0)",
    )
    orders = spark.createDataFrame(
        [(20, "Paid", "SALE", ts(2024, 2, 10, 15)), (21, "Completed", "RETURN", ts(2024, 2, 11)),
         (22, None, "SALE", ts(2024, 2, 12))],
        "order_id long, status string, order_type string, order_date timestamp_ntz",
    )
    items = spark.createDataFrame(
        [(20, 1, 3, None, Decimal(10)), (21, 1, -1, Decimal("-1.000"), Decimal(10)), (22, 1, 4, None, Decimal(10))],
        "order_id long, product_id long, quantity int, base_quantity decimal(18,3), unit_price decimal(18,0)",
    )
    empty_ret = spark.createDataFrame([], "return_id long, status string, return_date timestamp_ntz")
    empty_retd = spark.createDataFrame(
        [], "return_id long, product_id long, quantity int, total decimal(18,0), import_price decimal(18,0)"
    )
    checks = spark.createDataFrame([(1, ts(2024, 2, 20))], "check_id int, check_date timestamp_ntz")
    counted = spark.createDataFrame([(1, 2, Decimal("-2.000"))], "check_id int, product_id long, difference decimal(18,3)")
    cats = spark.createDataFrame([(0, "Loai 0")], "category_id int, category_name string")
    units = spark.createDataFrame([(0, "DVT 0")], "unit_id int, unit_name string")
    return SimpleNamespace(
        products=products, imports=imports, import_details=details, sales_orders=orders, order_items=items,
        purchase_returns=empty_ret, purchase_return_details=empty_retd, inventory_checks=checks, inventory_check_details=counted, categories=cats, units=units,
    )


def test_inventory_movement_back_casts_balances(spark):
    t = _movement_tables(spark)
    r = {x["product_id"]: x for x in movement.inventory_movement(t, "2024-02-01", "2024-02-29").collect()}
    p1 = r[1]
    # stock 10; +5 purchased after the period; in the period -3 sold, +1 returned
    assert p1["closing_stock"] == Decimal("5.000")
    assert p1["opening_stock"] == Decimal("7.000")
    assert p1["sales_out_qty"] == Decimal("3.000") and p1["return_in_qty"] == Decimal("1.000")
    assert p1["opening_stock"] + p1["purchase_in_qty"] + p1["return_in_qty"] - p1["supplier_return_out_qty"] \
        + p1["stocktake_adjust_qty"] - p1["sales_out_qty"] == p1["closing_stock"]
    assert p1["closing_cost_value"] == 500
    p2 = r[2]
    assert p2["opening_stock"] == Decimal("7.000") and p2["closing_stock"] == Decimal("5.000")


def test_row_number_by_id_matches_window(spark):
    rnd = random.Random(7)
    data = [(rnd.choice(["a", "b", None, "hot", "hot", "hot"]), i * 3 + rnd.randint(0, 2)) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, id long").dropDuplicates(["g", "id"])
    mine = row_number_by_id(df, ["g"], "id", block=64)
    ref = df.withColumn("row_no", F.row_number().over(Window.partitionBy("g").orderBy("id")))
    assert rows(mine, "g", "id", "row_no") == rows(ref, "g", "id", "row_no")
    allrank = row_number_by_id(df, [], "id", block=100)
    ids = sorted(r["id"] for r in df.collect())
    assert rows(allrank, "id", "row_no") == [(i, n + 1) for n, i in enumerate(ids)]


def test_numbering_of_far_apart_ids(spark):
    """The one-task summary of a whole frame has a row per partition, however sparse the ids."""
    ids = [i * 10**9 - 5 * 10**9 for i in range(300)]
    df = row_number_by_id(spark.createDataFrame([(i, str(i)) for i in ids], "id long, x string").repartition(7, "x"), [], "id")
    assert rows(df, "id", "row_no", "x") == [(i, n + 1, str(i)) for n, i in enumerate(ids)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window [" in plan and "_part_rows" in plan and "_blk" not in plan
    ties = row_number_by_id(spark.createDataFrame([(3,), (3,), (None,), (1,)], "id long"), [], "id")
    assert rows(ties, "row_no") == [(1,), (2,), (3,), (4,)] and row_number_by_id(ties.select("id").limit(0), [], "id").count() == 0


def _brute_duplicates(orders, lines, window=30):
    """Earliest other order with equal header, equal line multiset, within window seconds."""
    from collections import Counter

    ms = {}
    for o, *k in lines:
        ms.setdefault(o, Counter())[tuple(k)] += 1
    out = {}
    for x in orders:
        cands = [
            y for y in orders
            if y[0] != x[0] and y[1] == x[1] and y[2] == x[2]
            and abs((y[3].replace(microsecond=0) - x[3].replace(microsecond=0)).total_seconds()) <= window
            and ms.get(y[0], Counter()) == ms.get(x[0], Counter())
        ]
        if cands:
            out[x[0]] = min(cands, key=lambda y: (y[3], y[0]))[0]
    return out


def test_duplicate_sale_detect_against_brute_force(spark):
    rnd = random.Random(11)
    base = dt.datetime(2024, 1, 1, 9, 59, 30)  # straddles a 10-minute bucket edge
    orders, lines = [], []
    for i in range(1, 260):
        cust = rnd.choice([1, 2, None])
        amt = Decimal(rnd.choice([100, 200]))
        when = base + dt.timedelta(seconds=rnd.randint(0, 200), microseconds=rnd.randint(0, 999999))
        orders.append((i, cust, amt, when))
        for _ in range(rnd.choice([0, 1, 1, 2])):
            lines.append((i, rnd.choice([7, 8]), rnd.choice([1, 2]), Decimal(10)))
    o = spark.createDataFrame(
        [(i, c, a, w, "SALE") for i, c, a, w in orders],
        "order_id long, customer_id long, final_amount decimal(18,0), order_date timestamp_ntz, order_type string",
    )
    with pytest.raises(ValueError):  # a missing header field is no match for everything
        quality.duplicate_sale_detect(o, None, None, wallet_orders=None)
    o = o.withColumns({c: F.lit(None) for c, _ in quality.HEADER_KEYS if c not in o.columns})
    ln = spark.createDataFrame(lines, "order_id long, product_id long, quantity int, unit_price decimal(18,0)").select(
        "*", F.lit(None).cast("int").alias("gift_quantity"), F.lit(None).cast("bigint").alias("product_variant_id"),
        F.lit(None).cast("string").alias("serial_number"),
    )
    serials = spark.createDataFrame([], "order_id long")
    got = dict(rows(quality.duplicate_sale_detect(o, ln, serials, wallet_orders=None), "order_id", "duplicate_of"))
    assert got == _brute_duplicates(orders, lines)
    assert got  # the fixture does contain duplicates


def _python_moving_average(stock, price, receipts, method=1):
    for q, p in receipts:
        if q <= 0:
            continue
        if p <= 0:
            stock += q
            continue
        if method == 2 or stock <= 0:
            price = p
        else:
            num, den = Decimal(stock * price + q * p), Decimal(stock + q)
            price = int((num / den).quantize(Decimal(1), rounding="ROUND_HALF_UP"))
        stock += q
    return stock, price


def test_moving_average_cost_matches_sequential_fold(spark):
    rnd = random.Random(3)
    prods = [(pid, rnd.randint(-5, 20), rnd.randint(0, 300)) for pid in range(1, 30)]
    receipts = []
    for pid, _, _ in prods:
        for k in range(rnd.randint(0, 12)):
            receipts.append((pid, rnd.choice([0, 1, 2, 5, 10]), rnd.choice([0, 99, 150, 201, 333]), k))
    t = SimpleNamespace(products=spark.createDataFrame(
        [(p, s, Decimal(pr)) for p, s, pr in prods], "product_id long, stock int, import_price decimal(18,0)"))
    r = spark.createDataFrame(receipts, "product_id long, quantity int, new_price int, seq1 int").withColumn("seq2", F.lit(0))
    for method in (1, 2):
        got = {x["product_id"]: (x["stock"], int(x["import_price"])) for x in posting.moving_average_cost(t, r, method).collect()}
        for pid, s, pr in prods:
            rs = [(q, p) for p2, q, p, _ in sorted(receipts, key=lambda x: (x[0], x[3])) if p2 == pid]
            if rs:
                assert got[pid] == _python_moving_average(s, pr, rs, method), (pid, method)


def test_xml_items_bad_empty_and_typed(spark):
    req = spark.createDataFrame(
        [(1, '<Details><Item ImportDetailId="5" ProductId="2" VariantId="" Quantity="3" ImportPrice="10" Reason="x"/></Details>'),
         (2, "<Details><Item"), (3, "<Details></Details>"),
         (4, '<Details><Item ImportDetailId="5" ProductId="2" VariantId="abc" Quantity="x" ImportPrice="10"/></Details>')],
        "request_id long, details_xml string",
    )
    got = {r["request_id"]: r for r in posting.parse_return_items(req).collect()}
    assert got[1]["item_present"] and not got[1]["bad_xml"] and got[1]["variant_id"] is None and got[1]["quantity"] == 3
    assert got[2]["bad_xml"] and not got[2]["item_present"]
    assert not got[3]["bad_xml"] and not got[3]["item_present"]
    assert got[4]["bad_xml"] and got[4]["variant_id"] is None


def test_cashbook_entry_code(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 8, 9, 23, 59), 1234567)], "d timestamp_ntz, id long")
    assert df.select(quality.entry_code("d", "id")).collect()[0][0] == "SQ260809234567"


def test_stock_reduce_sequential_replays_calls(spark):
    rnd = random.Random(5)
    stock = {1: 10, 2: 0, 3: None}
    reqs = [(rnd.randint(1, 50), rnd.choice([1, 2, 3, 4]), rnd.choice([-1, 0, 1, 3, 5, 8])) for _ in range(120)]
    t = SimpleNamespace(products=spark.createDataFrame(list(stock.items()), "product_id long, stock int"))
    r = spark.createDataFrame(reqs, "order_id long, product_id long, quantity int")
    got = sorted((x["order_id"], x["product_id"], x["quantity"], x["outcome"], x["stock_after"])
                 for x in posting.stock_reduce_sequential(t, r).collect())
    want = []
    left = {k: (v or 0) for k, v in stock.items()}
    for o, p, q in sorted(reqs, key=lambda x: (x[1], x[0], x[2])):
        if q <= 0:
            outcome = "ignored"
        elif p in left and left[p] >= q:
            left[p] -= q
            outcome = "accepted"
        else:
            outcome = "rejected"
        want.append((o, p, q, outcome, left.get(p)))
    assert got == sorted(want)


@pytest.mark.parametrize("fold_rows", [0, 10, 10**6])
def test_stock_reduce_by_rounds(spark, fold_rows):
    """One hot product: running sums, further rounds and the fold give the same answers."""
    rnd = random.Random(7)
    reqs = [(rnd.randint(1, 10**6), 1, rnd.choice([0, 1, 2, 5, 40, 90])) for _ in range(300)] + [(k, 2, 1) for k in range(5)]
    t = SimpleNamespace(products=spark.createDataFrame([(1, 400), (2, 100)], "product_id long, stock int"))
    r = spark.createDataFrame(reqs, "order_id long, product_id long, quantity int")
    left, want = {1: 400, 2: 100}, []
    for o, p, q in sorted(reqs, key=lambda x: (x[1], x[0], x[2])):
        ok = 0 < q <= left[p]
        left[p] -= q * ok
        want.append((o, p, q, "ignored" if q <= 0 else "accepted" if ok else "rejected", left[p]))
    assert sorted(tuple(x) for x in posting.stock_reduce_sequential(t, r, fold_rows).collect()) == sorted(want)


def test_moving_average_folds_after_the_last_reset_only(spark, monkeypatch):
    """Receipts up to the last one that finds no stock don't reach the fold."""
    receipts = [(1, 1, 100 + k, k) for k in range(50)] + [(2, 5, 70, k) for k in range(3)]
    t = SimpleNamespace(products=spark.createDataFrame([(1, -40, Decimal(9)), (2, 4, Decimal(10))], "product_id long, stock int, import_price decimal(18,0)"))
    r = spark.createDataFrame(receipts, "product_id long, quantity int, new_price int, seq1 int").withColumn("seq2", F.lit(0))
    seen = []
    write = posting.materialize
    monkeypatch.setattr(posting, "materialize", lambda df, name: seen.append(write(df, name)) or seen[-1])
    got = {x["product_id"]: (x["stock"], int(x["import_price"])) for x in posting.moving_average_cost(t, r).collect()}
    assert got == {1: _python_moving_average(-40, 9, [(q, p) for i, q, p, _ in receipts if i == 1]),
                   2: _python_moving_average(4, 10, [(5, 70)] * 3)}
    assert {x["stock_before"] for x in seen[0].where("product_id = 1").collect()} == set(range(-40, 10))
