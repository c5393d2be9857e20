"""Reconciliation, repair and data-quality operators (Q1-Q25).

The source runs these as set-based UPDATE/INSERT/DELETE scripts. Here each
one returns the rows it *would* change, with their new values (or the rows
it reports); nothing is overwritten, the caller writes the result where it
belongs. "Now" is an explicit ``as_of`` parameter.

Scale notes: checks over duplicate keys aggregate first (``groupBy`` +
``having``) and join the small result back; ranking inside a repeated code
uses ``functions.ranking.row_number_by_id`` so a code shared by a third of
all rows is still spread over many tasks; the duplicate-sale search never
pairs orders - it compares each order with the earliest neighbour in a
30-second range window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..functions.ranking import row_number_by_id

# ---- fixed values that must equal the source system's ---------------------
PAYROLL_PREFIX = "PAYROLL:"
ADVANCE_CATEGORY = "Tạm ứng lương nhân viên"      # salary advance
SETTLEMENT_CATEGORY = "Chi lương nhân viên"      # salary payment
ADVANCE_DESCRIPTION = "Tạm ứng lương: "
SETTLEMENT_DESCRIPTION = "Thanh toán lương: "
EMPLOYEE_FALLBACK = "nhân viên"
PAYROLL_ADJUSTMENTS = ("ALLOWANCE", "BONUS", "DEDUCTION")
PAYROLL_PAYMENTS = ("ADVANCE", "SETTLEMENT")
SETTLEMENT_TYPES = ("DEBT_OFFSET", "REFUND")
# Bank name aliases (upper-cased, trimmed) -> bank code, fill blanks only.
BANK_CODES = {
    "ICB": ("ICB", "VTB", "VIETINBANK"),
    "VCB": ("VCB", "VIETCOMBANK"),
    "BIDV": ("BIDV",),
    "VBA": ("VBA", "AGRIBANK"),
    "MB": ("MB", "MBBANK"),
    "TCB": ("TCB", "TECHCOMBANK"),
    "ACB": ("ACB",),
    "VPB": ("VPB", "VPBANK"),
    "TPB": ("TPB", "TPBANK"),
    "STB": ("STB", "SACOMBANK"),
    "HDB": ("HDB", "HDBANK"),
    "OCB": ("OCB",),
    "VIB": ("VIB",),
    "SHB": ("SHB",),
    "EIB": ("EIB", "EXIMBANK"),
    "MSB": ("MSB",),
    "BAB": ("BAB", "BACABANK"),
    "ABB": ("ABB", "ABBANK"),
    "VAB": ("VAB", "VIETABANK"),
    "NAB": ("NAB", "NAMABANK"),
    "PGB": ("PGB", "PGBANK"),
    "SEAB": ("SEAB", "SEABANK"),
    "LPB": ("LPB", "LPBANK", "LIENVIETPOSTBANK"),
}
# ---------------------------------------------------------------------------


_z = S.nz


def _keys(df: DataFrame, key: str) -> DataFrame:
    """Distinct non-NULL keys of a fact table, for the right side of a semi/anti join.

    Spark's skew handling cannot split the right side of a semi or anti
    join; de-duplicating first (a partial aggregate per task) means one
    customer with a third of all orders sends one row, not a third of the
    table, to one reducer.
    """
    return df.where(F.col(key).isNotNull()).select(key).distinct()


def payroll_ref(payment_id) -> F.Column:
    return F.concat(F.lit(PAYROLL_PREFIX), S.col(payment_id).cast("string"))


def entry_code(entry_date, entry_id) -> F.Column:
    """``'SQ' + yyMMdd + last six digits of the id`` (cashbook entry code)."""
    return F.concat(F.lit("SQ"), F.date_format(S.col(entry_date), "yyMMdd"), S.code6("", entry_id))


# ---------------------------------------------------------------- payroll sync


def payroll_cashbook_missing(t) -> DataFrame:
    """Q1: live payroll payments without a live cashbook entry ``PAYROLL:<id>`` -> new OUT entries."""
    cats = t.cashbook_categories.where(
        (F.col("category_type") == S.CASH_OUT) & F.col("category_name").isin(ADVANCE_CATEGORY, SETTLEMENT_CATEGORY)
    )
    adv_id = cats.where(F.col("category_name") == ADVANCE_CATEGORY).agg(F.min("category_id")).scalar()
    set_id = cats.where(F.col("category_name") == SETTLEMENT_CATEGORY).agg(F.min("category_id")).scalar()
    # distinct non-NULL keys: the anti join's right side never holds a hot key
    live_refs = (
        t.cashbook_entries.where((F.col("is_deleted") == 0) & F.col("reference_code").isNotNull())
        .select("reference_code").distinct()
    )
    pp = t.employee_payroll_payments.where(
        (F.col("is_void") == 0) & (F.col("amount") > 0) & F.col("payment_type").isin("ADVANCE", "SETTLEMENT")
    ).withColumn("reference_code", payroll_ref("payment_id"))
    missing = pp.join(live_refs, "reference_code", "left_anti").join(
        t.employee_payrolls.select("payroll_id", "employee_name"), "payroll_id"
    )
    adv = F.col("payment_type") == "ADVANCE"
    return missing.select(
        "payment_id",
        F.col("payment_date").alias("entry_date"),
        F.lit(S.CASH_OUT).alias("entry_type"),
        F.when(adv, adv_id).otherwise(set_id).cast("int").alias("category_id"),
        F.when(adv, F.lit(ADVANCE_CATEGORY)).otherwise(F.lit(SETTLEMENT_CATEGORY)).alias("category_name"),
        "amount",
        S.default_if_blank("payment_method", S.DEFAULT_PAYMENT_METHOD).alias("payment_method"),
        F.concat(
            F.when(adv, F.lit(ADVANCE_DESCRIPTION)).otherwise(F.lit(SETTLEMENT_DESCRIPTION)),
            S.default_if_blank("employee_name", EMPLOYEE_FALLBACK),
        ).alias("description"),
        "reference_code",
        S.blank_to_null("created_by").alias("created_by"),
    )


def payroll_cashbook_void(t, as_of) -> DataFrame:
    """Q2: live cashbook entries whose source payroll payment is void -> deleted."""
    void = t.employee_payroll_payments.where(F.col("is_void") == 1).select(
        "payment_id", payroll_ref("payment_id").alias("reference_code")
    )
    return (
        t.cashbook_entries.where(F.col("is_deleted") == 0)
        .join(void, "reference_code")
        .select("entry_id", "reference_code", "payment_id", F.lit(1).alias("is_deleted"),
                S.ts(as_of).alias("updated_at"))
    )


def cashbook_code_backfill(t, as_of) -> DataFrame:
    """Q3: live PAYROLL entries with a blank code get ``SQ<yyMMdd><id6>``."""
    e = t.cashbook_entries.where(
        (F.col("is_deleted") == 0)
        & F.coalesce(F.ilike("reference_code", F.lit("PAYROLL:%"), F.lit("\u0001")), F.lit(False))
        & S.is_blank("entry_code")
    )
    return e.select("entry_id", "entry_date", entry_code("entry_date", "entry_id").alias("entry_code"),
                    S.ts(as_of).alias("updated_at"))


# ---------------------------------------------------------------- allocations


def allocation_wrong_customer(t) -> DataFrame:
    """Q4: allocations whose order belongs to another customer than the adjustment."""
    a = t.customer_debt_adjustments.select("adjustment_id", F.col("customer_id").alias("adjustment_customer_id"))
    o = t.sales_orders.select("order_id", F.col("customer_id").alias("order_customer_id"))
    return (
        t.customer_debt_discount_allocations.join(a, "adjustment_id").join(o, "order_id")
        .where(F.col("adjustment_customer_id") != F.col("order_customer_id"))
        .select("adjustment_id", "order_id", "amount", "adjustment_customer_id", "order_customer_id")
    )


def allocation_over_amount(t) -> DataFrame:
    """Q5: adjustments whose allocations sum to more than the adjustment amount."""
    alloc = t.customer_debt_discount_allocations.groupBy("adjustment_id").agg(
        F.sum(_z("amount")).alias("allocated")
    )
    return (
        t.customer_debt_adjustments.join(alloc, "adjustment_id", "left")
        .where(F.col("allocated") > F.col("amount"))
        .select("adjustment_id", F.col("amount").alias("adjustment_amount"),
                F.col("allocated").cast(S.SUM_MONEY).alias("allocated_amount"))
    )


# ---------------------------------------------------------------- blanks and codes


def normalise_blanks(df: DataFrame, key: str, column: str) -> DataFrame:
    """Q6 shape: ``SET c = NULLIF(TRIM(c), '') WHERE c IS NOT NULL``."""
    return df.where(F.col(column).isNotNull()).select(key, S.blank_to_null(column).alias(column))


def barcode_normalise(t) -> DataFrame:
    """Q6: trimmed barcodes, blank -> NULL."""
    return normalise_blanks(t.products, "product_id", "barcode")


def blank_to_null_serial(t) -> DataFrame:
    """Q22: ``SET serial_number = NULL WHERE TRIM(ISNULL(serial_number, '')) = ''``.

    Unlike the barcode repair, other serials are left as they are (not trimmed).
    """
    return t.product_serials.where(S.is_blank("serial_number")).select(
        "serial_id", F.lit(None).cast("string").alias("serial_number")
    )


def barcode_duplicates(t) -> DataFrame:
    """Q7: non-blank barcodes held by more than one product."""
    return (
        t.products.where(F.col("barcode").isNotNull() & (F.trim("barcode") != ""))
        .groupBy("barcode")
        .agg(F.count(F.lit(1)).alias("product_count"))
        .where(F.col("product_count") > 1)
        .orderBy("barcode")
    )


def barcode_duplicate_products(t) -> DataFrame:
    """Q8: the products behind Q7's barcodes."""
    d = barcode_duplicates(t).select("barcode")
    return (
        t.products.join(d, "barcode")
        .select("product_id", "product_code", "barcode", "product_name")
        .orderBy("barcode", "product_id")
    )


def duplicate_document_codes(t) -> DataFrame:
    """Q9: order and import codes used more than once (NULL codes ignored)."""

    def dup(df, code, kind):
        return (
            df.where(F.col(code).isNotNull())
            .groupBy(F.col(code).alias("code"))
            .agg(F.count(F.lit(1)).alias("duplicate_count"))
            .where(F.col("duplicate_count") > 1)
            .select(F.lit(kind).alias("document_type"), "code", "duplicate_count")
        )

    return dup(t.sales_orders, "order_code", "order").unionByName(dup(t.imports, "import_code", "import"))


def customer_code_backfill(t) -> DataFrame:
    """Q10: blank customer codes -> ``KH`` + last six digits of the id."""
    return t.customers.where(S.is_blank("customer_code")).select(
        "customer_id", S.code6("KH", "customer_id").alias("customer_code")
    )


def customer_code_dedupe(t) -> DataFrame:
    """Q11: second and later holders of a (trimmed) code get ``KH<id6>-<n>``.

    Runs on the codes *after* the blank backfill (Q10), as the source script
    does: a generated code can collide with an existing one.
    """
    code = F.coalesce(S.blank_to_null("customer_code"), S.code6("KH", "customer_id"))
    c = t.customers.select("customer_id", code.alias("customer_code")).withColumn("_code", F.trim("customer_code"))
    ranked = row_number_by_id(c, ["_code"], "customer_id")
    return ranked.where(F.col("row_no") > 1).select(
        "customer_id",
        F.col("customer_code").alias("old_customer_code"),
        F.concat(S.code6("KH", "customer_id"), F.lit("-"), F.col("row_no").cast("string")).alias("customer_code"),
        "row_no",
    )


def return_code_dedupe(t) -> DataFrame:
    """Q12: repeated return codes: later ones become ``LEFT(code, 30-len(id)-1) + '-' + id``."""
    ranked = row_number_by_id(t.purchase_returns.select("return_id", "return_code"), ["return_code"], "return_id")
    rid = F.col("return_id").cast("string")
    keep = F.lit(30) - F.length(rid) - F.lit(1)
    return ranked.where(F.col("row_no") > 1).select(
        "return_id",
        F.col("return_code").alias("old_return_code"),
        F.concat(F.expr("substring(return_code, 1, 30 - length(cast(return_id as string)) - 1)"), F.lit("-"), rid)
        .alias("return_code"),
    )


def bank_code_standardise(t) -> DataFrame:
    """Q13: suppliers with a blank bank code get the code of their bank name (when known)."""
    pairs = [x for code, names in BANK_CODES.items() for n in names for x in (F.lit(n), F.lit(code))]
    bank_map = F.create_map(*pairs)
    key = F.upper(F.trim(F.coalesce(F.col("bank_name"), F.lit(""))))
    return t.suppliers.where(S.is_blank("bank_code")).select(
        "supplier_id", "bank_name", F.col("bank_code").alias("old_bank_code"),
        F.coalesce(F.try_element_at(bank_map, key), F.col("bank_code")).alias("bank_code"),
    )


# ---------------------------------------------------------------- quantities and costs


def quantity_backfill(t) -> DataFrame:
    """Q14 (sales lines): input quantity, base quantity (gifts with the line's sign), factor 1."""
    oi = t.order_items.where(
        F.col("input_quantity").isNull() | F.col("base_quantity").isNull() | F.col("unit_conversion_to_base").isNull()
    )
    q, g = _z("quantity"), _z("gift_quantity")
    return oi.select(
        "order_id", "product_id", "quantity", "gift_quantity",
        F.coalesce(F.col("input_quantity"), F.col("quantity").cast(S.QTY)).alias("input_quantity"),
        F.coalesce(F.col("base_quantity"), F.when(q < 0, q - g).otherwise(q + g)).cast(S.QTY).alias("base_quantity"),
        F.coalesce(F.col("unit_conversion_to_base"), F.lit(1).cast("decimal(18,6)")).alias("unit_conversion_to_base"),
    )


def import_quantity_backfill(t) -> DataFrame:
    """Q14 (import lines): input and base quantity from quantity, factor 1."""
    d = t.import_details.where(
        F.col("input_quantity").isNull() | F.col("base_quantity").isNull() | F.col("unit_conversion_to_base").isNull()
    )
    return d.select(
        "import_detail_id", "quantity",
        F.coalesce(F.col("input_quantity"), F.col("quantity").cast(S.QTY)).alias("input_quantity"),
        F.coalesce(F.col("base_quantity"), F.col("quantity").cast(S.QTY)).alias("base_quantity"),
        F.coalesce(F.col("unit_conversion_to_base"), F.lit(1).cast("decimal(18,6)")).alias("unit_conversion_to_base"),
    )


def cost_price_backfill(t) -> DataFrame:
    """Q15: sales lines with cost 0/NULL take the product's import price when it is > 0."""
    p = t.products.select("product_id", "import_price")
    return (
        t.order_items.join(p, "product_id")
        .where((_z("cost_price") == 0) & (_z("import_price") > 0))
        .select("order_id", "product_id", "quantity", F.col("cost_price").alias("old_cost_price"),
                _z("import_price").cast(S.MONEY).alias("cost_price"))
    )


def variant_return_backfill(t) -> DataFrame:
    """Return lines without a variant take the variant of their import line."""
    d = t.import_details.where(F.col("variant_id").isNotNull()).select(
        "import_detail_id", F.col("variant_id").alias("import_variant_id")
    )
    return (
        t.purchase_return_details.where(F.col("variant_id").isNull())
        .join(d, "import_detail_id")
        .select("return_detail_id", "import_detail_id", F.col("import_variant_id").alias("variant_id"))
    )


def variant_return_stock_delta(t) -> DataFrame:
    """Per variant, Σ quantity on live returns (after Q16a) subtracted from variant stock."""
    fixed = variant_return_backfill(t).select("return_detail_id", F.col("variant_id").alias("_v"))
    lines = (
        t.purchase_return_details.join(fixed, "return_detail_id", "left")
        .withColumn("variant_id", F.coalesce(F.col("variant_id"), F.col("_v")))
        .where(F.col("variant_id").isNotNull())
    )
    live = t.purchase_returns.where(S.not_cancelled_broad("status")).select("return_id")
    qty = lines.join(live, "return_id").groupBy("variant_id").agg(
        F.sum(F.col("quantity").cast(S.QTY)).alias("return_qty")
    )
    return t.product_variants.select("variant_id", "stock_base_qty").join(qty, "variant_id").select(
        "variant_id",
        F.col("return_qty").cast(S.SUM_QTY).alias("return_qty"),
        (_z("stock_base_qty") - F.col("return_qty")).cast(S.SUM_QTY).alias("stock_base_qty"),
    )


# ---------------------------------------------------------------- duplicate sales


def _epoch_seconds(c) -> F.Column:
    """Whole seconds since 1970 for a naive timestamp, independent of the session zone."""
    c = S.col(c)
    return (
        F.unix_date(F.to_date(c)).cast("bigint") * 86400
        + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c).cast("int")
    ).cast("bigint")


LINE_KEYS = 6


def _line_counts(lines: DataFrame) -> DataFrame:
    """How often each order has each line (product, variant, quantity, gift, price, serial): order_id, _k0.., _cnt."""
    key = [F.col("product_id"), _z("product_variant_id"), F.col("quantity"), _z("gift_quantity"), F.col("unit_price"), F.coalesce(F.col("serial_number"), F.lit(""))]
    return lines.groupBy("order_id", *[k.alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.count(F.lit(1)).alias("_cnt"))


def sale_signatures(orders: DataFrame, counts: DataFrame) -> DataFrame:
    """The orders with a fingerprint of their lines: the number of different
    ones and order-independent sums of two 64-bit hashes. Plain aggregates, so
    a very large order is combined per task first. Equal multisets have equal
    fingerprints; ``_same_lines`` checks the reverse."""
    ks = [F.col(f"_k{i}") for i in range(LINE_KEYS)] + [F.col("_cnt")]
    fp = counts.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("_lines"),
        F.sum(_line_hash(*ks).cast("decimal(38,0)")).alias("_h1"),
        F.sum(_line_hash(F.lit("salt"), *ks).cast("decimal(38,0)")).alias("_h2"),
    )
    return orders.join(fp, "order_id", "left").select(
        "*",
        _z("_lines").alias("sig_lines"),
        F.coalesce(F.col("_h1"), F.lit(0).cast("decimal(38,0)")).alias("sig_h1"),
        F.coalesce(F.col("_h2"), F.lit(0).cast("decimal(38,0)")).alias("sig_h2"),
    ).drop("_lines", "_h1", "_h2")


def _line_hash(*cols: Column) -> Column:
    return F.xxhash64(*cols)


def _same_lines(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """The pairs (order_id, duplicate_of, sig_lines) whose orders have the same
    lines equally often: as many lines of one meet an equal line of the other
    as either has."""
    one = pairs.select("order_id", "duplicate_of").join(counts, "order_id")
    two = counts.select(F.col("order_id").alias("duplicate_of"), *[F.col(f"_k{i}").alias(f"_j{i}") for i in range(LINE_KEYS)], F.col("_cnt").alias("_cnt2"))
    equal = reduce(lambda x, y: x & y, [F.col(f"_k{i}").eqNullSafe(F.col(f"_j{i}")) for i in range(LINE_KEYS)])
    met = one.join(two, "duplicate_of").where(equal & (F.col("_cnt") == F.col("_cnt2"))).groupBy("order_id").agg(F.count(F.lit(1)).alias("_met"))
    return pairs.join(met, "order_id", "left").where(F.col("sig_lines") == _z("_met")).drop("_met", "sig_lines")


HEADER_KEYS = (
    ("customer_id", -1), ("employee_id", -1), ("cashier_id", -1), ("total_amount", 0), ("discount", 0),
    ("vat_amount", 0), ("final_amount", 0), ("paid_amount", 0), ("status", ""), ("payment_method", ""),
    ("order_type", ""),
)


def duplicate_sale_detect(orders: DataFrame, lines: DataFrame, serial_orders: DataFrame,
                          window_seconds: int = 30, bucket_seconds: int = 600, *, wallet_orders: DataFrame | None) -> DataFrame:
    """Q17: for each SALE order without serials or wallet rows, the earliest other order that
    has the same header (NULL-safe), the same multiset of lines and a time
    within ``window_seconds`` (whole-second difference).

    ``wallet_orders`` has no default: leaving wallet rows out finds more sales
    to reverse. None says that the shop has no wallet.

    Headers come first: only orders that another one with an equal header (by
    hash) is near in time have their lines read and counted. Those are grouped
    by (header, line fingerprint, 10-minute bucket), and the lines of each
    pair found are compared, one by one with their counts. Rows
    within 30 s of a bucket edge are copied into the neighbouring bucket as
    candidates only, so a group never spans more than one bucket of time and
    a signature repeated all day is still split across many tasks. Inside a
    group, ``min(struct(date, id))`` over a ±30 s range frame gives the
    earliest neighbour; when that is the order itself, the next order in
    time order is the answer if it is within range.
    """
    missing = [c for c, _ in HEADER_KEYS if c not in orders.columns]
    if missing:  # comparing fewer fields would find more "duplicates"
        raise ValueError(f"duplicate_sale_detect needs the header columns {missing}")
    cols = [F.coalesce(F.col(c), F.lit(d)).alias(f"_h_{c}") for c, d in HEADER_KEYS]
    heads = orders.select("order_id", "order_date", F.col("order_type").alias("_type"), *cols, _epoch_seconds("order_date").alias("_sec"))

    def slot(bucket, main):
        return F.struct(bucket.alias("bucket"), F.lit(main).alias("main"))

    def in_buckets(df: DataFrame) -> DataFrame:
        """Own bucket plus halo copies, produced from one pass over the rows."""
        b = F.floor(F.col("_sec") / bucket_seconds).cast("bigint")
        near_start = F.col("_sec") - b * bucket_seconds < window_seconds
        near_end = (b + 1) * bucket_seconds - F.col("_sec") <= window_seconds
        slots = F.array_compact(F.array(slot(b, True), F.when(near_start, slot(b - 1, False)), F.when(near_end, slot(b + 1, False))))
        return df.select("*", F.explode(slots).alias("_slot")).select(
            "*", F.col("_slot.bucket").alias("_bucket"), F.col("_slot.main").alias("_main")).drop("_slot")

    of_header = Window.partitionBy("_hash", "_bucket").orderBy("_sec")
    hashed = in_buckets(heads.select("order_id", "_sec", F.xxhash64(*[f"_h_{c}" for c, _ in HEADER_KEYS]).alias("_hash")))
    gap = F.least(F.col("_sec") - F.lag("_sec").over(of_header), F.lead("_sec").over(of_header) - F.col("_sec"))
    close = hashed.withColumn("_gap", gap).where(F.col("_main") & (F.col("_gap") <= window_seconds)).select("order_id")
    counts = _line_counts(lines.join(close, "order_id", "left_semi"))
    sig = sale_signatures(heads.join(close, "order_id", "left_semi"), counts)
    tied = serial_orders.select("order_id")
    if wallet_orders is not None:
        tied = tied.unionByName(wallet_orders.select("order_id"))
    sig = sig.join(tied.distinct().withColumn("_tied", F.lit(True)), "order_id", "left")
    rows = in_buckets(sig)
    part = [f"_h_{c}" for c, _ in HEADER_KEYS] + ["sig_lines", "sig_h1", "sig_h2", "_bucket"]
    me = F.struct(F.col("order_date"), F.col("order_id"))
    rng = Window.partitionBy(*part).orderBy("_sec").rangeBetween(-window_seconds, window_seconds)
    seq = Window.partitionBy(*part).orderBy("order_date", "order_id")
    w = rows.select(
        "*",
        F.min(me).over(rng).alias("_first"),
        F.lead(F.struct(F.col("order_date"), F.col("order_id"), F.col("_sec"))).over(seq).alias("_next"),
    )
    is_self = F.col("_first.order_id") == F.col("order_id")
    next_ok = F.col("_next").isNotNull() & (F.col("_next._sec") - F.col("_sec") <= window_seconds)
    cand = F.when(~is_self, F.col("_first.order_id")).when(next_ok, F.col("_next.order_id"))
    cand_date = F.when(~is_self, F.col("_first.order_date")).when(next_ok, F.col("_next.order_date"))
    pairs = w.where(
        F.col("_main") & (F.col("_type") == "SALE") & F.col("_tied").isNull() & cand.isNotNull()
    ).select(
        "order_id", "order_date", cand.alias("duplicate_of"), cand_date.alias("duplicate_of_date"), "sig_lines",
    )
    return _same_lines(pairs, counts).select("order_id", "order_date", "duplicate_of", "duplicate_of_date")


SALE_COLUMNS = ("order_id", "order_date", "order_code", "points_used", "points_earned", *(c for c, _ in HEADER_KEYS))
SALE_LINE_COLUMNS = ("order_id", "product_id", "product_variant_id", "quantity", "unit_price", "gift_quantity", "serial_number")


def duplicate_sale_inputs(t):
    """Orders and lines of a shop, with the columns that the search and the reversal read."""
    return t.sales_orders.select(*SALE_COLUMNS), t.order_items.select(*SALE_LINE_COLUMNS)


def duplicate_sale_detect_shop(t) -> DataFrame:
    orders, lines = duplicate_sale_inputs(t)
    return duplicate_sale_detect(orders, lines, _keys(t.product_serials, "order_id"),
                                 wallet_orders=_keys(t.customer_wallet_transactions, "order_id"))


def duplicate_sales_to_reverse(t):
    """Orders that Q18 reverses, with the inputs.

    Of a detected pair the earlier order survives; the later copy is
    reversed.
    """
    orders, lines = duplicate_sale_inputs(t)
    hits = duplicate_sale_detect(orders, lines, _keys(t.product_serials, "order_id"),
                                 wallet_orders=_keys(t.customer_wallet_transactions, "order_id"))
    later = hits.where(
        (F.col("duplicate_of_date") < F.col("order_date"))
        | ((F.col("duplicate_of_date") == F.col("order_date")) & (F.col("duplicate_of") < F.col("order_id")))
    ).select("order_id")
    return orders, lines, later


def _restore_qty():
    q, g = _z("quantity"), _z("gift_quantity")
    return F.when(q < 0, q - g).otherwise(q + g)


def duplicate_sale_reverse(t) -> DataFrame:
    """Q18 (stock): Σ(quantity ± gift with the line's sign) per product of the reversed orders."""
    _, lines, later = duplicate_sales_to_reverse(t)
    return (
        lines.join(later, "order_id")
        .groupBy("product_id")
        .agg(F.sum(_restore_qty()).cast("bigint").alias("quantity_to_restore"))
    )


def duplicate_sale_reverse_variants(t) -> DataFrame:
    """Q18 (variant stock): the same restore per variant, on existing variants."""
    _, lines, later = duplicate_sales_to_reverse(t)
    per_variant = (
        lines.where(F.col("product_variant_id").isNotNull()).join(later, "order_id")
        .groupBy(F.col("product_variant_id").alias("variant_id"))
        .agg(F.sum(_restore_qty()).alias("quantity_to_restore"))
    )
    return t.product_variants.select("variant_id", "stock_base_qty").join(per_variant, "variant_id").select(
        "variant_id", F.col("quantity_to_restore").cast("bigint").alias("quantity_to_restore"),
        (_z("stock_base_qty") + F.col("quantity_to_restore")).cast(S.SUM_QTY).alias("stock_base_qty"),
    )


def duplicate_sale_reverse_points(t) -> DataFrame:
    """Q18 (points): customers get back points used and lose points earned on the reversed orders.

    Summed per customer first (several reversed orders of one customer all count).
    """
    orders, _, later = duplicate_sales_to_reverse(t)
    delta = (
        orders.join(later, "order_id")
        .groupBy("customer_id")
        .agg(F.sum(_z("points_used") - _z("points_earned")).alias("points_delta"))
    )
    return t.customers.select("customer_id", "points").join(delta, "customer_id").select(
        "customer_id", F.col("points_delta").cast("bigint").alias("points_delta"),
        (_z("points") + F.col("points_delta")).cast("bigint").alias("points"),
    )


def duplicate_sale_reverse_cashbook(t, as_of) -> DataFrame:
    """Q18 (cashbook): live receipts ``BH:<order code>`` of the reversed orders are deleted."""
    orders, _, later = duplicate_sales_to_reverse(t)
    refs = orders.join(later, "order_id").select(F.concat(F.lit("BH:"), F.col("order_code")).alias("reference_code"))
    return (
        t.cashbook_entries.where(_z("is_deleted") == 0)
        .join(refs, "reference_code", "left_semi")
        .select("entry_id", "reference_code", F.lit(1).alias("is_deleted"), S.ts(as_of).alias("updated_at"))
    )


def unreferenced_duplicate_customer(t) -> DataFrame:
    """Q19: customers with a same-name/phone twin and no orders, payments, wallet rows or adjustments;
    one member of every group stays.

    Twins are found by counting (trimmed name, trimmed phone) groups, so a
    crowded group (e.g. blank name and phone) never produces pairs.
    """
    c = t.customers.select(
        "customer_id", "name", "phone",
        F.trim(F.coalesce(F.col("name"), F.lit(""))).alias("_n"),
        F.trim(F.coalesce(F.col("phone"), F.lit(""))).alias("_p"),
    )
    refs = (
        _keys(t.sales_orders, "customer_id").unionByName(_keys(t.customer_payments, "customer_id"))
        .unionByName(_keys(t.customer_wallet_transactions, "customer_id"))
        .unionByName(_keys(t.customer_debt_adjustments, "customer_id")).distinct().withColumn("_ref", F.lit(1))
    )
    c = c.join(refs, "customer_id", "left")
    # of a group without any referenced member the smallest id stays
    twins = c.groupBy("_n", "_p").agg(
        F.count(F.lit(1)).alias("_cnt"), F.max("_ref").alias("_any_ref"), F.min("customer_id").alias("_least")
    ).where(F.col("_cnt") > 1)
    return (
        c.where(F.col("_ref").isNull()).join(twins, ["_n", "_p"])
        .where(F.col("_any_ref").isNotNull() | (F.col("customer_id") != F.col("_least")))
        .select("customer_id", "name", "phone")
    )


# ---------------------------------------------------------------- identity repair


def rekey_invalid_id(header: DataFrame, id_col: str, children: dict[str, tuple[DataFrame, str, str]],
                     header_name: str) -> DataFrame:
    """Q20: id 0 -> max(positive id) + 1 in the header and every child table.

    ``children`` maps a table name to (frame, foreign-key column, row-key
    column). Returns (table_name, row_key, old_id, new_id) for every row to
    re-key. The new id is a scalar sub-query, evaluated once on the cluster.
    """
    new_id = header.agg(
        (F.coalesce(F.max(F.when(F.col(id_col) > 0, F.col(id_col))), F.lit(0)) + 1).cast("bigint")
    ).scalar()

    def part(name, df, fk, rk):
        return df.where(F.col(fk) == 0).select(
            F.lit(name).alias("table_name"), F.col(rk).cast("string").alias("row_key"),
            F.col(fk).cast("bigint").alias("old_id"), new_id.alias("new_id"),
        )

    frames = [part(header_name, header, id_col, id_col)] + [part(n, df, fk, rk) for n, (df, fk, rk) in children.items()]
    return reduce(DataFrame.unionByName, frames)


def rekey_supplier_zero(t) -> DataFrame:
    return rekey_invalid_id(
        t.suppliers, "supplier_id",
        {
            "imports": (t.imports, "supplier_id", "import_id"),
            "purchase_returns": (t.purchase_returns, "supplier_id", "return_id"),
            "supplier_payments": (t.supplier_payments, "supplier_id", "payment_id"),
            "supplier_debt_adjustments": (t.supplier_debt_adjustments, "supplier_id", "adjustment_id"),
        },
        "suppliers",
    )


def rekey_import_zero(t) -> DataFrame:
    return rekey_invalid_id(
        t.imports, "import_id",
        {
            "import_details": (t.import_details, "import_id", "import_detail_id"),
            "product_serials": (t.product_serials, "import_id", "serial_id"),
            "purchase_returns": (t.purchase_returns, "import_id", "return_id"),
            "supplier_debt_discount_allocations": (t.supplier_debt_discount_allocations, "import_id", "allocation_id"),
        },
        "imports",
    )


def rekey_purchase_return_zero(t) -> DataFrame:
    return rekey_invalid_id(
        t.purchase_returns, "return_id",
        {"purchase_return_details": (t.purchase_return_details, "return_id", "return_detail_id")},
        "purchase_returns",
    )


def rekey_purchase_return_line_zero(t) -> DataFrame:
    return rekey_invalid_id(t.purchase_return_details, "return_detail_id", {}, "purchase_return_details")


def empty_stocktakes(t) -> DataFrame:
    """Q21: stocktake headers with id 0 and no detail lines."""
    return (
        t.inventory_checks.where(F.col("check_id") == 0)
        .join(_keys(t.inventory_check_details, "check_id"), "check_id", "left_anti")
        .select("check_id", "check_date")
    )


def settlement_normalise(t) -> DataFrame:
    """Q23: invalid settlement type -> DEBT_OFFSET; refund method cleared for offsets."""
    st = F.when(F.col("settlement_type").isin(*SETTLEMENT_TYPES), F.col("settlement_type")).otherwise(
        F.lit("DEBT_OFFSET")
    )
    return t.purchase_returns.select(
        "return_id", st.alias("settlement_type"),
        F.when(st == "DEBT_OFFSET", F.lit(None).cast("string")).otherwise(F.col("refund_method")).alias("refund_method"),
    )


def payment_method_backfill(t) -> DataFrame:
    """Q24: blank payment methods -> 'Tiền mặt' in customer payments, imports and supplier payments."""

    def part(name, df, key):
        return df.where(S.is_blank("payment_method")).select(
            F.lit(name).alias("table_name"), F.col(key).cast("bigint").alias("row_id"),
            F.lit(S.DEFAULT_PAYMENT_METHOD).alias("payment_method"),
        )

    return (
        part("customer_payments", t.customer_payments, "payment_id")
        .unionByName(part("imports", t.imports, "import_id"))
        .unionByName(part("supplier_payments", t.supplier_payments, "payment_id"))
    )


# ---------------------------------------------------------------- constraints report


def _row_rules() -> dict[str, list[tuple[str, Column, list[str]]]]:
    """CHECK and NOT NULL rules by table: (rule, condition of a violation, key)."""
    col = F.col
    positive = lambda *key: ("amount_positive", ~F.coalesce(col("amount") > 0, F.lit(False)), list(key))
    one_of = lambda rule, c, values, key: (rule, ~F.coalesce(col(c).isin(*values), F.lit(False)), [key])
    cash = (S.CASH_IN, S.CASH_OUT)
    return {
        "cashbook_entries": [positive("entry_id"), one_of("entry_type_in_out", "entry_type", cash, "entry_id")],
        "cashbook_categories": [one_of("category_type_in_out", "category_type", cash, "category_id")],
        "customer_debt_adjustments": [positive("adjustment_id")],
        "customer_debt_discount_allocations": [positive("adjustment_id", "order_id")],
        "supplier_debt_adjustments": [positive("adjustment_id")],
        "supplier_debt_discount_allocations": [positive("allocation_id")],
        "employee_payroll_adjustments": [positive("adjustment_id"), one_of("adjustment_type_valid", "adjustment_type", PAYROLL_ADJUSTMENTS, "adjustment_id")],
        "employee_payroll_payments": [one_of("payment_type_advance_settlement", "payment_type", PAYROLL_PAYMENTS, "payment_id")],
        "purchase_returns": [one_of("settlement_type_valid", "settlement_type", SETTLEMENT_TYPES, "return_id")],
        # a CHECK lets NULL pass; the column is nullable
        "store_info": [("price_method_1_2", ~col("import_price_method").isin(1, 2), ["store_name"])],
        "sales_orders": [("order_code_not_null", col("order_code").isNull(), ["order_id"])],
        "imports": [
            ("import_code_not_null", col("import_code").isNull(), ["import_id"]),
            ("credit_not_negative", col("supplier_credit_applied") < 0, ["import_id"]),  # a CHECK lets NULL pass
        ],
    }


def _unique_rules() -> dict[str, list[tuple[str, Column | None, list[str]]]]:
    """UNIQUE rules by table: (rule, rows that take part, columns)."""
    there = lambda c: F.col(c).isNotNull()
    return {
        "sales_orders": [("order_code_unique", there("order_code"), ["order_code"])],
        "imports": [("import_code_unique", there("import_code"), ["import_code"])],
        "customer_debt_discount_allocations": [("allocation_unique", None, ["adjustment_id", "order_id"])],
        "supplier_debt_discount_allocations": [("allocation_unique", None, ["adjustment_id", "import_id"])],
        "product_variants": [("sku_unique", None, ["sku_code"])],
        "product_serials": [("serial_unique", there("serial_number"), ["serial_number"])],
        "employee_payrolls": [("month_employee_unique", None, ["payroll_month", "employee_id"])],
        "products": [("barcode_unique", there("barcode") & (F.trim("barcode") != ""), ["barcode"])],
    }


def constraint_violations(t) -> DataFrame:
    """Q25: the CHECK / UNIQUE / NOT NULL rules of the schema as a report (rule, table, key).

    The rules are data; each table is read once and each of its rows gives an
    entry per violated row rule and per unique rule that it takes part in. One
    aggregate counts the entries of all tables (combined in each task first):
    a violated row rule counts once a row, a unique key if it occurs twice.
    """
    rows, unique = _row_rules(), _unique_rules()

    def entries(table: str) -> DataFrame:
        found = [(rule, cond, key, False) for rule, cond, key in rows.get(table, [])] + [(rule, cond, key, True) for rule, cond, key in unique.get(table, [])]
        structs = []
        for rule, cond, key, is_unique in found:
            e = F.struct(F.lit(rule).alias("rule"), F.lit(is_unique).alias("is_unique"), F.array(*[F.col(c).cast("string") for c in key]).alias("key"))
            structs.append(e if cond is None else F.when(cond, e))
        return getattr(t, table).select(F.explode(F.array_compact(F.array(*structs))).alias("e")).select(F.lit(table).alias("table_name"), "e.*")

    every = reduce(DataFrame.unionByName, [entries(table) for table in dict.fromkeys([*rows, *unique])])
    counted = every.groupBy("rule", "table_name", "is_unique", "key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 OR NOT is_unique")
    times = F.when(F.col("is_unique"), F.lit(1).cast("long")).otherwise(F.col("_n"))
    return counted.select("rule", "table_name", F.concat_ws("|", "key").alias("row_key"), F.explode(F.sequence(F.lit(1).cast("long"), times)).alias("_i")).drop("_i")
