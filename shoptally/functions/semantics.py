"""Business rules shared by the operators, as Spark Column expressions.

Each helper returns a ``Column`` built from ``pyspark.sql.functions`` only,
so every rule stays inside whole-stage codegen and Catalyst can push the
status/date predicates down to the scans. The rules differ on purpose
between reports (see the notes on each helper); do not unify them.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values that must equal the source system's ---------------------
# Status spellings that mean "cancelled" in the broad check.
CANCELLED_STATUSES = ("Cancelled", "Canceled", "Đã hủy", "Hủy")
# Sale statuses counted as revenue in the overview and customer-profit reports.
EFFECTIVE_SALE_STATUSES = ("Completed", "Paid", "Partial")
# Sale statuses counted by stock movement and top sellers.
PAID_OR_COMPLETED = ("Paid", "Completed")
# Order type of customer returns.
RETURN_TYPE = "RETURN"
# Default payment method text ("cash").
DEFAULT_PAYMENT_METHOD = "Tiền mặt"
# Cashbook entry types.
CASH_IN, CASH_OUT = "IN", "OUT"
# ---------------------------------------------------------------------------

MONEY = "decimal(18,0)"
QTY = "decimal(18,3)"
SUM_MONEY = "decimal(38,0)"
SUM_QTY = "decimal(38,3)"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nz(c, default=0) -> Column:
    """``ISNULL(x, default)``."""
    return F.coalesce(col(c), F.lit(default))


def isnull_str(c, default: str = "") -> Column:
    return F.coalesce(col(c), F.lit(default))


def not_cancelled_broad(status) -> Column:
    """``ISNULL(status,'') NOT IN (all cancelled spellings)``: NULL is live."""
    return ~isnull_str(status).isin(*CANCELLED_STATUSES)


def not_cancelled_strict(status) -> Column:
    """``status <> 'Cancelled'``: NULL is *excluded*, other spellings included."""
    return col(status) != F.lit("Cancelled")


def not_cancelled_isnull(status) -> Column:
    """``ISNULL(status,'') <> 'Cancelled'``: NULL is live, only one spelling."""
    return isnull_str(status) != F.lit("Cancelled")


def status_in(status, values) -> Column:
    return isnull_str(status).isin(*values)


def is_return(order_type) -> Column:
    return isnull_str(order_type) == F.lit(RETURN_TYPE)


def is_sale(order_type) -> Column:
    return isnull_str(order_type) != F.lit(RETURN_TYPE)


def cost_expr(cost_price, import_price) -> Column:
    """Line cost: ``ISNULL(NULLIF(cost_price,0), ISNULL(import_price,0))``."""
    return F.coalesce(F.nullif(col(cost_price), F.lit(0)), col(import_price), F.lit(0))


def base_qty(base_quantity, quantity) -> Column:
    """``ISNULL(base_quantity, quantity)`` typed as the first argument."""
    return F.coalesce(col(base_quantity).cast(QTY), col(quantity).cast(QTY))


def clamp0(c) -> Column:
    """``CASE WHEN x < 0 THEN 0 ELSE x END`` keeping NULL as NULL -> 0."""
    c = col(c)
    return F.when(c < 0, F.lit(0).cast("decimal(1,0)")).otherwise(c)


def code6(prefix: str, key) -> Column:
    """``prefix + RIGHT('000000' + CAST(key AS NVARCHAR), 6)``: keeps the last six digits."""
    return F.concat(F.lit(prefix), F.expr("right(concat('000000', cast({} as string)), 6)".format(_sql_name(key))))


def _sql_name(c) -> str:
    if isinstance(c, str):
        return f"`{c}`"
    raise TypeError("code6 needs a column name")


def blank_to_null(c) -> Column:
    """``NULLIF(LTRIM(RTRIM(x)), '')``."""
    return F.nullif(F.trim(col(c)), F.lit(""))


def is_blank(c) -> Column:
    return blank_to_null(c).isNull()


def default_if_blank(c, default: str) -> Column:
    return F.coalesce(blank_to_null(c), F.lit(default))


def like_any(keyword, *columns) -> Column:
    """``c1 LIKE '%'+kw+'%' OR ...`` (case-insensitive, NULL column = no match).

    ``%`` and ``_`` in the keyword stay wildcards, as in the unescaped
    concatenation of the source; ``\\`` is a plain character. A NULL keyword
    matches nothing.
    """
    if keyword is None:
        return F.lit(False)
    pattern = F.lit(f"%{keyword}%")
    cond = None
    for c in columns:
        term = F.coalesce(F.ilike(col(c), pattern, F.lit("\u0001")), F.lit(False))
        cond = term if cond is None else (cond | term)
    return cond


def keyword_match(keyword, *columns, trim: bool = True, null_is_empty: bool = True) -> Column:
    """``(@kw = '' OR c1 LIKE '%'+@kw+'%' OR ...)``.

    ``trim``: the keyword is trimmed first (most procedures do). When
    ``null_is_empty`` is false a NULL keyword matches nothing (the procedures
    that compare ``@Keyword = ''`` without ISNULL). The predicate is built in
    Python, so an empty keyword adds no filter at all and pushdown stays intact.
    """
    if keyword is None:
        if not null_is_empty:
            return F.lit(False)
        keyword = ""
    kw = keyword.strip() if trim else keyword
    if kw.rstrip(" ") == "":  # T-SQL '=' pads with blanks: '   ' = '' is true
        return F.lit(True)
    return like_any(kw, *columns)


def ts(value) -> Column:
    """A timestamp literal (naive, like the source's DATETIME)."""
    if value is None:
        return F.lit(None).cast("timestamp_ntz")
    if isinstance(value, str):
        value = _dt.datetime.fromisoformat(value)
    elif isinstance(value, _dt.date) and not isinstance(value, _dt.datetime):
        value = _dt.datetime(value.year, value.month, value.day)
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def day_start(value) -> _dt.datetime:
    """``CONVERT(DATE, x)`` as a datetime at midnight."""
    if isinstance(value, str):
        value = _dt.datetime.fromisoformat(value)
    return _dt.datetime(value.year, value.month, value.day)


def day_after(value) -> _dt.datetime:
    """``DATEADD(DAY, 1, CONVERT(DATE, x))``."""
    return day_start(value) + _dt.timedelta(days=1)


def parse_dt(value):
    if value is None:
        return None
    if isinstance(value, str):
        return _dt.datetime.fromisoformat(value)
    if isinstance(value, _dt.date) and not isinstance(value, _dt.datetime):
        return _dt.datetime(value.year, value.month, value.day)
    return value


def in_half_open(c, start, end_exclusive) -> Column:
    return (col(c) >= ts(start)) & (col(c) < ts(end_exclusive))


def in_closed(c, start, end) -> Column:
    return (col(c) >= ts(start)) & (col(c) <= ts(end))


def month_column(date_column: str) -> str:
    """The month folder ('yyyy-MM') of a date column: ``order_date`` -> ``order_month``."""
    return date_column.removesuffix("_date") + "_month"


def in_months(df: DataFrame, date_column: str, start=None, end=None, end_exclusive=None) -> DataFrame:
    """The rows of the months that a period touches; all rows where ``df`` has no month folders.

    For frames that carry their document's month but not its date (lines):
    the join with the documents of the period decides, this only skips folders.
    """
    month = month_column(date_column)
    if month not in df.columns:
        return df
    if start is not None:
        df = df.where(F.col(month) >= f"{parse_dt(start):%Y-%m}")
    if end is None and end_exclusive is not None:
        end = parse_dt(end_exclusive) - _dt.timedelta(microseconds=1)
    return df if end is None else df.where(F.col(month) <= f"{parse_dt(end):%Y-%m}")


def during(df: DataFrame, date_column: str, start=None, end=None, end_exclusive=None) -> DataFrame:
    """The rows dated in a period, both bounds optional; rows without a date only where neither is given.

    The condition on the date becomes one on the month wherever ``df`` has
    its folders, so that whole folders are skipped.
    """
    df = in_months(df, date_column, start, end, end_exclusive)
    if start is not None:
        df = df.where(F.col(date_column) >= ts(parse_dt(start)))
    if end is not None:
        df = df.where(F.col(date_column) <= ts(parse_dt(end)))
    if end_exclusive is not None:
        df = df.where(F.col(date_column) < ts(parse_dt(end_exclusive)))
    return df


def within(df: DataFrame, date_column: str, start, end) -> DataFrame:
    """The rows dated in the closed period; a missing bound selects none, as a comparison with NULL does."""
    return df.where(F.lit(False)) if start is None or end is None else during(df, date_column, start, end)
