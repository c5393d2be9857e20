"""The one representative parameter set per registered key.

Sales and imports in the test data span 1995-2001; cashbook, payments and
payroll rows fall in December 1998 - January 1999 (event times shifted back
9131 days). Periods are wide enough that every branch of every report sees
rows; none is a sampling device.
"""

from __future__ import annotations

import datetime as _dt
from types import SimpleNamespace

P = SimpleNamespace(
    # stock movement (R2): day-truncated half-open period
    mv_from="1997-01-01", mv_to="1998-06-30",
    mv_start="1997-01-01 00:00:00", mv_end_excl="1998-07-01 00:00:00",
    # sales/import reports
    from_dt="1996-01-01 00:00:00", to_dt="1998-12-31 23:59:59",
    # cashbook, payments (R1.10, L12, L13, L20, L21)
    cb_from="1999-01-01 00:00:00", cb_to="1999-01-20 00:00:00",
    top_n=20,
    # "as of" instant replacing GETDATE()
    as_of=_dt.datetime(2026, 8, 20, 9, 30, 0),
)

# listing parameters
P.kw_products = "red"
P.kw_in_stock, P.cat_in_stock = "blue", 3
P.kw_for_import, P.cat_for_import = "gear", 0
P.kw_imports, P.status_imports = "chu 3", "All"
P.kw_suppliers = "bank"
P.kw_returns = "tra hang 1"
P.kw_returnable = ""
P.cb_type = " out "
P.kw_cashbook = "sq1"
P.price_method = 1

# second parameter sets: one id, one status, one type
P.one_product, P.one_import, P.one_supplier, P.one_customer, P.one_serial_product = 10, 100, 3, 7, 9
