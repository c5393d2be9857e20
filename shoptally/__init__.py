"""shoptally: retail back-office analytics as Spark DataFrame operators.

Sub-packages
  sources    typed scans, shop-table fixtures, XML line items, seed rows
  functions  business rules as Column expressions
  operators  reports, listings, debts, batch posting, data quality
  plans      the key -> query registry and the DuckDB oracle SQL
  streaming  (the source system has no streaming; see its docstring)
"""

from .session import get_spark  # noqa: F401
