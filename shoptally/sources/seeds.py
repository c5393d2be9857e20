"""Seed rows of the cashbook categories (A3) and their keyed upsert.

The source inserts each seed category only when (type, name) is missing,
then forces the profit flag of named categories. Here the seed is a small
literal DataFrame; the upsert is a ``left_anti`` join on (type, name) plus
``unionByName``; new ids continue after the largest existing id in seed
order; the flag rules are ``when(isin)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values that must equal the source system's ---------------------
# (type, name, sort_order, affects_profit when inserted), in the order the
# scripts insert them; every seed row is a system category, active.
SEED_CATEGORIES = [
    ("IN", "Thu khác", 10, 1),
    ("IN", "Góp vốn", 20, 1),
    ("IN", "Thu nợ khách hàng", 30, 1),
    ("IN", "Hoàn tiền nhà cung cấp", 40, 1),
    ("OUT", "Chi khác", 10, 1),
    ("OUT", "Lương nhân viên", 20, 1),
    ("OUT", "Tiền điện", 30, 1),
    ("OUT", "Tiền nước", 40, 1),
    ("OUT", "Thuê nhà", 50, 1),
    ("OUT", "Internet", 60, 1),
    ("OUT", "Vận chuyển", 70, 1),
    ("OUT", "Văn phòng phẩm", 80, 1),
    ("OUT", "Chi trả nhà cung cấp", 90, 1),
    ("IN", "Thu tiền khách trả", 25, 0),
    ("OUT", "Chi tiền trả NCC", 85, 0),
    ("OUT", "Tạm ứng lương nhân viên", 95, 1),
    ("OUT", "Chi lương nhân viên", 96, 1),
    ("IN", "Thu hoàn tiền hàng trả NCC", 35, 0),
]
# Categories whose amounts never count as profit or loss.
NOT_PROFIT = ["Góp vốn", "Thu tiền khách trả", "Thu nợ khách hàng", "Hoàn tiền nhà cung cấp",
              "Chi trả nhà cung cấp", "Chi tiền trả NCC"]
# Categories that always count as profit or loss.
PROFIT = ["Thu khác", "Chi khác", "Lương nhân viên", "Tiền điện", "Tiền nước", "Thuê nhà", "Internet",
          "Vận chuyển", "Văn phòng phẩm"]
# The supplier-refund income category is re-asserted when it already exists.
REFUND_CATEGORY = ("IN", "Thu hoàn tiền hàng trả NCC", 35)
# ---------------------------------------------------------------------------


def seed_frame(spark) -> DataFrame:
    return spark.createDataFrame(
        [(i, ty, name, sort, ap) for i, (ty, name, sort, ap) in enumerate(SEED_CATEGORIES, start=1)],
        "seed_no int, category_type string, category_name string, sort_order int, affects_profit int",
    )


def cashbook_category_seed(categories: DataFrame) -> DataFrame:
    """The category table after seeding: existing rows (with flag rules applied)
    plus missing seed rows numbered after the largest existing id."""
    spark = categories.sparkSession
    seed = F.broadcast(seed_frame(spark))  # a fixed list of 18 rows
    missing = seed.join(categories.select("category_type", "category_name").distinct(), ["category_type", "category_name"],
                        "left_anti")
    max_id = categories.agg(F.coalesce(F.max("category_id"), F.lit(0)).cast("int")).scalar()
    from ..functions.ranking import row_number_by_id

    added = row_number_by_id(missing, [], "seed_no", "_rank").select(
        (max_id + F.col("_rank")).cast("int").alias("category_id"), "category_type", "category_name",
        F.lit(1).alias("is_system"), F.lit(1).alias("is_active"), "affects_profit", "sort_order",
    )
    ty, name, sort = REFUND_CATEGORY
    refund = (F.col("category_type") == ty) & (F.col("category_name") == name)
    existing = categories.select(
        "category_id", "category_type", "category_name",
        F.when(refund, F.lit(1)).otherwise(F.col("is_system")).alias("is_system"),
        F.when(refund, F.lit(1)).otherwise(F.col("is_active")).alias("is_active"),
        F.when(refund, F.lit(0)).otherwise(F.col("affects_profit")).alias("affects_profit"),
        F.when(refund, F.lit(sort)).otherwise(F.col("sort_order")).alias("sort_order"),
    )
    allrows = existing.unionByName(added)
    flag = (
        F.when(F.col("category_name").isin(*NOT_PROFIT), F.lit(0))
        .when(F.col("category_name").isin(*PROFIT), F.lit(1))
        .otherwise(F.col("affects_profit"))
    )
    return allrows.withColumn("affects_profit", flag.cast("int"))
