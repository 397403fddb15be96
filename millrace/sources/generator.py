"""Seeded synthetic sales rows, generated where they are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the generator.
REGIONS = ["North", "South", "East", "West", "Central"]
DISCOUNTS = [0.0, 0.05, 0.10, 0.15, 0.20, 0.25, 0.30]
CSV_HEADER = ["TransactionID", "CustomerID", "Quantity", "Price", "Discount", "CategoryID", "StoreRegion"]


def generate_sales(spark: SparkSession, rows: int, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """`rows` rows, the same for a seed whatever the partitioning: every draw is of the MD5 of seed, draw and the row's own id, so that other engines can make the same rows."""

    def draw(k: int, n: int):
        digits = F.substring(F.md5(F.concat(F.lit(f"{seed}-{k}-"), F.col("id").cast("string")).cast("binary")), 1, 8)
        return F.conv(digits, 16, 10).cast("bigint") % n

    def pick(values: list, k: int):
        return F.array(*map(F.lit, values))[draw(k, len(values)).cast("int")]

    base = spark.range(1, rows + 1, 1, partitions or spark.sparkContext.defaultParallelism)
    return base.select(
        F.col("id").cast("int").alias("transaction_id"),
        (draw(1, 100_000) + 1).cast("int").alias("customer_id"),
        (draw(2, 100) + 1).cast("int").alias("quantity"),
        ((draw(3, 149_501) + 500) / 100).cast("float").alias("price"),
        pick(DISCOUNTS, 4).cast("float").alias("discount"),
        (draw(5, 50) + 1).cast("int").alias("category_id"),
        pick(REGIONS, 6).alias("store_region"),
    )


def write_sales_csv(df: DataFrame, path: str) -> None:
    """Header and seven columns, in as many files as the frame has partitions."""
    df.toDF(*CSV_HEADER).write.mode("overwrite").option("header", True).csv(path)
