"""Streaming ingestion: files that arrive in a folder extend the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import group_by_category
from ..schema import SALES


def stream_sales_csv(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of sales rows from CSV files with a header."""
    return spark.readStream.schema(SALES).option("header", True).option("maxFilesPerTrigger", files_per_trigger).csv(folder)


def stream_group_by_category(stream: DataFrame) -> DataFrame:
    """Running category aggregates; write with outputMode("complete"). State is one row for each category."""
    return group_by_category(stream)
