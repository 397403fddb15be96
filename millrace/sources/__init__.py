"""Readers, writers and the data generator."""

from .readers import append_rows, read_csv_lenient, read_csv_strict, read_lineitem, read_raw, read_sales_parquet, table_stats
from .generator import generate_sales, write_sales_csv

__all__ = ["append_rows", "generate_sales", "read_csv_lenient", "read_csv_strict", "read_lineitem", "read_raw", "read_sales_parquet", "table_stats", "write_sales_csv"]
