"""Structured Streaming forms of the append and the grouped aggregation."""

from .ingest import stream_group_by_category, stream_sales_csv

__all__ = ["stream_group_by_category", "stream_sales_csv"]
