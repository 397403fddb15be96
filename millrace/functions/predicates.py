"""Filters as Columns. `raw=True` gives the form over lineitem's own columns, which Parquet can prune by."""

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def quantity_gt(threshold: int, raw: bool = False) -> Column:
    """Strictly more than the threshold. lineitem quantities are integral doubles, so the raw form is equivalent."""
    return F.col("l_quantity") > float(threshold) if raw else F.col("quantity") > threshold


def category_eq(category: int) -> Column:
    return F.col("category_id") == category


def quantity_and_category(threshold: int, category: int) -> Column:
    return quantity_gt(threshold) & category_eq(category)


def arrow_predicate(fn: Callable, *columns: str) -> Column:
    """Escape hatch for an opaque predicate over whole batches: from Arrow arrays to a boolean array."""

    def whole(*arrays: pa.Array) -> pa.Array:
        return fn(*arrays)

    return F.arrow_udf(whole, "boolean")(*map(F.col, columns))


def row_predicate(fn: Callable, *columns: str) -> Column:
    """The same for a predicate that knows one row's values only; batches travel by Arrow, fn runs once a row."""
    return F.udf(fn, "boolean", useArrow=True)(*map(F.col, columns))
