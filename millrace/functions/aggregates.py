"""Scalar and grouped aggregates as lists of Columns, evaluated together in one pass."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _price() -> Column:
    return F.col("price").cast("double")


def net_sales() -> Column:
    """price * (1 - discount) * quantity with every operand widened to double first."""
    return _price() * (F.lit(1.0) - F.col("discount").cast("double")) * F.col("quantity").cast("double")


def agg_count(name: str = "cnt") -> Column:
    return F.count(F.lit(1)).alias(name)


def agg_sum_price(name: str = "sum_price", digits: int | None = 2) -> Column:
    s = F.sum(_price())
    return (s if digits is None else F.round(s, digits)).alias(name)


def agg_sum_quantity(name: str = "sum_quantity") -> Column:
    return F.sum("quantity").cast("bigint").alias(name)


def agg_net_sales(name: str = "net_sales", digits: int | None = 2) -> Column:
    s = F.sum(net_sales())
    return (s if digits is None else F.round(s, digits)).alias(name)


def agg_price(empty_as_zero: bool = False, skip_nan: bool = False, rounded: bool = True) -> list[Column]:
    """COUNT, SUM, AVG, MIN and MAX of price.

    An empty input gives nulls beside the zero count; `empty_as_zero` gives zeros. NaN is the greatest value;
    `skip_nan` leaves it out of MIN and MAX.
    """
    p = _price()
    seen = F.when(~F.isnan(p), p) if skip_nan else p
    parts = {"sum_price": F.sum(p), "avg_price": F.avg(p), "min_price": F.min(seen), "max_price": F.max(seen)}
    if rounded:
        parts |= {"sum_price": F.round(parts["sum_price"], 2), "avg_price": F.round(parts["avg_price"], 4)}
    if empty_as_zero:
        parts = {k: F.coalesce(v, F.lit(0.0)) for k, v in parts.items()}
    return [agg_count(), *(v.alias(k) for k, v in parts.items())]


def group_metrics(skip_nan: bool = False, rounded: bool = True) -> list[Column]:
    """What a group row holds: the price aggregates and the integer sum of quantity."""
    return [*agg_price(skip_nan=skip_nan, rounded=rounded), agg_sum_quantity()]
