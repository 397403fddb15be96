"""Grouped aggregation by category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..functions import group_metrics


def group_by_category(df: DataFrame, where: Column | None = None, ordered: bool = False, skip_nan: bool = False, few: bool = False) -> DataFrame:
    """Count, price and quantity aggregates for each category_id; partial aggregation runs before the one shuffle.

    Null keys form one group; an empty input gives no rows. `few` says that the groups are known to fit one task, as the
    table's fixed fifty categories do: they are then ordered where they are merged, without a range exchange and the job
    that samples for it.
    """
    kept = df if where is None else df.where(where)
    out = kept.groupBy("category_id").agg(*group_metrics(skip_nan=skip_nan))
    if ordered and few:
        return out.coalesce(1).sortWithinPartitions("category_id")
    return out.orderBy("category_id") if ordered else out
