"""Column builders: predicates, scalar expressions and aggregate lists."""

from .aggregates import agg_count, agg_net_sales, agg_price, agg_sum_price, agg_sum_quantity, group_metrics, net_sales
from .predicates import arrow_predicate, category_eq, quantity_and_category, quantity_gt, row_predicate

__all__ = ["agg_count", "agg_net_sales", "agg_price", "agg_sum_price", "agg_sum_quantity", "arrow_predicate", "category_eq", "group_metrics", "net_sales", "quantity_and_category", "quantity_gt", "row_predicate"]
