"""DataFrame -> DataFrame operators."""

from .grouping import group_by_category
from .scan import first_rows, for_each, for_each_partition, get_row, head, map_partitions, morsels, partition_rows, row_cursor, scan_morsel, scan_range, with_row_id

__all__ = ["first_rows", "for_each", "for_each_partition", "get_row", "group_by_category", "head", "map_partitions", "morsels", "partition_rows", "row_cursor", "scan_morsel", "scan_range", "with_row_id"]
