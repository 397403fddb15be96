"""Positional scans, morsel descriptors and per-row callbacks.

Row ids are positions in storage order: files in the order of their paths, rows in that of Parquet's own row index
(`_metadata.row_index`). A file's first id is the sum of the row counts before it, one row a file, which Parquet's
footers answer; no row is sorted or moved to be numbered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DEFAULT_MORSEL = 100_000


def with_row_id(df: DataFrame, *columns: Column | str) -> DataFrame:
    """A frame read from Parquet with `row_id`, its position in the whole table, beside the given columns (all of them by default)."""
    place, own = F.col("_metadata.row_index"), columns or ("*",)
    if len(df.inputFiles()) <= 1:
        return df.select(place.alias("row_id"), *own)
    counts = df.groupBy(F.col("_metadata.file_path").alias("_path")).agg(F.count(F.lit(1)).alias("_n"))
    first = counts.select("_path", (F.sum("_n").over(W.orderBy("_path")) - F.col("_n")).alias("_first"))
    held = df.select(F.struct(*own).alias("_row"), F.col("_metadata.file_path").alias("_file"), place.alias("_place"))
    return held.join(first, F.col("_file") == F.col("_path")).select((F.col("_first") + F.col("_place")).alias("row_id"), "_row.*")


def scan_range(numbered: DataFrame, start: int, end: int) -> DataFrame:
    """Half-open range of row ids; an end past the table is harmless, a start past it gives nothing."""
    return numbered.where((F.col("row_id") >= start) & (F.col("row_id") < end))


def morsels(spark: SparkSession, total: DataFrame | int, size: int = DEFAULT_MORSEL) -> DataFrame:
    """Descriptors (morsel_id, start_row, end_row) covering `total` rows; size 0 means the default, 0 rows none.

    `total` is a number or a one-row frame whose only column is the count, which keeps the plan lazy.
    """
    size = size or DEFAULT_MORSEL
    counted = spark.range(1).select(F.lit(total).cast("bigint").alias("n")) if isinstance(total, int) else total.toDF("n")
    made = counted.where("n > 0").select("n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / size)))).toDF("n", "morsel_id")
    return made.select("morsel_id", (F.col("morsel_id") * size).alias("start_row"), F.least(F.col("n"), (F.col("morsel_id") + 1) * size).alias("end_row"))


def scan_morsel(numbered: DataFrame, morsel_id: int, size: int = DEFAULT_MORSEL) -> DataFrame:
    size = size or DEFAULT_MORSEL
    return scan_range(numbered, morsel_id * size, (morsel_id + 1) * size)


def get_row(numbered: DataFrame, row_id: int) -> Row:
    """One row by position; IndexError outside the table."""
    row = numbered.where(F.col("row_id") == row_id).drop("row_id").first()
    if row is None:
        raise IndexError(row_id)
    return row


def first_rows(numbered: DataFrame, n: int) -> DataFrame:
    """The first n rows in storage order."""
    return scan_range(numbered, 0, n)


def head(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows in a stated order: a top-k per partition and one merge, not a full sort."""
    return df.orderBy(*order).limit(n)


def row_cursor(df: DataFrame) -> Iterator[Row]:
    """A pull cursor on the driver, one partition in memory at a time."""
    return df.toLocalIterator(prefetchPartitions=True)


def for_each(numbered: DataFrame, callback: Callable[[int], None]) -> None:
    """Call back on the driver with every row id in ascending order."""
    for row in row_cursor(numbered.select("row_id").orderBy("row_id")):
        callback(row.row_id)


def for_each_partition(df: DataFrame, callback: Callable[[Iterator[Row]], None]) -> None:
    """Side effects where the rows are, in no particular order."""
    df.foreachPartition(callback)


def map_partitions(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """Results where the rows are: fn maps an iterator of Arrow batches to another."""
    return df.mapInArrow(fn, schema)


def partition_rows(df: DataFrame) -> DataFrame:
    """partition_id and n_rows of each non-empty partition: what the scheduler deals out."""
    return df.groupBy(F.spark_partition_id().alias("partition_id")).agg(F.count(F.lit(1)).alias("n_rows"))
