"""CSV (strict and lenient) and Parquet readers for the sales table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LINEITEM_COLUMNS, SALES

# Fixed values of the lenient number format: an unsigned-prefix integer or float, no leading blank or plus sign.
INT_PREFIX = r"^(-?[0-9]+)"
FLOAT_PREFIX = r"(?i)^(-?(?:inf(?:inity)?|nan|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?))"


def read_sales_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table that already has the sales columns."""
    return spark.read.parquet(path).select(*SALES.fieldNames())


def read_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of lineitem that the sales table is bound to; callers filter them before `bind_lineitem`."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*LINEITEM_COLUMNS)


def read_csv_strict(spark: SparkSession, path: str) -> DataFrame:
    """Spark's own CSV reader under the fixed schema (bad fields become null, quotes are honoured)."""
    return spark.read.schema(SALES).option("header", True).csv(path)


def _file_sizes(spark: SparkSession, path: str) -> list[int]:
    """Sizes of the files that a path, a pattern or a folder (and the folders in it) stands for, hidden ones apart."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    todo, sizes = list(fs.globStatus(p) or []), []
    while todo:
        found = todo.pop()
        if found.isFile():
            sizes.append(found.getLen())
        else:
            todo += [s for s in fs.listStatus(found.getPath()) if s.getPath().getName()[0] not in "._"]
    return sizes


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Files as they are: path, modificationTime, length and content, one row a file."""
    return spark.read.format("binaryFile").load(path)


def _number(token: Column, pattern: str, kind: str) -> Column:
    value = F.regexp_extract(token, pattern, 1).try_cast(kind)
    if kind == "float":
        word = F.lower(F.regexp_extract(token, pattern, 1))
        finite = ~word.rlike("inf|nan")
        named = F.when(word.rlike("nan"), F.lit(float("nan"))).when(word.startswith("-inf"), F.lit(float("-inf"))).when(word.startswith("inf"), F.lit(float("inf"))).cast("float")
        value = F.when(finite & (F.isnan(value) | (F.abs(value) == float("inf"))), F.lit(0.0)).when(finite, value).otherwise(named)
    return F.coalesce(value, F.lit(0)).cast(kind)


def read_csv_lenient(spark: SparkSession, path: str) -> DataFrame:
    """Lenient CSV without a single Python row.

    The first line of each file (that isn't blank) is dropped whatever it holds; blank lines are skipped; fields are split at every
    comma (no quoting); a row needs seven fields and more are ignored; a number is the longest valid prefix of its
    field, 0 if there is none or it is out of range; the region is taken verbatim. A zero-byte file, in a folder too, raises
    ValueError, a header alone gives no rows, a missing path raises Spark's PATH_NOT_FOUND.
    """
    if 0 in _file_sizes(spark, path):
        raise ValueError(f"empty file: {path}")
    # One column, as the separator is a control character; a line that holds one even so is kept whole as corrupt.
    reader = spark.read.schema("line string, whole string").option("columnNameOfCorruptRecord", "whole").option("header", True).option("sep", "\u0001").option("quote", "").option("escape", "")
    lines = reader.csv(path).select(F.regexp_replace(F.coalesce("whole", "line"), r"[\r\n]+$", "").alias("line"))
    rows = lines.select(F.split("line", ",").alias("t")).where(F.size("t") >= 7)
    number = {"int": INT_PREFIX, "float": FLOAT_PREFIX}
    return rows.select(*(F.col("t")[i].alias(f.name) if f.dataType.simpleString() == "string" else _number(F.col("t")[i], number[f.dataType.simpleString()], f.dataType.simpleString()).alias(f.name) for i, f in enumerate(SALES)))


def append_rows(df: DataFrame, rows: Iterable[tuple] | DataFrame) -> DataFrame:
    """The table with more rows; for durable appends write them with mode("append")."""
    more = rows if isinstance(rows, DataFrame) else df.sparkSession.createDataFrame(list(rows), df.schema)
    return df.unionByName(more)


def table_stats(df: DataFrame) -> dict[str, int]:
    """Row count and Catalyst's size estimate in bytes."""
    plan = df._jdf.queryExecution().optimizedPlan()
    return {"rows": df.count(), "size_bytes": int(str(plan.stats().sizeInBytes()))}
