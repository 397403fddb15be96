"""The query catalogue: DataFrame plans and the SQL each must agree with."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from .. import operators as op
from .. import sources as src
from ..schema import COLUMNS, LINEITEM_BINDING, SALES, bind_lineitem

Query = Callable[[SparkSession, str], DataFrame]

SALES_CTE = "WITH sales AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in LINEITEM_BINDING.items()) + " FROM lineitem) "
_P = "CAST(price AS DOUBLE)"
_NET = f"{_P} * (CAST(1 AS DOUBLE) - CAST(discount AS DOUBLE)) * CAST(quantity AS DOUBLE)"
_AGG = f"COUNT(*) AS cnt, ROUND(SUM({_P}), 2) AS sum_price, ROUND(AVG({_P}), 4) AS avg_price, MIN({_P}) AS min_price, MAX({_P}) AS max_price"
_GROUP = f"category_id, {_AGG}, CAST(SUM(quantity) AS BIGINT) AS sum_quantity"
_ALL = ", ".join(COLUMNS)
MORSEL = 25_000


def _sales(spark: SparkSession, sf: str, raw=None) -> DataFrame:
    """The sales view; `raw` filters lineitem's own columns first, so that Parquet statistics apply."""
    rows = src.read_lineitem(spark, sf)
    return bind_lineitem(rows if raw is None else rows.where(raw))


def _qty(threshold: int):
    return fn.quantity_gt(threshold, raw=True)


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    return op.with_row_id(src.read_lineitem(spark, sf), *(F.expr(e).alias(c) for c, e in LINEITEM_BINDING.items()))


def _odd(quantity):
    import pyarrow.compute as pc

    return pc.equal(pc.bit_wise_and(quantity, 1), 1)


def _copy_batches(batches):
    yield from batches


def _shared(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder that the session names; a local session without one takes a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/{name}-{os.urandom(8).hex()}"


def _csv(spark: SparkSession, sf: str, reader) -> DataFrame:
    path = _shared(spark, "millrace-csv")
    src.write_sales_csv(_sales(spark, sf), path)
    return reader(spark, path)


def _scan_range(spark: SparkSession, sf: str) -> DataFrame:
    return op.scan_range(_numbered(spark, sf), 100, 5_000)


QUERIES: dict[str, Query] = {
    "q01_count": lambda s, d: _sales(s, d).agg(fn.agg_count()),
    "q02_filter_conj": lambda s, d: _sales(s, d, _qty(25)).where(fn.category_eq(10)),
    "q03_filter_agg": lambda s, d: _sales(s, d, _qty(25)).agg(*fn.agg_price()),
    "q04_group": lambda s, d: op.group_by_category(_sales(s, d), ordered=True, few=True),
    "q05_net_cat": lambda s, d: _sales(s, d).where(fn.category_eq(1)).agg(fn.agg_net_sales()),
    "q06_filter_count": lambda s, d: _sales(s, d, _qty(45)).agg(fn.agg_count()),
    "q07_conj_agg": lambda s, d: _sales(s, d, _qty(10)).where(fn.category_eq(5)).agg(*fn.agg_price()),
    "q08_filter_group": lambda s, d: op.group_by_category(_sales(s, d, _qty(25)), ordered=True, few=True),
    "q09_net_all": lambda s, d: _sales(s, d).agg(fn.agg_net_sales()),
    "q10_qty_cat": lambda s, d: _sales(s, d).where(fn.category_eq(20)).agg(fn.agg_sum_quantity()),
    "sum_price_all": lambda s, d: _sales(s, d).agg(fn.agg_sum_price()),
    "sum_price_sel": lambda s, d: _sales(s, d, _qty(25)).agg(fn.agg_sum_price()),
    "sum_qty_all": lambda s, d: _sales(s, d).agg(fn.agg_sum_quantity()),
    "net_sales_sel": lambda s, d: _sales(s, d, _qty(25)).agg(fn.agg_net_sales()),
    "agg_price_all": lambda s, d: _sales(s, d).agg(*fn.agg_price()),
    "agg_price_empty": lambda s, d: _sales(s, d, _qty(1000)).agg(*fn.agg_price()),
    "agg_price_empty_zero": lambda s, d: _sales(s, d, _qty(1000)).agg(*fn.agg_price(empty_as_zero=True)),
    "filter_generic_or": lambda s, d: _sales(s, d).where((F.col("quantity") < 5) | (F.col("store_region") == "R")),
    "filter_udf": lambda s, d: _sales(s, d).where(fn.arrow_predicate(_odd, "quantity")),
    "filter_subset": lambda s, d: _sales(s, d, _qty(25)).where(fn.category_eq(7)).where(F.col("price") > 50_000),
    "filter_cat_eq": lambda s, d: _sales(s, d).where(fn.category_eq(3)),
    "filter_qty_gt": lambda s, d: _sales(s, d, _qty(45)),
    "group_unsorted": lambda s, d: op.group_by_category(_sales(s, d)),
    "group_filtered_unsorted": lambda s, d: op.group_by_category(_sales(s, d, _qty(25))),
    "project_net": lambda s, d: _sales(s, d).select("transaction_id", F.round(fn.net_sales(), 2).alias("net")),
    "morsels": lambda s, d: op.morsels(s, src.read_lineitem(s, d).agg(F.count(F.lit(1))), MORSEL),
    "scan_all": lambda s, d: _sales(s, d),
    "scan_range": _scan_range,
    "scan_morsel": lambda s, d: op.scan_morsel(_numbered(s, d), 1, MORSEL).drop("row_id"),
    "get_row": lambda s, d: _numbered(s, d).where(F.col("row_id") == 17).drop("row_id"),
    "scan_foreach": lambda s, d: op.map_partitions(_sales(s, d).select("category_id", "quantity"), _copy_batches, "category_id int, quantity int"),
    "first_rows": lambda s, d: op.first_rows(_numbered(s, d), 5).drop("row_id"),
    "head_n": lambda s, d: op.head(_sales(s, d), 5, *COLUMNS),
    "append_rows": lambda s, d: src.append_rows(_sales(s, d), [(1, 2, 3, 4.5, 0.25, 6, "Z")]),
    "generate_sales": lambda s, d: src.generate_sales(s, 10_000),
    "csv_strict": lambda s, d: _csv(s, d, src.read_csv_strict),
    "csv_lenient": lambda s, d: _csv(s, d, src.read_csv_lenient),
}


def _sql(select: str) -> str:
    return SALES_CTE + select


def _place(where: str, more: str = "") -> str:
    return _sql(f"SELECT {more}{_ALL} FROM (SELECT *, row_number() OVER () - 1 AS row_id FROM sales) {where}")


def _generated(rows: int, seed: int) -> str:
    def draw(k: int, n: int) -> str:
        return f"(CAST('0x' || substr(md5('{seed}-{k}-' || id), 1, 8) AS BIGINT) % {n})"

    return (
        f"SELECT CAST(id AS INT) AS transaction_id, CAST({draw(1, 100_000)} + 1 AS INT) AS customer_id, CAST({draw(2, 100)} + 1 AS INT) AS quantity, "
        f"CAST(({draw(3, 149_501)} + 500) / 100.0::DOUBLE AS FLOAT) AS price, CAST(({src.generator.DISCOUNTS})[{draw(4, 7)} + 1] AS FLOAT) AS discount, "
        f"CAST({draw(5, 50)} + 1 AS INT) AS category_id, ({src.generator.REGIONS})[{draw(6, 5)} + 1] AS store_region FROM (SELECT UNNEST(range(1, {rows + 1})) AS id)"
    )


_CSV_SQL = _sql("SELECT " + ", ".join(f"CAST({c} AS INT) AS {c}" if c == "transaction_id" else c for c in COLUMNS) + " FROM sales")

ORACLE: dict[str, str] = {
    "q01_count": _sql("SELECT COUNT(*) AS cnt FROM sales"),
    "q02_filter_conj": _sql(f"SELECT {_ALL} FROM sales WHERE quantity > 25 AND category_id = 10"),
    "q03_filter_agg": _sql(f"SELECT {_AGG} FROM sales WHERE quantity > 25"),
    "q04_group": _sql(f"SELECT {_GROUP} FROM sales GROUP BY category_id ORDER BY category_id"),
    "q05_net_cat": _sql(f"SELECT ROUND(SUM({_NET}), 2) AS net_sales FROM sales WHERE category_id = 1"),
    "q06_filter_count": _sql("SELECT COUNT(*) AS cnt FROM sales WHERE quantity > 45"),
    "q07_conj_agg": _sql(f"SELECT {_AGG} FROM sales WHERE quantity > 10 AND category_id = 5"),
    "q08_filter_group": _sql(f"SELECT {_GROUP} FROM sales WHERE quantity > 25 GROUP BY category_id ORDER BY category_id"),
    "q09_net_all": _sql(f"SELECT ROUND(SUM({_NET}), 2) AS net_sales FROM sales"),
    "q10_qty_cat": _sql("SELECT CAST(SUM(quantity) AS BIGINT) AS sum_quantity FROM sales WHERE category_id = 20"),
    "sum_price_all": _sql(f"SELECT ROUND(SUM({_P}), 2) AS sum_price FROM sales"),
    "sum_price_sel": _sql(f"SELECT ROUND(SUM({_P}), 2) AS sum_price FROM sales WHERE quantity > 25"),
    "sum_qty_all": _sql("SELECT CAST(SUM(quantity) AS BIGINT) AS sum_quantity FROM sales"),
    "net_sales_sel": _sql(f"SELECT ROUND(SUM({_NET}), 2) AS net_sales FROM sales WHERE quantity > 25"),
    "agg_price_all": _sql(f"SELECT {_AGG} FROM sales"),
    "agg_price_empty": _sql(f"SELECT {_AGG} FROM sales WHERE quantity > 1000"),
    "agg_price_empty_zero": _sql(
        f"SELECT COUNT(*) AS cnt, COALESCE(SUM({_P}), 0.0) AS sum_price, COALESCE(AVG({_P}), 0.0) AS avg_price, COALESCE(MIN({_P}), 0.0) AS min_price, COALESCE(MAX({_P}), 0.0) AS max_price FROM sales WHERE quantity > 1000"
    ),
    "filter_generic_or": _sql(f"SELECT {_ALL} FROM sales WHERE quantity < 5 OR store_region = 'R'"),
    "filter_udf": _sql(f"SELECT {_ALL} FROM sales WHERE quantity % 2 = 1"),
    "filter_subset": _sql(f"SELECT * FROM (SELECT * FROM (SELECT {_ALL} FROM sales WHERE quantity > 25) WHERE category_id = 7) WHERE price > 50000"),
    "filter_cat_eq": _sql(f"SELECT {_ALL} FROM sales WHERE category_id = 3"),
    "filter_qty_gt": _sql(f"SELECT {_ALL} FROM sales WHERE quantity > 45"),
    "group_unsorted": _sql(f"SELECT {_GROUP} FROM sales GROUP BY category_id"),
    "group_filtered_unsorted": _sql(f"SELECT {_GROUP} FROM sales WHERE quantity > 25 GROUP BY category_id"),
    "project_net": _sql(f"SELECT transaction_id, ROUND({_NET}, 2) AS net FROM sales"),
    "morsels": f"SELECT CAST(i AS BIGINT) AS morsel_id, CAST(i * {MORSEL} AS BIGINT) AS start_row, CAST(LEAST(n, (i + 1) * {MORSEL}) AS BIGINT) AS end_row FROM (SELECT COUNT(*) AS n FROM lineitem), LATERAL (SELECT UNNEST(range(0, CAST(CEIL(n / {MORSEL}.0) AS BIGINT))) AS i)",
    "scan_all": _sql(f"SELECT {_ALL} FROM sales"),
    "scan_foreach": _sql("SELECT category_id, quantity FROM sales"),
    "scan_range": _place("WHERE row_id >= 100 AND row_id < 5000", "row_id, "),
    "scan_morsel": _place(f"WHERE row_id >= {MORSEL} AND row_id < {2 * MORSEL}"),
    "get_row": _place("WHERE row_id = 17"),
    "first_rows": _place("WHERE row_id < 5"),
    "generate_sales": _generated(10_000, 42),
    "head_n": _sql(f"SELECT {_ALL} FROM sales ORDER BY {_ALL} LIMIT 5"),
    "append_rows": _sql(f"SELECT {_ALL} FROM sales UNION ALL SELECT CAST(1 AS BIGINT), 2, 3, CAST(4.5 AS FLOAT), CAST(0.25 AS FLOAT), 6, 'Z'"),
    "csv_strict": _CSV_SQL,
    "csv_lenient": _CSV_SQL,
}

assert SALES.fieldNames() == COLUMNS
