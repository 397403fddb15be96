"""The sales schema and its binding to a lineitem-shaped table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SALES = T.StructType(
    [
        T.StructField("transaction_id", T.IntegerType()),
        T.StructField("customer_id", T.IntegerType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("price", T.FloatType()),
        T.StructField("discount", T.FloatType()),
        T.StructField("category_id", T.IntegerType()),
        T.StructField("store_region", T.StringType()),
    ]
)
COLUMNS = SALES.fieldNames()

#: sales column -> SQL expression over lineitem; both the DataFrame binding and the oracle's CTE are made from it.
LINEITEM_BINDING = {
    "transaction_id": "CAST(l_orderkey * 10 + l_linenumber AS BIGINT)",
    "customer_id": "CAST(l_suppkey AS INT)",
    "quantity": "CAST(l_quantity AS INT)",
    "price": "CAST(l_extendedprice AS FLOAT)",
    "discount": "CAST(l_discount AS FLOAT)",
    "category_id": "CAST(l_partkey % 50 + 1 AS INT)",
    "store_region": "l_returnflag",
}


LINEITEM_COLUMNS = ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"]


def bind_lineitem(lineitem: DataFrame) -> DataFrame:
    """Project lineitem onto the sales columns. Filter raw lineitem columns before this, so that they reach the scan."""
    return lineitem.select(*(F.expr(e).alias(c) for c, e in LINEITEM_BINDING.items()))
