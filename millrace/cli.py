"""python -m millrace.cli: inspect a sales CSV, print its morsels and run the ten-query suite in one thread and in several.

A data path that doesn't exist is an error; the default is where the published samples are kept.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from . import functions as fn
from . import operators as op
from .session import local_session
from .sources import read_csv_lenient, table_stats
from .telemetry import QueryMetrics, Speedup, Timer

# Fixed value: where the published samples are kept.
DATA = "data/sample/sales_250k.csv"

#: The suite at the thresholds of a table whose quantities run to 100.
SUITE = {
    "Q1": lambda t: t.agg(fn.agg_count()),
    "Q2": lambda t: t.where(fn.quantity_and_category(50, 10)).agg(fn.agg_count()),
    "Q3": lambda t: t.where(fn.quantity_gt(50)).agg(*fn.agg_price()),
    "Q4": lambda t: op.group_by_category(t, ordered=True, few=True),
    "Q5": lambda t: t.where(fn.category_eq(1)).agg(fn.agg_net_sales(), fn.agg_count()),
    "Q6": lambda t: t.where(fn.quantity_gt(90)).agg(fn.agg_count()),
    "Q7": lambda t: t.where(fn.quantity_and_category(20, 5)).agg(*fn.agg_price()),
    "Q8": lambda t: op.group_by_category(t, fn.quantity_gt(50), ordered=True, few=True),
    "Q9": lambda t: t.agg(fn.agg_net_sales()),
    "Q10": lambda t: t.where(fn.category_eq(20)).agg(fn.agg_sum_quantity(), fn.agg_count()),
}


def run_suite(table: DataFrame, warm: int = 0) -> list[QueryMetrics]:
    """Metrics of the ten queries, each after `warm` runs of it; matched rows are those of the selection, or the whole table where there is none."""
    rows, out = table.count(), []
    for name, plan in SUITE.items():
        for _ in range(warm):
            plan(table).collect()
        with Timer(name, rows) as t:
            made = plan(table).collect()
        out.append(t.metrics(rows if name in {"Q4", "Q9"} else sum(r.cnt for r in made)))
    return out


def ingested(threads: int, path: str) -> tuple[SparkSession, DataFrame, QueryMetrics]:
    """A session of so many threads with the table held in memory, and what reading it took."""
    spark = local_session(threads)
    with Timer("ingest") as t:
        table = read_csv_lenient(spark, path).cache()
        t.rows_in = table.count()
    return spark, table, t.metrics(t.rows_in)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="millrace", description=__doc__)
    p.add_argument("-d", "--data", default=DATA, help="CSV file or folder")
    p.add_argument("-m", "--morsel-size", type=int, default=op.scan.DEFAULT_MORSEL, help="for the printed morsels only")
    p.add_argument("-i", "--inspect", type=int, default=5, help="first rows to show")
    p.add_argument("-t", "--threads", type=int, default=4)
    p.add_argument("--run-queries", action="store_true", help="the default")
    p.add_argument("--no-queries", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    args, _ = parser().parse_known_args(argv)
    serial = None
    if not args.no_queries:
        spark, table, _ = ingested(1, args.data)
        serial = run_suite(table, warm=1)
        spark.stop()
    spark, table, read = ingested(args.threads, args.data)
    print(read.report())
    print(f"footprint: {table_stats(table)['size_bytes'] / 2**20:.2f} MB")
    table.show(args.inspect)
    op.morsels(spark, read.rows_in, args.morsel_size).show()
    if serial:
        for one, many in zip(serial, run_suite(table, warm=1), strict=True):
            gain = Speedup(one.seconds, many.seconds, args.threads)
            print(f"{many.report()}; serial {one.seconds * 1000:.2f} ms, speedup {gain.speedup:.2f}, efficiency {gain.efficiency:.2f}")
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
