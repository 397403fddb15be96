"""Fixtures worked out by hand: readers, switches, morsels, scans, telemetry, command line."""

import math
import subprocess
import sys

import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from millrace import cli
from millrace import functions as fn
from millrace import operators as op
from millrace import sources as src
from millrace.schema import SALES
from millrace.streaming import stream_group_by_category, stream_sales_csv
from millrace.plans.compare import compare, markdown
from millrace.telemetry import QueryMetrics, Speedup

HEADER = "TransactionID,CustomerID,Quantity,Price,Discount,CategoryID,StoreRegion"
# Five sample rows that are published with expected results.
FIVE = [(1, 83811, 15, 42.39, 0.10, 16, "South"), (2, 18290, 95, 158.23, 0.25, 35, "North"), (3, 77398, 55, 52.52, 0.0, 14, "South"), (4, 66238, 78, 44.67, 0.05, 46, "Central"), (5, 54988, 29, 676.57, 0.10, 1, "South")]


@pytest.fixture(scope="module")
def five(spark):
    return spark.createDataFrame(FIVE, SALES)


def test_scalars(five):
    got = five.agg(fn.agg_count(), fn.agg_sum_quantity(), fn.agg_sum_price(), fn.agg_net_sales(digits=None)).first()
    assert (got.cnt, got.sum_quantity) == (5, 272)
    assert got.sum_price == pytest.approx(974.38, rel=1e-6)
    assert got.net_sales == pytest.approx(35703.2765, rel=1e-6)
    kept = five.where(fn.quantity_gt(50)).agg(*fn.agg_price()).first()
    assert tuple(kept) == pytest.approx((3, 255.42, 85.14, 44.67, 158.23), rel=1e-6)
    assert five.where(fn.quantity_gt(90)).count() == 1
    assert five.where(fn.quantity_and_category(50, 10)).count() == 0
    assert [r.category_id for r in op.group_by_category(five, ordered=True).collect()] == [1, 14, 16, 35, 46]


def test_empty_and_nan(spark, five):
    none = five.where("false")
    assert tuple(none.agg(*fn.agg_price()).first()) == (0, None, None, None, None)
    assert tuple(none.agg(*fn.agg_price(empty_as_zero=True)).first()) == (0, 0.0, 0.0, 0.0, 0.0)
    assert op.group_by_category(none).count() == 0
    odd = spark.createDataFrame([(1, 1, 1, math.nan, 0.0, 1, ""), (2, 1, 1, 2.0, 0.0, 1, ""), (3, 1, 1, math.nan, 0.0, 2, "")], SALES)
    plain = {r.category_id: r for r in op.group_by_category(odd).collect()}
    assert plain[1].min_price == 2.0 and math.isnan(plain[1].max_price) and math.isnan(plain[2].min_price)
    skip = {r.category_id: r for r in op.group_by_category(odd, skip_nan=True).collect()}
    assert (skip[1].min_price, skip[1].max_price, skip[2].min_price) == (2.0, 2.0, None)


def test_lenient_csv(spark, tmp_path):
    body = ["1,83811,15,42.39,0.10,16,South", "2,5,12abc,1.5x,0.05,3,North", "3,6,,,0.05,3,North", "4,7,99999999999,2.0,0.05,3,North", "5,8,1,2.0,0.05", "6,9,1,2.0,0.05,3,West,extra", "7,10, 4,+2.0,0.05,3, East", '8,11,3.9,1e2,0.05,3,"Cen,tral"', "", "9,12,-3,nan,0.05,3,", "10,13,3,1e400,0.05,3,inf", "11,14,3,inf,0.05,3,x", "12,15,3,1.0,0.05,3,a\u0001b"]
    path = tmp_path / "a.csv"
    path.write_text(HEADER + "\r\n" + "\r\n".join(body))
    got = {r.transaction_id: r for r in src.read_csv_lenient(spark, str(path)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 6, 7, 8, 9, 10, 11, 12]
    assert (got[2].quantity, got[2].price) == (12, 1.5)
    assert (got[3].quantity, got[3].price) == (0, 0.0)
    assert got[4].quantity == 0
    assert got[6].store_region == "West"
    assert (got[7].quantity, got[7].price, got[7].store_region) == (0, 0.0, " East")
    assert (got[8].quantity, got[8].price, got[8].store_region) == (3, 100.0, '"Cen')
    assert got[9].quantity == -3 and math.isnan(got[9].price) and got[9].store_region == ""
    assert (got[10].price, got[10].store_region) == (0.0, "inf")
    assert got[11].price == math.inf
    assert got[12].store_region == "a\u0001b"
    (tmp_path / "h.csv").write_text(HEADER + "\n")
    assert src.read_csv_lenient(spark, str(tmp_path / "h.csv")).count() == 0
    (tmp_path / "z.csv").write_text("")
    with pytest.raises(ValueError):
        src.read_csv_lenient(spark, str(tmp_path / "z.csv"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        src.read_csv_lenient(spark, str(tmp_path / "no.csv")).count()


@pytest.mark.parametrize(("total", "size", "want"), [(0, 100000, []), (1, 100000, [(0, 1)]), (100000, 100000, [(0, 100000)]), (250000, 100000, [(0, 100000), (100000, 200000), (200000, 250000)]), (60000, 25000, [(0, 25000), (25000, 50000), (50000, 60000)]), (10, 0, [(0, 10)])])
def test_morsels(spark, total, size, want):
    assert [(r.start_row, r.end_row) for r in op.morsels(spark, total, size).orderBy("morsel_id").collect()] == want


def test_scans(spark, five, tmp_path):
    five.coalesce(1).write.parquet(str(tmp_path / "t"))
    numbered = op.with_row_id(src.read_sales_parquet(spark, str(tmp_path / "t")))
    assert op.get_row(numbered, 1).customer_id == 18290
    with pytest.raises(IndexError):
        op.get_row(numbered, 5)
    assert op.scan_range(numbered, 3, 99).count() == 2 and op.scan_range(numbered, 9, 99).count() == 0
    assert op.scan_morsel(numbered, 1, 2).count() == 2
    seen = []
    op.for_each(numbered, seen.append)
    assert seen == [0, 1, 2, 3, 4]
    op.for_each_partition(numbered, lambda rows: list(rows))
    assert op.head(numbered, 2, "row_id").count() == 2
    assert src.table_stats(five)["rows"] == 5
    assert {r.n_rows for r in op.partition_rows(five.coalesce(1)).collect()} == {5}
    assert five.where(fn.row_predicate(lambda q: q > 50, "quantity")).count() == 3
    assert five.where(fn.arrow_predicate(lambda q, c: pc.greater(pc.multiply(q, c), 300), "quantity", "category_id")).count() == 3


def test_positions_over_several_files(spark, tmp_path):
    rows = src.generate_sales(spark, 1000, partitions=1)
    path = str(tmp_path / "many")
    for k in range(4):
        rows.where(f"transaction_id > {250 * k} AND transaction_id <= {250 * (k + 1)}").write.mode("append").parquet(path)
    table = src.read_sales_parquet(spark, path)
    assert len(table.inputFiles()) == 4
    numbered = op.with_row_id(table)
    assert sorted(r.row_id for r in numbered.select("row_id").collect()) == list(range(1000))
    parts = [op.scan_morsel(numbered, k, 300).select("row_id").collect() for k in range(4)]
    assert [len(p) for p in parts] == [300, 300, 300, 100] and len({r for p in parts for r in p}) == 1000
    assert op.scan_range(numbered, 0, 100).count() == 100 == op.first_rows(numbered, 100).count()
    assert op.get_row(numbered, 600) == op.get_row(op.with_row_id(table, *table.columns), 600)
    one = sorted((r.row_id, r.transaction_id) for r in numbered.collect())
    files = [sorted(x) for x in zip(*[iter(t for _, t in one)] * 250, strict=True)]
    assert sorted(files) == [list(range(250 * k + 1, 250 * k + 251)) for k in range(4)]  # a file's rows stand together


def test_lenient_folder(spark, five, tmp_path):
    src.write_sales_csv(five.repartition(2), str(tmp_path / "in"))
    assert src.read_csv_lenient(spark, str(tmp_path / "in")).count() == 5
    assert src.read_raw(spark, str(tmp_path / "in")).agg(F.sum("length")).first()[0] > 100
    (tmp_path / "in" / "part-empty.csv").write_text("")
    with pytest.raises(ValueError, match="empty file"):
        src.read_csv_lenient(spark, str(tmp_path / "in"))


def test_generator_and_append(spark):
    a, b = src.generate_sales(spark, 1000, partitions=2), src.generate_sales(spark, 1000, partitions=5)
    assert a.exceptAll(b).count() == 0 and a.schema == SALES or a.columns == SALES.fieldNames()
    r = a.agg(F.min("quantity"), F.max("quantity"), F.min("price"), F.max("price"), F.max("category_id")).first()
    assert r[0] >= 1 and r[1] <= 100 and r[2] >= 5 and r[3] <= 1500 and r[4] <= 50
    assert src.append_rows(a, [(1, 2, 3, 4.0, 0.1, 5, "x")]).count() == 1001


def test_streaming(spark, five, tmp_path):
    src.write_sales_csv(five, str(tmp_path / "in"))
    q = stream_group_by_category(stream_sales_csv(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("groups").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.table("groups").count() == 5


def test_telemetry_and_cli(spark, five):
    assert QueryMetrics("q", 2.0, 10, 3).rows_per_second == 5
    assert Speedup(8.0, 2.0, 8).speedup == 4 and Speedup(8.0, 2.0, 8).efficiency == 0.5 and Speedup(1.0, 0.0, 4).speedup == 0
    assert [m.rows_matched for m in cli.run_suite(five)] == [5, 0, 3, 5, 1, 1, 0, 3, 5, 0]
    assert cli.parser().parse_known_args(["-d", "x", "--unknown"])[0].threads == 4


def test_cli_reports_speedup(tmp_path):
    (tmp_path / "a.csv").write_text("\n".join([HEADER, *(",".join(map(str, r)) for r in FIVE)]))
    out = subprocess.run([sys.executable, "-m", "millrace.cli", "-d", str(tmp_path / "a.csv"), "-t", "2"], capture_output=True, text=True, timeout=300, check=True).stdout
    assert out.count("efficiency") == 10 and "footprint" in out and "ingest" in out


def test_compare(spark):
    rows = compare(spark, "/root/testdata/sf0.001", ["q01_count", "q08_filter_group"], runs=1)
    assert [r.equal for r in rows] == [True, True]
    assert "q08_filter_group" in markdown(rows)
