"""Every catalogued query against its SQL, values and all."""

import duckdb
import pytest

from millrace.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    return c


def rows(frame):
    return sorted(map(tuple, frame), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    made = got.select(*columns).collect()
    if name not in ORACLE:
        assert made
        return
    want = duck.execute(ORACLE[name])
    order = [c[0] for c in want.description]
    assert sorted(order) == columns
    want = [tuple(r[order.index(c)] for c in columns) for r in want.fetchall()]
    assert len(made) == len(want)
    for a, b in zip(rows(made), rows(want), strict=True):
        assert a == pytest.approx(b, rel=1e-9) if all(isinstance(x, (int, float, type(None))) for x in a) and None not in a else a == b


def test_pushdown(spark):
    plan = QUERIES["q08_filter_group"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,25.0)]" in plan
    assert "l_tax" not in plan.rpartition("ReadSchema")[2]
