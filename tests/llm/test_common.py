import random

import pytest
from pyspark.sql import functions as F

from millrace.llm.common import connected_components, dropped, ranked, stored


@pytest.mark.parametrize("kind", ["random", "chain", "star", "none"])
def test_components(sp, kind):
    rng = random.Random(kind)
    edges = {"random": [(rng.randrange(60), rng.randrange(60)) for _ in range(35)], "chain": [(i, i + 1) for i in range(100, 140)], "star": [(7, i) for i in range(200, 260)], "none": [(5, 5)]}[kind]
    lab = {x: x for e in edges for x in e}
    for a, b in edges:
        x, y = lab[a], lab[b]
        lab = {k: min(x, y) if v in (x, y) else v for k, v in lab.items()}
    got = {r.node: r.component for r in connected_components(sp.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in lab.items() if kind != "none" and any(k in e and e[0] != e[1] for e in edges)}


def test_ranks(sp):
    rows = [(i % 3 if i % 7 else None, i // 2) for i in range(500)]
    got = ranked(sp.createDataFrame(rows, "k int, v int"), ["k"], [F.col("v")], F.pmod("v", F.lit(5))).collect()
    by = {}
    for r in got:
        by.setdefault(r.k, []).append((r["rank"], r.v % 5, r.v))
    assert len(got) == 500
    for group in by.values():
        group.sort()
        assert [g[0] for g in group] == list(range(len(group)))
        assert [g[1:] for g in group] == sorted(g[1:] for g in group)


def test_stored(sp):
    a = stored(sp.range(10).toDF("x"), "t")
    assert a.count() == 10 and "spark.checkpoint" not in str(a.inputFiles()) and a.inputFiles()[0].startswith("file:")
    dropped(a)
