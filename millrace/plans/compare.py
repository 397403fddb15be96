"""Run catalogued queries beside DuckDB on the same Parquet files: values first, then times."""

from __future__ import annotations

import json
import math
import os
import sys
from dataclasses import asdict, dataclass
from statistics import median

from pyspark.sql import SparkSession

from ..session import local_session
from ..telemetry import Timer
from .queries import ORACLE, QUERIES


@dataclass(frozen=True)
class Compared:
    query: str
    equal: bool
    rows: int
    spark_ms: float
    duckdb_ms: float


def _same(a: list[tuple], b: list[tuple]) -> bool:
    def close(x, y) -> bool:
        return math.isclose(x, y, rel_tol=1e-9, abs_tol=0.011) if isinstance(x, float) and isinstance(y, float) else x == y

    return len(a) == len(b) and all(all(map(close, x, y)) for x, y in zip(sorted(a, key=repr), sorted(b, key=repr), strict=True))


def compare(spark: SparkSession, sf_dir: str, names: list[str] | None = None, runs: int = 5) -> list[Compared]:
    """Median milliseconds after one warm-up, rows fetched by both, and whether their values agree."""
    import duckdb

    duck, out = duckdb.connect(), []
    for f in sorted(os.listdir(sf_dir)):
        if f.endswith(".parquet"):
            at = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
            duck.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{at}'")
    for name in names or sorted(ORACLE):
        ours, theirs = [], []
        for _ in range(runs + 1):
            with Timer(name) as t:
                frame = QUERIES[name](spark, sf_dir)
                columns = sorted(frame.columns)
                got = [tuple(r) for r in frame.select(*columns).collect()]
            ours.append(t.seconds)
            with Timer(name) as t:
                cursor = duck.execute(ORACLE[name])
                order = [c[0] for c in cursor.description]
                want = cursor.fetchall()
            theirs.append(t.seconds)
        want = [tuple(r[order.index(c)] for c in columns) for r in want]
        out.append(Compared(name, _same(got, want), len(got), round(1000 * median(ours[1:] or ours), 2), round(1000 * median(theirs[1:] or theirs), 2)))
    return out


def markdown(rows: list[Compared]) -> str:
    lines = ["| query | equal | rows | Spark ms | DuckDB ms |", "|-|-|-|-|-|"]
    return "\n".join(lines + [f"| {r.query} | {'yes' if r.equal else 'NO'} | {r.rows} | {r.spark_ms} | {r.duckdb_ms} |" for r in rows]) + "\n"


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    rows = compare(local_session(os.environ.get("BENCH_CPUS", "8")), sf_dir)
    print(markdown(rows))
    print(json.dumps([asdict(r) for r in rows]))
    return int(not all(r.equal for r in rows))


if __name__ == "__main__":
    sys.exit(main())
