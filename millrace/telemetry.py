"""Timing records, speedup figures and their text form."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class QueryMetrics:
    name: str
    seconds: float
    rows_in: int
    rows_matched: int

    @property
    def rows_per_second(self) -> float:
        return self.rows_in / self.seconds if self.seconds > 0 else 0.0

    def report(self) -> str:
        return f"{self.name}: {self.seconds * 1000:.2f} ms, {self.rows_matched} of {self.rows_in} rows, {self.rows_per_second:,.0f} rows/s"


@dataclass(frozen=True)
class Speedup:
    """serial and parallel are seconds of one query in sessions of 1 and `threads` threads."""

    serial: float
    parallel: float
    threads: int

    @property
    def speedup(self) -> float:
        return self.serial / self.parallel if self.parallel > 0 else 0.0

    @property
    def efficiency(self) -> float:
        return self.speedup / self.threads if self.threads > 0 else 0.0


class Timer:
    """with Timer("q", rows) as t: ...; t.metrics(matched)"""

    def __init__(self, name: str, rows_in: int = 0):
        self.name, self.rows_in, self.seconds = name, rows_in, 0.0

    def __enter__(self) -> Timer:
        self._began = time.perf_counter()
        return self

    def __exit__(self, *exc) -> None:
        self.seconds = time.perf_counter() - self._began

    def metrics(self, matched: int) -> QueryMetrics:
        return QueryMetrics(self.name, self.seconds, self.rows_in, matched)


def force(df: DataFrame) -> None:
    """Run the whole plan and discard its rows where they are made."""
    df.write.format("noop").mode("overwrite").save()
