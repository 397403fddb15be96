"""Session defaults used by the command line, the benchmark and the tests."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", app: str = "millrace", **extra: str) -> SparkSession:
    """A local session for tests and the benchmark; on a cluster pass your own session to every function."""
    conf = DEFAULTS | {"spark.master": f"local[{cpus}]", "spark.app.name": app, "spark.driver.memory": "8g"}
    if cpus != "*":
        conf["spark.sql.shuffle.partitions"] = str(cpus)
    session = SparkSession.builder.config(map=conf | extra).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
