"""Shared pieces: shared-folder tables, salted ranks and connected components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A word's characters: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once an application: they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp()  # the driver's own: its file server hands the archive to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, f"{package.name}-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


_held: dict[str, dict] = {}


def cache(name: str) -> dict:
    """A Python worker's cache for one operator. Workers outlive operators: another's cache is dropped first."""
    if name not in _held:
        _held.clear()
        release()
    return _held.setdefault(name, {})


def release() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def lean(name: str, run):
    """A batch function that drops other operators' caches when it begins and gives its memory back when it ends."""

    def whole(batches):
        cache(name)
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that spark.checkpoint.dir names. Where it is unset, a local session takes a temporary folder; a cluster has none that all can read."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read again: its lineage ends there, so a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a stored frame that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A table is broadcast up to this size in memory.
BROADCAST_BYTES = 16 << 20


def small(df: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """The frame with a broadcast hint if it, or the stored frame that it is made of, is measured to be small enough."""
    of = df if counted is None else counted
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in of.schema if f.dataType.typeName() in ("string", "binary")]
    row = F.lit(24 + 8 * len(of.columns))
    for t in texts:
        row = row + t
    return F.broadcast(df) if (of.agg(F.sum(row.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES else df


_PLAIN = ("LogicalRelation", "Project", "Filter", "SubqueryAlias")


def _scan_of_files(df: DataFrame) -> bool:
    """Whether the rows are rows of Parquet files, selected and renamed at most."""
    todo = [df._jdf.queryExecution().analyzed()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() not in _PLAIN or not node.deterministic():
            return False
        below = node.children()
        todo += [below.apply(i) for i in range(below.size())]
    try:
        df.select("_metadata.file_path", "_metadata.row_index").schema  # noqa: B018
    except AnalysisException:
        return False
    return "_metadata" not in df.columns


def numbered(df: DataFrame, name: str = "_row") -> DataFrame:
    """The frame with a number for each row, the same in every job that reads it.

    A row's number is its file's (files in the order of their paths) and its place in the file, neither of which depends
    on how files are dealt to tasks. What isn't a plain scan of Parquet files is stored first.
    """
    whole = df if _scan_of_files(df) else stored(df, "numbered")
    held = whole.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    names = held.select("_file").distinct().withColumn("_no", F.row_number().over(W.orderBy("_file")) - 1)
    files = stored(names.withColumnRenamed("_file", "_path"), "files")
    return held.join(small(files), F.col("_file") == F.col("_path")).select(*df.columns, (F.shiftleft(F.col("_no").cast("long"), 40) + F.col("_place")).alias(name))


def renamed(df: DataFrame, *keep: str) -> DataFrame:
    """The frame with all columns but those to keep under names that clash with nothing; df.columns restores them by toDF."""
    return df.toDF(*(c if c in keep else f"_own{i}" for i, c in enumerate(df.columns)))


def scan_bytes(df: DataFrame) -> int:
    """The size of what a frame reads, as the optimizer knows it: for scans that of their files; no job is run."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def ranked(df: DataFrame, keys: list[str], order: list[Column], salt: Column, name: str = "rank") -> DataFrame:
    """Dense 0-based rank of each row among the rows of its keys, without a task that holds all rows of a key.

    Rows are numbered within (keys, salt); a prefix sum over the (keys, salt) counts, one row for each, gives where
    each salt begins. The order is by salt, then by `order`. The offsets are broadcast if they are BROADCAST_BYTES at
    most, else joined by shuffle.
    """
    salted = df.withColumn("_salt", salt)
    by = [*keys, "_salt"]
    counts = salted.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(*by, (F.sum("_n").over(W.partitionBy(*keys).orderBy("_salt")) - F.col("_n")).alias("_before"))
    at = salted.withColumn("_at", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    before = stored(before, "offsets")
    named = before.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), "_before")
    same = [at[c].eqNullSafe(named[f"_k{i}"]) for i, c in enumerate(by)]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return at.join(small(named, before), on).withColumn(name, (F.col("_before") + F.col("_at") - 1).cast("long")).drop("_salt", "_before", "_at", *(f"_k{i}" for i in range(len(by))))


#: A key is hot with more rows than this, and with more than one in HOT_SHARE of all, so that there are HOT_SHARE hot keys at most.
HOT_ROWS, HOT_SHARE = 1000, 100_000


def named_by(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Stored rows left-joined with the stored names of their keys (one row a key), where one key may hold a third of all rows.

    Rows of hot keys stay where they are and meet a broadcast of these keys' names, HOT_SHARE at most; the rest is shuffled.
    """
    least = max(HOT_ROWS, rows.count() // HOT_SHARE)
    hot = F.broadcast(stored(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > least).select(key), "hot"))
    few = F.broadcast(stored(names.join(hot, key, "left_semi"), "names"))
    columns = [*rows.columns, *(c for c in names.columns if c != key)]
    kept = rows.join(hot, key, "left_semi").join(few, key, "left").select(*columns)
    return kept.union(rows.join(hot, key, "left_anti").join(names, key, "left").select(*columns))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge list (a, b), component being its smallest node.

    Alternating large-star and small-star rounds; each is two aggregations of minima and joins, so that no task
    gathers a node's neighbours, and each is written to the shared folder. Raises if it hasn't ended by max_rounds.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links")
    mark = None
    for _ in range(max_rounds):
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = large.join(least, F.col("a") == F.col("k")).select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a != b").distinct()
        then = stored(small, "links")
        dropped(now)
        now = then
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
