"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected as often as the source's target goes into its size. The prefix sum of these
expected copies within the source, shifted by one random offset in [0, 1), passes integers; a document is emitted once for
each that it crosses. Documents are laid out by size (its number of binary digits, then a salt, then the size
itself), so that each stretch of the sum has short and long ones and one offset brings the words taken near the target.

The prefix sum is a rank times a rate, and ranks are dealt over (source, digits, salt): no task holds a source. Salts hash
the row's id and text, and there are more of them in larger tables. One row a source is ordered in one task.

A null text has size 0; a null source is a source, the last; documents of one size are in the order of salt, id (null
first) and text, so that reruns agree; wholly equal rows are drawn each for itself and are told apart by nothing; texts of
any length count whole; an empty table gives no rows; a source without words has target and takes 0. Extra columns pass
through mix() under any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, documents, ranked, renamed, small, stored

WEIGHTS, MOST, SEED = (1, 2, 3), 3, "mix-1"
#: Salts at least, and rows for each salt in larger tables.
SALTS, SALTED = 256, 1 << 16


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target from rows of (source, size).

    With sources in the order of cap over weight, a source is at its cap if its share of what the sources before it
    leave is above it, and then so are all before it: one pass of window sums settles the resharing.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = s.withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * most)
    by = W.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    every = W.partitionBy()
    s = s.withColumns({"total": F.sum("source_size").over(every), "left_w": F.sum("w").over(every) - F.sum("w").over(by) + F.col("w"), "before": F.sum("cap").over(by) - F.col("cap")})
    s = s.withColumn("full", (F.col("total") - F.col("before")) * F.col("w") > F.col("cap") * F.col("left_w"))
    spent, open_w = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0)), F.sum(F.when(~F.col("full"), F.col("w"))).over(every)
    share = (F.col("w") * (F.col("total") - spent)).cast("double") / open_w.cast("double")
    return s.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def _digits(text, n: int):
    """The first n hexadecimal digits of a text's MD5 as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, n), 16, 10).cast("long")


def _offset():
    """The source's random number in [0, 1)."""
    return _digits(F.concat(F.lit(f"{SEED}-"), F.coalesce("source", F.lit(""))), 6).cast("double") / 16777216.0


def sizes_of(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, mark (of the text)."""
    return docs.select("doc_id", "source", word_count().alias("size"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("mark"))


def with_copies(sized: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows (doc_id, source, size, mark and more) with source_size, target and copies, by the stored sizes of the same rows."""
    targets = stored(source_targets(sizes.select("source", "size")).withColumn("offset", _offset()), "targets")
    salts = max(SALTS, -(-sizes.count() // SALTED))
    salt = F.length(F.bin("size")) * F.lit(salts).cast("long") + _digits(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("-"), "mark"), 8) % salts
    named = targets.withColumnRenamed("source", "_source")
    placed = ranked(sized, ["source"], [F.col("size"), F.col("doc_id"), F.col("mark")], salt).join(small(named, targets), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = F.floor((F.col("rank") + 1) * rate + F.col("offset")) - F.floor(F.col("rank") * rate + F.col("offset"))
    return placed.withColumn("copies", crossed.cast("int")).drop("rank", "offset", "mark")


def mix(docs: DataFrame) -> DataFrame:
    """The columns of docs, each row as often as the mix takes it."""
    own = renamed(docs, "doc_id", "source", "text")
    sizes = stored(sizes_of(own), "sizes")
    sized = own.withColumns({"size": word_count(), "mark": F.md5(F.coalesce("text", F.lit("")).cast("binary"))})
    taken = with_copies(sized, sizes).where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select(*own.columns).toDF(*docs.columns)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    sizes = stored(sizes_of(documents(spark, sf_dir)), "sizes")
    return with_copies(sizes, sizes).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP6_SQL = r"""
WITH sized AS (SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(COALESCE(text, '')) AS mark FROM documents),
n AS (SELECT greatest(256, CAST(ceil(COUNT(*) / 65536.0) AS BIGINT)) AS salts FROM sized),
s0 AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
s1 AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, 3 * source_size AS cap FROM s0),
s2 AS (SELECT *, SUM(source_size) OVER () AS total, SUM(w) OVER () - SUM(w) OVER o + w AS left_w, SUM(cap) OVER o - cap AS before
       FROM s1 WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST)),
s3 AS (SELECT *, (total - before) * w > cap * left_w AS is_full FROM s2),
s4 AS (SELECT *, COALESCE(SUM(CASE WHEN is_full THEN cap END) OVER (), 0) AS spent, SUM(CASE WHEN NOT is_full THEN w END) OVER () AS open_w FROM s3),
t AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE CAST(w * (total - spent) AS DOUBLE) / CAST(open_w AS DOUBLE) END AS target FROM s4),
r AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
             CAST(CAST('0x' || substr(md5('mix-1-' || COALESCE(d.source, '')), 1, 6) AS INT) AS DOUBLE) / 16777216.0 AS u,
             row_number() OVER (PARTITION BY d.source ORDER BY length(bin(d.size)) * salts + CAST('0x' || substr(md5(COALESCE(CAST(d.doc_id AS VARCHAR), '') || '-' || d.mark), 1, 8) AS BIGINT) % salts, d.size, d.doc_id NULLS FIRST, d.mark) - 1 AS rnk
      FROM sized d JOIN t ON d.source IS NOT DISTINCT FROM t.source, n)
SELECT doc_id, size, source_size, target, CAST((floor((rnk + 1) * rate + u) - floor(rnk * rate + u)) * size AS BIGINT) AS taken FROM r
"""
