"""Temporal URL filter: dated list entries become validity intervals, captures are judged as of their fetch time.

An entry says what a list holds of a host, or of a host and a path prefix, from a date on; the next entry for the same
list, host and path ends it, so each of them has disjoint intervals [from, until). A capture is looked up under its host
and every parent domain, and under every prefix of its path that ends at a slash; the longest listed host decides, then the
longest path, and of lists that hold the same a block beats an allow. Numeric hosts and IPv6 literals have no parents.

Captures are first reduced to distinct (host, path to the depth of the deepest entry, fetch day): what a third of all
captures share is judged once a day. Verdicts are broadcast if they are measured to be small; beyond that they come back by
a join whose hot keys adaptive execution splits. Captures without a host or a time don't enter a join.

A null or unparsable url has a null host, and like a null fetch time is judged `none`; ties are settled by list name; of
one day's entries for the same list, host and path the last by action counts; repeated captures are judged alike; an empty
list leaves all captures at `none`; empty captures give no rows. Extra columns pass through; those named as the verdict's
give way to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small, stored, table

#: The pages table has no fetch time; the query takes this day of 2024 as a page's.
FETCH_DAY = "date_add(DATE'2024-01-01', CAST(pmod(page_id, 366) AS INT))"
#: A backslash ends a host as a slash does; of several @ the last ends the user's part.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#\\]*@)?(\[[^\]/]*\]|[^/?#:@\\]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"
NUMERIC = r"^(\[.*|[0-9.]+)$"
VERDICT = ["host", "verdict", "by_list", "listed_host", "listed_path"]


def host_of(url: str) -> F.Column:
    return F.nullif(F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(".")), F.lit(""))


def validity(entries: DataFrame) -> DataFrame:
    """list, listed_host, listed_path, action, valid_from, valid_until (null: still valid) from dated entries (list, host, path, action, listed_on); "drop" takes a name off its list."""
    by = W.partitionBy("list", "host", "path")
    one = entries.groupBy("list", "host", "path", "listed_on").agg(F.max("action").alias("action"))
    until = one.withColumn("valid_until", F.lead("listed_on").over(by.orderBy("listed_on"))).where("action != 'drop'")
    return until.select("list", F.col("host").alias("listed_host"), F.col("path").alias("listed_path"), "action", F.col("listed_on").alias("valid_from"), "valid_until")


def _prefix(path, depth):
    return F.array_join(F.slice(F.split(path, "/"), F.lit(1), depth + 1), "/")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """captures with host, verdict (block, allow or none), by_list, listed_host and listed_path."""
    intervals = stored(validity(entries), "intervals")
    depth = intervals.agg(F.max(F.size(F.split("listed_path", "/")) - 1)).first()[0] or 0
    own = captures.drop(*VERDICT)
    held = own.withColumns({"host": host_of(url), "_day": F.col(fetched).cast("date"), "_path": _prefix(F.regexp_extract(url, PATH, 1), F.lit(depth))})
    some = F.col("host").isNotNull() & F.col("_day").isNotNull()
    keys = held.where(some).select(F.col("host").alias("_h"), F.col("_path").alias("_p"), F.col("_day").alias("_d")).distinct()
    # Every parent domain, the labels from the i-th on; every prefix of the path, the empty one too.
    parts = F.split("_h", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    names = keys.select("*", F.explode(F.when(F.col("_h").rlike(NUMERIC), F.array("_h")).otherwise(parents)).alias("listed_host"))
    prefixes = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(F.split("_p", "/")) - 1), lambda i: _prefix(F.col("_p"), i)))
    asked = names.select("*", F.explode(prefixes).alias("listed_path"))
    active = (F.col("_d") >= F.col("valid_from")) & (F.col("valid_until").isNull() | (F.col("_d") < F.col("valid_until")))
    valid = asked.join(small(intervals), ["listed_host", "listed_path"]).where(active)
    best = F.max_by(F.struct("action", "list", "listed_host", "listed_path"), F.struct(F.length("listed_host"), F.length("listed_path"), F.col("action") == "block", F.col("list")))
    verdicts = stored(valid.groupBy("_h", "_p", "_d").agg(best.alias("_v")), "verdicts")
    judged = held.where(some).join(small(verdicts), (F.col("host") == F.col("_h")) & (F.col("_path") == F.col("_p")) & (F.col("_day") == F.col("_d")), "left")
    out = judged.select(*own.columns, "host", F.coalesce("_v.action", F.lit("none")).alias("verdict"), F.col("_v.list").alias("by_list"), "_v.listed_host", "_v.listed_path")
    no = F.lit(None).cast("string")
    return out.union(held.where(~some).select(*own.columns, "host", F.lit("none"), no, no, no))


def _digits(name: str, at: int):
    return F.conv(F.substring(F.md5(F.col(name).cast("binary")), at, 2), 16, 10).cast("int")


def rule_entries(hosts: DataFrame) -> DataFrame:
    """Dated entries (list, host, path, action, listed_on) made by rule of the hosts in use, as no list comes with the tables.

    By digits of a host's MD5: some hosts are blocked by `spam` and half of these dropped from it later, some are allowed
    by `trusted`, some are blocked below /en alone; some parent domains are blocked by `adult` and allowed again later.
    """

    def listed(d: DataFrame, where: str, list_: str, path: str, action: str, day) -> DataFrame:
        return d.where(where).select(F.lit(list_).alias("list"), "host", F.lit(path).alias("path"), F.lit(action).alias("action"), F.date_add(F.lit("2024-01-01").cast("date"), day).alias("listed_on"))

    def dealt(d: DataFrame) -> DataFrame:
        return d.withColumns({c: _digits("host", at) for c, at in (("a", 1), ("b", 3), ("c", 5))})

    own = dealt(hosts)
    parents = dealt(hosts.where(~F.col("host").rlike(NUMERIC) & F.col("host").rlike(r"\..*\.")).select(F.regexp_extract("host", r"^[^.]*\.(.*)$", 1).alias("host")).distinct())
    parts = [
        listed(own, "a < 96", "spam", "", "block", F.col("b")),
        listed(own, "a < 96 AND a % 2 = 1", "spam", "", "drop", F.col("b") + 1 + F.col("c") % 60),
        listed(own, "a % 3 = 0", "trusted", "", "allow", F.col("c")),
        listed(own, "a % 4 = 2", "spam", "/en", "block", F.col("c")),
        listed(parents, "a % 2 = 0", "adult", "", "block", F.col("b")),
        listed(parents, "a % 2 = 0", "adult", "", "allow", F.col("b") + 30 + F.col("c")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, fetched, host, verdict, by_list, listed_host, listed_path of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr(FETCH_DAY).alias("fetched"))
    hosts = stored(pages.select(host_of("url").alias("host")).where("host IS NOT NULL").distinct(), "hosts")
    return judge(pages, rule_entries(hosts))


OP5_SQL = f"""
WITH c AS (SELECT row_number() OVER () AS k, page_id, url, CAST(DATE '2024-01-01' + CAST(((page_id % 366) + 366) % 366 AS INT) AS DATE) AS fetched,
             NULLIF(rtrim(lower(regexp_extract(url, '{HOST}', 1)), '.'), '') AS host, regexp_extract(url, '{PATH}', 1) AS path FROM pages),
hs AS (SELECT DISTINCT host FROM c WHERE host IS NOT NULL),
ps AS (SELECT DISTINCT regexp_extract(host, '^[^.]*\\.(.*)$', 1) AS host FROM hs WHERE NOT regexp_matches(host, '{NUMERIC}') AND regexp_matches(host, '\\..*\\.')),
x AS (SELECT *, CAST('0x' || substr(md5(host), 1, 2) AS INT) AS a, CAST('0x' || substr(md5(host), 3, 2) AS INT) AS b, CAST('0x' || substr(md5(host), 5, 2) AS INT) AS c
      FROM (SELECT host, FALSE AS parent FROM hs UNION ALL SELECT host, TRUE FROM ps)),
e AS (SELECT 'spam' AS l, host AS h, '' AS p, 'block' AS a, DATE '2024-01-01' + b AS d FROM x WHERE NOT parent AND a < 96
      UNION ALL SELECT 'spam', host, '', 'drop', DATE '2024-01-01' + (b + 1 + c % 60) FROM x WHERE NOT parent AND a < 96 AND a % 2 = 1
      UNION ALL SELECT 'trusted', host, '', 'allow', DATE '2024-01-01' + c FROM x WHERE NOT parent AND a % 3 = 0
      UNION ALL SELECT 'spam', host, '/en', 'block', DATE '2024-01-01' + c FROM x WHERE NOT parent AND a % 4 = 2
      UNION ALL SELECT 'adult', host, '', 'block', DATE '2024-01-01' + b FROM x WHERE parent AND a % 2 = 0
      UNION ALL SELECT 'adult', host, '', 'allow', DATE '2024-01-01' + (b + 30 + c) FROM x WHERE parent AND a % 2 = 0),
i AS (SELECT l, h, p, a, d AS valid_from, lead(d) OVER (PARTITION BY l, h, p ORDER BY d) AS valid_until FROM e),
m AS (SELECT k, a, l, h, p, row_number() OVER (PARTITION BY k ORDER BY length(h) DESC, length(p) DESC, a = 'block' DESC, l DESC) AS r
      FROM c JOIN i ON (c.host = i.h OR ends_with(c.host, '.' || i.h) AND NOT regexp_matches(c.host, '{NUMERIC}')) AND (p = '' OR path = p OR starts_with(path, p || '/'))
           AND a <> 'drop' AND fetched >= valid_from AND (valid_until IS NULL OR fetched < valid_until))
SELECT page_id, url, fetched, host, COALESCE(a, 'none') AS verdict, l AS by_list, h AS listed_host, p AS listed_path FROM c LEFT JOIN (SELECT * FROM m WHERE r = 1) USING (k)
"""
