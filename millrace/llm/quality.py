"""Quality rules as a bitmask ledger.

Every rule is evaluated once, in one pass without a shuffle: the ledger holds a row's measurements and, in one
integer, a bit for each rule that it fails. A policy is a version name and a mask; a row is kept if none of the mask's
bits is set. Ablations come from the counts of rows by bit pattern (2**rules at most) by bitwise aggregation, with no
second look at the texts. Built-in functions only.

A null or empty text has no words and fails too_few_words; repeated rows are judged alike, each by itself; an empty
table gives no rows. Words of any length and texts of any length are measured whole. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, documents

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

#: name -> what fails, over the measurements; a rule's bit is its place.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "4 * n_symbols > n_words",
    "duplicate_lines": "n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE = ("too_few_words", "repeated_words")
POLICIES: dict[str, tuple[str, ...]] = {"base-1": BASE, "web-1": (*BASE, "symbols", "duplicate_lines", "short_words", "long_words")}
CURRENT = "web-1"


def mask(policy: str) -> int:
    return sum(BIT[r] for r in POLICIES[policy])


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the measurements of each row.

    Texts whose windows' 64-bit hashes are not all distinct have the windows sorted, by hash and then by their words, so
    that words decide what is equal. A window's words count once however many found windows cover them.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.select("doc_id", F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("words"), lines.alias("lines"), F.length(F.regexp_replace(t, SPACE, "")).cast("long").alias("word_chars"), F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    windows = F.expr("CASE WHEN size(words) > 2 THEN transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) ELSE CAST(array() AS array<bigint>) END")
    hashed = split.select("doc_id", "words", "word_chars", "n_symbols", F.size("words").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), windows.alias("h"))
    ordered = hashed.withColumn("s", F.expr("CASE WHEN size(array_distinct(h)) < size(h) THEN sort_array(transform(h, (x, i) -> struct(struct(x AS h, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c) AS w, i AS i))) ELSE CAST(array() AS array<struct<w: struct<h: bigint, a: string, b: string, c: string>, i: int>>) END")).drop("h", "words")
    found = ordered.withColumn("p", F.expr("sort_array(transform(filter(s, (x, i) -> (i > 0 AND s[greatest(i - 1, 0)].w = x.w) OR (i < size(s) - 1 AND s[least(i + 1, size(s) - 1)].w = x.w)), x -> x.i))"))
    covered = F.expr("aggregate(p, struct(CAST(0 AS bigint) AS e, CAST(0 AS bigint) AS t), (a, x) -> struct(CAST(x + 3 AS bigint) AS e, CAST(a.t + x + 3 - greatest(x, a.e) AS bigint) AS t), a -> a.t)")
    return found.select("doc_id", "n_words", "n_lines", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Measurements and `failures`, the bits of the rules that each row fails."""
    bits: Column = F.lit(0)
    for name, fails in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(BIT[name])).otherwise(F.lit(0)))
    return measured(docs, text).withColumn("failures", bits)


def keeps(policy: str = CURRENT) -> Column:
    return F.col("failures").bitwiseAND(F.lit(mask(policy))) == 0


def ablations(kept_ledger: DataFrame, policy: str = CURRENT) -> DataFrame:
    """rule, n_failing, n_only (rows that no other rule of the policy fails), n_kept_without."""
    patterns = kept_ledger.groupBy("failures").agg(F.count(F.lit(1)).alias("n"))
    m = mask(policy)
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).alias("bit")) for r in POLICIES[policy])))
    seen = patterns.withColumn("failures", F.col("failures").bitwiseAND(F.lit(m))).select("failures", "n", rules.alias("r")).select("failures", "n", "r.rule", "r.bit")
    return seen.groupBy("rule").agg(
        F.sum(F.when(F.expr("failures & bit != 0"), F.col("n")).otherwise(0)).alias("n_failing"),
        F.sum(F.when(F.expr("failures = bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.expr("failures & ~bit = 0"), F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failures."""
    rows = ledger(documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~keeps("base-1")).alias("base_failed"), keeps().alias("kept"), "failures")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy does to the corpus: rule, n_failing, n_only, n_kept_without."""
    return ablations(ledger(documents(spark, sf_dir)))


OP7_SQL = r"""
WITH w AS (SELECT doc_id, COALESCE(text, '') AS text, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS words,
                  list_filter(string_split(COALESCE(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, row_number() OVER () AS k FROM documents),
g AS (SELECT k, i, list_slice(words, i, i + 2) AS g FROM (SELECT k, words, UNNEST(range(1, len(words) - 1)) AS i FROM w)),
d AS (SELECT k, i FROM (SELECT k, i, COUNT(*) OVER (PARTITION BY k, g) AS n FROM g) WHERE n > 1),
c AS (SELECT k, COUNT(DISTINCT i + o) AS n FROM d, (SELECT UNNEST(range(0, 3)) AS o) GROUP BY k),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(lines) AS BIGINT) AS n_lines,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(COALESCE(c.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN c USING (k)),
b AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (4 * n_symbols > n_words)::INT + 8 * (n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines)::INT
             + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 15 * n_words)::INT AS INT) AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed, failures & 63 = 0 AS kept, failures FROM b
"""

ABLATIONS_SQL = f"""
WITH l AS ({OP7_SQL}), r AS (SELECT * FROM (VALUES {", ".join(f"('{r}', {BIT[r]})" for r in POLICIES[CURRENT])}) v(rule, bit))
SELECT rule, CAST(COUNT(*) FILTER (failures & bit <> 0) AS BIGINT) AS n_failing, CAST(COUNT(*) FILTER (failures = bit) AS BIGINT) AS n_only,
       CAST(COUNT(*) FILTER (failures & ~bit = 0) AS BIGINT) AS n_kept_without FROM l, r GROUP BY rule
"""
