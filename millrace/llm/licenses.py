"""License scan: phrase places, and an exact set-similarity join of text blocks with license templates.

A block is a passage of as many consecutive words as some template has, starting at a template's word, within a paragraph:
passages run over line ends (comment marks are no words), so that wrapped notices are found, but not over a line without
words. A template is found in a passage of its length or shorter that holds at least `threshold` of its distinct words.
Words are put in one global order, rarest in the corpus first, and three filters leave few pairs to verify: length (a
block needs as many template words as the least that the threshold asks for, and has no more words than the template),
prefix (overlap of a needs one of the first |T| - a + 1 words of the template among the first |B| - a + 1 of the block) and
position (what is left of both after the words that meet must still reach a). The filters lose nothing; pairs left are
verified by intersection.

Each text is split into words once. A text that as a whole lacks the words that every template needs has no such passage,
and one without all of a phrase's words no phrase; only texts that pass, in full, are looked at further. Word frequencies are
counted over all rows; one number for each template word (their union is fixed and small) reaches the driver. The
templates are broadcast: their number does not depend on the data. Built-in functions only.

A null text is empty: no words, null first_word and last_word, empty labels, score 0. Repeated rows are scanned each
by itself; an empty table gives no rows; extra columns are ignored; texts and lines of any length are read whole.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, small, stored

# The phrases and labels of the base scan.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Public license statements and the labels that they stand for.
TEMPLATES = {
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-notice",
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-notice",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit-grant",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software": "zlib",
    "this program and the accompanying materials are made available under the terms of the eclipse public license": "epl",
    "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work": "cc0",
}
THRESHOLD = 0.8

#: Characters of words in the text as it is (only A-Z are lower-cased), and those between words.
IN, OUT = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def phrase_pattern(phrases) -> str:
    """Zero-width places where a phrase's words stand consecutively, so that overlapping places all count."""
    each = "|".join(f"{OUT}+".join(map(re.escape, p.split(" "))) for p in phrases)
    return f"(?i)(?<!{IN})(?=(?:{each})(?!{IN}))"


def _words(upto) -> F.Column:
    return F.regexp_count(upto, F.lit(f"{IN}+")).cast("long")


def base_columns(phrases: dict[str, str]) -> dict[str, F.Column]:
    """n_base, first_word, last_word and base (an array of labels) of a text; null text: none."""
    pattern = phrase_pattern(phrases)
    places = F.coalesce(F.regexp_count(F.col("text"), F.lit(pattern)), F.lit(0)).cast("long")
    some = F.col("n_base") > 0
    # The text up to the last place: what a greedy match takes before it.
    first = F.when(some, _words(F.expr(f"substring(text, 1, regexp_instr(text, r'{pattern}') - 1)")))
    last = F.when(some, _words(F.regexp_extract("text", f"(?s)^(.*){pattern}", 1)))
    labels = F.array_compact(F.array(*(F.when(some & F.col("text").rlike(phrase_pattern([p])), F.lit(label)) for p, label in phrases.items())))
    return {"n_base": places, "first_word": first, "last_word": last, "base": labels}


def least_overlap(n: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * n - 1e-9))


def template_matches(scanned: DataFrame, blocked: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    """row_id, label, containment of every block and template that meet the threshold; scanned has every text's vocabulary, blocked row_id and blocks (b, an array of distinct template words, and width, the words of a passage)."""
    spark = scanned.sparkSession
    sets = {t: sorted(set(t.split(" "))) for t in templates}
    counted = {r.w: r.n for r in scanned.select(F.explode("vocabulary").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted({w for s in sets.values() for w in s}, key=lambda w: (counted.get(w, 0), w))
    place = {w: i + 1 for i, w in enumerate(order)}
    rows = []
    for t, words in sets.items():
        tokens, a = sorted(place[w] for w in words), least_overlap(len(words), threshold)
        rows += [(k, p, a, len(t.split(" ")), len(tokens), tokens, templates[t]) for p, k in enumerate(tokens[: len(tokens) - a + 1])]
    prefixes = F.broadcast(spark.createDataFrame(rows, "token int, t_at int, need int, t_words int, t_size int, t_tokens array<int>, label string"))
    at = F.lit(order)
    blocks = blocked.select("row_id", F.explode("blocks").alias("s")).select("row_id", "s.width", F.array_sort(F.transform("s.b", lambda w: F.array_position(at, w).cast("int"))).alias("b"))
    pairs = blocks.select("row_id", "width", "b", F.posexplode("b").alias("b_at", "token")).join(prefixes, "token")
    # The first token that both prefixes share decides a pair, so it is verified once.
    meet = F.col("b_at") <= F.size("b") - F.col("need")
    left = F.least(F.size("b") - F.col("b_at"), F.col("t_size") - F.col("t_at")) >= F.col("need")
    both = F.array_intersect("b", "t_tokens")
    same = pairs.where((F.size("b") >= F.col("need")) & (F.col("width") <= F.col("t_words")) & meet & left).where((both[0] == F.col("token")) & (F.size(both) >= F.col("need")))
    return same.select("row_id", "label", (F.size(both) / F.col("t_size")).alias("containment"))


def _enough(words, template: list[str], threshold: float):
    return F.size(F.array_intersect(words, F.lit(template))) >= least_overlap(len(template), threshold)


def passages(templates: dict[str, str], threshold: float):
    """The blocks of a text whose vocabulary some template allows: distinct sets of template words with their width."""
    sets = [(len(t.split(" ")), sorted(set(t.split(" ")))) for t in templates]
    longest, union = max(n for n, _ in sets), sorted({w for _, t in sets for w in t})

    def line(x):
        words = F.filter(F.split(x, f"{OUT}+"), lambda w: w != "")
        return F.when(F.size(words) > 0, words).otherwise(F.array_repeat(F.lit(""), longest))  # no passage spans it

    def of(n: int, t: list[str]):
        starts = F.filter(F.sequence(F.lit(1), F.size("stream")), lambda i: F.array_contains(F.lit(t), F.element_at("stream", i)))
        found = F.transform(starts, lambda i: F.array_sort(F.array_intersect(F.slice("stream", i, F.lit(n)), F.lit(union))))
        long_enough = F.filter(F.array_distinct(found), lambda b: F.size(b) >= least_overlap(len(t), threshold))
        return F.when(_enough("vocabulary", t, threshold), F.transform(long_enough, lambda b: F.struct(b.alias("b"), F.lit(n).alias("width"))))

    stream = F.flatten(F.transform(F.split(F.translate("text", UPPER, LOWER), "\n"), line))
    return stream, F.flatten(F.array_compact(F.array(*(of(n, t) for n, t in sets))))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base (labels of phrases), found (labels of both), score."""
    sets = [sorted(set(t.split(" "))) for t in templates]
    union, least = sorted(set().union(*sets)), min(least_overlap(len(s), threshold) for s in sets)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row_id", F.monotonically_increasing_id())
    # Lower case by Unicode only widens what is looked at further, and cuts words at the same places.
    split = rows.withColumn("low", F.lower("text")).withColumn("words", F.split("low", f"{OUT}+"))
    ends = (F.element_at("words", 1) == "").cast("int") + ((F.size("words") > 1) & (F.element_at("words", -1) == "")).cast("int")
    phrase = F.lit(False)
    for p in phrases:
        every = F.lit(True)
        for w in sorted(p.split(" "), key=len, reverse=True):
            every = every & F.contains("low", F.lit(w))
        phrase = phrase | every
    cut = split.select("row_id", "doc_id", "text", (F.size("words") - ends).cast("long").alias("n_words"), phrase.alias("phrase"), F.array_intersect("words", F.lit(union)).alias("vocabulary"))
    template = F.lit(False)
    for s in sets:
        template = template | _enough("vocabulary", s, threshold)
    template = F.when(F.size("vocabulary") >= least, template).otherwise(F.lit(False))
    scanned = stored(cut.withColumn("template", template).withColumn("text", F.when(F.col("phrase") | F.col("template"), F.col("text"))), "scan")
    stream, blocks = passages(templates, threshold)
    blocked = stored(scanned.where("template").withColumn("stream", stream).select("row_id", blocks.alias("blocks")), "blocks")
    best = template_matches(scanned, blocked, templates, threshold).groupBy("row_id").agg(F.max("containment").alias("score"), F.collect_set("label").alias("more"))
    kept = stored(best, "matches")
    columns = base_columns(phrases)
    based = scanned.withColumn("text", F.when(F.col("phrase"), F.col("text"))).withColumn("n_base", columns.pop("n_base")).withColumns(columns)
    out = based.select("row_id", "doc_id", "n_words", "n_base", "first_word", "last_word", "base").join(small(kept), "row_id", "left")
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base", F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))).alias("found"), F.coalesce("score", F.lit(0.0)).alias("score"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""

    def joined(c: str):
        return F.array_join(F.array_sort(F.array_distinct(c)), ",")

    return scan(documents(spark, sf_dir)).select("doc_id", "n_words", "n_base", "first_word", "last_word", joined("base").alias("base_labels"), joined("found").alias("labels"), "score")


def _sql() -> str:
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in PHRASES.items())
    templates = ", ".join(f"('{t}', '{label}')" for t, label in TEMPLATES.items())
    w = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, translate(COALESCE(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents),
w AS (SELECT k, doc_id, text, regexp_extract_all(text, '{w}') AS words FROM d),
p AS (SELECT string_split(p, ' ') AS p, label FROM (VALUES {phrases}) v(p, label)),
hits AS (SELECT w.k, i, p.label FROM w, p, LATERAL (SELECT UNNEST(range(1, len(w.words) - len(p.p) + 2)) AS i) WHERE words[i] = p.p[1] AND list_slice(words, i, i + len(p.p) - 1) = p.p),
b AS (SELECT k, CAST(COUNT(*) AS BIGINT) AS n_base, CAST(MIN(i) - 1 AS BIGINT) AS first_word, CAST(MAX(i) - 1 AS BIGINT) AS last_word, list(DISTINCT label) AS base FROM hits GROUP BY k),
t AS (SELECT list_distinct(string_split(t, ' ')) AS t, len(string_split(t, ' ')) AS n, label FROM (VALUES {templates}) v(t, label)),
l AS (SELECT k, i, regexp_extract_all(line, '{w}') AS words FROM (SELECT k, UNNEST(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)),
g AS (SELECT k, i, words, SUM(CAST(len(words) = 0 AS INT)) OVER (PARTITION BY k ORDER BY i) AS para, COALESCE(SUM(len(words)) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l),
o AS (SELECT k, para, before + j AS at, w FROM (SELECT k, para, before, UNNEST(words) AS w, generate_subscripts(words, 1) AS j FROM g)),
x AS (SELECT o.*, t.label, t.n, len(t.t) AS size FROM o JOIN (SELECT UNNEST(t) AS w, t.* FROM t) t USING (w)),
m AS (SELECT a.k, a.label, COUNT(DISTINCT b.w) / CAST(any_value(a.size) AS DOUBLE) AS c FROM x a JOIN x b ON a.k = b.k AND a.para = b.para AND a.label = b.label AND b.at >= a.at AND b.at < a.at + a.n
      GROUP BY a.k, a.label, a.at HAVING COUNT(DISTINCT b.w) >= greatest(1, ceil({THRESHOLD} * any_value(a.size) - 1e-9))),
s AS (SELECT k, MAX(c) AS score, list(DISTINCT label) AS more FROM m GROUP BY k)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, COALESCE(n_base, 0) AS n_base, first_word, last_word, COALESCE(array_to_string(list_sort(base), ','), '') AS base_labels,
       COALESCE(array_to_string(list_sort(list_distinct(list_concat(COALESCE(base, []), COALESCE(more, [])))), ','), '') AS labels, COALESCE(score, 0) AS score
FROM w LEFT JOIN b USING (k) LEFT JOIN s USING (k)
"""


OP9_SQL = _sql()
