"""The built-in function operators: SQL on a small table of odd rows, and what they must not do."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import licenses, mixing, quality, urlfilter
from millrace.llm.registry import oracle_sql, queries

ODD = [
    (1, None, "en", None, 0), (2, "", "en", "b", 0), (3, " \t\x0b\n", "de", "b", 0), (4, "a b c a b c a b c " * 20, "en", "a", 0), (4, "a b c a b c a b c " * 20, "en", "a", 0),
    (5, "x\ny\nx\n \nx ###", "en", "é", 0), (6, "Licensed under the Apache License, Version 2.0.\nCC-BY MIT  License", None, "a", 0), (7, "GNU General\nPublic License license licensed under cc by nc 4", "en", "z", 0),
    (8, "w" * 50_000, "en", "a", 0), (9, "word " * 30_000, "en", "a", 0), (10, "éa|b|é #$%    x mit LICENSEé mit license", "fr", "b", 0), (11, "gnu general public license gnu general public license cc by cc by", "en", "b", 0),
    (None, "the null id row has some words", "en", "c", 0), (12, "one two three four one two three five " + "filler%d " * 3 + "q" * 3, "en", "c", 0), (13, "İ K mıt license cc by", "en", "\U0001f600", 0),
    (14, "permission is hereby granted, free of charge, to any person obtaining a copy of the software and associated documentation", "en", "c", 0),
]
PAGES = [(1, "http://m.casino-win.example.com/x", ""), (2, None, ""), (2, None, ""), (3, "not a url", ""), (500, "https://u@CASINO-win.example.com.:80?q", ""), (None, "http://tionsh.example.net", ""), (250, "http://m.tiontion.example.com", ""), (250, "http://m.tiontion.example.com", ""), (-5, "http://x.tiontion.example.com/en/7", "")]
PAGES += [(300 + i, f"http://{h}/{p}", "") for i, (h, p) in enumerate((h, p) for h in ("a.example.org", "b.a.example.org", "c.example.net", "[::1]:80", "10.0.0.1", "u:p@q@d.example.net", "x\\@evil.example") for p in ("", "en", "en/1", "english", "?en"))]


@pytest.fixture(scope="module")
def odd(sp, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    sp.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS size", "2 AS words", "3 AS n_words", "4 AS copies", "5 AS target").coalesce(1).write.parquet(f"{d}/documents.parquet")
    sp.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS verdict").coalesce(1).write.parquet(f"{d}/pages.parquet")
    return d


def same(sp, d, name, files=""):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet{files}'")
    cur = c.execute(oracle_sql()[name])
    columns = [x[0] for x in cur.description]
    want = sorted(map(repr, cur.fetchall()))
    got = queries()[name](sp, d)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == want


@pytest.mark.parametrize("name", sorted(set(oracle_sql()) - {"pipeline"}))
def test_odd_rows(sp, odd, name):
    same(sp, odd, name, "/*.parquet")


@pytest.mark.parametrize("name", sorted(set(oracle_sql()) - {"pipeline"}))
def test_tables(sp, name):
    same(sp, "/root/testdata/sf0.001", name)


@pytest.mark.parametrize("name", ["op5_url_filter", "op6_source_mixing", "op7_quality_rules", "op9_license_scan"])
def test_empty(sp, odd, tmp_path, name):
    for t in ("documents", "pages"):
        sp.read.parquet(f"{odd}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries()[name](sp, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["op7_quality_rules", "op9_license_scan"])
def test_no_python(sp, odd, name):
    plan = queries()[name](sp, odd)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct"))


def test_targets(sp):
    """Against the resharing done step by step."""
    sizes = {"a": 1000, "b": 10, "c": 500, "d": 3, "e": 0, "f": 40, None: 700}
    names = sorted(s for s in sizes if s) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left, w = total - sum(3 * sizes[s] for s in full), sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and left * weight[s] / w > 3 * sizes[s]}
        if not over:
            break
        full |= over
    want = {s: 3.0 * sizes[s] if s in full else left * weight[s] / w for s in names}
    got = {r.source: r.target for r in mixing.source_targets(sp.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    assert got == pytest.approx(want)


def test_mix(sp):
    d = sp.createDataFrame([(i, "w " * (1 + i % 7), "ab"[i % 5 == 0], i) for i in range(3000)], "doc_id long, text string, source string, size long")
    got = mixing.mix(d)
    assert got.columns == d.columns
    taken = {r.source: r.n for r in got.selectExpr("source", "size(split(trim(text), ' ')) AS n").groupBy("source").agg({"n": "sum"}).toDF("source", "n").collect()}
    aim = {r.source: r.target for r in mixing.source_targets(d.selectExpr("source", "size(split(trim(text), ' ')) AS size")).collect()}
    assert all(abs(taken[s] - aim[s]) < 40 for s in aim)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mixing.mix(d.repartition(7)).collect()))


def test_ablations(sp):
    rows = sp.createDataFrame([(b,) for b in (0, 0, 1, 3, 4, 12, 64)], "failures int")
    got = {r.rule: r for r in quality.ablations(rows).collect()}
    assert (got["too_few_words"].n_failing, got["too_few_words"].n_only, got["too_few_words"].n_kept_without) == (2, 1, 4)
    assert (got["symbols"].n_failing, got["symbols"].n_only, got["symbols"].n_kept_without) == (2, 1, 4)
    assert got["long_words"].n_kept_without == 3


ENTRIES = [("spam", "example.org", "", "block", "2024-01-10"), ("spam", "example.org", "", "drop", "2024-03-01"), ("trusted", "a.example.org", "", "allow", "2024-02-01"), ("spam", "a.example.org", "/x", "block", "2024-01-01"), ("spam", "0.0.1", "", "block", "2023-01-01"), ("spam", "[::1]", "", "block", "2023-01-01")]


def test_judge(sp):
    e = sp.createDataFrame(ENTRIES, "list string, host string, path string, action string, listed_on string").withColumn("listed_on", F.to_date("listed_on"))
    assert [(str(r.valid_from), str(r.valid_until)) for r in urlfilter.validity(e).where("listed_host = 'example.org'").collect()] == [("2024-01-10", "2024-03-01")]
    asked = {
        ("http://b.example.org/", "2024-01-09"): "none", ("http://b.example.org/", "2024-01-10"): "block", ("http://b.example.org/", "2024-03-01"): "none", ("http://a.example.org/y", "2024-02-01"): "allow", ("http://a.example.org/x/1", "2024-02-01"): "block",
        ("http://a.example.org/xy", "2024-02-01"): "allow", ("http://10.0.0.1/", "2024-02-01"): "none", ("http://[::1]:80/x", "2024-02-01"): "block", ("http://u:p@w@a.example.org/y?/x", "2024-02-02"): "allow", (None, "2024-02-01"): "none", ("http://b.example.org", None): "none",
    }
    rows = [(u, d, 1, "own") for u, d in asked] * 2
    d = sp.createDataFrame(rows, "url string, fetched string, _path int, verdict string")
    got = urlfilter.judge(d, e).collect()
    assert len(got) == len(rows) and all(asked[r.url, r.fetched] == r.verdict for r in got)
    assert {r.verdict for r in urlfilter.judge(d, e.where("false")).collect()} == {"none"}


def test_threshold():
    assert [licenses.least_overlap(n, 0.8) for n in (1, 5, 10, 11)] == [1, 4, 8, 9]
    assert [k for k, _ in corpus_pipeline.STAGES][0] == "language ID"
