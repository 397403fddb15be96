"""Language ID, neighbours, HTML and the pipeline."""

import random
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import langid, neighbours
from millrace.llm.extract import extract, main_text
from millrace.llm.registry import queries

SF = "/root/testdata/sf0.01"


def slow_forward(word, by):
    """The sum over all segmentations in logarithms, place by place."""
    s = b" " + word
    like = np.full((len(s) + 1, 2), -np.inf)
    like[0] = 0
    for e in range(1, len(s) + 1):
        for a in range(e):
            if s[a:e] in by:
                like[e] = np.logaddexp(like[e], like[a] + np.log(by[s[a:e]]))
    return like[-1]


def test_forward_sums_all_segmentations():
    pieces = sorted([b" ", b"a", b"b", b"ab", b" a", b"ba", b" ab", b"aababaababa", b"\xe3", b"\x81"])
    rng = np.random.default_rng(1)
    for least in (0.1, 1e-12):
        prob = rng.random((len(pieces), 2)) * least
        by = dict(zip(pieces, prob, strict=True))
        scorer = langid.Scorer(langid.Trie(pieces), ["x", "y"], prob)
        # A word of forty bytes and more, and one without blanks whose characters are of several bytes.
        words = [b"ab", b"aba", b"b", b"abab", b"aab" * 14, b"aababaababa" * 3, b"\xe3\x81" * 45, b"a" * 700]
        for w, g in zip(words, scorer.likelihoods(words), strict=True):
            assert g == pytest.approx(slow_forward(w, by)), w
            assert langid.long_word(scorer.trie, w, prob, 64) == pytest.approx(g)
        for w in words[:4]:
            s, total = b" " + w, np.zeros(2)
            for cuts in product([0, 1], repeat=len(s) - 1):
                at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(s)]
                parts = [s[a:b] for a, b in zip(at, at[1:], strict=False)]
                if all(p in by for p in parts):
                    total += np.prod([by[p] for p in parts], 0)
            assert scorer.likelihoods([w])[0] == pytest.approx(np.log(total))


def test_expected_counts():
    """Against forward and backward sums place by place; and with probabilities that need rescaling, every byte is counted once."""
    pieces = sorted([b" ", b"a", b"b", b"ab", b" a", b"ba", b"aabab"])
    trie = langid.Trie(pieces)
    words, counts = [b"aabab", b"ab", b"aab" * 19], np.array([[2.0, 1], [0, 3], [1, 1]])
    for least in (1, 1e-12):
        prob = np.random.default_rng(2).random((len(pieces), 2)) * least
        into, want = np.zeros((len(pieces), 2)), np.zeros((len(pieces), 2))
        langid.expected(*trie.lattice(words), prob, trie.reach, counts, into)
        assert sum(into[i] * len(t) for i, t in enumerate(pieces)) == pytest.approx(sum(c * (len(w) + 1) for w, c in zip(words, counts, strict=True)))
        for w, c in zip(words if least == 1 else [], counts, strict=False):
            s = b" " + w
            spans = [(a, e, pieces.index(s[a:e])) for a in range(len(s)) for e in range(a + 1, len(s) + 1) if s[a:e] in pieces]
            left, right = np.zeros((len(s) + 1, 2)), np.zeros((len(s) + 1, 2))
            left[0] = right[-1] = 1
            for a, e, i in sorted(spans):
                left[e] += left[a] * prob[i]
            for a, e, i in sorted(spans, reverse=True):
                right[a] += right[e] * prob[i]
            for a, e, i in spans:
                want[i] += c * left[a] * prob[i] * right[e] / left[-1]
        assert least != 1 or into == pytest.approx(want)


def test_language(sp):
    got = {r.doc_id: r for r in queries()["op3_language_id"](sp, SF).collect()}
    docs = sp.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()
    held = [(d.lang, got[d.doc_id].lang_pred) for d in docs if got[d.doc_id].held_out]
    assert len(got) == len(docs) and all(got[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0) for d in docs)
    assert np.mean([a == b for a, b in held]) > 0.97


def test_language_odd(sp):
    rows = [(i, t, x, 0.5) for i, (t, x) in enumerate([("the cat and the dog " * 5, "en"), ("der hund und die katze " * 5, "de")] * 20 + [(None, "en"), ("", "de"), ("12 .. 34", "en"), ("ñ" * 5000, None), ("…—", "en"), ("the dog", None)])]
    d = sp.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in langid.identify(d).collect()}
    assert [got[i].lang_pred for i in (40, 41, 42, 44)] == ["und"] * 4 and got[45].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.identify(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(d.where("false")).count() == 0


def brute(rows, k=10):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in ok:
        if q % 100 == 0:
            out[q] = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in ok if i != q and len(y) == len(x))[:k]
    return out


def answers(rows):
    got = {}
    for r in rows:
        got.setdefault(r.query_id, {})[r["rank"]] = (r.score, r.vec_id)
    return got


def test_neighbours(sp):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(400)] + [(i, [1.0] * 16) for i in range(400, 500)]
    rows += [(500, None), (501, [0.0] * 16), (600, [float("nan")] * 16), (601, [None] * 16), (None, [1.0] * 16), (700, [2.0, 1.0]), (701, [1.0, 1.0]), (800, [])]
    d = sp.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, _row int, shard string")
    query = F.col("vec_id") % 100 == 0
    got, want = answers(neighbours.nearest(d, query, shard=100, least=10, width=4.0).collect()), brute(rows)
    assert set(got) == set(want)
    assert got[700] == {1: (1.0, 701)}
    assert [v for _, v in (got[400][k] for k in range(1, 11))] == list(range(401, 411))
    assert np.mean([len({i for _, i in g.values()} & {i for _, i in want[q]}) / len(want[q]) for q, g in got.items()]) >= 0.9
    everything = neighbours.nearest(d, query, shard=100, width=1000.0).collect()
    assert {(r.query_id, r["rank"], r.vec_id) for r in everything} == {(q, k, i) for q, best in want.items() for k, (_, i) in enumerate(best, 1)}
    assert neighbours.nearest(d.where("false"), query).count() == 0


def test_repeated_queries(sp):
    """A repeated query row, and one of the same id with another vector: each has its own result, of distinct rows."""
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(1, 60)]
    rows += [(100, [0.5] * 8), (100, [0.5] * 8), (100, [-0.5] * 8)]
    d = sp.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = neighbours.nearest(d, F.col("vec_id") % 100 == 0, width=1000.0).collect()
    want = []
    for i, (q, x) in enumerate(rows):
        if q == 100:
            want += list(enumerate(sorted((float(np.sqrt(((np.array(x) - y) ** 2).sum())), j) for k, (j, y) in enumerate(rows) if k != i)[:10], 1))
    assert sorted((r["rank"], r.vec_id) for r in out) == sorted((k, j) for k, (_, j) in want)
    assert sorted((r["rank"], round(r.score, 9)) for r in out) == sorted((k, round(s, 9)) for k, (s, _) in want)


def test_recall(sp):
    d = sp.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r.vec_id, list(r.embedding)) for r in d.collect()])
    got = answers(queries()["op4_nearest_neighbours"](sp, "/root/testdata/sf0.1").collect())
    assert np.mean([len({i for _, i in got[q].values()} & {i for _, i in w}) / len(w) for q, w in want.items()]) >= 0.9
    ranked = neighbours.found(d, F.col("vec_id") % 100 == 0, least=500).select("query_row", "shard", "ranked").distinct()
    assert ranked.groupBy("query_row").agg(F.sum("ranked").alias("n")).agg(F.avg("n")).first()[0] < 0.08 * d.count()


def test_radius_is_exact():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 64))
    index = neighbours.MultiIndex(np.arange(500), np.arange(500), x, *neighbours.learn(x, 64))
    bits = np.unpackbits(index.codes, axis=1)
    for q in range(20):
        near = index.within(index.codes[q], 50)
        distance = (bits != bits[q]).sum(1)
        assert len(near) >= 50 and sorted(near) == np.flatnonzero(distance <= distance[near].max()).tolist()


LONG = "This is the story of a cat that was in the house with all of its friends, and it is a very good one to read."
HTML = [
    (f"<article><h1>T &amp; U</h1><p>{LONG}<p>Tail.<br>x</article><footer>&copy; {LONG}</footer>", f"T & U\n{LONG}\nTail. x"),
    (f"<body><div class='site-header'><p>{LONG}</div><main><p>{LONG}</p><aside>{LONG}</aside></main><div id=cookie-banner>{LONG}</div><section class=comments><p>{LONG}</section>", LONG),
    (f"<div class=ad>{LONG}</div><div><p>{LONG}</p><p>short</p></div><ul><li><a href=x>{LONG}</a></ul><form><p>{LONG}</form>", f"{LONG}\nshort"),
    (f"<div class='page-header'>x</div><div id='content'><p>{LONG}</p><p>a <span class='ad'>buy</span> <span>b</span> <a href=x>c</a></p><ins class=adsbygoogle>no</ins></div><ol class=commentlist><li>{LONG}</ol>", f"{LONG}\na b c"),
    ("<div class='post'><p>Only short.</p><p>Lines here.</p></div>", "Only short.\nLines here."),
    (None, ""), ("", ""), ("<", "") , ("<p>&am", ""), ("<!-- never closed <p>x", ""), ("<script>var a = '<article>'", ""), (f"<article><script>var x='</p>';</script><p>{LONG}<style>p{{}}</style> y&nbsp; z", f"{LONG} y z"),
    (f"<article><p hidden>no<p style='display: none'>no<p>{LONG}</article", LONG), ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000, "deep"), ("<article>" + "word " * 50_000, ("word " * 50_000).strip()),
]


@pytest.mark.parametrize(("html", "want"), HTML)
def test_html(html, want):
    assert main_text(html) == want or html == "<" and main_text(html) in ("", "<")


def test_pages(sp):
    d = sp.createDataFrame([(i, "u", h, 7) for i, (h, _) in enumerate(HTML)] + [(None, None, None, 7)], "page_id long, url string, html string, text int")
    got = extract(d).collect()
    assert len(got) == len(HTML) + 1 and all(r.n_chars == len(r.text) for r in got)
    assert extract(d.where("false")).count() == 0


def test_pipeline(sp, tmp_path):
    docs = sp.read.parquet(f"{SF}/documents.parquet")
    whole = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(sp, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        after = sp.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert after.columns == whole.columns, name
            assert after.exceptAll(docs).count() == 0 or name in ("suffix-array dedup", "mixing sources to target weights")
        docs = after
    n = [sp.read.parquet(f"{tmp_path}/{k}").count() for k in range(3)]
    assert whole.count() >= n[0] > 0.9 * whole.count() and n[0] > n[1] >= n[2]
    assert docs.selectExpr("sum(length) / count(DISTINCT sequence_id)").first()[0] > 2000
    empty = whole.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(sp, empty, SF).count() == 0


def slow_judged(found):
    """The two passes as they are stated, looking outward from every open block."""
    from millrace.llm import extract as x

    first = [label for label, _ in x.first_pass(found)]
    out = []
    for i, (text, _, _, body, _, box) in enumerate(found):
        if first[i] is not None:
            out.append(first[i] == x.TEXT)
            continue
        sides = []
        for way in (range(i - 1, -1, -1), range(i + 1, len(found))):
            side = ("edge", x.BOILERPLATE, None)
            for j in way:
                if body == x.SURE and found[j][3] != x.SURE:
                    break
                if first[j] is not None:
                    side = ("block", first[j], found[j][5])
                    break
            if body == x.SURE and side[0] == "edge":
                side = ("edge", x.TEXT, box)
            sides.append(side)
        labels = {label for _, label, _ in sides}
        if body == x.SURE:
            out.append(True)
        elif body == x.HINTED and (all(kind == "edge" for kind, _, _ in sides) or len(text) >= x.MIN_CHARS):
            out.append(True)
        elif len(labels) == 1:
            out.append(x.TEXT in labels)
        else:
            out.append(any(label == x.TEXT and b == box for _, label, b in sides))
    return out


def test_two_passes():
    from millrace.llm import extract as x

    rng = random.Random(5)
    for _ in range(400):
        found = [(" ".join(rng.choice(["the", "of", "zork", "blim"][: rng.choice([2, 4])]) for _ in range(rng.choice([3, 30, 80]))), rng.choice([0, 0, 0, 1.0]), rng.random() < 0.15, rng.choice([0, 0, 1, 2]), False, rng.randint(1, 3)) for _ in range(rng.randint(0, 12))]
        assert x.classify(found) == slow_judged(found)


def test_rules_decide(sp):
    """How many blocks each rule decides; and with containers renamed and classes gone most pages give the same text."""
    import re
    from collections import Counter

    from millrace.llm import extract as x

    rules, same, pages = Counter(), 0, [r.html or "" for r in sp.read.parquet(f"{SF}/pages.parquet").select("html").collect()]
    for html in pages:
        rules.update(rule for _, rule in x.judged(list(x.blocks(html))))
        bare = re.sub(r'\s(?:class|id|role)="[^"]*"', "", re.sub(r"<(/?)(article|main|nav|footer|header|aside|section)\b", r"<\1div", html))
        same += main_text(bare) == main_text(html)
    assert min(rules[r] for r in ("links", "density", "neighbours", "mark")) > len(pages) and rules["mark"] < 0.2 * rules.total()
    assert same >= 0.75 * len(pages)


def test_pipeline_odd_rows(sp, tmp_path):
    """Nulls in any column, empty and long texts, ties, repeated rows and ids, and columns named as the stages' own."""
    en, de = "the cat and the dog of the house went to the river and it was a good day for them all number{} {} ", "der hund und die katze aus dem haus gingen an den fluss und es war ein guter tag zahl{} {} "
    rows = [(i, (en, de)[i % 2].format(i, i * 7) * (1 + i % 3), ("en", "de")[i % 2], f"s{i % 3}") for i in range(40)]
    rows += [(3, rows[3][1], "de", "s0"), (3, "a wholly other text that shares the id and that is in english of the same kind", None, None), (None, rows[0][1], "en", "s0"), (None, "this one has no id at all but it is a text of the english kind", None, "s1")]
    rows += [(100, None, "en", "s1"), (101, "", "de", None), (102, " \n", None, None), (103, "12 34", "en", "s2"), (104, en.format("long", "x") * 4000, "en", "s2"), (None, None, None, None)]
    odd = [(*r, None if r[1] is None else len(r[1]), 0.5, "x", 7, 8, "y", 9, 1, "z", 2) for r in rows]
    names = "score double, lang_pred string, _row int, _spans int, size string, copies int, node int, _own4 string, `rank` int"
    docs = sp.createDataFrame(odd, f"doc_id long, text string, lang string, source string, n_chars long, {names}")
    whole = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(sp, docs, "").write.parquet(f"{tmp_path}/{k}")
        docs = sp.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == whole.columns, name
            assert {tuple(r) for r in docs.select("score", "lang_pred", "_row", "_spans", "size", "copies", "node", "_own4", "rank").collect()} == {(0.5, "x", 7, 8, "y", 9, 1, "z", 2)}
    texts = [sorted(r.text for r in sp.read.parquet(f"{tmp_path}/{k}").select("text").collect()) for k in range(2)]
    assert len(texts[0]) == 45 and len(texts[1]) == len(set(texts[1])) < len(set(texts[0]))
    assert all(t in texts[1] for t in (rows[41][1], rows[43][1])) and docs.count() > 0
