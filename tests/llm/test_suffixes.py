import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import suffixes
from millrace.llm.common import numbered, stored
from millrace.llm.suffixes import adjacent_prefixes, sorted_suffixes, without_repeats


def brute(rows, length=100):
    """(spans, kept) of each row, by a set of all windows."""
    seen, out = set(), []
    for _, text in sorted(rows, key=lambda r: r[0]):
        t = (text or "").encode()
        covered = bytearray(len(t))
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            if w in seen:
                covered[i : i + length] = b"\1" * length
            seen.add(w)
        out.append((_, len(t), sum(covered), sum(1 for i, c in enumerate(covered) if c and (not i or not covered[i - 1])), hashlib.sha256(bytes(b for b, c in zip(t, covered, strict=True) if not c)).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdé", k=rng.randint(1, 6))) for _ in range(60)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    line, passage, hot = prose(12), prose(60), prose(9)
    rows = [(0, None), (1, ""), (2, "short"), (3, "a" * 5000), (4, "a" * 99), (5, "ab" * 700), (6, "Laêlepa " * 80)]
    for i in range(7, 90):
        parts = [prose(rng.randint(1, 60)) for _ in range(3)]
        parts.insert(rng.randint(0, 3), rng.choice([line, passage, passage[rng.randint(0, 80) :], hot, passage[: rng.randint(90, 200)]]))
        rows.append((i, "\n".join(parts)))
    near = prose(200).split(" ")
    for i in range(90, 120):
        edit = list(near)
        edit[rng.randrange(200)] = "X"
        rows.append((i, " ".join(edit)))
    rows += [(i, rows[20][1]) for i in range(120, 140)]
    rng.shuffle(rows)
    return rows


def test_suffix_array():
    rng = random.Random(1)
    for trial in range(150):
        alphabet = rng.choice([2, 3, 256])
        s = []
        for _ in range(rng.randint(1, 4)):
            s += [rng.randint(1, alphabet) for _ in range(rng.randint(1, 150))] + [0]
        got = sorted_suffixes(np.array(s, np.int16), 100).tolist()
        assert sorted(got) == list(range(len(s)))
        assert all(s[a : a + 100] <= s[b : b + 100] for a, b in zip(got, got[1:], strict=False)), trial


def test_prefixes():
    t = np.frombuffer(b"banana banana bandana", np.uint8)
    order = sorted(range(len(t)), key=lambda i: t[i:].tobytes())
    got = adjacent_prefixes(t, np.array(order), 100)
    for k, (a, b) in enumerate(zip(order, order[1:], strict=False), 1):
        x, y = t[a:].tobytes(), t[b:].tobytes()
        assert got[k] == next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y))) or got[k] >= min(len(x), len(y))


@pytest.mark.parametrize(("crowd", "stretch", "horde"), [(512, 1 << 21, 8192), (1, 300, 8192), (1, 300, 1), (2, 1 << 21, 5)])
def test_against_brute_force(sp, crowd, stretch, horde):
    rows = corpus(crowd)
    d = numbered(sp.createDataFrame(rows, "doc_id long, text string").repartition(5))
    out = d.join(suffixes.repeats(d, 100, crowd, stretch, horde), "_row", "left").select("doc_id", "text", "_spans").mapInArrow(suffixes._digests(100), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    assert sorted(map(tuple, out.collect())) == brute(rows)


def test_texts(sp):
    long = "é" * 300
    d = sp.createDataFrame([(1, long, 0), (2, "x" + long, 1), (2, None, 2), (None, long, 3)], "doc_id long, text string, spans int")
    got = {r.spans: r.text for r in without_repeats(d).collect()}
    assert without_repeats(d).columns == d.columns
    assert len(got[0]) < 300 and got[1] == "x" and got[2] is None and got[3] == ""
    assert without_repeats(d.where("false")).count() == 0


def test_numbers_do_not_move(sp):
    d = stored(sp.createDataFrame(corpus(4), "doc_id long, text string").repartition(30), "many")
    rows = numbered(d)
    old = sp.conf.get("spark.sql.files.maxPartitionBytes")
    before = sorted((r._row, r.doc_id) for r in rows.select("_row", "doc_id").collect())
    spans = suffixes.repeats(rows)
    sp.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # other splits, as after a lost executor
    try:
        after = sorted((r._row, r.doc_id) for r in numbered(d.select("doc_id", "text")).select("_row", "doc_id").collect())
        out = rows.join(spans, "_row", "left").select("doc_id", "text", "_spans").mapInArrow(suffixes._digests(100), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
        assert before == after and len({r for r, _ in before}) == len(before)
        assert sorted(map(tuple, out.collect())) == brute(corpus(4))
    finally:
        sp.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_no_byte_goes_on_hashes_alone(sp, monkeypatch):
    """With hashes that collide everywhere, so that contents and anchors are told apart by bytes only, the result is the same."""
    rows = corpus(3)[:60]
    d = numbered(sp.createDataFrame(rows, "doc_id long, text string").repartition(3))
    anchors = suffixes._anchors

    def dull(length, buckets, stretch):
        run = anchors(length, buckets, stretch)

        def wrapped(batches):
            whole = suffixes.fragments

            def same(*args):
                h, f, *rest = whole(*args)
                return (h & np.uint64(3), f & np.uint64(1), *rest)

            suffixes.fragments = same
            try:
                yield from run(batches)
            finally:
                suffixes.fragments = whole

        return wrapped

    monkeypatch.setattr(suffixes, "_anchors", dull)
    out = d.join(suffixes.repeats(d), "_row", "left").select("doc_id", "text", "_spans").mapInArrow(suffixes._digests(100), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    assert sorted(map(tuple, out.collect())) == brute(rows)


def test_clashing_names(sp):
    d = sp.createDataFrame([(1, "é" * 300, 7, "a", 1.0), (2, "x" + "é" * 300, 8, "b", 2.0)], "doc_id long, text string, _row int, _spans string, _own0 double")
    assert sorted(map(tuple, without_repeats(d).collect()))[1] == (2, "x", 8, "b", 2.0)


def test_batches_take_little_memory():
    """Cutting a few MB of texts into fragments takes bounded memory beside them, one text of 2 MB or many of 2 kB."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300_000)]
    whole = " ".join(words)[:2_000_000]
    for texts in ([whole], [whole[i : i + 2000] for i in range(0, len(whole), 2000)]):
        b = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "_row", "text"])
        tracemalloc.start()
        for _ in suffixes._anchors(suffixes.LENGTH, 8, suffixes.STRETCH)(iter([b])):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 50e6, peak
