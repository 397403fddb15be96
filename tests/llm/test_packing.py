import random
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import packing
from millrace.llm.packing import WordTokens, default_tokenizer, fullest, pack, plan_bins, token_pieces

TEXTS = [None, "", "   ", "Hello, world!! it's 12.5% of İstanbul", "naïve café — “quoted”… Ünïcödé ß Straße.", "a b c é É.", "<|startoftext|> x <|ENDOFTEXT|><|endoftext|>", "don't, y'all'd've; 'tis", "word. Word, WORD! word| word:word", "日本語 текст ελληνικά ΣΑΣ", "x" * 9000, "the of and " * 4000, "\x1c a\x1fb \x85 c", "퟿ \U0001f600!!", "ñandú, niño; übér?!", "a+b=c #tag @me"]


def ids(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids + [0]


def test_tokens_are_the_tokenizers_own():
    tok, fast = Tokenizer.from_file(default_tokenizer()), WordTokens(default_tokenizer())
    for _ in range(2):
        for text, raw in zip(TEXTS, fast.batch(TEXTS), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == ids(tok, text)[:-1], text


def test_fullest():
    rng = random.Random(2)
    for _ in range(200):
        items = [rng.randint(1, 20) for _ in range(rng.randint(1, 7))]
        room = rng.randint(0, 40)
        best = max((sum(c) for n in range(len(items) + 1) for c in combinations(items, n) if sum(c) <= room), default=0)
        got = fullest({x: items.count(x) for x in items}, room)
        assert sum(k * v for k, v in got.items()) == best
        assert all(v <= items.count(k) for k, v in got.items())


def test_plan_uses_every_rank_once():
    rng = random.Random(4)
    counts = {rng.randint(1, 100): rng.randint(1, 30) for _ in range(25)}
    rows, bins = plan_bins(counts, 100)
    for length, n in counts.items():
        spans = sorted((a, b) for x, a, b, *_ in rows if x == length)
        assert spans[0][0] == 0 and spans[-1][1] == n and all(p[1] == q[0] for p, q in zip(spans, spans[1:], strict=False))
    assert bins >= -(-sum(k * v for k, v in counts.items()) // 100)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_round_trip(sp, capacity):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 1), (None, "null id", 1)]
    d = sp.createDataFrame(rows, "doc_id long, text string, length int")
    got = pack(token_pieces(d, default_tokenizer(), capacity), capacity).collect()
    tok = Tokenizer.from_file(default_tokenizer())
    want = []
    for i, t, _ in rows:
        x = ids(tok, t)
        want += [(i, k, a, len(x[a : a + capacity]), zlib.crc32(np.array(x[a : a + capacity], "<u4").tobytes())) for k, a in enumerate(range(0, len(x), capacity))]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // capacity) * 1.1 + 1
    assert pack(token_pieces(d.where("false"), default_tokenizer())).count() == 0


@pytest.mark.parametrize("salted", [1, 7, 1 << 16])
def test_a_length_of_many_pieces(sp, monkeypatch, salted):
    """One length holds most pieces, under many salts or few: each piece has a place, and places are gapless."""
    monkeypatch.setattr(packing, "SALTED", salted)
    lengths = [30] * 500 + [100] * 20 + list(range(1, 60))
    d = sp.createDataFrame([(i % 300, i // 300, 0, n, i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = pack(d, 100).collect()
    assert sorted((r.doc_id, r.piece, r.length) for r in got) == sorted((i % 300, i // 300, n) for i, n in enumerate(lengths))
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 100


def test_packing_starts_no_second_kind_of_worker(sp, monkeypatch):
    """Lists made into frames go through Python workers and a daemon of their own, which stay on the executors."""
    d = sp.createDataFrame([(i, 0, 0, 1 + i % 9, i) for i in range(50)], "doc_id long, piece int, start long, length long, ids_crc32 long")

    def refused(*_):
        raise AssertionError("a list was parallelized")

    monkeypatch.setattr(type(sp.sparkContext), "parallelize", refused)
    assert pack(d, 100).count() == 50
    assert pack(d.where("false"), 100).count() == 0


def test_the_pipeline_holds_few_chunks(monkeypatch):
    """The pipeline's packing workers keep some 2 * HELD_CHUNKS chunks, and give the ids that op2's give."""

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    monkeypatch.setattr(corpus_pipeline, "ship", lambda _: None)
    monkeypatch.setattr(packing, "pack", lambda pieces: pieces)
    texts = [" ".join(f"{k:x}-{i}" for i in range(256)) for k in range(1100)]
    texts += texts[:300]
    b = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    got, want = (pa.Table.from_batches(run(iter([b]))) for run in (corpus_pipeline.packed(None, Docs(), ""), token_pieces(Docs(), default_tokenizer())))
    assert got == want
    packing.cache("other")  # drops the tokens
    pa.Table.from_batches(corpus_pipeline.packed(None, Docs(), "")(iter([b])))
    tok = packing.cache("tokens")[default_tokenizer()]
    assert len(tok.chunks) + len(tok.older) <= 2 * (50_000 + 256 * 256)
