"""Best-fit packing of token pieces by minimum bin slack.

Lengths are integers of at most `capacity`, so the lengths' histogram, `capacity` rows at most, holds all that packing
needs. For each bin the largest length left is placed, then a subset-sum over a bitset (one Python integer) of the
lengths left finds the fullest combination beside it. While that combination is there, the next bin would choose it
again, so it is taken as often as the counts allow: the plan has rows for kinds of bins, not for bins. Each
piece finds its bin by its rank among the pieces of its length.

A null text is empty: one piece of the end id alone. Repeated rows are packed each for itself; a document is cut only
if longer than a bin. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cache, documents, partitions, ranked, stored

CAPACITY, END_ID = 2048, 0
#: Lower-case ASCII and Latin-1 letters, then marks that no such word joins: the tokenizer splits between the two.
_PLAIN = regex.compile(rb"(?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf])+")
_MARKS = b".,;:!?|"
#: Chunks of the newer half of the cache, and words: fewer take less memory and more time.
_CACHE = 300_000
#: Pieces of a length under one salt at most.
SALTED = 1 << 16
_END = "</w>"


class WordTokens:
    """Token ids by the tokenizer itself, kept for each white-space separated chunk.

    The tokenizer drops white space and never joins across it, and lower-cases before all else that it does, so the
    ids of a text are those of its lower-cased chunks in turn. Texts that hold "<|" go to it whole, as special
    tokens are matched before all that. The cache is bounded: when its newer half is full it becomes the older one, from which
    chunks in use are taken over; ids are kept as little-endian uint32 bytes.
    """

    def __init__(self, path: str, held: int = _CACHE):
        from tokenizers import Tokenizer

        self.held = held
        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith(_END)
        self.chunks: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.words: dict[bytes, bytes] = {}
        self.marks: dict[bytes, bytes] = {b"": b""}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_words(self, words: list[bytes]) -> None:
        """Words of letters alone are one unit to the tokenizer each, so a run of them can be split at the word ends."""
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            ids = np.array(self.tokenizer.encode(b" ".join(part).decode(), add_special_tokens=False).ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):
                self.words.update((w, self._ids(w.decode())) for w in part)
                continue
            raw, a = ids.tobytes(), 0
            for w, b in zip(part, (stops * 4).tolist(), strict=True):
                self.words[w] = raw[a:b]
                a = b

    def learn(self, chunks: list[bytes]) -> None:
        split, odd = [], []
        for c in chunks:
            if (ids := self.older.get(c)) is not None:
                self.chunks[c] = ids
                continue
            word = c.rstrip(_MARKS)
            if word.isalpha() or _PLAIN.fullmatch(word):
                split.append((c, word, c[len(word) :]))
            else:
                odd.append(c)
        if len(self.words) > self.held:
            self.words.clear()
        self._learn_words(list({w for _, w, _ in split if w not in self.words}))
        for marks in {m for _, _, m in split if m not in self.marks}:
            self.marks[marks] = self._ids(marks.decode())
        self.chunks.update([(c, self.words[w] + self.marks[m]) for c, w, m in split])
        self.chunks.update([(c, self._ids(c.decode("utf-8", "replace"))) for c in odd])

    def batch(self, texts: list[str | None]) -> Iterator[bytes]:
        if len(self.chunks) > self.held:
            self.older, self.chunks = self.chunks, {}
        known = self.chunks
        for text in texts:
            text = text or ""
            if "<|" in text:
                yield self._ids(text)
                continue
            chunks = text.encode("utf-8", "replace").lower().split()
            found = list(map(known.get, chunks))
            if None in found:
                new = [i for i, ids in enumerate(found) if ids is None]
                self.learn(list({chunks[i] for i in new}))
                for i in new:
                    found[i] = known[chunks[i]]
            yield b"".join(found)


def _pieces(path: str, capacity: int, end_id: int, held: int = _CACHE):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = cache("tokens")
        if path not in known:
            known[path] = WordTokens(path)
        tok = known[path]
        tok.held = held
        end = end_id.to_bytes(4, "little")
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                out = []
                for doc, ids in zip(part.column(0).to_pylist(), tok.batch(part.column(1).to_pylist()), strict=True):
                    ids += end
                    for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[a : a + 4 * capacity]
                        out.append((doc, k, a // 4, len(piece) // 4, zlib.crc32(piece)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, held: int = _CACHE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids and the end id, cut at multiples of capacity.

    A worker keeps the ids of some 2 * held chunks; that bounds its memory and changes no result.
    """
    return docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, capacity, end_id, held), "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], room: int) -> Counter:
    """The multiset of available lengths whose sum is the largest that room allows, larger lengths first."""
    can, steps, goal = 1, [], (2 << room) - 1
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left and not can >> room & 1:
            k = min(k, left)
            steps.append((can, length, k))
            can |= (can << length * k) & goal
            left, k = left - k, 2 * k
        if can >> room & 1:
            break
    at, out = can.bit_length() - 1, Counter()
    for before, length, k in reversed(steps):
        if not before >> at & 1:
            out[length] += k
            at -= length * k
    return out


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rows (length, rank from, rank to, copies a bin, first bin, offset in a bin), and the number of bins."""
    left, used, rows, bins = {k: v for k, v in counts.items() if v}, Counter(), [], 0
    while left:
        largest = max(left)
        left[largest] -= 1
        kind = fullest(left, capacity - largest) + Counter({largest: 1})
        left[largest] += 1
        times, offset = min(left[x] // k for x, k in kind.items()), 0
        for x, k in sorted(kind.items(), reverse=True):
            rows.append((x, used[x], used[x] + k * times, k, bins, offset))
            used[x] += k * times
            offset += k * x
            left[x] -= k * times
            if not left[x]:
                del left[x]
        bins += times
    return rows, bins


def _placed(rows: list[tuple], columns: int):
    plan = np.array(sorted(rows), np.int64).reshape(-1, 6)
    keys = plan[:, 0] << 48 | plan[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = plan[np.searchsorted(keys, length << 48 | rank, "right") - 1]
            j = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:columns], pa.array(row[:, 4] + j // row[:, 3]), pa.array(row[:, 5] + j % row[:, 3] * length)], [*b.schema.names[:columns], "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id and offset beside the columns of token_pieces.

    Pieces of one length are ranked under salts, as many as its pieces need, so a length that a third of all rows share is
    dealt over all tasks, and salts are few beside the rows. Only the histogram (capacity rows at most) reaches the
    driver; only it and the plan made of it reach the tasks.
    """
    spark = pieces.sparkSession
    kept = stored(pieces, "pieces")
    counts = {r.length: r.n for r in kept.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, _ = plan_bins(counts, capacity)
    each = max(1, min(SALTED, sum(counts.values()) // (4 * partitions(spark))))
    # From an Arrow table: a list would start a second Python daemon with workers of its own on each executor.
    table = pa.table({"length": pa.array(list(counts), pa.int64()), "salts": pa.array([-(-n // each) for n in counts.values()], pa.int64())})
    salts = F.broadcast(spark.createDataFrame(table))
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts"))
    with_rank = ranked(kept.join(salts, "length"), ["length"], [F.col(c) for c in ("doc_id", "piece", "start", "ids_crc32")], salt)
    names = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return with_rank.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_placed(rows, 5), names + ", sequence_id long, offset long")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return pack(token_pieces(documents(spark, sf_dir), tokenizer or default_tokenizer()))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
