"""Language identification by segmentation-marginalised unigrams.

Pieces are the tokens of a public byte vocabulary, of any length (no white space but a leading blank that marks a word's
start), and all single bytes. Each language has a probability for every piece; a word's likelihood is the sum over all
its segmentations into pieces, by the forward algorithm, and a text's is the product over its words. Sums are rescaled by
powers of two as they shrink, so words have any length too: short ones are summed many at once, long ones one by one over
a window as wide as the longest piece.

Probabilities are fitted by expectation maximisation over all words of a bounded sample of labelled rows: about
SAMPLE_DOCS documents of each language, of SAMPLE_BYTES at most each. Expectations are taken where the words are; the
driver sums PARTS tables of pieces by languages. Everything else reads every word of every text.

Words are runs of letters (A-Z lower-cased, every byte beyond ASCII taken as one). The score is the posterior of the
predicted language among those learned; ties go to the first by name. A null text or one without a letter is `und`
with score 0, as is everything if nothing could be learned. A null doc_id counts as held out. Repeated rows are judged
alike; extra columns are ignored, or passed through under any name by keep_identified; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cache, documents, renamed, stored

SAMPLE_DOCS, SAMPLE_BYTES, ROUNDS, FOLDS = 1000, 1 << 20, 4, 5
ALPHA, PARTS = 0.01, 16
#: Words of more bytes are summed one by one; the sum is the same.
LONG = 48
#: Sums are kept above this power of two.
_LOW = 300
_CACHE = 400_000
#: A-Z to a-z, all other ASCII but a-z to blanks.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_LETTERS).split()


def vocabulary(path: str) -> list[bytes]:
    """The pieces in order; every single byte is one."""
    with open(path, "rb") as f:
        tokens = {base64.b64decode(line.split()[0]) for line in f}
    kept = {t for t in tokens if t.strip() and len(t.split()) == 1 and t.rstrip() == t and len(t) - len(t.lstrip()) <= 1 and t[:1] not in b"\t\n\r\x0b\x0c" and t.lower() == t}
    return sorted(kept | {bytes([c]) for c in range(256)})


class Trie:
    """All pieces that begin at every place of a buffer."""

    def __init__(self, pieces: list[bytes]):
        self.reach = max(map(len, pieces))
        nodes: dict[int, int] = {}
        ends = {}
        for i, t in enumerate(pieces):
            at = 0
            for c in t:
                at = nodes.setdefault(at << 8 | c, len(nodes) + 1)
            ends[at] = i
        keys = np.fromiter(nodes, np.int64, len(nodes))
        order = np.argsort(keys)
        self.keys, self.below = keys[order], np.fromiter(nodes.values(), np.int64, len(nodes))[order]
        self.piece = np.full(len(nodes) + 1, -1, np.int32)
        self.piece[list(ends)] = list(ends.values())
        self.root = np.zeros(256, np.int64)
        self.root[self.keys[: np.searchsorted(self.keys, 256)]] = self.below[: np.searchsorted(self.keys, 256)]

    def found(self, buffer: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number in begin, length and piece of every piece that begins at a place and ends by its stop."""
        which, at, n, out = np.arange(len(begin)), self.root[buffer[begin]], 1, []
        while True:
            live = at > 0
            which, at = which[live], at[live]
            i = self.piece[at]
            out.append((which[i >= 0], np.full(np.count_nonzero(i >= 0), n), i[i >= 0]))
            more = begin[which] + n < stop[which]
            which, at = which[more], at[more]
            if not len(which):
                return tuple(np.concatenate(c) for c in zip(*out, strict=True))
            asked = at << 8 | buffer[begin[which] + n]
            to = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
            at = np.where(self.keys[to] == asked, self.below[to], 0)
            n += 1

    def lattice(self, words: list[bytes]) -> tuple[np.ndarray, list[list[tuple[int, np.ndarray, np.ndarray]]]]:
        """Lengths of the words with their leading blank; for each place the pieces there as (length, words, pieces)."""
        lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
        buffer = np.frombuffer(b" " + b" ".join(words), np.uint8)
        ends = np.cumsum(lens)
        word = np.repeat(np.arange(len(words)), lens)
        which, n, piece = self.found(buffer, np.arange(len(buffer)), ends[word])
        place = which - (ends - lens)[word[which]]
        key = place * (self.reach + 1) + n
        order = np.argsort(key, kind="stable")
        key, w, piece = key[order], word[which[order]], piece[order]
        at: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(int(lens.max()))]
        cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        for a, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(key)], strict=True):
            p, length = divmod(int(key[a]), self.reach + 1)
            at[p].append((length, w[a:e], piece[a:e]))
        return lens, at


def _raise_low(sums: np.ndarray, here: int, span: slice, going: np.ndarray, power: np.ndarray) -> None:
    """Multiply a span of places by 2**_LOW for the words and languages whose sum at `here` is below its inverse."""
    low = (sums[:, here] < 2.0**-_LOW) & (sums[:, here] > 0) & going[:, None]
    if low.any():
        w, k = np.nonzero(low)
        sums[w, span, k] *= 2.0**_LOW
        power[w, k] -= _LOW


def forward(lens: np.ndarray, at: list, prob: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """sums and powers [word, place, language]: sums * 2**powers is the probability of all segmentations of what comes before the place."""
    n, width = len(lens), len(at)
    sums, powers, power = np.zeros((n, width + 1, prob.shape[1])), np.zeros((n, width + 1, prob.shape[1]), np.int64), np.zeros((n, prob.shape[1]), np.int64)
    sums[:, 0] = 1
    for p in range(width):
        if p % 4 == 3:
            _raise_low(sums, p, slice(p, p + reach + 1), lens > p, power)
        powers[:, p] = power
        for length, w, piece in at[p]:
            sums[w, p + length] += sums[w, p] * prob[piece]
    powers[:, width] = power
    return sums, powers


def expected(lens: np.ndarray, at: list, prob: np.ndarray, reach: int, counts: np.ndarray, into: np.ndarray) -> None:
    """Add the expected count of each piece for each language."""
    sums, powers = forward(lens, at, prob, reach)
    rows = np.arange(len(lens))
    total, whole = sums[rows, lens], powers[rows, lens]
    back, power = np.zeros_like(sums), np.zeros_like(whole)
    back[rows, lens] = 1
    weight = np.divide(counts, total, out=np.zeros_like(total), where=total > 0)
    for p in reversed(range(len(at))):
        if p % 4 == 3:
            _raise_low(back, p + 1, slice(p + 1, p + 2 + reach), lens > p, power)
        for length, w, piece in at[p]:
            then = back[w, p + length] * prob[piece]
            back[w, p] += then
            np.add.at(into, piece, np.ldexp(sums[w, p] * then * weight[w], (powers[w, p] + power[w] - whole[w]).astype(np.int32)))


def long_word(trie: Trie, word: bytes, prob: np.ndarray, block: int = 1 << 14) -> np.ndarray:
    """The logarithm of a word's likelihood in each language, in memory that does not grow with the word."""
    text, size, power = b" " + word, prob.shape[1], np.zeros(prob.shape[1])
    sums = np.zeros((block + trie.reach + 1, size))
    sums[0] = 1
    for a in range(0, len(text), block):
        part = np.frombuffer(text[a : a + block + trie.reach], np.uint8)
        here = min(block, len(text) - a)
        which, n, piece = trie.found(part, np.arange(here), np.full(here, len(part)))
        order = np.argsort(which, kind="stable")
        to, share = (which + n)[order], prob[piece[order]]
        cuts = np.searchsorted(which[order], np.arange(here + 1)).tolist()
        for p in range(here):
            if p % 4 == 3 and (low := sums[p] < 2.0**-_LOW).any():
                sums[p : p + trie.reach + 1, low] *= 2.0**_LOW
                power[low] -= _LOW
            i, e = cuts[p], cuts[p + 1]
            sums[to[i:e]] += sums[p] * share[i:e]
        sums[: trie.reach + 1] = sums[here : here + trie.reach + 1].copy()
        sums[trie.reach + 1 :] = 0
    with np.errstate(divide="ignore"):
        return np.log(sums[0]) + power * math.log(2)


def _grouped(words: list[bytes], size: int = 2048, cells: int = 1 << 18) -> Iterator[np.ndarray]:
    """Numbers of words of about one length: `size` words or `cells` bytes at most, but always one word."""
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
    order = np.argsort(lens, kind="stable")
    i = 0
    while i < len(order):
        e = i + 1
        step = min(size, len(order) - i)
        while step and e - i < size:
            if e + step <= len(order) and e - i + step <= size and (e - i + step) * lens[order[e + step - 1]] <= cells:
                e += step
            else:
                step //= 2
        yield order[i:e]
        i = e


def _first_guess(at: list, counts: np.ndarray, into: np.ndarray) -> None:
    for pieces in at:
        for length, w, piece in pieces:
            np.add.at(into, piece, counts[w] * length)  # longer pieces explain more of a word


def _expect(model):
    """One row a task: the expected counts of all pieces, as bytes, over the task's (word, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, prob, size = model.value
        into = np.zeros((int(trie.piece.max()) + 1, size))
        for b in batches:
            words, counts = b.column(0).to_pylist(), np.array(b.column(1).to_pylist(), float)
            for part in _grouped(words):
                lens, at = trie.lattice([words[i] for i in part])
                if prob is None:
                    _first_guess(at, counts[part], into)
                else:
                    expected(lens, at, prob, trie.reach, counts[part], into)
        yield pa.RecordBatch.from_arrays([pa.array([into.tobytes()], pa.binary())], ["counts"])

    return run


def fit(words: DataFrame, trie: Trie, size: int, rounds: int = ROUNDS) -> np.ndarray:
    """prob[piece, language] from stored rows of (word, counts in each of `size` languages, part)."""
    spark, prob = words.sparkSession, None
    dealt = stored(words.repartition(PARTS, "word").sortWithinPartitions(F.length("word"), "word"), "words")
    for _ in range(rounds + 1):
        model = spark.sparkContext.broadcast((trie, prob, size))
        total = np.zeros((int(trie.piece.max()) + 1, size))
        for x in sorted(bytes(r.counts) for r in dealt.mapInArrow(_expect(model), "counts binary").collect()):  # sorted: sums do not depend on the tasks' order
            total += np.frombuffer(x).reshape(total.shape)
        total += ALPHA
        prob = total / total.sum(0)
        model.unpersist()
    return prob


class Scorer:
    def __init__(self, trie: Trie, langs: list[str], prob: np.ndarray):
        self.trie, self.langs, self.prob = trie, langs, prob
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.rows = np.zeros((1024, len(self.langs)))

    def likelihoods(self, words: list[bytes]) -> np.ndarray:
        """Logarithms of the likelihoods [word, language]."""
        out = np.zeros((len(words), len(self.langs)))
        short = np.array([i for i, w in enumerate(words) if len(w) <= LONG], np.int64)
        for part in _grouped([words[i] for i in short]):
            lens, at = self.trie.lattice([words[short[i]] for i in part])
            sums, powers = forward(lens, at, self.prob, self.trie.reach)
            rows = np.arange(len(part))
            out[short[part]] = np.log(sums[rows, lens]) + powers[rows, lens] * math.log(2)
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = long_word(self.trie, w, self.prob)
        return out

    def learn(self, words: list[bytes]) -> None:
        start = len(self.at)
        if start + len(words) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((start + len(words), len(self.langs)))])
        self.rows[start : start + len(words)] = self.likelihoods(words)
        self.at.update((w, start + i) for i, w in enumerate(words))

    def batch(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if len(self.at) > _CACHE:
            self.clear()
        split = [words_of(t) if t else [] for t in texts]
        new = {w for ws in split for w in ws if w not in self.at} if self.langs else ()
        if new:
            self.learn(sorted(new))
        names, scores = [], []
        for text, ws in zip(texts, split, strict=True):
            if not ws or not self.langs or not any(map(str.isalpha, text)):
                names.append("und")
                scores.append(0.0)
                continue
            like = self.rows[np.fromiter(map(self.at.__getitem__, ws), np.int64, len(ws))].sum(0)
            best = int(like.argmax())
            names.append(self.langs[best])
            scores.append(float(1 / np.exp(like - like[best]).sum()))
        return names, scores


def _predict(model, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, langs, prob = model.value
        tag, scorers = zlib.crc32(prob.tobytes()), cache("language")
        if tag not in scorers:
            scorers.clear()
            scorers[tag] = Scorer(trie, langs, prob)
        for b in batches:
            at = b.schema.get_field_index("text")
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                names, scores = scorers[tag].batch(part.column(at).to_pylist())
                passed = [k for k in range(b.num_columns) if keep or k != at]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in passed), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*(part.schema.names[k] for k in passed), "lang_pred", "score"])

    return run


def held_out() -> Column:
    return F.pmod(F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)), F.lit(FOLDS)) == 0


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seen: dict[str, Counter] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if text:
                seen.setdefault(lang, Counter()).update(words_of(text))
        for lang, c in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["lang", "word", "n"])


def train(docs: DataFrame, vocabulary_path: str, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> tuple[Trie, list[str], np.ndarray]:
    """The model of the labelled rows outside the held-out fold."""
    labelled = docs.where(~held_out() & F.col("lang").isNotNull() & (F.octet_length("text") <= sample_bytes)).select("doc_id", "lang", "text")
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    trie, langs = Trie(vocabulary(vocabulary_path)), sorted(sizes)
    if not langs:
        return trie, [], np.zeros((int(trie.piece.max()) + 1, 0))
    share = F.element_at(F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample_docs / n)))), F.col("lang"))
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * float(1 << 30)).select("lang", "text")
    counted = sample.mapInArrow(_count_words, "lang string, word binary, n long").groupBy("word")
    words = counted.agg(F.array(*(F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)) for x in langs)).alias("counts"))
    return trie, langs, fit(words, trie, len(langs))


def _predicted(rows: DataFrame, vocabulary_path: str | None, keep: bool) -> DataFrame:
    model = rows.sparkSession.sparkContext.broadcast(train(rows, vocabulary_path or default_vocabulary()))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if keep or f.name != "text")
    return rows.mapInArrow(_predict(model, keep), f"{schema}, lang_pred string, score double")


def identify(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    return _predicted(docs.select("doc_id", "lang", "text"), vocabulary_path, False).drop("lang")


def keep_identified(docs: DataFrame, least_score: float, vocabulary_path: str | None = None) -> DataFrame:
    """The rows of docs, in their own columns, with an identified language whose score is least_score at least."""
    own = renamed(docs, "doc_id", "lang", "text")
    known = _predicted(own, vocabulary_path, True).where((F.col("lang_pred") != "und") & (F.col("score") >= least_score))
    return known.select(*own.columns).toDF(*docs.columns)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    return identify(documents(spark, sf_dir)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
