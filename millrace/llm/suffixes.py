"""Exact repeats of `length` bytes across documents, by two-stage suffix sorting.

Suffixes are sorted where equal windows are sure to meet. Of every window of `length` bytes the K-gram of least hash (the
leftmost, if several) is its anchor: equal windows have equal anchors at equal offsets. The windows of one anchor make a
fragment of a text, about one for 35 bytes. Hashes only bring fragments together, bytes decide:

* Fragments travel first as two hashes and a place, bucket by bucket. An anchor with one place needs nothing more; most
  end here. A fragment whose bytes stand earlier in its batch is settled there, so a passage that a third of all rows
  share leaves each batch once.
* All fragments whose anchor has several places are read again as bytes. Of equal ones the first represents them, the
  others are repeats as wholes. Where a key has several contents, the suffixes of their representatives are sorted:
  those smaller than their successors directly, the rest by scans of the 257 buckets. Adjacent common prefixes of
  `length` bytes give the groups of equal windows, and all but a group's earliest are repeats.

An anchor with more than CROWD contents is dealt again: eight neighbouring windows share `length` - 7 bytes, whose hash
is the key under which they meet; with more than HORDE contents every window has a key of its own. Equal contents of a key
are settled in each batch before they are shuffled and again as a task reads them, so a task holds the different
contents of a key, HORDE at most, and sorts whole keys, some BLOCK bytes at a time.

Buckets grow in number with the input and a task holds one at a time, so memory does not grow with the corpus.

A null text is empty; texts shorter than `length` lose nothing; rows of one doc_id (repeated rows too) are in the order of
their files' paths and places; a null doc_id comes last. Texts of any length are cut into overlapping stretches for
hashing only. Spans may cut through a character; without_repeats drops the bytes of characters that are not whole any
more. Extra columns pass through under any name; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lean, numbered, partitions, renamed, scan_bytes, stored

LENGTH, K = 100, 32
CROWD, HORDE, CHUNK, BLOCK, STRETCH = 512, 8192, 8, 1 << 19, 1 << 17
#: Bytes of the table's files for each bucket of fragments.
BUCKET = 4 << 20
#: Texts that are cut into fragments, and that are read again, at a time.
ANCHORED, DOCS = 1500, 500
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_NULL = np.iinfo(np.int64).max


def _words(buffer: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as integers; the buffer's last seven places have none."""
    return np.ndarray((max(0, len(buffer) - 7),), np.dtype("<u8"), buffer, 0, (1,))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _ODD[4]
    x ^= x >> np.uint64(29)
    return x


def gram_hashes(buffer: np.ndarray) -> np.ndarray:
    """A hash of the K bytes from each place on."""
    w = _words(buffer)
    n = len(buffer) - K + 1
    total = w[:n] * _ODD[0]
    for i in range(1, K // 8):
        total += w[8 * i : 8 * i + n] * _ODD[i]
    return _mixed(total)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


_power_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def fragments(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH):
    """Anchor hash, content hash, first window, number of windows and anchor offset of every fragment of the texts in buffer[starts:ends]."""
    none = np.zeros(0, np.uint64)
    if len(buffer) < length:
        return none, none, *(np.zeros(0, np.int64),) * 3
    h = gram_hashes(buffer)
    n = len(buffer) - length + 1
    place = (np.uint64(1) << np.uint64(24)) - np.uint64(1)
    low = (h & ~place) | np.arange(len(h), dtype=np.uint64)
    size, want = 1, length - K + 1
    while 2 * size <= want:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    low = np.minimum(low[:n], low[want - size : want - size + n])
    anchor = (low & place).astype(np.int64)
    valid = np.zeros(n + 1, np.int8)
    has = ends - starts >= length
    np.add.at(valid, starts[has], 1)
    np.add.at(valid, ends[has] - length + 1, -1)
    valid = np.cumsum(valid[:n]).astype(bool)
    new = np.ones(n, bool)
    new[1:] = anchor[1:] != anchor[:-1]
    new[starts[has]] = True
    first = np.flatnonzero(new & valid)
    stop = np.flatnonzero(np.concatenate((valid[:-1] & (new[1:] | ~valid[1:]), valid[-1:]))) + 1
    count = stop - first
    size = len(h) + 1
    top = 1 << size.bit_length()
    if top not in _power_tables:
        _power_tables[top] = (_powers(_BASE, top), _powers(_INVERSE, top))
    up, down = _power_tables[top]
    sums = np.zeros(size, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    content = (sums[stop + length - K] - sums[first]) * down[first]
    at = anchor[first]
    content = _mixed(content + (count.astype(np.uint64) << np.uint64(20) | (at - first).astype(np.uint64)) * _ODD[1])
    return h[at], content, first, count, at - first


_FIELDS = (("h", "<u8"), ("f", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("start", "<i8"), ("n", "<i4"), ("d", "<i4"))


def _packed(columns: dict[str, np.ndarray], at: np.ndarray) -> bytes:
    return b"".join(columns[c][at].astype(t).tobytes() for c, t in _FIELDS)


def _unpacked(blob: bytes) -> dict[str, np.ndarray]:
    n, out, at = len(blob) // sum(np.dtype(t).itemsize for _, t in _FIELDS), {}, 0
    for c, t in _FIELDS:
        out[c] = np.frombuffer(blob, t, n, at)
        at += n * np.dtype(t).itemsize
    return out


def _stretches(texts: list[bytes], length: int, stretch: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of about `stretch` bytes: text number, its start in the text, start and end in the buffer of every part."""
    parts: list[tuple[int, int, bytes]] = []
    size = 0

    def made():
        ends = np.cumsum([len(p) for _, _, p in parts])
        return np.frombuffer(b"".join(p for _, _, p in parts), np.uint8), np.array([i for i, _, _ in parts]), np.array([a for _, a, _ in parts]), ends - [len(p) for _, _, p in parts], ends

    for i, t in enumerate(texts):
        for a in range(0, len(t) - length + 1, stretch):
            part = t[a : a + stretch + length - 1]
            if size and size + len(part) > stretch:
                yield made()
                parts, size = [], 0
            parts.append((i, a, part))
            size += len(part)
    if parts:
        yield made()


def _raw(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


_OUT = "row long, start long, n long, h long, d int, kind int"
MARK, ASK, ASK_CROWD, ASK_HORDE = 0, 1, 2, 3


def _batch(columns: dict[str, np.ndarray], kind: int) -> pa.RecordBatch:
    n = len(columns["row"])
    return pa.RecordBatch.from_arrays([pa.array(columns[c].astype(np.int64)) for c in ("row", "start", "n")] + [pa.array(columns["h"].view(np.int64)), pa.array(columns["d"].astype(np.int32)), pa.array(np.full(n, kind, np.int32))], ["row", "start", "n", "h", "d", "kind"])


def _take(columns: dict[str, np.ndarray], at) -> dict[str, np.ndarray]:
    return {c: v[at] for c, v in columns.items()}


def _firsts(columns: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """In the order of anchor, content, place: the columns, and whether each is the first of its anchor and content."""
    order = np.lexsort((columns["start"], columns["row"], columns["doc"], columns["f"], columns["h"]))
    c = _take(columns, order)
    first = np.ones(len(order), bool)
    first[1:] = (c["h"][1:] != c["h"][:-1]) | (c["f"][1:] != c["f"][:-1])
    return c, first


def _differ(c: dict[str, np.ndarray], first: np.ndarray, raw: list[bytes], length: int) -> np.ndarray:
    """Fragments that differ in bytes from the first of their hashes."""
    later = np.flatnonzero(~first)
    of = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))[later]

    def read(at: np.ndarray) -> Iterator[bytes]:
        for t, s, n in zip(c["text"][at].tolist(), c["start"][at].tolist(), c["n"][at].tolist(), strict=True):
            yield raw[t][s : s + n + length - 1]

    differ = np.zeros(len(first), bool)
    differ[later] = np.fromiter((x != y for x, y in zip(read(later), read(of), strict=True)), bool, len(later))
    return differ


def _anchors(length: int, buckets: int, stretch: int):
    """(bucket, kind, blob): fragments for each bucket, and repeats settled within the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, ANCHORED) for whole in batches for i in range(0, whole.num_rows, ANCHORED)):
            docs = np.array([_NULL if d is None else d for d in b.column(0).to_pylist()], np.int64)
            rows, raw = b.column(1).to_numpy(), _raw(b.column(2))
            found = []
            for buffer, text, at, starts, ends in _stretches(raw, length, stretch):
                h, f, first, n, d = fragments(buffer, starts, ends, length)
                part = np.searchsorted(ends, first, "right")
                found.append({"h": h, "f": f, "doc": docs[text[part]], "row": rows[text[part]], "start": at[part] + first - starts[part], "n": n, "d": d, "text": text[part]})
            if not found:
                continue
            c, first = _firsts({k: np.concatenate([x[k] for x in found]) for k in found[0]})
            first |= _differ(c, first, raw, length)
            kept, again = _take(c, first), _take(c, ~first)
            # In the order of the texts places are long runs that compress well.
            kept = _take(kept, np.lexsort((kept["start"], kept["row"])))
            bucket = (kept["h"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            filled, begin = np.unique(bucket[order], return_index=True)
            out = [(int(i), 1, _packed(kept, order[a:e])) for i, a, e in zip(filled, begin, [*begin[1:], len(order)], strict=True)]
            out += [(int(rows[0]) % buckets, 0, _packed(again, slice(None)))] if len(again["row"]) else []
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["bucket", "kind", "blob"])

    return run


def _meet(crowd: int, horde: int):
    """Rows sorted by bucket: repeats that their batch has settled (MARK), and fragments to be read again (ASK)."""

    def asked(held: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        h = np.concatenate([x["h"] for x in held])
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        shared = np.zeros(len(h), bool)
        shared[order[1:][same]] = shared[order[:-1][same]] = True
        c, first = _firsts(_take({k: np.concatenate([x[k] for x in held]) for k, _ in _FIELDS}, shared))
        _, at = np.unique(c["h"], return_inverse=True)
        contents = np.bincount(at, first).astype(np.int64)[at]
        yield _batch(_take(c, contents <= crowd), ASK)
        yield _batch(_take(c, (contents > crowd) & (contents <= horde)), ASK_CROWD)
        yield _batch(_take(c, contents > max(crowd, horde)), ASK_HORDE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for b in batches:
            for bucket, kind, blob in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if not kind:
                    yield _batch(_unpacked(blob), MARK)
                    continue
                if bucket != last and held:
                    yield from asked(held)
                    held = []
                last = bucket
                held.append(_unpacked(blob))
        if held:
            yield from asked(held)

    return run


def _cut(a: dict, text: bytes, length: int) -> Iterator[tuple[int, int, int]]:
    """(key, start, windows) of the parts that a fragment asked for is read in."""
    s, n, d = a["start"], a["n"], a["d"]
    if a["kind"] == ASK:
        yield a["h"], s, n
        return
    chunk = CHUNK if a["kind"] == ASK_CROWD else 1
    for j in range((d - n + 1) // chunk, d // chunk + 1):
        hi, lo, shared = min(d, chunk * j + chunk - 1), max(d - n + 1, chunk * j), s + d - chunk * j
        digest = hashlib.blake2b(text[shared : shared + length - chunk + 1], digest_size=8, key=b"%d" % j).digest()
        yield int.from_bytes(digest, "little", signed=True), s + d - hi, hi - lo + 1


def _read_again(length: int):
    """(key, doc, row, start, n, bytes) of the parts of the fragments asked for; without bytes where an equal part of the batch stands earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, DOCS):
                b, out = whole.slice(at, DOCS), []
                first: dict[tuple[int, bytes], int] = {}
                for doc, row, text, asked in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _raw(b.column(2)), b.column(3).to_pylist(), strict=True):
                    doc = _NULL if doc is None else doc
                    for key, s, n in (x for a in asked for x in _cut(a, text, length)):
                        _earliest(first, out, [key, doc, row, s, n, text[s : s + n + length - 1]])
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(),) * 5 + (pa.binary(),))], ["key", "doc", "row", "start", "n", "bytes"])

    return run


def _earliest(first: dict[tuple[int, bytes], int], out: list[list], part: list) -> None:
    """Add a part to out; of two with the same key and bytes the later one loses its bytes."""
    same = part[0], part[5]
    at = first.setdefault(same, len(out))
    if at < len(out):
        if part[1:4] < out[at][1:4]:
            out[at][5] = None
            first[same] = len(out)
        else:
            part[5] = None
    out.append(part)


def sorted_suffixes(symbols: np.ndarray, depth: int) -> np.ndarray:
    """The suffix array to the first `depth` symbols; symbols are 0..256 and end with a 0.

    Suffixes smaller than their successors are sorted directly, eight symbols' keys at a time, and only while tied.
    Each other suffix is larger than its successor, so scanning the buckets (suffixes by first symbol) upwards
    finds every successor before it: taking what stands before each suffix in turn puts it in place.
    """
    n = len(symbols)
    step = np.empty(n, np.int64)
    step[:-1] = np.sign(symbols[:-1].astype(np.int64) - symbols[1:])
    step[-1] = -1  # nothing stands after the end
    at = np.where(step != 0, np.arange(n), n)
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    bigger = step[nearest] > 0  # than its successor
    direct = np.flatnonzero(~bigger)
    padded = np.concatenate((symbols, np.zeros(depth + 8, symbols.dtype)))
    order, group = direct, np.zeros(len(direct), np.int64)
    tied = np.arange(len(direct))
    for k in range(0, depth, 7):
        key = np.zeros(len(tied), np.uint64)
        for i in range(7):  # 257 symbols take nine bits
            key = key << np.uint64(9) | padded[order[tied] + k + i].astype(np.uint64)
        by = np.lexsort((key, group[tied]))
        order[tied], key, g = order[tied][by], key[by], group[tied]
        differs = np.ones(len(tied), bool)
        differs[1:] = (key[1:] != key[:-1]) | (g[1:] != g[:-1])
        group[tied] = tied[np.maximum.accumulate(np.where(differs, np.arange(len(tied)), 0))]
        more = ~differs
        more[:-1] |= ~differs[1:]
        tied = tied[more]
        if not len(tied):
            break
    head = np.searchsorted(symbols[order], np.arange(258))
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []

    def scan(suffixes: np.ndarray) -> np.ndarray:
        """Put what stands before these, in their order, into its buckets; what belongs to the same bucket is returned."""
        before = suffixes[suffixes > 0] - 1
        before = before[bigger[before]]
        s = symbols[before]
        by = np.argsort(s, kind="stable")
        before, s = before[by], s[by]
        own = before[:0]
        if not len(s):
            return own
        cuts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        for a, e in zip(cuts, [*cuts[1:], len(s)], strict=True):
            if s[a] == current:
                own = before[a:e]
            else:
                waiting[s[a]].append(before[a:e])
        return own

    for current in range(257):
        level = np.concatenate(waiting[current]) if waiting[current] else order[:0]
        while len(level):
            out.append(level)
            level = scan(level)
        own = order[head[current] : head[current + 1]]
        out.append(own)
        scan(own)
    return np.concatenate(out)


def adjacent_prefixes(buffer: np.ndarray, suffixes: np.ndarray, most: int) -> np.ndarray:
    """Common prefix, in bytes and to `most`, of each suffix with the one before it; the first has 0."""
    padded = np.concatenate((buffer, np.zeros(most + 8, np.uint8)))
    w = _words(padded)
    out = np.zeros(len(suffixes), np.int64)
    open_ = np.arange(1, len(suffixes))
    for k in range(0, most, 8):
        differ = w[suffixes[open_] + k] ^ w[suffixes[open_ - 1] + k]
        same = differ == 0
        bit = differ[~same] & (~differ[~same] + np.uint64(1))
        out[open_[~same]] = k + np.log2(bit.astype(np.float64)).astype(np.int64) // 8
        open_ = open_[same]
        out[open_] = k + 8
    return np.minimum(out, most)


def repeated_windows(doc: np.ndarray, row: np.ndarray, start: np.ndarray, count: np.ndarray, pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, windows) runs of the fragments' windows that also stand earlier among them."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    buffer = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    symbols = buffer.astype(np.int16) + 1
    symbols[begin + sizes] = 0
    which = np.repeat(np.arange(len(pieces)), sizes + 1)
    offset = np.arange(len(buffer)) - begin[which]
    suffixes = sorted_suffixes(symbols, length)
    suffixes = suffixes[offset[suffixes] < count[which[suffixes]]]  # the windows; a fragment's tail only orders them
    new = adjacent_prefixes(buffer, suffixes, length) < length
    group = np.cumsum(new)
    w = which[suffixes]
    place = start[w] + offset[suffixes]
    by = np.lexsort((place, row[w], doc[w], group))
    later = np.ones(len(by), bool)
    later[0:1] = False
    g, r, p = group[by], row[w][by], place[by]
    later[1:] = g[1:] == g[:-1]
    # One place may come from several fragments of a crowd's cuts only once: places are distinct within a group.
    r, p = r[later], p[later]
    by = np.lexsort((p, r))
    r, p = r[by], p[by]
    cut = np.ones(len(r), bool)
    cut[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1)
    firsts = np.flatnonzero(cut)
    return r[firsts], p[firsts], np.diff(np.append(firsts, len(r)))


def _sort_fragments(length: int):
    """Rows sorted by key. Of equal parts of a key one is held, the earliest so far; the others are repeats as wholes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        first: dict[bytes, int] = {}
        size, begun, last = 0, 0, None

        def settled() -> pa.RecordBatch:
            doc, row, start, n = (np.array([x[i] for x in held], np.int64) for i in (1, 2, 3, 4))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in repeated_windows(doc, row, start, n, [x[5] for x in held], length)], ["row", "start", "n"])

        for b in batches:
            marks = []
            for x in map(list, zip(*(b.column(i).to_pylist() for i in range(6)), strict=True)):
                if x[5] is None:
                    marks.append(x)
                    continue
                if x[0] != last:
                    if len(held) - begun == 1:  # one content only: nothing to sort
                        size -= len(held.pop()[5])
                    if size >= BLOCK:
                        yield settled()
                        held, size = [], 0
                    first, begun, last = {}, len(held), x[0]
                at = first.setdefault(x[5], len(held))
                if at == len(held):
                    held.append(x)
                    size += len(x[5])
                elif x[1:4] < held[at][1:4]:
                    marks.append(held[at])
                    held[at] = x
                else:
                    marks.append(x)
            if marks:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in marks], pa.int64()) for i in (2, 3, 4)], ["row", "start", "n"])
        if held:
            yield settled()

    return run


def repeats(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD, stretch: int = STRETCH, horde: int = HORDE) -> DataFrame:
    """(_row, _spans): runs of windows that stand earlier too, for rows of numbered docs (doc_id, _row, text)."""
    spark = docs.sparkSession
    n = partitions(spark)
    texts = docs.select("doc_id", "_row", "text")
    buckets = max(n, min(scan_bytes(docs) // BUCKET, 1 << 30))
    blobs = texts.mapInArrow(lean("suffixes", _anchors(length, buckets, stretch)), "bucket int, kind int, blob binary").repartition(n, "bucket").sortWithinPartitions("bucket")
    met = stored(blobs.mapInArrow(lean("suffixes", _meet(crowd, horde)), _OUT), "repeats")
    asked = met.where(F.col("kind") != MARK).groupBy("row").agg(F.collect_list(F.struct("start", "n", "h", "d", "kind")).alias("asked")).withColumnRenamed("row", "_row")
    again = texts.join(asked, "_row").select("doc_id", "_row", "text", "asked").mapInArrow(lean("suffixes", _read_again(length)), "key long, doc long, row long, start long, n long, bytes binary")
    sorted_ = again.repartition(n, "key").sortWithinPartitions("key").mapInArrow(lean("suffixes", _sort_fragments(length)), "row long, start long, n long")
    marks = stored(sorted_, "marks").union(met.where(F.col("kind") == MARK).select("row", "start", "n"))
    return marks.groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("_spans")).withColumnRenamed("row", "_row")


def removed_spans(spans: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal [start, end) runs of bytes covered by windows."""
    out: list[tuple[int, int]] = []
    for a, e in sorted((s["start"], s["start"] + s["n"] + length - 1) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((a, e))
    return out


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, e in spans:
        parts.append(text[at:a])
        at = e
    return b"".join([*parts, text[at:]])


def _digests(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, spans in zip(b.column(0).to_pylist(), _raw(b.column(1)), b.column(2).to_pylist(), strict=True):
                gone = removed_spans(spans, length)
                out.append((doc, len(text), sum(e - a for a, e in gone), len(gone), hashlib.sha256(_kept(text, gone)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(),) * 4 + (pa.string(),))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _texts(length: int, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            for whole, text, spans in zip(b.column(at).is_valid().to_pylist(), _raw(b.column(at)), b.column(b.num_columns - 1).to_pylist(), strict=True):
                kept.append(_kept(text, removed_spans(spans, length)).decode("utf-8", "ignore") if whole else None)
            columns = [pa.array(kept, pa.string()) if i == at else c for i, c in enumerate(b.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:-1])

    return run


def _with_spans(rows: DataFrame, length: int) -> DataFrame:
    return rows.join(repeats(rows, length), "_row", "left")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The columns of docs, text without the bytes that stand earlier."""
    own = renamed(docs, "doc_id", "text")
    return _with_spans(numbered(own), length).select(*own.columns, "_spans").mapInArrow(_texts(length, own.columns.index("text")), own.schema).toDF(*docs.columns)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    rows = numbered(documents(spark, sf_dir).select("doc_id", "text"))
    return _with_spans(rows, LENGTH).select("doc_id", "text", "_spans").mapInArrow(_digests(LENGTH), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
