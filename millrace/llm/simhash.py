"""SimHash near-duplicates: fingerprints, BK-trees over shards of them, components.

Fingerprints of 64 bits are cut into BANDS, one more than the bits that two linked ones may differ in, so that these agree
in some band. For each band the distinct fingerprints are dealt to shards by a hash of its value, many values to a
shard of about `shard` members: every link lies within some shard. A value with more members than that is dealt again
by bands of the bits still open, twice at most, after which 19 open bits bound it.

A shard's members make a BK-tree (children keyed by their Hamming distance to the parent), held in arrays; every member
is looked up in it, a block of them at a time, following only edges within the radius. Of 16,384 random members a look-up
meets some 180 (1.1 %), so work is the number of fingerprints times a constant. A spanning forest of the links is emitted,
not all pairs. Trees live where their shard is: they hold three times eight bytes of every distinct fingerprint, 0.4 GB
for the 15 million documents of 30 GB and above a terabyte for 100 TB, so a broadcast would have no bound and would send
all fingerprints through the driver.

Nulls and empty texts have fingerprint zero and are linked like any other; texts of one or two words are hashed whole;
texts of any length count whole; repeated rows share a fingerprint and so a component, in which ties go to the smallest
doc_id; a null doc_id takes no part in naming components, and a component of such rows alone has a null name. Extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, documents, named_by, partitions, small, stored

RADIUS, SHINGLE, SEED = 2, 3, 42
BANDS, DEALS, SHARD = RADIUS + 1, 3, 16_384
#: Nodes that a block of look-ups may meet at once, were none pruned.
BLOCK = 1 << 22

#: The eight bits of each octet, most significant first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of word shingles, as an unsigned integer; zero for no words."""
    from xxhash import xxh64_digest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and white space only
    if not words:
        return 0
    n, total, joined = max(1, len(words) - shingle + 1), np.zeros(64, np.int64), b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    for at in range(0, n, 1 << 16):  # bounded memory for the longest texts
        h = b"".join([xxh64_digest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)])
        octets = np.frombuffer(h, np.uint8).reshape(-1, 8)
        total += np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])


class BKTree:
    """A metric tree of distinct integers under Hamming distance, built and searched level by level. A node's number is its value's."""

    def __init__(self, values: np.ndarray):
        self.values = values
        keys, children = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        rest = np.arange(1, len(values))
        at = np.zeros(len(rest), np.int64)
        while len(rest):
            key = at * 65 + np.bitwise_count(values[rest] ^ values[at])
            order = np.argsort(key, kind="stable")
            key, rest = key[order], rest[order]
            first = np.concatenate(([True], key[1:] != key[:-1]))
            keys.append(key[first])
            children.append(rest[first])
            at, rest = rest[first][np.cumsum(first) - 1][~first], rest[~first]
        order = np.argsort(np.concatenate(keys))
        #: Edges in the order of parent and distance.
        self.keys, self.children = np.concatenate(keys)[order], np.concatenate(children)[order]
        self.met = 0

    def within(self, asked: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(number in asked, node) of every pair that differs in `radius` bits at most."""
        who, node = np.arange(len(asked)) if len(self.values) else np.zeros(0, np.int64), np.zeros(len(asked) if len(self.values) else 0, np.int64)
        out = [(who[:0], node[:0])]
        while len(who):
            self.met += len(who)
            d = np.bitwise_count(asked[who] ^ self.values[node]).astype(np.int64)
            near = d <= radius
            out.append((who[near], node[near]))
            begin = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
            n = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), "right") - begin
            who = np.repeat(who, n)
            node = self.children[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def shard_links(members: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints, as pairs of numbers."""
    tree, up, out = BKTree(members), {}, []

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    block = max(1, BLOCK // max(1, len(members)))
    for at in range(0, len(members), block):
        who, node = tree.within(members[at : at + block], radius)
        who += at
        later = node < who
        for x, y in zip(who[later].tolist(), node[later].tolist(), strict=True):
            if (a := top(x)) != (b := top(y)):
                up[a] = b
                out.append((x, y))
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, shard, fp) sorted; only one shard is held."""

    def made(members: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        values = np.concatenate(members).view(np.uint64) if members else np.zeros(0, np.uint64)
        if len(values) > 1 and (found := shard_links(values)):
            e = values[np.array(found, np.int64)].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(e[:, 0])), pa.array(np.ascontiguousarray(e[:, 1]))], ["a", "b"])

    last, members = None, []
    for b in batches:
        keys = np.stack([b.column(i).to_numpy() for i in (0, 1)], 1)
        fp = b.column(2).to_numpy()
        cuts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1)))).tolist() if len(keys) else []
        for a, e in zip(cuts, [*cuts[1:], len(keys)], strict=True):
            if tuple(keys[a]) != last:
                yield from made(members)
                last, members = tuple(keys[a]), []
            members.append(fp[a:e])
    yield from made(members)


def _bands(open_bits: list[int], n: int = BANDS) -> list[tuple[int, list[int]]]:
    """(mask as a signed integer, the bits still open) of each of n bands of the open bits."""
    out, at = [], 0
    for i in range(n):
        end = at + (len(open_bits) - at) // (n - i)
        mask = sum(1 << p for p in open_bits[at:end])
        out.append((mask - (1 << 64) if mask >> 63 else mask, open_bits[:at] + open_bits[end:]))
        at = end
    return out


def fingerprint_links(distinct: DataFrame, shard: int = SHARD) -> DataFrame:
    """(a, b): a spanning forest, over each shard, of the links between the stored distinct fingerprints fp."""
    spark = distinct.sparkSession
    shards = max(1, -(-distinct.count() // shard))
    paths: dict[int, list[int]] = {0: list(range(64))}
    rows, parts = distinct.select(F.lit(0).alias("path"), F.lit(0).cast("long").alias("key"), "fp"), []
    for deal in range(DEALS):
        bands = {p * BANDS + j: (p, mask, left) for p, bits in paths.items() for j, (mask, left) in enumerate(_bands(bits))}
        # A key is a hash of all bits that its members agree in; two that collide only share a shard.
        each = F.array_compact(F.array(*(F.when(F.col("path") == p, F.struct(F.lit(q).alias("path"), F.xxhash64("key", F.lit(q), F.col("fp").bitwiseAND(F.lit(mask))).alias("key"))) for q, (p, mask, _) in bands.items())))
        rows = rows.select("fp", F.explode(each).alias("s")).select("s.path", "s.key", "fp")
        paths = {q: left for q, (_, _, left) in bands.items()}
        crowd = rows.groupBy("path", "key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > shard).select("path", "key")
        crowd = stored(crowd, "crowd") if deal < DEALS - 1 else None
        if crowd is None or crowd.isEmpty():
            parts.append(rows)
            break
        few = small(crowd)
        parts.append(rows.join(few, ["path", "key"], "left_anti").select("path", "key", "fp"))
        rows = stored(rows.join(few, ["path", "key"], "left_semi").select("path", "key", "fp"), "crowded")
    n = partitions(spark)
    # What is dealt again keeps a shard for each key; the first deal puts many keys in one.
    dealt = parts[0].select("path", F.pmod("key", F.lit(shards)).alias("shard"), "fp")
    for p in parts[1:]:
        dealt = dealt.union(p.select("path", F.col("key").alias("shard"), "fp"))
    return dealt.repartition(n, "path", "shard").sortWithinPartitions("path", "shard", "fp").mapInArrow(_links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """doc_id, fp (signed 64 bits) and component_id of every row of docs (doc_id, text)."""
    of = stored(docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    distinct = stored(of.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    parts = connected_components(fingerprint_links(distinct.select("fp"), shard))
    named = parts.join(distinct.withColumnRenamed("fp", "node"), "node")
    names = named.groupBy("component").agg(F.min("first").alias("component_id")).join(parts, "component").select(F.col("node").alias("fp"), "component_id")
    every = stored(distinct.join(names, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")), "components")
    return named_by(of, every, "fp").select("doc_id", "fp", "component_id")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id for every document."""
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
