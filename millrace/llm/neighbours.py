"""Approximate nearest neighbours by multi-index hashing.

Codes are the signs of centred, rotated vectors; the rotation is learned by iterative quantisation on a bounded sample
(about SAMPLE rows), the codes index every row. Rows are dealt by hash to shards. A shard cuts its codes into m
substrings of eight bits and indexes each. If two codes differ in fewer than m (s + 1) bits, some substring differs in at
most s: probing every substring's values within s retrieves every code within that radius. For each query s grows until
the guaranteed radius holds the shard's part of WIDTH * sqrt(n) codes of n (one at least); the codes of the smallest such
radius are ranked by Euclidean distance of the original vectors in double precision, and the shards' best k are merged.
The rule is one formula for tables of all sizes; the share of rows ranked falls as the table grows.

Where neighbours differ in few bits the probes are few. Where vectors are spread evenly over many dimensions, neighbours
differ in 40 % of the bits, and any radius that holds them makes the probes reach most codes of a shard: work then is
queries times rows, in popcounts, and the ranking alone is spared. The queries are a stated set (rows whose id is
divisible by 100) held against all rows in blocks. A shard has SHARD rows at most, so that its queries are few copies.

Equal vectors tie, so of each distinct vector only its k + 1 smallest (id, row) can be in a result (one may be the query):
the rest are left out before anything is shuffled. This loses nothing and leaves no hot bucket.

Vectors null, zero, or holding null or non-finite components take no part; a vector meets only those of its own
dimension; ids that are null take no part; repeated rows are rows, each in results and, where its id makes it a query,
with a result of its own, in which the others of its id stand; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import numbered, partitions, stored, table

K, EVERY = 10, 100
BITS, SAMPLE, ITERATIONS, WIDTH, BLOCK = 512, 8192, 10, 2.0, 256
#: Rows of a shard: SHARD at most, and fewer than LEAST only in a table that has no more.
SHARD, LEAST = 1 << 18, 4096
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: The 256 differences of a substring by their number of bits, and how many have at most s.
_NEAR = np.argsort(_POP, kind="stable").astype(np.uint8)
_WITHIN = np.cumsum(np.bincount(_POP))


def learn(sample: np.ndarray, bits: int = BITS, iterations: int = ITERATIONS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Centre and projection [dimension, bits], bits being a multiple of 64.

    Principal directions, rotated so that signs lose least; where there are more bits than dimensions the directions
    are repeated in further rotations.
    """
    rng, dim = np.random.default_rng(seed), sample.shape[1]
    mean = sample.mean(0)
    centred = sample - mean
    _, vectors = np.linalg.eigh(centred.T @ centred)
    made = []
    while sum(m.shape[1] for m in made) < bits:
        n = min(dim, bits - sum(m.shape[1] for m in made))
        basis = vectors[:, ::-1][:, :n]
        z = centred @ basis
        r = np.linalg.qr(rng.normal(size=(n, n)))[0]
        for _ in range(iterations):
            u, _, vt = np.linalg.svd(np.where(z @ r > 0, 1.0, -1.0).T @ z)
            r = (u @ vt).T
        made.append(basis @ r)
    return mean, np.concatenate(made, 1)


class MultiIndex:
    """One shard: its vectors, codes and a table of each substring."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, mean: np.ndarray, projection: np.ndarray):
        self.rows, self.ids, self.vectors, self.mean, self.projection = rows, ids, vectors, mean, projection
        self.codes = np.concatenate([self.code(vectors[i : i + 8192]) for i in range(0, len(vectors), 8192)])
        self.words = self.codes.view(np.uint64)
        m = self.codes.shape[1]
        self.order = np.stack([np.argsort(self.codes[:, t], kind="stable").astype(np.int32) for t in range(m)])
        self.ends = np.stack([np.cumsum(np.bincount(self.codes[:, t], minlength=256)) for t in range(m)])
        self.begins = np.concatenate((np.zeros((m, 1), np.int64), self.ends[:, :-1]), 1)

    def code(self, vectors: np.ndarray) -> np.ndarray:
        return np.packbits((vectors.astype(float) - self.mean) @ self.projection > 0, axis=1)

    def within(self, code: np.ndarray, candidates: int) -> np.ndarray:
        """Places in the smallest Hamming radius that holds `candidates` codes (all, if fewer)."""
        m, n = len(code), len(self.codes)
        want, word = min(candidates, n), code.view(np.uint64)
        found, near, done = np.zeros(n, bool), np.zeros(0, np.int64), 0
        flat, base = self.order.ravel(), (np.arange(m) * n)[:, None]
        for s in range(9):
            values = code[:, None] ^ _NEAR[None, done : _WITHIN[s]]
            done = _WITHIN[s]
            at = np.arange(m)[:, None]
            begin, size = (base + self.begins[at, values]).ravel(), (self.ends[at, values] - self.begins[at, values]).ravel()
            before = np.cumsum(size) - size
            found[flat[np.repeat(begin - before, size) + np.arange(size.sum())]] = True
            near = np.flatnonzero(found)
            if len(near) < want:
                continue
            bits = np.bitwise_count(self.words[near] ^ word).sum(1, dtype=np.int64)
            held = np.cumsum(np.bincount(bits, minlength=8 * m + 1)[: m * (s + 1)])
            if held[-1] >= want:
                return near[bits <= np.searchsorted(held, want)]
        return near

    def search(self, rows: np.ndarray, queries: np.ndarray, k: int, candidates: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """(query's row, places of the best, distances, codes ranked) of each query."""
        for row, q, code in zip(rows, queries, self.code(queries), strict=True):
            at = self.within(code, candidates + 1)
            at = at[self.rows[at] != row]
            distance = np.sqrt(((self.vectors[at].astype(float) - q) ** 2).sum(1))
            best = np.lexsort((self.rows[at], self.ids[at], distance))[:k]
            yield row, at[best], distance[best], len(at)


_FOUND = "query_row long, query_id long, row long, vec_id long, score double, shard long, ranked long"


def _search(model, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by shard, a shard's own vectors (kind 0) before the queries (kind 1)."""
        shard, index, held, asked = None, None, [], []

        def answers() -> Iterator[pa.RecordBatch]:
            nonlocal index, held, asked
            if index is None and held:
                mean, projection, _ = model.value[shard[1]]
                index = MultiIndex(*(np.concatenate([x[i] for x in held]) for i in range(3)), mean, projection)
                held = []
            if index is not None and asked:
                candidates = model.value[shard[1]][2](len(index.rows))
                rows, ids, vectors = (np.concatenate([x[i] for x in asked]) for i in range(3))
                out = list(index.search(rows, vectors.astype(float), k, candidates))
                size = [len(at) for _, at, _, _ in out]
                at = np.concatenate([x for _, x, _, _ in out])
                columns = [np.repeat(rows, size), np.repeat(ids, size), index.rows[at], index.ids[at], np.concatenate([d for _, _, d, _ in out]), np.full(len(at), shard[0]), np.repeat(np.array([n for *_, n in out], np.int64), size)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_row", "query_id", "row", "vec_id", "score", "shard", "ranked"])
            asked = []

        for b in batches:
            keys = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)], 1)
            cuts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1)))).tolist() if len(keys) else []
            for a, e in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                s, d, kind = keys[a].tolist()
                if (s, d) != shard:
                    yield from answers()
                    shard, index, held, asked = (s, d), None, [], []
                part = b.slice(a, e - a)
                rows, ids = part.column(3).to_numpy(), part.column(4).to_numpy()
                vectors = part.column(5).flatten().to_numpy().reshape(-1, d)
                if kind == 0:
                    held.append((rows, ids, vectors))
                    continue
                for i in range(0, len(rows), BLOCK):
                    asked.append((rows[i : i + BLOCK], ids[i : i + BLOCK], vectors[i : i + BLOCK]))
                    if sum(len(x[0]) for x in asked) >= BLOCK:
                        yield from answers()
        yield from answers()

    return run


class Candidates:
    """How many codes a shard of some size has to hold within a query's radius: its part of WIDTH * sqrt(n), one at least."""

    def __init__(self, n: int, width: float):
        self.share = width * math.sqrt(n) / n

    def __call__(self, size: int) -> int:
        return math.ceil(self.share * size)


def found(rows: DataFrame, is_query, k: int = K, shard: int = SHARD, least: int = LEAST, width: float = WIDTH, bits: int = BITS, sample: int = SAMPLE) -> DataFrame:
    """The shards' best k of each query, and how many codes each shard ranked for it."""
    spark = rows.sparkSession
    usable = F.expr("vec_id IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists(embedding, x -> x != 0)")
    whole = stored(numbered(rows.select("vec_id", "embedding")).where(usable).withColumn("dim", F.size("embedding")), "vectors")
    few = whole.withColumn("_r", F.row_number().over(W.partitionBy("embedding").orderBy("vec_id", "_row"))).where(F.col("_r") <= k + 1).drop("_r")
    sizes = {r.dim: r.n for r in whole.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    models, count = {}, {}
    for dim, n in sizes.items():
        drawn = whole.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("_row", F.lit("sample")), F.lit(1 << 30)) < F.lit(min(1.0, sample / n) * (1 << 30)))).select("embedding").limit(2 * sample).toArrow()
        flat = np.array(drawn.column(0).combine_chunks().flatten(), float).reshape(-1, dim) if drawn.num_rows else np.zeros((1, dim))
        models[dim], count[dim] = (*learn(flat, bits), Candidates(n, width)), max(1, -(-n // shard), min(partitions(spark), n // least))
    if not sizes:
        return spark.createDataFrame([], _FOUND)
    model = spark.sparkContext.broadcast(models)
    shards = F.element_at(F.create_map(*(F.lit(x) for d, n in count.items() for x in (d, n))), F.col("dim"))
    columns = ["shard", "dim", "kind", "_row", "vec_id", "embedding"]
    index = few.withColumns({"shard": F.pmod(F.xxhash64("_row"), shards).cast("long"), "kind": F.lit(0)}).select(*columns)
    asked = whole.where(is_query).withColumns({"shard": F.explode(F.sequence(F.lit(0), shards - 1).cast("array<bigint>")), "kind": F.lit(1)}).select(*columns)
    dealt = index.union(asked).repartition(partitions(spark), "shard", "dim").sortWithinPartitions("shard", "dim", "kind", "_row")
    return dealt.mapInArrow(_search(model, k), _FOUND)


def nearest(rows: DataFrame, is_query, k: int = K, **how) -> DataFrame:
    """query_id, rank, vec_id, score of rows (vec_id, embedding) for the rows that is_query holds for."""
    by = W.partitionBy("query_row").orderBy("score", "vec_id", "row")
    best = found(rows, is_query, k, **how).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the ten nearest of every row whose id is divisible by 100."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
