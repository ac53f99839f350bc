"""Approximate nearest neighbours by a hash-prefix forest."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, spread, stage
from .shingles import _runs_of

#: Trees, and bits of each tree's hash strings.
TREES, BITS = 128, 16
#: Vectors of a shard's forest, at most, by plan.
SHARD_ROWS = 32_768
#: Share of a shard's vectors that are a query's candidates, scored exactly, and candidates per neighbour at least.
SHARE, PER_NEIGHBOUR = 0.2, 10
#: A tree's range holds this part of the candidates when the ascent stops, so that they come from several trees.
PART = 1 / 3
#: Queries of a shard whose ranges are held at a time.
QUERY_ROWS = 256
SEED = 5


def planes(dim: int, trees: int, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((trees * bits, dim))


def hashes(vectors: np.ndarray, trees: int = TREES, bits: int = BITS) -> np.ndarray:
    """A hash string per tree and vector, as an unsigned number with the first bit on top."""
    signs = vectors @ planes(vectors.shape[1], trees, bits).T >= 0
    packed = np.packbits(signs.reshape(len(vectors), trees, bits), axis=2)
    return np.ascontiguousarray(packed).view(">u2").astype(np.uint16).reshape(len(vectors), trees).T.copy()


class Forest:
    """The sorted hash strings of each tree over one shard, whose vectors come by falling preference on ties."""

    def __init__(self, vectors: np.ndarray):
        # Inner products are cosines after one more coordinate lifts all vectors to the longest one's length.
        norms = (vectors**2).sum(axis=1)
        lifted = np.hstack([vectors, np.sqrt(np.maximum(norms.max(initial=0) - norms, 0))[:, None]])
        found = np.hstack([hashes(part) for part in np.array_split(lifted, len(lifted) // 4096 + 1)])
        self.order = np.argsort(found, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(found, self.order, axis=1)

    def ranges(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end of the range of vectors that share a prefix with a query: prefix length - 1, tree, query."""
        keys = hashes(np.hstack([queries, np.zeros((len(queries), 1))]))
        low, high = (np.empty((BITS, len(self.sorted), len(queries)), np.int32) for _ in range(2))
        for level in range(1, BITS + 1):
            rest = np.uint16((1 << (BITS - level)) - 1)
            for t, listed in enumerate(self.sorted):
                low[level - 1, t] = np.searchsorted(listed, keys[t] & ~rest, "left")
                high[level - 1, t] = np.searchsorted(listed, keys[t] | rest, "right")
        return low, high

    def candidates(self, queries: np.ndarray, wanted: int) -> Iterator[np.ndarray]:
        """Per query the ``wanted`` vectors that share the most and longest prefixes with it.

        Binary searches descend to each tree's longest match. Then all trees shorten their prefix in step; a vector is
        met again at each step and tree whose range holds it. The ascent stops when the ranges hold PART of
        ``wanted`` on average and ``wanted`` different vectors together; those met most often are the candidates, the first
        ones on ties. A query among many alike stops at a long prefix, a lone one goes up further.
        """
        trees, n = self.sorted.shape
        low, high = self.ranges(queries)
        for q in range(len(queries)):
            met = np.zeros(n, np.int64)
            for level in range(BITS - 1, -1, -1):
                size = high[level, :, q] - low[level, :, q]
                met += np.bincount(self._members(low[level, :, q], size), minlength=n)
                if size.sum() >= PART * wanted * trees and np.count_nonzero(met) >= wanted:
                    break
            if wanted < n:
                least = np.partition(met, n - wanted)[n - wanted]
                (surely,), (rest,) = (met > least).nonzero(), (met == least).nonzero()
                yield np.concatenate([surely, rest[: wanted - len(surely)]])
            else:
                yield np.arange(n)

    def _members(self, low: np.ndarray, size: np.ndarray) -> np.ndarray:
        starts = low + np.arange(len(low), dtype=np.int64) * self.order.shape[1]
        return self.order.ravel()[spread(starts, size)]


def search_shard(forest: Forest, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, qrows: np.ndarray, queries: np.ndarray, k: int, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, vector position, score) of each query's ``k`` nearest candidates; ties to smaller ids."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    wanted = min(len(vectors), max(PER_NEIGHBOUR * k + 1, int(np.ceil(share * len(vectors)))))
    for q, found in enumerate(forest.candidates(queries, wanted)):
        found = found[rows[found] != qrows[q]]
        near = vectors[found] @ queries[q]
        if len(found) > k:
            edge = np.partition(near, len(near) - k)[len(near) - k]
            found = found[near >= edge - 1e-9 * (1 + abs(edge))]
        score = (vectors[found] * queries[q]).sum(axis=1)  # row by row alike, so that equal vectors tie
        best = np.lexsort((ids[found], -score))[:k]
        out.append((np.full(len(best), q), found[best], score[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _searcher(k: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell: its vectors, which are held, then its queries, which pass by."""
        cell, held, forest = None, [], None
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            asked = batch.column("asked").to_numpy(zero_copy_only=False)
            ids, rows = batch.column("id").to_numpy(), batch.column("row").to_numpy()
            vectors = batch.column("v").flatten().to_numpy().reshape(len(ids), -1)
            bounds = [*(_runs_of(cells, asked).nonzero()[0]).tolist(), len(ids)]
            for i, j in pairwise(bounds):
                if cells[i] != cell:
                    cell, held, forest = cells[i], [], None
                if not asked[i]:
                    held.append((ids[i:j], rows[i:j], vectors[i:j]))
                    continue
                if not held:
                    continue
                if forest is None:
                    own = tuple(np.concatenate(x) for x in zip(*held, strict=True))
                    own = tuple(x[np.lexsort((own[1], own[0]))] for x in own)
                    held, forest = [own], Forest(own[2])
                for a in range(i, j, QUERY_ROWS):
                    part = slice(a, min(j, a + QUERY_ROWS))
                    q, v, score = search_shard(forest, *held[0], rows[part], vectors[part], k, share)
                    yield pa.RecordBatch.from_arrays([pa.array(rows[part][q]), pa.array(ids[part][q]), pa.array(held[0][0][v]), pa.array(score)], ["qrow", "query_id", "vec_id", "score"])

    return run


def nearest(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", every: int = 20, k: int = 20, share: float = SHARE) -> DataFrame:
    """Columns query_id, rank, vec_id, score: the ``k`` nearest found of each row whose id is divisible by ``every``.

    Rows are dealt into shards of about SHARD_ROWS, each with its own forest, and every query meets every shard in one
    cell of a grid of shards by parts of the queries. A task holds a shard's vectors and forest while queries stream
    past, so its memory is bounded whatever the number of queries, and no table is broadcast. Where the shards alone keep
    all cores busy the queries are one part: then vectors are sent, and forests built, once, and a query is sent once for
    each shard. The shards' best are merged by query. Null, empty, zero and all vectors with null or non-finite
    components take no part, nor do rows without id or of another length than most; repeated rows are rows of their own,
    and only the query's own row is left out. Scores are inner products in double precision; ties go to the smaller id.
    """
    spark = embeddings.sparkSession
    ship(spark)
    numbers = F.transform(F.col(embedding), lambda x: x.cast("double"))
    sound = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)
    valid = embeddings.select(F.col(vec_id).cast("long").alias("id"), numbers.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & sound)
    rows = stage(valid.withColumn("row", F.monotonically_increasing_id()).withColumn("dim", F.size("v")))
    sizes = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim, n = (sizes[0]["dim"], sizes[0]["count"]) if sizes else (1, 0)
    rows = rows.where(F.col("dim") == dim)
    shards = n // SHARD_ROWS + 1
    wide = -(-2 * spark.sparkContext.defaultParallelism // shards)
    place = F.xxhash64("row")
    first = F.pmod(place, F.lit(shards)) * wide
    held = rows.select(F.explode(F.sequence(first, first + (wide - 1))).alias("cell"), F.lit(False).alias("asked"), "row", "id", "v")
    part = F.pmod(place, F.lit(wide)).cast("long")
    queries = rows.where(F.pmod("id", F.lit(every)) == 0).select(F.explode(F.sequence(part, F.lit(shards * wide - 1).cast("long"), F.lit(wide).cast("long"))).alias("cell"), F.lit(True).alias("asked"), "row", "id", "v")
    cells = held.unionByName(queries).repartitionById(shards * wide, F.col("cell").cast("int")).sortWithinPartitions("cell", "asked")
    found = cells.mapInArrow(_searcher(k, share), "qrow long, query_id long, vec_id long, score double")
    best = Window.partitionBy("qrow").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    return nearest(read_table(spark, sf_dir, "embeddings"))
