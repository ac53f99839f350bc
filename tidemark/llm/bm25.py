"""Exact top-k search by BM25: an inverted index in shards, searched with block-max pruning and merged exactly."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, ship, slices, spread, stage, utf8
from .shingles import _runs_of, word_hashes
from .substring_dedup import packed, unpacked

K1, B = 1.2, 0.75
#: Bytes of text that a shard indexes, and shards that a task holds at most.
SHARD_BYTES, SHARDS_PER_CELL = 32 << 20, 4
#: Shards up to which their numbers, some fifty bytes each, are broadcast to them; beyond it they are joined by shuffle.
BROADCAST_SHARDS = 500_000
#: Documents of a window, and postings that are read before there is a floor.
WINDOW, FIRST = 4096, 65_536
#: Postings that can be read in the time in which a cursor seeks a document, and seeks of a query at a time.
SEEK, MOST_SEEKS = 12, 1 << 20
#: Share of a shard's documents from which a term counts as frequent, frequent terms at most, queries from which their product pays,
#: and sums of a product at a time. A product is in single precision: what it is off by is at most SLACK of a sum, for so many terms.
FREQUENT, MOST_FREQUENT, FEWEST, PRODUCT, SLACK = 0.04, 1024, 8, 1 << 20, 1e-4


def _index(batches: Iterator[pa.RecordBatch], shard_bytes: int = SHARD_BYTES) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for whole in batches:
        for batch in slices(whole, "text", min(SLICE_BYTES, shard_bytes)):
            data, at = utf8(batch.column("text"))
            words, bounds = word_hashes(data, at)
            held.append((batch.column("doc_id"), words, np.diff(bounds)))
            size += len(data)
            if size >= shard_bytes:
                yield _shard(held)
                held, size = [], 0
    if held:
        yield _shard(held)


def _shard(held: list) -> pa.RecordBatch:
    """One row: counts, the terms with their document frequencies, and the postings."""
    ids = pa.concat_arrays([x[0] for x in held])
    words, lengths = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
    doc = np.repeat(np.arange(len(lengths)), lengths)
    order = np.argsort(words, kind="stable")  # documents stay in order within a term
    words, doc = words[order], doc[order]
    first = _runs_of(words, doc).nonzero()[0]
    tf = np.diff(np.append(first, len(words)))
    words, doc = words[first], doc[first]
    begin = _runs_of(words).nonzero()[0]
    blob = packed(
        i=ids.fill_null(0).to_numpy().astype(np.int64), o=ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), n=lengths.astype(np.int64),
        s=np.append(begin, len(words)).astype(np.int64), d=doc.astype(np.uint16 if len(lengths) <= 1 << 16 else np.uint32), f=tf.astype(np.uint16 if tf.max(initial=0) < 1 << 16 else np.uint32),
    )
    terms = pa.array(words[begin].view(np.int64))
    return pa.RecordBatch.from_pydict(
        {
            "shard": pa.array([uuid.uuid4().hex]),
            "n_docs": pa.array([len(lengths)], pa.int64()),
            "n_words": pa.array([int(lengths.sum())], pa.int64()),
            "terms": pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), terms),
            "dfs": pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), pa.array(np.diff(np.append(begin, len(words))).astype(np.int64))),
            "blob": pa.array([blob], pa.binary()),
        }
    )


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            words, bounds = word_hashes(*utf8(batch.column("text")))
            query = np.repeat(batch.column("query").to_numpy(), np.diff(bounds))
            order = np.lexsort((words, query))
            words, query = words[order], query[order]
            first = _runs_of(query, words).nonzero()[0]
            yield pa.RecordBatch.from_arrays([pa.array(query[first]), pa.array(words[first].view(np.int64)), pa.array(np.diff(np.append(first, len(words))))], ["query", "term", "tf"])


class Shard:
    """A shard's postings with their impacts under the corpus's mean length, in blocks with their largest impact.

    A block holds a term's postings in one window of WINDOW documents, so that the blocks of all terms end at the same
    documents, and the largest impacts of a window's blocks together bound what its documents can score.
    """

    def __init__(self, terms: np.ndarray, blob: bytes, mean: float):
        p = unpacked(blob)
        self.order = np.argsort(terms)  # terms are sorted as unsigned, asked for as signed numbers
        self.terms = terms[self.order]
        self.ids, self.no_id, start = p["i"], p["o"], p["s"]
        self.start = start
        tf, doc = p["f"].astype(np.float64), p["d"].astype(np.int64)
        self.impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * p["n"][doc] / mean)) if len(tf) else tf
        window = doc // WINDOW
        new = _runs_of(window)
        new[start[:-1]] = True
        (at,) = new.nonzero()
        self.block_at = np.append(at, len(tf))
        self.block_of = np.searchsorted(at, start)  # blocks of term t: block_of[t] to block_of[t + 1]
        self.block_window = window[at]
        self.block_top = np.maximum.reduceat(self.impact, at) if len(at) else np.zeros(0)
        self.windows = -(-len(self.ids) // WINDOW)
        self.doc, self.doc_key = doc, p["d"]
        self.bits = max(1, int(len(self.ids)).bit_length())
        self.read = 0

    @property
    def key(self) -> np.ndarray:
        """Each posting's term and document as one number, by which postings are ordered."""
        return (np.repeat(np.arange(len(self.terms)), np.diff(self.start)) << self.bits) | self.doc

    @cached_property
    def frequent(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The terms in many documents, each term's row among them or -1, and their impacts as a matrix of terms and documents."""
        df = np.diff(self.start)
        terms = (df >= max(1, FREQUENT * len(self.ids))).nonzero()[0]
        terms = terms[np.argsort(-df[terms], kind="stable")[:MOST_FREQUENT]]
        row = np.full(len(df), -1, np.int32)
        row[terms] = np.arange(len(terms))
        matrix = np.zeros((len(terms), len(self.ids)), np.float32)
        for i, (a, b) in enumerate(zip(self.start[terms].tolist(), self.start[terms + 1].tolist(), strict=True)):
            matrix[i, self.doc[a:b]] = self.impact[a:b]
        return terms, row, matrix

    @cached_property
    def top(self) -> np.ndarray:
        """Each term's largest impact."""
        return np.maximum.reduceat(self.block_top, self.block_of[:-1]) if len(self.block_top) else np.zeros(0)

    @cached_property
    def forward(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where documents begin; by document its terms and their impacts; and a place for each term's number in a query, -1 outside of it."""
        order = np.argsort(self.doc_key, kind="stable")
        begin = np.append(0, np.cumsum(np.bincount(self.doc, minlength=len(self.ids))))
        return begin, np.repeat(np.arange(len(self.terms), dtype=np.int32), np.diff(self.start))[order], self.impact[order], np.full(len(self.terms), -1)

    def products(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Per query (terms, idf) and document the sums over the frequent terms, as one product of matrices."""
        _, row, matrix = self.frequent
        asked = np.zeros((len(queries), len(matrix)), np.float32)
        for i, (terms, idf) in enumerate(queries):
            at = row[terms]
            asked[i, at[at >= 0]] = idf[at >= 0]
        return asked @ matrix

    def known(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the terms this shard has, and their positions in it."""
        at = np.searchsorted(self.terms, terms)
        held = at < len(self.terms)
        held[held] = self.terms[at[held]] == terms[held]
        return held, self.order[at[held]]

    def _sums(self, blocks: np.ndarray, weight: np.ndarray, only: np.ndarray | None = None) -> np.ndarray:
        """Per document the weighed impacts of some blocks' postings, added up in their order."""
        n = self.block_at[blocks + 1] - self.block_at[blocks]
        at = spread(self.block_at[blocks], n)
        self.read += len(at)
        doc, part = self.doc[at], self.impact[at] * np.repeat(weight, n)
        if only is not None:
            doc, part = doc[only[doc]], part[only[doc]]
        return np.bincount(doc, part, len(self.ids))

    def _whole(self, terms: np.ndarray, idf: np.ndarray) -> np.ndarray:
        """Per document the weighed impacts of all postings of some terms."""
        ends = list(zip(self.start[terms].tolist(), self.start[terms + 1].tolist(), strict=True))
        if not ends:
            return np.zeros(len(self.ids))
        part = np.concatenate([self.impact[a:b] for a, b in ends])
        part *= np.repeat(idf, [b - a for a, b in ends])
        self.read += len(part)
        return np.bincount(np.concatenate([self.doc[a:b] for a, b in ends]), part, len(self.ids))

    def _scores(self, docs: np.ndarray, terms: np.ndarray, idf: np.ndarray) -> np.ndarray:
        """Scores of some documents, added up in the terms' order: these documents' own postings are looked through."""
        begin, term, impact, number = self.forward
        n = begin[docs + 1] - begin[docs]
        at = spread(begin[docs], n)
        self.read += len(docs) * len(terms)
        number[terms] = np.arange(len(terms))
        asked = number[term[at]]
        number[terms] = -1
        (met,) = (asked >= 0).nonzero()
        asked, part = asked[met], np.zeros((len(docs), len(terms)))
        part[np.repeat(np.arange(len(docs)), n)[met], asked] = idf[asked] * impact[at[met]]
        return np.bincount(np.repeat(np.arange(len(docs)), len(terms)), part.ravel(), len(docs))

    def best(self, terms: np.ndarray, idf: np.ndarray, k: int, begun: np.ndarray | None = None, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the ``k`` best documents for terms (positions in this shard), ties to smaller ids.

        Block-max WAND for many documents at a time. The floor is the k-th largest sum of what has been read. As long
        as a window's unread blocks could together lift a document over the floor that none of its read blocks holds,
        they are read by falling maximum: these are the pivot blocks. Then documents are left that a read block
        holds and whose sum and unread maxima reach the floor; as they grow fewer, their windows' other blocks are
        read, or, where that is less, cursors seek the documents themselves. All other blocks are skipped. The
        scores of the documents left are added up in the terms' order, whatever was skipped.

        ``begun`` has the sums over the frequent terms (``products``), so that only blocks of the others are unread; ``floor`` is a
        score that documents of other shards reach ``k`` times. Where it is beyond all that is left, nothing is read.
        """
        docs = len(self.ids)
        all_terms, all_idf, slack = terms, idf, 1e-9
        sums, floor = np.zeros(docs), floor * (1 - SLACK)
        if begun is not None:
            other = self.frequent[1][terms] < 0
            terms, idf, slack, sums = terms[other], idf[other], SLACK, begun
            if begun.max(initial=0) * (1 + slack) + (idf * self.top[terms]).sum() * (1 + slack) < floor:
                return np.zeros(0, np.int64), np.zeros(0)
            if (self.start[terms + 1] - self.start[terms]).sum() <= FIRST:  # what the first step would read
                sums, terms, idf = sums + self._whole(terms, idf), terms[:0], idf[:0]
                if docs > k and not (floor > 0 and np.count_nonzero(sums * (1 + slack) >= floor) <= 4 * k):
                    floor = max(floor, np.partition(sums, docs - k)[docs - k] * (1 - slack))
        n = self.block_of[terms + 1] - self.block_of[terms]
        block, weight = spread(self.block_of[terms], n), np.repeat(idf, n)
        top = weight * self.block_top[block]
        order = np.argsort(-top, kind="stable")
        block, weight, top = block[order], weight[order], top[order] * (1 + 1e-9)
        window, size = self.block_window[block], self.block_at[block + 1] - self.block_at[block]
        unread, left = np.ones(len(block), bool), np.bincount(window, top, self.windows)
        step = FIRST

        def advance(due: np.ndarray) -> None:
            nonlocal sums, floor, left, step
            taken = due[: int(np.searchsorted(np.cumsum(size[due]), step)) + 1]
            sums = sums + self._sums(block[taken], weight[taken])
            unread[taken] = False
            left = np.bincount(window[unread], top[unread], self.windows)
            if docs > k:
                floor = max(floor, np.partition(sums, docs - k)[docs - k] * (1 - slack))
            step *= 2

        while len(due := (unread & (left >= floor)[window]).nonzero()[0]):
            advance(due)
        while True:
            bound = sums * (1 + slack)
            (found,) = ((sums > 0) & ((bound + np.repeat(left, WINDOW)[:docs] if len(block) else bound) >= floor)).nonzero()
            if not len(block):
                break
            asked = np.zeros(self.windows, bool)
            asked[found // WINDOW] = True
            (due,) = (unread & asked[window]).nonzero()
            if len(found) * len(terms) <= size[due].sum() // SEEK or not len(due):
                break
            advance(due)
        if len(found) * len(all_terms) <= MOST_SEEKS and (self.forward[0][found + 1] - self.forward[0][found]).sum() <= MOST_SEEKS:
            score = self._scores(found, all_terms, all_idf)
        else:
            inside = np.zeros(docs, bool)
            inside[found] = True
            n = self.block_of[all_terms + 1] - self.block_of[all_terms]
            score = self._sums(spread(self.block_of[all_terms], n), np.repeat(all_idf, n), inside)[found]
        best = np.lexsort((self.ids[found], self.no_id[found], -score))[:k]
        return found[best], score[best]


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index as a table: a row per shard of about ``shard_bytes`` of text."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return stage(rows.mapInArrow(partial(_index, shard_bytes=shard_bytes), "shard string, n_docs long, n_words long, terms array<long>, dfs array<long>, blob binary"))


def _meet(held: list[Shard], queries: list[tuple[int, np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """What the held shards have for queries (query, terms, idf): query, doc_id, no id, score. A shard's scores raise the next one's floor."""
    scores = [np.zeros(0)] * len(queries)
    for shard in held:
        met = [(i, at, idf[known]) for i, (_, terms, idf) in enumerate(queries) for known, at in [shard.known(terms)] if len(at)]
        together = max(1, PRODUCT // max(1, len(shard.ids)))
        for first in range(0, len(met), together):
            some = met[first : first + together]
            begun = shard.products([x[1:] for x in some]) if len(met) >= FEWEST else [None] * len(some)
            for (i, at, idf), sums in zip(some, begun, strict=True):
                floor = float(scores[i].min()) if len(scores[i]) == k else 0.0
                found, score = shard.best(at, idf, k, sums, floor)
                scores[i] = np.sort(np.append(scores[i], score))[-k:]
                yield np.full(len(found), queries[i][0]), shard.ids[found], shard.no_id[found] > 0, score


def _searcher(mean: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell: its shards, which are held, then its queries, which pass by."""
        cell, held = None, []
        for batch in batches:
            out, due = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0))], []
            terms, idf = batch.column("terms"), batch.column("idf")
            for i, (own, query) in enumerate(zip(batch.column("cell").to_pylist(), batch.column("query").to_pylist(), strict=True)):
                if own != cell:
                    out, due = [*out, *_meet(held, due, k)], []
                    cell, held = own, []
                if query is None:
                    held.append(Shard(terms[i].values.to_numpy(), batch.column("blob")[i].as_py(), mean))
                else:
                    due.append((query, terms[i].values.to_numpy(), idf[i].values.to_numpy()))
            out += _meet(held, due, k)
            query, doc, none, score = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(doc, mask=none), pa.array(score)], ["query", "doc_id", "score"])

    return run


def search(index: DataFrame, queries: DataFrame, k: int = 10, terms: int | None = None, query_id: str = "query_id", text: str = "text") -> DataFrame:
    """Columns query_id, rank, doc_id, score: each query's ``k`` best documents with a score above 0, all over the shards.

    Words are those of ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A query's terms are its distinct words, or with
    ``terms`` those of the largest tf * idf among them that another document has too (ties by term hash). Numbers of
    documents, document frequencies and the mean length are those of the whole corpus, so a score doesn't depend on
    the sharding, and a shard's k best hold all that can be in the merged k best.

    Every query meets every shard in one of the cells of a grid: up to SHARDS_PER_CELL shards by a part of the
    queries. A task holds a cell's shards while the queries stream past, so its memory is bounded whatever the number of
    queries; nothing is broadcast. Where the shards alone keep all cores busy, as with much data, the queries are one
    part and the index is read and sent once; the queries are sent once for each row of cells. Ties
    go to the smaller id, null ids last. Queries without a known term, null and empty texts have no rows; repeated query
    rows are searched one by one; other columns of the queries are dropped, whatever their names.
    """
    spark = index.sparkSession
    ship(spark)
    sums = index.agg(F.sum("n_docs").alias("n"), F.sum("n_words").alias("w"), F.count(F.lit(1)).alias("shards")).first()
    n, mean, shards = sums["n"] or 0, max(1.0, (sums["w"] or 0) / max(1, sums["n"] or 0)), sums["shards"]
    asked = stage(queries.select(F.col(query_id).alias("query_id"), F.col(text).alias("text")).withColumn("query", F.monotonically_increasing_id()))
    words = stage(asked.select("query", "text").mapInArrow(_query_terms, "query long, term long, tf long"))
    known = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.dfs").alias("df"))
    df = known.join(words.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weighed = words.join(df, "term").withColumn("idf", F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    if terms:
        salient = Window.partitionBy("query").orderBy(F.desc(F.col("tf") * F.col("idf")), "term")
        weighed = weighed.where("df > 1").withColumn("k", F.row_number().over(salient)).where(F.col("k") <= terms)
    ready = weighed.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("term", "idf"))).alias("terms"))

    cores = spark.sparkContext.defaultParallelism
    per_cell = max(1, min(SHARDS_PER_CELL, shards // (4 * cores)))
    high = -(-shards // per_cell)
    wide = max(1, -(-2 * cores // max(1, high)))
    numbered = index.select("shard", (F.floor((F.row_number().over(Window.orderBy("shard")) - 1) / per_cell) * wide).alias("cell"))  # a row per shard
    numbered = F.broadcast(numbered) if shards <= BROADCAST_SHARDS else numbered
    held = index.join(numbered, "shard").select(F.explode(F.sequence("cell", F.col("cell") + F.lit(wide - 1))).alias("cell"), F.lit(None).cast("long").alias("query"), "terms", F.lit(None).cast("array<double>").alias("idf"), "blob")
    passing = ready.select(
        F.explode(F.sequence(F.pmod(F.xxhash64("query"), F.lit(wide)), F.lit(high * wide - 1).cast("long"), F.lit(wide).cast("long"))).alias("cell"),
        "query", F.col("terms.term").alias("terms"), F.col("terms.idf").alias("idf"), F.lit(None).cast("binary").alias("blob"),
    )
    cells = held.unionByName(passing if high else passing.limit(0)).repartitionById(max(1, high * wide), F.col("cell").cast("int")).sortWithinPartitions("cell", F.col("query").asc_nulls_first())
    found = cells.mapInArrow(_searcher(mean, k), "query long, doc_id long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.join(asked.select("query", "query_id"), "query").select("query_id", "rank", "doc_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    asked = docs.where(F.pmod("doc_id", F.lit(100)) == 0)
    return search(build(docs), asked, query_id="doc_id")
