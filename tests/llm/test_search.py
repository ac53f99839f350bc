"""BM25 search and nearest neighbours against brute force."""

import collections
import math
import re

import awkward
import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import ann, bm25
from tidemark.llm.common import utf8
from tidemark.llm.shingles import word_hashes

LOW = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def brute(texts, queries, k, terms=None):
    tf = {i: collections.Counter(words(t)) for i, t in texts}
    df = collections.Counter(w for c in tf.values() for w in c)
    n, mean = len(tf), sum(sum(c.values()) for c in tf.values()) / len(tf)
    every = sorted(df)
    hashed = dict(zip(every, word_hashes(*utf8(pa.array(every)))[0].view(np.int64).tolist(), strict=True))
    idf = {w: math.log(1 + (n - f + 0.5) / (f + 0.5)) for w, f in df.items()}
    out = {}
    for q, text in queries:
        asked = [w for w in collections.Counter(words(text)).items() if w[0] in df]
        if terms:
            asked = sorted(((w, c) for w, c in asked if df[w] > 1), key=lambda x: (-x[1] * idf[x[0]], hashed[x[0]]))[:terms]
        score = collections.Counter()
        for w, _ in sorted(asked, key=lambda x: hashed[x[0]]):
            for i, c in tf.items():
                if w in c:
                    score[i] += idf[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
        out[q] = sorted(((round(s, 9), i) for i, s in score.items()), key=lambda x: (-x[0], x[1]))[:k]
    return {q: [(i, s) for s, i in v] for q, v in out.items() if v}


def found(df):
    out = collections.defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (str(r.query_id), r.rank)):
        out[r.query_id].append((r.doc_id, round(r.score, 9)))
    return dict(out)


def test_bm25_of_whole_texts_over_many_shards(spark, documents, texts, monkeypatch):
    monkeypatch.setattr(bm25, "SHARDS_PER_CELL", 3)
    asked = [(i, t) for i, t in texts if i % 10 == 0]
    index = bm25.build(documents, shard_bytes=5_000)
    assert index.count() > 20
    got = found(bm25.search(index, spark.createDataFrame(asked, "query_id long, text string"), k=7))
    assert got == brute(texts, asked, 7)


def test_bm25_query_scores_every_word_of_the_whole_texts(spark, sf, texts):
    asked = [(i, t) for i, t in texts if i % 100 == 0]
    assert max(len(set(words(t))) for _, t in asked) > 100
    assert found(bm25.query(spark, sf)) == brute(texts, asked, 10)


def test_bm25_query_of_own_words_finds_itself(spark, tmp_path):
    rows = [(100, "alpha beta"), (1, "gamma delta"), (2, "gamma")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert found(bm25.query(spark, str(tmp_path))) == brute(rows, rows[:1], 10) != {}


def one_shard(docs):
    (row,) = bm25._index(iter(docs))
    return bm25.Shard(row.column("terms")[0].values.to_numpy(), row.column("blob")[0].as_py(), 300.0)


def plain(postings, n, terms, idf, k):
    """Every posting of every term, scored in order."""
    score = np.zeros(n)
    for t, w in zip(terms, idf, strict=True):
        doc, impact = postings[t]
        score[doc] += w * impact
    best = np.lexsort((np.arange(n), -score))[:k]
    best = best[score[best] > 0]
    return best.tolist(), score[best]


def postings_of(shard):
    bounds, doc = shard.block_at[shard.block_of], shard.key & ((1 << shard.bits) - 1)
    return [(doc[a:b], shard.impact[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]


@pytest.mark.parametrize("window", [1, 16, 64, 100_000])
def test_bm25_of_many_terms_is_exact(documents, monkeypatch, window):
    monkeypatch.setattr(bm25, "WINDOW", window)
    shard = one_shard(documents.select("doc_id", "text").orderBy("doc_id").toArrow().combine_chunks().to_batches()[:1])
    rng, postings = np.random.default_rng(1), postings_of(shard)
    for k in (1, 10, len(shard.ids), len(shard.ids) + 5):
        terms = np.sort(rng.choice(len(shard.terms), size=200, replace=False))
        idf = rng.random(200) * 3
        want, best = plain(postings, len(shard.ids), terms, idf, k)
        got, s = shard.best(terms, idf, k)
        assert got.tolist() == want and np.array_equal(s, best)


def test_bm25_product_of_frequent_terms_is_exact_and_reads_less(documents):
    (row,) = bm25._index(iter(documents.select("doc_id", "text").toArrow().to_batches(max_chunksize=1 << 20)))
    shard = bm25.Shard(row.column("terms")[0].values.to_numpy(), row.column("blob")[0].as_py(), 300.0)
    df, rng, n = np.diff(shard.start), np.random.default_rng(5), len(shard.ids)
    queries = [(t := np.sort(rng.choice(len(df), 300, replace=False, p=df / df.sum())), np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))) for _ in range(20)]
    plain = [shard.best(t, w, 10) for t, w in queries]
    read, shard.read = shard.read, 0
    for (t, w), sums, (doc, score) in zip(queries, shard.products(queries), plain, strict=True):
        for floor in (0.0, score[4], score[-1]):
            got, own = shard.best(t, w, 10, sums, floor)
            assert got[:5].tolist() == doc[:5].tolist() and own[:5].tolist() == score[:5].tolist()
        assert not len(shard.best(t, w, 10, sums, 2 * score[0] + w.sum() * 3)[0])
    assert shard.read < 3 * read


def test_bm25_of_salient_terms(spark, documents, texts):
    asked = [(i, t) for i, t in texts if i % 10 == 0]
    got = found(bm25.search(bm25.build(documents), spark.createDataFrame(asked, "query_id long, text string"), k=10, terms=8))
    assert got == brute(texts, asked, 10, 8)


def test_bm25_awkward(spark):
    index = bm25.build(awkward.table(spark))
    asked = spark.createDataFrame([(1, None), (2, ""), (3, "zzz unknown"), (4, "quick FOX"), (4, "quick FOX")], "query_id long, text string")
    got = bm25.search(index, asked, k=3).collect()
    assert {r.query_id for r in got} == {4} and len(got) == 6
    assert [r.doc_id for r in sorted(got, key=lambda r: r.rank)][:2] == [5, 5] and None in {r.doc_id for r in got}
    clash = asked.selectExpr("*", "1 AS query", "'x' AS doc_id", "2 AS score", "3 AS rank", "'t' AS terms", "4 AS cell", "5 AS n")
    assert sorted(map(str, bm25.search(index, clash, k=3).collect())) == sorted(map(str, got))
    long = spark.createDataFrame([(7, awkward.LONG * 4)], "query_id long, text string")
    assert [r.doc_id for r in sorted(bm25.search(index, long, k=3).collect(), key=lambda r: r.rank)][:2] == [7, 8]
    empty = bm25.build(awkward.table(spark, []))
    assert bm25.search(empty, asked, k=3).count() == 0


def test_pruning_skips_and_stays_exact(monkeypatch):
    monkeypatch.setattr(bm25, "FIRST", 64)
    monkeypatch.setattr(bm25, "WINDOW", 64)
    rng = np.random.default_rng(0)
    p = 1 / np.arange(1, 2001)
    docs = [" ".join(rng.choice([f"w{i}" for i in range(2000)], size=rng.integers(1, 200), p=p / p.sum())) for _ in range(3000)]
    shard = one_shard([pa.RecordBatch.from_pydict({"doc_id": pa.array(range(3000), pa.int64()), "text": pa.array(docs)})])
    postings, every, few, few_read = postings_of(shard), 0, 0, 0
    df = np.array([len(d) for d, _ in postings])
    for j in range(60):
        if j % 2:  # a rare word and frequent ones
            terms = np.unique([(df > 40).nonzero()[0][j], *np.argsort(-df)[rng.integers(0, 20, 3)]])
        else:  # a document's own words
            terms = np.array([t for t, (d, _) in enumerate(postings) if j * 40 in d])
        idf = np.log(1 + (3000 - df[terms] + 0.5) / (df[terms] + 0.5))
        want, best = plain(postings, 3000, terms, idf, 10)
        before = shard.read
        got, s = shard.best(terms, idf, 10)
        assert got.tolist() == want and np.array_equal(s, best)
        every += df[terms].sum()
        if j % 2:
            few, few_read = few + df[terms].sum(), few_read + shard.read - before
    assert shard.read < every and few_read < 0.5 * few


def test_forest_recall_and_scores(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = sorted((r.vec_id, r.embedding) for r in table.collect())
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = collections.defaultdict(list)
    for r in ann.nearest(table).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for i in (ids % 20 == 0).nonzero()[0]:
        score = vectors @ vectors[i]
        score[i] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        mine = sorted(got[int(ids[i])])
        assert [m[0] for m in mine] == list(range(1, min(20, len(ids) - 1) + 1))
        assert all(np.isclose(s, vectors[i] @ vectors[np.searchsorted(ids, v)], atol=1e-12) for _, v, s in mine)
        hits, total = hits + len(set(best) & {m[1] for m in mine}), total + len(best)
    assert hits / total >= 0.9


def test_forest_among_copies_finds_as_many_as_asked(spark):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((40, 16))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    vectors[:5] = vectors[0]
    ids = [*range(20), *range(21, 40), 41]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>")
    got = sorted(r.rank for r in ann.nearest(table).collect())
    assert got == list(range(1, 21))


@pytest.mark.parametrize("copies", [5, 50, 150])
def test_forest_candidates_are_as_many_as_wanted(copies):
    rng = np.random.default_rng(copies)
    vectors = rng.standard_normal((200, 16))
    vectors[:copies] = vectors[0]
    for wanted in (21, 130, 200):
        assert {len(set(c.tolist())) for c in ann.Forest(vectors).candidates(vectors[::7], wanted)} == {wanted}


def test_forest_candidates_are_those_met_most_often():
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((300, 16))
    forest = ann.Forest(vectors)
    norms = (vectors**2).sum(axis=1)
    keys = ann.hashes(np.hstack([vectors, np.sqrt(norms.max() - norms)[:, None]])).T
    asked = ann.hashes(np.hstack([vectors[:20], np.zeros((20, 1))])).T
    for q, got in enumerate(forest.candidates(vectors[:20], 60)):
        common = np.array([[16 - int(a ^ b).bit_length() for a, b in zip(row.tolist(), asked[q].tolist(), strict=True)] for row in keys])
        for stop in range(16, 0, -1):
            met = np.maximum(common - stop + 1, 0).sum(axis=1)
            if (common >= stop).sum() >= ann.PART * 60 * ann.TREES and np.count_nonzero(met) >= 60:
                break
        assert sorted(got.tolist()) == sorted(np.lexsort((np.arange(300), -met))[:60].tolist())


def test_forest_awkward(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (None, [1.0, 1.0]), (8, []), (2, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS rank", "2 AS score")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in ann.nearest(table, share=1.0).collect())
    assert [g for g in got if g[0] == 0] == [(0, 1, 1), (0, 2, 2), (0, 3, 2), (0, 4, 20)]
    assert [g[2] for g in got if g[0] == 20] == [0, 1, 2, 2]
    assert ann.nearest(table.where("false")).count() == 0


def test_forest_blocks_and_shards(spark, sf, monkeypatch):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    whole = sorted(map(tuple, ann.nearest(table, share=1.0).collect()))
    monkeypatch.setattr(ann, "SHARD_ROWS", 40)
    monkeypatch.setattr(ann, "QUERY_ROWS", 3)
    cut = sorted(map(tuple, ann.nearest(table, share=1.0).collect()))
    assert [w[:3] for w in whole] == [c[:3] for c in cut]
