"""Near copies and repeated substrings against brute force."""

import bisect
import collections
import hashlib
import re
import time

import awkward
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join as J
from tidemark.llm import substring_dedup as D

LOW = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(texts):
    sets = {i: shingles(t) for i, t in texts}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(seed=1, groups=12):
    """Families of texts with few to many changed words, so that pairs lie on both sides of the threshold."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(groups):
        base = rng.choice(vocabulary, size=rng.integers(3, 200)).tolist()
        for _ in range(rng.integers(1, 14)):
            text = list(base)
            for _ in range(rng.integers(0, 1 + max(1, len(text) // 25))):
                text[rng.integers(len(text))] = str(rng.choice(vocabulary))
            if rng.random() < 0.3:
                text = text[: max(1, int(len(text) * rng.uniform(0.75, 1)))]
            out.append(" ".join(text))
    return list(enumerate(map(str, rng.permutation(out))))


@pytest.mark.parametrize("options", [{}, {"block_shingles": 300}, {"cluster_nodes": 2}, {"cluster_nodes": 2, "flush_keys": 500}])
def test_components_are_the_brute_force_ones(spark, options):
    texts = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.components(spark.createDataFrame(texts, "doc_id long, text string"), **options).collect()}
    assert got == brute_components(texts)


@pytest.mark.parametrize("options", [{}, {"block_shingles": 300}, {"cluster_nodes": 2}])
def test_all_links_of_a_component_are_counted(spark, options):
    texts = near_copies()
    texts += [(1000 + i, texts[i % 7][1]) for i in range(20)] + [(2000, ""), (2001, None), (2002, "alone")]
    sets, of = {i: shingles(t) for i, t in texts}, brute_components(texts)
    wanted = collections.Counter()
    for x, a in enumerate(sorted(sets)):
        for b in sorted(sets)[x + 1 :]:
            both = len(sets[a] & sets[b])
            wanted[of[a][1]] += bool(both) and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both)
    got = J.components(spark.createDataFrame(texts, "doc_id long, text string"), count_links=True, **options).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got} == {i: (*of[i], wanted[of[i][1]]) for i in sets}
    assert max(wanted.values()) > max(collections.Counter(c for _, c in of.values()).values())


def test_components_of_documents(spark, documents, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.components(documents).collect()}
    assert got == brute_components(texts)


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(0)
    tried = 0
    for _ in range(1500):
        a = np.unique(rng.integers(0, 1 << 63, int(np.exp(rng.uniform(0.7, 8))), dtype=np.uint64))
        b = a
        while True:
            k = rng.integers(1, max(2, len(a) // 20 + 1))
            c = np.unique(np.concatenate([b, rng.integers(0, 1 << 63, k, dtype=np.uint64)])) if rng.random() < 0.5 else np.delete(b, rng.integers(0, len(b), min(k, len(b) - 1)))
            if not len(c) or np.array_equal(c, b) or not J.linked(a, c):
                break
            b = c
        if not np.array_equal(a, b):
            tried += 1
            assert len(np.intersect1d(J.sketch_keys(a), J.sketch_keys(b)))
    assert tried > 1000


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate({97: "b", 98: "a"})
    return word


@pytest.mark.parametrize("n", [1024, 1 << 17])
def test_words_that_fool_polynomials_are_not_linked(spark, n):
    word = thue_morse(n)
    texts = [(1, word), (2, word.translate({97: "b", 98: "a"})), (3, word + " " + word), (4, word)]
    got = {r.doc_id: r.component_id for r in J.components(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 1}


def test_a_link_by_equal_hashes_alone_is_refused():
    """Where hashes tell too few words apart, the words themselves do; equal sets of hashes are another matter."""
    base = [f"w{i}" for i in range(60)]
    a, b = " ".join(base), " ".join([f"v{i}" for i in range(60)])
    assert J.linked_words(a, a + " end") and not J.linked_words(a, b)
    sets = [np.arange(50, dtype=np.uint64), np.arange(51, dtype=np.uint64)]
    nodes, other = np.array([1, 2]), np.zeros(2, bool)
    assert J.block_links(nodes, sets, other) == [(1, 2)]
    assert J.block_links(nodes, sets, other, lambda i, j: J.linked_words([a, b][i], [a, b][j])) == []


def test_a_key_that_many_share_is_sent_once_a_batch():
    key = np.array([5, 5, 5, 9, 5, 7, 9])
    node = np.array([3, 1, 2, 4, 2, 8, 4])
    rows = J._combined([(key[:4], node[:4]), (key[4:], node[4:])]).to_pylist()
    assert sorted((r["key"], r["node"], r["hub"] or 0) for r in rows) == [(5, 1, 0), (5, 2, 1), (5, 3, 1), (7, 8, 0), (9, 4, 0)]


def test_threshold_is_inclusive(spark):
    common = [f"c{i}" for i in range(84)]  # 80 shingles
    texts = [(1, " ".join(common)), (2, " ".join(common + [f"e{i}" for i in range(20)])), (3, " ".join(common + [f"f{i}" for i in range(21)]))]
    got = {r.doc_id: r.component_id for r in J.components(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_components_awkward(spark):
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in J.components(awkward.table(spark)).collect())
    assert got[(1, 0, 1)] == got[(2, 0, 2)] == got[(3, 0, 3)] == 1 and got[(4, 1, 4)] == 1
    assert got[(5, 15, 5)] == 2 and got[(None, 15, 5)] == 1
    assert {c for d, n, c in got if d in (7, 8)} == {7}
    assert sum(got.values()) == len(awkward.ROWS)
    assert J.components(awkward.table(spark, [])).count() == 0


def brute_removal(texts, length=D.LENGTH):
    seen, out = set(), {}
    for i, text in sorted(texts):
        data = (text or "").encode()
        cover = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            part = data[s : s + length]
            if part in seen:
                cover[s : s + length] = True
            seen.add(part)
        spans = int((np.diff(np.concatenate(([0], cover.astype(int)))) == 1).sum())
        kept = bytes(np.frombuffer(data, np.uint8)[~cover])
        out[i] = (len(data), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def removed(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.h) for r in df.withColumn("h", F.sha2("kept", 256)).collect()}


@pytest.mark.parametrize("options", [{}, {"bucket_suffixes": 40, "doc_bucket_bytes": 3000}, {"bucket_suffixes": 9, "doc_bucket_bytes": 700}, {"segment": 37}, {"bucket_suffixes": 15, "segment": 200}])
def test_repeats_are_the_brute_force_ones(spark, options):
    rng = np.random.default_rng(7)
    passages = ["".join(rng.choice(list("abcdef é"), size=n)) for n in (60, 99, 100, 101, 180, 400)]
    texts = []
    for i in range(60):
        parts = [str(rng.choice(passages)) if rng.random() < 0.6 else "".join(rng.choice(list("uvwxyz "), size=rng.integers(0, 150))) for _ in range(rng.integers(0, 6))]
        texts.append((i, "".join(parts)))
    texts += [(100, "ab" * 300), (101, "a" * 350), (102, "a" * 99), (103, "ba" * 120), (104, texts[5][1])]
    assert removed(D.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"), **options)) == brute_removal(texts)


def test_repeats_of_documents(spark, documents, texts):
    assert removed(D.remove_repeats(documents, bucket_suffixes=500, doc_bucket_bytes=60_000)) == brute_removal(texts)


def test_repeats_awkward(spark):
    rows = D.remove_repeats(awkward.table(spark)).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans))
    assert len(rows) == len(awkward.ROWS)
    assert by[1] == by[2] == [(0, 0, 0)]
    assert by[5] == [(85, 0, 0)] * 2  # under the length, and the same document listed twice
    n = len(awkward.LONG.encode())
    assert by[7] == [(n, 0, 0)] and by[8] == [(n + 16, n, 1)]
    assert by[10] == [(5000, 4999, 1)]
    assert D.remove_repeats(awkward.table(spark, [])).count() == 0


def test_same_row_twice_is_one_document(spark):
    rows = [(3, "q" * 20 + "".join(chr(97 + i * 7 % 26) + str(i) for i in range(80)))] * 2 + [(4, "".join(chr(97 + i * 7 % 26) + str(i) for i in range(80)))]
    got = sorted((r.doc_id, r.n_removed) for r in D.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got[0] == got[1] == (3, 0) and got[2][1] > 100


def test_buckets_of_hot_grams_follow_all_tokens():
    rng = np.random.default_rng(3)
    n = 200_000
    s = {"h": rng.integers(0, 3, n).astype(np.uint64), "c": rng.integers(0, 4, n).astype(np.uint64), "d": rng.integers(0, 1000, n), "t": rng.integers(0, 2, n), "a": rng.integers(0, 50, n)}
    keys = sorted(zip(*(s[k][:3000].tolist() for k in D.TOKENS), strict=True))[::5]
    splitters = {k: np.array([x[i] for x in keys], s[k].dtype) for i, k in enumerate(D.TOKENS)}
    begin = time.process_time()
    got = D.bucket_of(splitters, s)
    assert time.process_time() - begin < 3
    for i in rng.integers(0, n, 300).tolist():
        assert got[i] == bisect.bisect_right(keys, tuple(int(s[k][i]) for k in D.TOKENS))


def test_strings_that_fool_polynomials_are_kept(spark):
    word = thue_morse(2048)
    texts = [(1, word), (2, word.translate({97: "b", 98: "a"})), (3, "".join(word[i : i + 64] + word[i : i + 64].translate({97: "b", 98: "a"}) for i in range(0, 512, 64)))]
    assert removed(D.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"))) == brute_removal(texts)


def test_a_long_text_is_read_in_pieces(spark):
    rng = np.random.default_rng(5)
    long = "".join(rng.choice(list("abcdefgh "), size=40_000))
    texts = [(1, long[5000:5300]), (2, long + long[100:900]), (3, "x" + long[20_000:31_000]), (4, long)]
    for segment in (1000, 7777, D.SEGMENT):
        assert removed(D.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"), segment=segment)) == brute_removal(texts)


def test_multikey_order():
    rng = np.random.default_rng(0)
    columns = [rng.integers(0, 5, 5000), rng.integers(0, 7, 5000), rng.integers(0, 1000, 5000)]
    order = D.multikey_order(columns, small=16)
    assert [tuple(int(c[i]) for c in columns) for i in order] == sorted(zip(*(c.tolist() for c in columns), strict=True))
