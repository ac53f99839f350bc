"""The pipeline's stages, one by one and together."""

import collections

import awkward
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from test_copies import brute_components
from test_texts import spans
from tidemark.llm import mixing
from tidemark.llm.common import stage


def test_names_and_columns(spark, sf, documents):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "secret_scan", "source_mixing", "packing"]
    docs = documents
    for _, step in corpus_pipeline.STAGES[:-1]:
        done = stage(step(spark, docs, sf))
        assert done.dtypes == documents.dtypes
        docs = done
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.columns[-2:] == ["sequence_id", "offset"] and packed.count() >= docs.count()


def test_language_stage_keeps_clean_documents(spark, sf, documents):
    kept = {r.doc_id for r in corpus_pipeline.identify(spark, documents, sf).collect()}
    gone = [r for r in documents.collect() if r.doc_id not in kept]
    assert len(gone) <= 0.02 * documents.count()


def test_one_document_of_each_group_stays(spark, sf, documents, texts):
    kept = collections.Counter(r.doc_id for r in corpus_pipeline.near_duplicates(spark, documents, sf).collect())
    groups = collections.defaultdict(set)
    for i, (_, component) in brute_components(texts).items():
        groups[component].add(i)
    assert all(sum(kept[i] for i in g) == 1 for g in groups.values())


def test_the_same_rows_go_whatever_the_partitions(spark, sf, documents, tmp_path):
    """What is read again under other partitions between the actions doesn't number its rows anew."""
    documents.repartition(9).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    want = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect())
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        left = corpus_pipeline.near_duplicates(spark, docs, sf)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        assert sorted(r.doc_id for r in left.collect()) == want
        groups = collections.defaultdict(set)
        for i, (_, component) in brute_components([(r.doc_id, r.text) for r in docs.collect()]).items():
            groups[component].add(i)
        kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()}
        assert all(len(g & kept) == 1 for g in groups.values())
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_secrets_go_and_no_document_does(spark, sf, documents):
    done = corpus_pipeline.secrets(spark, documents, sf).collect()
    assert len(done) == documents.count()
    assert all(not spans(r.text) for r in done) and all(r.n_chars == len(r.text) for r in done)


def test_mix_stage_has_the_words_of_the_mix(spark, sf, documents):
    target = {r.source: r.target for r in mixing.mix(documents).select("source", "target").distinct().collect()}
    got, most = collections.Counter(), collections.Counter()
    for r in corpus_pipeline.mix(spark, documents, sf).select("doc_id", "source", mixing.word_count(F.col("text")).alias("n")).collect():
        got[r.source] += r.n
        most[r.doc_id] += 1
    assert all(abs(got[s] - t) <= 0.5 + 1e-6 for s, t in target.items()) and max(most.values()) <= 3


@pytest.mark.parametrize("k", range(5))
def test_stages_awkward(spark, sf, k):
    step = corpus_pipeline.STAGES[k][1]
    for rows in (awkward.ROWS, []):
        docs = awkward.table(spark, rows)
        done = step(spark, docs, sf)
        assert k == 4 or done.dtypes == docs.dtypes
        found = done.collect()
        assert bool(found) == bool(rows)
    docs = stage(awkward.table(spark))
    if k == 1:
        left = [r.doc_id for r in step(spark, docs, sf).collect()]
        assert len(left) == len(awkward.ROWS) - 3 and (7 in left) != (8 in left)


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
