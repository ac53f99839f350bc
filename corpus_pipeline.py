"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join, language_id, mixing, packing, secret_scan
from tidemark.llm.common import read_table, scratch, stage

#: Posterior probability from which a predicted language counts.
LEAST_SCORE = 0.5


def _wrapped(docs: DataFrame, *parts: str) -> DataFrame:
    """All columns as one struct and the named ones beside it, so that an operator's own columns clash with none."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *[F.col(p) for p in parts])


def _unwrapped(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"doc.`{c}`") for c in docs.columns])


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go: null texts, texts without a letter, and predictions under LEAST_SCORE.

    The model is fitted on the documents that have a lang; where lang is null the prediction fills it. Without any
    labelled document nothing can be recognised and all documents stay.
    """
    model = language_id.fit(docs)
    if not model.languages:
        return docs
    found = language_id.identify(_wrapped(docs, "text"), model).where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return _unwrapped(found, docs, lang=F.coalesce("doc.lang", "lang_pred"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, the first in the table's order; ids may repeat or be null.

    Rows get their numbers once, in a table that both sides read: a second numbering could differ, as it follows how
    files are dealt over partitions.
    """
    rows = stage(_wrapped(docs).withColumn("row", F.monotonically_increasing_id()))
    groups = jaccard_join.components(rows.select("row", "doc.text"), doc_id="row")
    copies = groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("row"))
    return _unwrapped(rows.join(copies, "row", "left_anti"), docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the scan finds is replaced by a mark; n_chars follows the text. No document goes."""
    clean = secret_scan.redact(secret_scan.scan(_wrapped(docs, "text")))
    return _unwrapped(clean, docs, text=F.col("text"), n_chars=_length(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one that meets a source's target in part has its leading words.

    Documents without a word have nothing that could be taken, and go.
    """
    mixed = mixing.repeat_taken(mixing.mix(_wrapped(docs, "text", "source")))
    return _unwrapped(mixed, docs, text=F.col("text"), n_chars=_length(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokenized documents' pieces and their places in sequences."""
    return packing.pack_documents(docs, packing.tokenizer_path())


def _length(docs: DataFrame) -> Column:
    kind = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else "long"
    return F.length("text").cast(kind)


STAGES = [
    ("language_id", identify),
    ("jaccard_join", near_duplicates),
    ("secret_scan", secrets),
    ("source_mixing", mix),
    ("packing", pack),
]

#: The mix and the packing follow hashes and a tokenizer that SQL doesn't have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; what a stage kept in the shared folder goes as soon as its result is written there."""
    docs = read_table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
