"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import key_of, ship, slices

#: Rows that the model is fitted on at most (in expectation), drawn by a hash of the row.
FIT_ROWS = 20_000
#: Tasks that count the fitting rows; each sends a count per language and bucket.
FIT_TASKS = 16
ORDERS = (1, 2, 3)
BITS = 15
SMOOTH = 0.5
UNKNOWN = "und"

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Model:
    """Languages in code point order, and the log-probability of each bucket of each order's n-grams."""

    languages: tuple[str, ...]
    logs: np.ndarray  # float32, languages x (orders * 2 ** BITS)


def features(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Per order the buckets of all n-grams of the joined texts, and where each text starts.

    Texts are lower-cased and each is closed by a line feed; n-grams that reach over a text's end are
    counted with the text in which they start, as the n-grams at its end.
    """
    low = [t.lower() + "\n" for t in texts]
    at = np.zeros(len(low) + 1, np.int64)
    np.cumsum([len(t) for t in low], out=at[1:])
    points = np.frombuffer(("".join(low) + "\n" * max(ORDERS)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n, out, value = at[-1], [], np.zeros(at[-1], np.uint64)
    for k in range(max(ORDERS)):
        value = (value + points[k : k + n]) * _MULTIPLIERS[k]
        if k + 1 in ORDERS:
            mixed = (value ^ (value >> np.uint64(29))) * _MULTIPLIERS[0]
            out.append((mixed >> np.uint64(64 - BITS)).astype(np.int64) + (len(out) << BITS))
    return out, at


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for whole in batches:
        for batch in slices(whole, "text"):
            langs = batch.column("lang").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for lang in set(langs):
                found, _ = features([t for t, x in zip(texts, langs, strict=True) if x == lang])
                total = sums.setdefault(lang, np.zeros(len(ORDERS) << BITS, np.int64))
                for buckets in found:
                    total += np.bincount(buckets, minlength=len(total))
    for lang, total in sums.items():
        (at,) = total.nonzero()
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at)), "bucket": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", rows: int = FIT_ROWS) -> Model:
    """A model from the rows with text and language, at most about ``rows`` of them.

    The share that is drawn depends on their number alone, and the draw on a hash of the whole row, so copies of a text
    under other ids are drawn one by one. What comes to the driver is a count per language and bucket, whatever the
    size of ``docs``.
    """
    ship(docs.sparkSession)
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"), key_of(docs, docs.columns).alias("key"))
    share = rows / max(1, labelled.count())
    if share < 1:
        labelled = labelled.where(F.pmod("key", F.lit(1 << 30)) < int(share * (1 << 30)))
    labelled = labelled.drop("key")
    counted = labelled.repartition(FIT_TASKS).mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counted.toPandas()
    languages = tuple(sorted(got["lang"].unique()))
    counts = np.full((len(languages), len(ORDERS) << BITS), SMOOTH)
    if languages:
        counts[got["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(), got["bucket"].to_numpy()] += got["n"].to_numpy()
    shaped = counts.reshape(len(languages), len(ORDERS), 1 << BITS)
    logs = np.log(shaped / shaped.sum(axis=2, keepdims=True))
    return Model(languages, logs.reshape(len(languages), len(ORDERS) << BITS).astype(np.float32))


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The language of each text and its posterior probability under equal priors."""
    asked = [i for i, t in enumerate(texts) if t is not None and _LETTER.search(t)] if model.languages else []
    lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if asked:
        found, at = features([texts[i] for i in asked])
        total = np.zeros((len(model.languages), len(asked)))
        for k, logs in enumerate(model.logs):
            for buckets in found:
                total[k] += np.add.reduceat(logs[buckets], at[:-1], dtype=np.float64)
        total -= total.max(axis=0)
        odds = np.exp(total)
        best = odds.argmax(axis=0)
        score[asked] = 1 / odds.sum(axis=0)
        for i, b in zip(asked, best, strict=True):
            lang[i] = model.languages[b]
    return lang, score


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with columns lang_pred and score.

    The model's matrix (languages x hashed n-grams, a size that doesn't grow with the data) is broadcast. Null texts and
    texts without a letter, and every text under an empty model, are ``und`` with score 0; ties go to the smaller
    language. Columns of the result's names are replaced, others pass through, rows are kept one to one.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.drop("lang_pred", "score")
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                lang, score = predict(shared.value, batch.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Fold 2 of 4 by CRC-32 of the id as text; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
