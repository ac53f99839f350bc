"""Files of samples and event grids as tables, and tables as files."""

from __future__ import annotations

import csv
import io
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_FRAMES = 65_536


def raw_samples(spark: SparkSession, path: str, rate: int, channels: int = 1, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """Raw little-endian float32 files as chunks: series (file name), start_frame, rate, ch0 (and ch1).

    Spark reads the bytes from any store it knows; a file is one row of the scan, cut into chunks in its task. Bytes that
    don't fill a frame are an error.
    """
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("series"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for series, content in zip(pdf["series"], pdf["content"], strict=True):
                if len(content) % (4 * channels):
                    raise ValueError(f"{series}: {len(content)} bytes are no whole number of frames")
                x = np.frombuffer(content, "<f4").reshape(-1, channels)
                for i in range(0, len(x), chunk):
                    part = x[i : i + chunk]
                    yield pd.DataFrame({"series": [series], "start_frame": [i], "rate": [rate], **{f"ch{c}": [part[:, c]] for c in range(channels)}})

    return files.mapInPandas(run, "series string, start_frame long, rate int, " + ", ".join(f"ch{c} array<float>" for c in range(channels)))


def whole_signals(chunks: DataFrame, channel: str = "ch0") -> DataFrame:
    """One row per series with all samples in order, for kernels that need the whole signal."""
    listed = F.array_sort(F.collect_list(F.struct("start_frame", F.col(channel).alias("x"))))
    return chunks.groupBy("series", "rate").agg(F.flatten(F.transform(listed, lambda c: F.transform(c["x"], lambda v: v.cast("double")))).alias("samples"))


def checked_content(spark: SparkSession, path: str, sha256: dict[str, str]) -> DataFrame:
    """Files with whether their SHA-256 is the pinned one: series, bytes, sha256, ok. Files without a pin are not ok."""
    pins = spark.createDataFrame([(k, v.lower()) for k, v in sha256.items()] or [("", "")], "series string, pinned string")
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("series"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return files.join(F.broadcast(pins), "series", "left").select("series", "bytes", "sha256", F.coalesce(F.col("sha256") == F.col("pinned"), F.lit(False)).alias("ok"))


GRID = "series string, idx long, seconds double, strength double, downbeat boolean"


def grid(spark: SparkSession, path: str) -> DataFrame:
    """Event grids from delimited text: series (file name), idx, seconds, strength, downbeat.

    Each file tells its own delimiter (tab, semicolon or comma) and header by its first line; without a header the first
    column is seconds. idx is the beat column, or else the place among the file's events, whatever way files are
    dealt over tasks: a file, which holds a song's beats, is one row of the scan. Missing strengths and downbeats are
    null, and lines without seconds are left out.
    """
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("series"), F.col("value").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(series, *event) for series, text in zip(pdf["series"], pdf["text"], strict=True) for event in _events(text)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in GRID.split(", ")], dtype=object)

    return files.mapInPandas(run, GRID)


def _events(text: str) -> Iterator[tuple[int, float, float | None, bool | None]]:
    lines = text.lstrip("\ufeff").splitlines()
    first = next((x for x in lines if x.strip()), "")
    rows = [[c.strip() for c in row] for row in csv.reader(io.StringIO("\n".join(lines)), delimiter=next((s for s in "\t;," if s in first), ",")) if any(c.strip() for c in row)]
    if not rows:
        return
    named = any(c and not _number(c) for c in rows[0])
    names = [c.lower() for c in rows[0]] if named else ["seconds"]
    at = next((names.index(n) for n in ("seconds", "time", "t", "start") if n in names), 0)
    strength = next((names.index(n) for n in ("strength", "model_score", "score") if n in names), None)
    beat, downbeat = (names.index(n) if n in names else None for n in ("beat", "downbeat"))
    cell = lambda row, k: row[k] if k is not None and k < len(row) and row[k] else None
    place = 0
    for row in rows[named:]:
        if (seconds := cell(row, at)) is None:
            continue
        said, score, number = cell(row, downbeat), cell(row, strength), cell(row, beat)
        yield int(number) if number is not None else place, float(seconds), float(score) if score is not None else None, said.lower() in ("true", "1", "yes") if said is not None else None
        place += 1


def _number(cell: str) -> bool:
    try:
        float(cell)
    except ValueError:
        return cell.strip().lower() in ("true", "false")
    return True


def kept(df: DataFrame, path: str) -> DataFrame:
    """``df`` measured once and kept at ``path`` for many queries: written if nothing is there yet, and read from there."""
    spark = df.sparkSession
    if not _place(spark, f"{path}/_SUCCESS")[1]:
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def prepared_frames(prepared: DataFrame, ranges: DataFrame, size: int) -> DataFrame:
    """Samples of ranges of a kept signal: ``ranges`` (series, from, to) with samples, silence where the signal has none.

    prepared: series, start_frame, samples, in chunks of ``size`` (the last one may be shorter). A range asks for its own chunks
    alone, by an equi-join on their starts, so a read costs what it covers.
    """
    spans = ranges.select("series", "from", "to").distinct().where(F.col("to") > F.col("from"))
    chunk = lambda c: F.floor(c / size)
    asked = spans.withColumn("start_frame", F.explode(F.transform(F.sequence(chunk(F.col("from")), chunk(F.col("to") - 1)), lambda k: k * size)))
    parts = asked.join(prepared.select("series", "start_frame", F.transform("samples", lambda x: x.cast("double")).alias("x")), ["series", "start_frame"], "left")
    whole = F.concat(F.coalesce("x", F.array().cast("array<double>")), F.array_repeat(F.lit(0.0), F.lit(size) - F.coalesce(F.size("x"), F.lit(0))))
    joined = parts.groupBy("series", "from", "to").agg(F.min("start_frame").alias("_first"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start_frame", whole.alias("w")))), lambda p: p["w"])).alias("_all"))
    return joined.select("series", "from", "to", F.slice("_all", (F.col("from") - F.col("_first") + 1).cast("int"), (F.col("to") - F.col("from")).cast("int")).alias("samples"))


def drop_kept(spark: SparkSession, path: str) -> bool:
    """Delete what ``kept`` wrote; False if it is gone already, so that closing twice does no harm."""
    place, there = _place(spark, path)
    return bool(there and place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True))


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def first_downbeat(rows: DataFrame) -> DataFrame:
    return rows.where("downbeat").groupBy("series").agg(F.min_by("idx", "idx").alias("idx"), F.min("seconds").alias("seconds"))


def wav24(samples: np.ndarray, rate: int) -> tuple[bytes, int]:
    """A 24-bit WAV of frames x channels in -1 to 1, and how many samples were clipped."""
    x = np.atleast_2d(np.asarray(samples, float).T).T
    scaled = np.floor(x * 8388607 + 0.5)
    clipped = int((np.abs(scaled) > 8388607).sum())
    whole = np.clip(scaled, -8388608, 8388607).astype("<i4")
    body = whole.reshape(-1, 1).view(np.uint8)[:, :3].tobytes()
    channels = x.shape[1]
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, channels, rate, rate * channels * 3, channels * 3, 24, b"data", len(body))
    return head + body, clipped


def as_wav(signals: DataFrame) -> DataFrame:
    """Signals (series, rate, samples) as WAV contents: series, wav, clipped. Write them with any binary sink."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [wav24(np.asarray(s), int(r)) for s, r in zip(pdf["samples"], pdf["rate"], strict=True)]
            yield pd.DataFrame({"series": pdf["series"], "wav": [m[0] for m in made], "clipped": [m[1] for m in made]})

    return signals.select(F.col("series").cast("string").alias("series"), "rate", "samples").mapInPandas(run, "series string, wav binary, clipped long")


def write_audit(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """Audit rows as text with a header (csv, tsv) or JSON lines; arrays become JSON in delimited text."""
    flat = rows.select(*[F.to_json(c).alias(c) if rows.schema[c].dataType.typeName() in ("array", "map", "struct") and kind != "json" else F.col(c) for c in rows.columns])
    if kind == "json":
        flat.write.mode("overwrite").json(path)
    else:
        flat.write.mode("overwrite").csv(path, header=True, sep="\t" if kind == "tsv" else ",")
