"""Kernels as DataFrame operators: one group per series, Arrow batches in and out.

A signal is one row: series, rate, samples (array). Rows of many series run in parallel; one series is one task's
memory, at most about four hours of samples. Kernels without context between frames work on chunks instead.
"""

from __future__ import annotations

import math
import os
import tempfile
import zipfile
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels import bars as bar_kernels
from ..kernels import beats as beat_kernels
from ..kernels import dsp, fit
from .signal import MAJOR, MINOR, TONES

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the library to the executors' Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="code-"), f"{root.name}-core.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            if p.relative_to(root).parts[0] != "llm":
                z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def valid_signals(signals: DataFrame) -> DataFrame:
    """Signals of at least 3 s at a rate of 4,000 to 384,000 with finite samples; others go."""
    finite = F.forall("samples", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return signals.where(F.col("rate").between(4000, 384000) & (F.size("samples") >= 3 * F.col("rate")) & finite)


ANALYSIS = "series string, bpm double, confidence double, ambiguous boolean, beats array<double>, strengths array<double>, key string, key_confidence double, centroid double, rms_db double, peak_db double"


def analyze(signals: DataFrame, preferred: float | None = None) -> DataFrame:
    """Beats, tempo, key and levels of every signal: one row per series. Beats come with strengths from 0 to 1."""
    ship(signals.sparkSession)

    def run(batches):
        for pdf in batches:
            out = []
            for series, rate, samples in zip(pdf["series"], pdf["rate"], pdf["samples"], strict=True):
                x = np.asarray(samples, float)
                f = dsp.features(x, int(rate))
                d = beat_kernels.detect(f["flux"], x, int(rate), f["hop"], f["window"], preferred)
                name, sure = dsp.key(dsp.chroma(x, int(rate)), MAJOR, MINOR, TONES)
                rms, peak = np.sqrt((x**2).mean()), np.abs(x).max()
                out.append((series, d.bpm, d.confidence, d.ambiguous, d.beats.tolist(), d.strengths[: len(d.beats)].tolist(), name, sure, f["centroid"], 20 * math.log10(max(rms, 1e-8)), 20 * math.log10(max(peak, 1e-8))))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ANALYSIS.split(", ")])

    return signals.select(F.col("series").cast("string").alias("series"), "rate", "samples").mapInPandas(run, ANALYSIS)


def analyze_with_beats(features: DataFrame, clock: DataFrame, duration_us: int) -> DataFrame:
    """Measured features with an external clock in place of the detected one, where that clock is valid; else the reason."""
    from .clock import robust_bpm, validity

    checked = validity(clock, duration_us).join(robust_bpm(clock), "series", "left")
    return features.join(checked, "series", "left").withColumn("declined", F.when(F.col("valid").isNull(), "NO_CLOCK").when(~F.col("valid"), "INVALID_TIMESTAMPS"))


def yin_pitch(signals: DataFrame, **options) -> DataFrame:
    """A row per window: series, frame, seconds, frequency_hz (null where unvoiced), confidence, rms_db."""
    ship(signals.sparkSession)

    def run(batches):
        for pdf in batches:
            for series, rate, samples in zip(pdf["series"], pdf["rate"], pdf["samples"], strict=True):
                found = dsp.yin(np.asarray(samples, float), int(rate), **options)
                yield pd.DataFrame({"series": str(series), "frame": np.arange(len(found["seconds"])), **found}).assign(frequency_hz=lambda d: d["frequency_hz"].astype(object).where(d["frequency_hz"].notna(), None))

    return signals.select("series", "rate", "samples").mapInPandas(run, "series string, frame long, seconds double, frequency_hz double, confidence double, rms_db double")


def log_mel(signals: DataFrame) -> DataFrame:
    """A row per frame of signals at 22,050 Hz: series, frame, bins (128)."""
    ship(signals.sparkSession)

    def run(batches):
        for pdf in batches:
            for series, samples in zip(pdf["series"], pdf["samples"], strict=True):
                found = dsp.log_mel(np.asarray(samples, float))
                yield pd.DataFrame({"series": str(series), "frame": np.arange(len(found)), "bins": list(found)})

    return signals.select("series", "samples").mapInPandas(run, "series string, frame long, bins array<float>")


def stft_features(signals: DataFrame) -> DataFrame:
    """A row per frame: series, frame, flux and the attack shares of four bands."""
    ship(signals.sparkSession)

    def run(batches):
        for pdf in batches:
            for series, rate, samples in zip(pdf["series"], pdf["rate"], pdf["samples"], strict=True):
                f = dsp.features(np.asarray(samples, float), int(rate))
                yield pd.DataFrame({"series": str(series), "frame": np.arange(len(f["flux"])), "flux": f["flux"], **{f"b{i}": f["attack"][:, i] for i in range(4)}})

    return signals.select("series", "rate", "samples").mapInPandas(run, "series string, frame long, flux double, b0 double, b1 double, b2 double, b3 double")


def beat_track(onsets: DataFrame, period: float, step: float) -> DataFrame:
    """Chain of beats in every onset series (series, k, x): series, idx, frame."""
    ship(onsets.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("k")["x"].to_numpy(float)
        envelope = beat_kernels.gaussian(beat_kernels.normalise(x, step), 0.7)
        frames = beat_kernels.track(envelope, beat_kernels.local_periods(envelope, period, step), period)
        return pd.DataFrame({"series": str(pdf["series"].iloc[0]), "idx": np.arange(len(frames)), "frame": frames})

    return onsets.groupBy("series").applyInPandas(run, "series string, idx long, frame long")


#: Beats that are decoded at once.
BEATS_AT_ONCE = 100_000


def track_bars(beats: DataFrame, meters: tuple[int, ...] = bar_kernels.METERS, change: float = bar_kernels.CHANGE) -> DataFrame:
    """Meter and place of every beat (series, idx, logit): with the posteriors of the state and of a bar's beginning.

    Rows are dealt by series and stream through in order; series of about BEATS_AT_ONCE beats together are one batch.
    """
    ship(beats.sparkSession)
    model = bar_kernels.model(meters, change)

    def done(held: list[pd.DataFrame]) -> pd.DataFrame:
        held = sorted(held, key=len)
        found = bar_kernels.decode_many([h["logit"].to_numpy(float) for h in held], model)
        return pd.concat([pd.DataFrame({"series": h["series"].to_numpy(), "idx": h["idx"].to_numpy(), **f}) for h, f in zip(held, found, strict=True)])

    def run(batches):
        part, held, longest = None, [], 0
        for pdf in batches:
            part = pdf if part is None else pd.concat([part, pdf])
            ends = (part["series"].to_numpy()[1:] != part["series"].to_numpy()[:-1]).nonzero()[0] + 1
            if not len(ends):
                continue
            whole, part = part.iloc[: ends[-1]], part.iloc[ends[-1] :]
            for _, one in whole.groupby("series", sort=False):
                if held and max(longest, len(one)) * (len(held) + 1) > BEATS_AT_ONCE:
                    yield done(held)
                    held, longest = [], 0
                held.append(one)
                longest = max(longest, len(one))
        if part is not None and len(part):
            held.append(part)
        if held:
            yield done(held)

    dealt = beats.select("series", "idx", F.col("logit").cast("double").alias("logit")).repartition("series").sortWithinPartitions("series", "idx")
    return dealt.mapInPandas(run, "series long, idx long, meter int, phase int, state_posterior double, downbeat_posterior double")


def meter_regions(tracked: DataFrame, min_posterior: float = 0.9, min_bars: int = 3) -> DataFrame:
    """Runs of whole bars of one meter: first and last beat, bars, mean and least posterior of beginnings, usability."""
    from pyspark.sql import Window

    w = Window.partitionBy("series").orderBy("idx")
    starts = tracked.where("phase = 0").withColumn("_next", F.lead("idx").over(w)).where("_next is not null")
    new = F.when(F.coalesce(F.lag("meter").over(w) != F.col("meter"), F.lit(True)), 1).otherwise(0)
    runs = starts.withColumn("_n", new).withColumn("region", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = runs.groupBy("series", "region", "meter").agg(F.min("idx").alias("first_idx"), F.max("_next").alias("end_idx"), F.count(F.lit(1)).alias("bars"), F.avg("downbeat_posterior").alias("mean_posterior"), F.min("downbeat_posterior").alias("least_posterior"))
    return found.withColumn("usable", (F.col("bars") >= min_bars) & (F.col("least_posterior") >= min_posterior))


def remove_duplicates(clock: DataFrame, reference: DataFrame) -> DataFrame:
    """Beats that stay after sub-pulse neighbours went, by the reference's local periods: series, idx."""
    ship(clock.sparkSession)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame({"series": pd.Series(dtype="int64"), "idx": pd.Series(dtype="int64")})
        left, right = left.sort_values("idx"), right.sort_values("idx")
        kept = beat_kernels.drop_duplicates(left["us"].to_numpy() / 1e6, left["strength"].to_numpy(float), right["us"].to_numpy() / 1e6)
        return left.iloc[kept][["series", "idx"]]

    return clock.select("series", "idx", "us", "strength").groupBy("series").cogroup(reference.select("series", "idx", "us").groupBy("series")).applyInPandas(run, "series long, idx long")


FIT = "series long, idx long, moved_s double, fitted_s double, converged boolean, code string"


def regularise(paired: DataFrame, most_s: float = 0.020, penalty: float = 30.0) -> DataFrame:
    """Bounded fit of every clock (series, idx, raw_s, output_s): displacements, and a code where there is no fit."""
    ship(paired.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        raw, output = pdf["raw_s"].to_numpy(float), pdf["output_s"].to_numpy(float)
        if len(raw) < 3:
            moved, ok, code = np.zeros(len(raw)), False, "INSUFFICIENT_OBSERVED_SUPPORT"
        elif not (np.diff(output) > 0).all() or not (np.diff(raw) > 0).all():
            moved, ok, code = np.zeros(len(raw)), False, "NUMERICAL_FAILURE"
        else:
            moved, ok, _ = fit.bounded_clock(raw, output, fit.displacement_bounds(raw, most_s), penalty)
            code = None if ok else "DID_NOT_CONVERGE"
        return pd.DataFrame({"series": pdf["series"].to_numpy(), "idx": pdf["idx"].to_numpy(), "moved_s": moved, "fitted_s": raw + moved, "converged": ok, "code": code})

    return paired.groupBy("series").applyInPandas(run, FIT)


def anchors(knots: DataFrame, rate: int = 44100) -> DataFrame:
    """Adaptive anchors of the monotone cubic through every series' knots (series, idx, x, y)."""
    ship(knots.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        x, y = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
        if len(x) < 2:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("series", "i", "source_frame", "output_frame")})
        secant = np.diff(y) / np.diff(x)
        slope = np.concatenate([secant[:1], np.where((secant[1:] > 0) & (secant[:-1] > 0), 2 / (1 / secant[1:] + 1 / secant[:-1]), 0), secant[-1:]])

        def forward(at: np.ndarray) -> np.ndarray:
            k = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
            h = x[k + 1] - x[k]
            u = (at - x[k]) / h
            return (2 * u**3 - 3 * u**2 + 1) * y[k] + (u**3 - 2 * u**2 + u) * h * slope[k] + (3 * u**2 - 2 * u**3) * y[k + 1] + (u**3 - u**2) * h * slope[k + 1]

        found = fit.adaptive_anchors(forward, x, rate)
        return pd.DataFrame({"series": int(pdf["series"].iloc[0]), "i": np.arange(len(found)), "source_frame": found[:, 0], "output_frame": found[:, 1]})

    return knots.select("series", "idx", "x", "y").groupBy("series").applyInPandas(run, "series long, i long, source_frame long, output_frame long")


def infer(chunks: DataFrame, backend) -> DataFrame:
    """Logits of every chunk (series, chunk, start, bins: array of frames) by a pluggable model.

    ``backend()`` opens a session in a worker and returns a function from frames x 128 to two arrays of logits; the
    session serves all of a task's chunks. Frames must be 1 to 1,500 and finite.
    """
    ship(chunks.sparkSession)

    def run(batches):
        call = backend()
        for pdf in batches:
            for series, chunk, start, bins in zip(pdf["series"], pdf["chunk"], pdf["start"], pdf["bins"], strict=True):
                x = np.stack([np.asarray(b, np.float32) for b in bins])
                if not (1 <= len(x) <= 1500 and np.isfinite(x).all()):
                    raise ValueError("a model chunk needs 1 to 1500 finite frames")
                beat, down = call(x)
                yield pd.DataFrame({"series": str(series), "chunk": int(chunk), "frame": np.arange(start, start + len(x)), "beat": np.asarray(beat, float), "downbeat": np.asarray(down, float)})

    return chunks.mapInPandas(run, "series string, chunk long, frame long, beat double, downbeat double")


def energy_backend():
    """A deterministic stand-in for a trained model: logits from the rise of a frame's mean level. It is no trained model."""

    def call(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        level = x.mean(axis=1)
        rise = np.maximum(0, np.diff(level, prepend=level[:1]))
        z = (rise - rise.mean()) / max(1e-6, rise.std())
        return 2 * z - 2, 2 * z - 4

    return call


def resample(signals: DataFrame, anchor_table: DataFrame) -> DataFrame:
    """Samples (series, samples) moved along their anchors by linear interpolation. Pitch follows speed: this is no pitch-preserving stretch."""
    ship(signals.sparkSession)
    listed = anchor_table.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("output_frame", "source_frame"))).alias("anchors"))

    def run(batches):
        for pdf in batches:
            out = []
            for series, samples, found in zip(pdf["series"], pdf["samples"], pdf["anchors"], strict=True):
                o, s = np.array([a["output_frame"] for a in found], float), np.array([a["source_frame"] for a in found], float)
                at = np.interp(np.arange(o[0], o[-1] + 1), o, s)
                out.append((series, np.interp(at, np.arange(len(samples)), np.asarray(samples, float), left=0.0, right=0.0)))
            yield pd.DataFrame(out, columns=["series", "samples"])

    return signals.join(listed, "series").select("series", "samples", "anchors").mapInPandas(run, signals.select("series").schema.simpleString()[7:-1].replace(":", " ") + ", samples array<double>")
