"""Windowed features of sampled series (series, k, x) and spectral frames (series, frame, bins).

Windows, equi-joins and grouped aggregates per series; where every sample meets many lags, blocks of a series are
transformed in Arrow groups, so that no sample is repeated for each lag.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _by_k(series: str = "series", k: str = "k") -> WindowSpec:
    return Window.partitionBy(series).orderBy(k)


def _db(rms: Column) -> Column:
    return 20 * F.log10(F.greatest(rms, F.lit(1e-8)))


def energy_blocks(signal: DataFrame, size: int) -> DataFrame:
    """Tumbling blocks of ``size`` samples (the last may be partial) with their level in dB."""
    return signal.groupBy("series", F.floor(F.col("k") / size).alias("block")).agg(F.count(F.lit(1)).alias("n"), _db(F.sqrt(F.avg(F.col("x") * F.col("x")))).alias("rms_db"))


def levels(signal: DataFrame) -> DataFrame:
    """RMS and peak of a series, plain and in dB."""
    found = signal.groupBy("series").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.max(F.abs("x")).alias("peak"))
    return found.withColumn("rms_db", _db(F.col("rms"))).withColumn("peak_db", _db(F.col("peak")))


def peak_gain(signal: DataFrame, ceiling: float = 0.891250938) -> DataFrame:
    """The constant gain that keeps a series' peak under ``ceiling``, at most 1."""
    return signal.groupBy("series").agg(F.max(F.abs("x")).alias("peak")).withColumn("gain", F.least(F.lit(1.0), ceiling / F.nullif("peak", F.lit(0.0)))).withColumn("gain", F.coalesce("gain", F.lit(1.0)))


def attack_derivative(signal: DataFrame, size: int) -> DataFrame:
    """Rise of the amplitude from block to block, zero where it falls."""
    blocks = signal.groupBy("series", F.floor(F.col("k") / size).alias("block")).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("amplitude"))
    before = F.coalesce(F.lag("amplitude").over(_by_k(k="block")), F.lit(0.0))
    return blocks.withColumn("rise", F.greatest(F.lit(0.0), F.col("amplitude") - before))


def normalise(signal: DataFrame, radius: int, long_radius: int) -> DataFrame:
    """Onset strength: what exceeds the local mean, by the local RMS (at least 0.15 of the whole's), at most 5."""
    near, far = _by_k().rowsBetween(-radius, radius), _by_k().rowsBetween(-long_radius, long_radius)
    onset = signal.withColumn("o", F.greatest(F.lit(0.0), F.col("x") - F.avg("x").over(near)))
    whole = Window.partitionBy("series")
    floor = F.sqrt(F.avg(F.col("o") * F.col("o")).over(whole)) * 0.15 + 1e-7
    local = F.sqrt(F.avg(F.col("o") * F.col("o")).over(far))
    return onset.withColumn("onset", F.least(F.lit(5.0), F.col("o") / F.greatest(floor, local))).drop("o")


def gaussian(signal: DataFrame, sigma: float, value: str = "x") -> DataFrame:
    """Gaussian smoothing over +-3 sigma; at the edges too by the whole sum of weights."""
    radius = math.ceil(3 * sigma)
    weights = [math.exp(-0.5 * (j / sigma) ** 2) for j in range(-radius, radius + 1)]
    total = sum(weights)
    # lag takes a positive count back, lead ahead: offset j of the kernel is j rows ahead.
    terms = [F.coalesce(F.lag(value, -j).over(_by_k()) if j < 0 else F.lead(value, j).over(_by_k()) if j else F.col(value), F.lit(0.0)) * F.lit(w) for j, w in zip(range(-radius, radius + 1), weights, strict=True)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return signal.withColumn("smooth", out / total)


def autocorrelation(signal: DataFrame, max_lag: int, value: str = "x", block: int = 1 << 16) -> DataFrame:
    """Autocorrelation of the centred series by its energy, unbiased by the number of products. Columns series, lag, r.

    A series is cut into blocks with the next ``max_lag`` samples as a halo; each gives its sums of products at all lags by
    one transform, and these are added up. So no sample meets its lags one by one, and a long series is many tasks.
    """
    from .kernel_ops import ship

    ship(signal.sparkSession)
    size = max(block, max_lag + 1)
    stats = signal.groupBy("series").agg(F.avg(value).alias("_mean"), F.count(F.lit(1)).alias("n"), F.greatest(F.var_pop(value) * F.count(F.lit(1)), F.lit(1e-12)).alias("energy"))
    home = F.floor(F.col("k") / size)
    places = F.when((F.pmod("k", F.lit(size)) <= max_lag) & (home > 0), F.array(home - 1, home)).otherwise(F.array(home))
    dealt = signal.join(stats, "series").select("series", F.explode(places).alias("block"), "k", (F.col(value) - F.col("_mean")).alias("c"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf["k"].to_numpy() - int(pdf["block"].iloc[0]) * size
        wide = np.zeros(max(int(at.max()), max_lag) + 1)
        wide[at] = pdf["c"].to_numpy(float)
        own = wide[:size]
        n = 1 << int(len(wide) + len(own)).bit_length()
        sums = np.fft.irfft(np.conj(np.fft.rfft(own, n)) * np.fft.rfft(wide, n), n)[: max_lag + 1]
        return pd.DataFrame({"series": pdf["series"].iloc[0], "lag": np.arange(max_lag + 1), "s": sums})

    schema = T.StructType([T.StructField("series", signal.schema["series"].dataType), T.StructField("lag", T.LongType()), T.StructField("s", T.DoubleType())])
    sums = dealt.groupBy("series", "block").applyInPandas(run, schema).groupBy("series", "lag").agg(F.sum("s").alias("s"))
    return sums.join(stats, "series").where(F.col("lag") < F.col("n")).select("series", "lag", (F.col("s") / F.col("energy") * F.col("n") / F.greatest(F.lit(1), F.col("n") - F.col("lag"))).alias("r"))


def harmonic_support(correlation: DataFrame, low: float, high: float, step: float = 0.125) -> DataFrame:
    """Support of each period: correlation at 1 to 4 periods (between lags linear, 0 outside) by falling weights."""
    count = int((high - low) / step)
    series = correlation.select("series").distinct()
    periods = series.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count).cast("long")))).withColumn("period", F.lit(low) + F.col("i") * step)
    weights = F.array(*[F.struct(F.lit(float(h)).alias("h"), F.lit(w).alias("w")) for h, w in ((1, 1.0), (2, 0.5), (3, 0.25), (4, 0.125))])
    asked = periods.withColumn("_h", F.explode(weights)).withColumn("at", F.col("period") * F.col("_h.h")).withColumn("lag", F.floor("at"))
    table = correlation.select("series", "lag", "r", F.lead("r").over(_by_k(k="lag")).alias("next"))
    value = F.when(F.col("next").isNotNull(), F.col("r") + (F.col("at") - F.col("lag")) * (F.col("next") - F.col("r"))).otherwise(0.0)
    found = asked.join(table, ["series", "lag"], "left").withColumn("v", F.coalesce(value, F.lit(0.0)) * F.col("_h.w"))
    return found.groupBy("series", "i", "period").agg((F.sum("v") / 1.875).alias("support"))


def candidates(support: DataFrame) -> DataFrame:
    """Local maxima of the support (not under the one before, above the next), and the ends where they rise."""
    w = _by_k(k="i")
    around = support.withColumn("before", F.lag("support").over(w)).withColumn("after", F.lead("support").over(w))
    peak = (F.coalesce(F.col("support") >= F.col("before"), F.col("after").isNotNull())) & F.coalesce(F.col("support") > F.col("after"), F.col("support") > F.col("before"))
    return around.where(peak).drop("before", "after")


def tempo_top(found: DataFrame, step_s: float, k: int = 8) -> DataFrame:
    """The ``k`` candidates of the largest support under a weak preference for dense pulses."""
    held = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("support")))
    scored = found.withColumn("bpm", 60.0 / (F.col("period") * step_s)).withColumn("support", held).withColumn("ranked", F.col("support") * (1.0 + 0.12 * F.ln(F.col("bpm") / 40.0)))
    order = Window.partitionBy("series").orderBy(F.desc("ranked"), "i")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("i", "period")


def bins(frames: DataFrame) -> DataFrame:
    """A row per bin: series, frame, bin, m and the magnitude before (0 in the first frame)."""
    long = frames.select("series", "frame", F.posexplode("bins").alias("bin", "m"))
    return long.withColumn("before", F.coalesce(F.lag("m").over(Window.partitionBy("series", "bin").orderBy("frame")), F.lit(0.0)))


def decayed_max(long: DataFrame, decay_frames: float) -> DataFrame:
    """Running maximum that decays by e every ``decay_frames``: a plain running maximum of ln(m) + frame / decay."""
    w = Window.partitionBy("series", "bin").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return long.withColumn("whitening", F.coalesce(F.exp(F.max(F.when(F.col("m") > 0, F.ln("m") + F.col("frame") / decay_frames)).over(w) - F.col("frame") / decay_frames), F.lit(0.0)))


def flux(frames: DataFrame, decay_frames: float = 16.0, low_bins: int = 8) -> DataFrame:
    """Positive rise of whitened log magnitudes, low bins by 1.3; 0 unless the plain rise exceeds 0.5 %."""
    white = decayed_max(bins(frames), decay_frames).withColumn("l", F.ln(1.0 + 10.0 * F.col("m") / F.greatest(F.lit(1e-4), F.col("whitening"))))
    rise = F.greatest(F.lit(0.0), F.col("l") - F.coalesce(F.lag("l").over(Window.partitionBy("series", "bin").orderBy("frame")), F.lit(0.0)))
    weighed = white.withColumn("r", rise * F.when(F.col("bin") < low_bins, 1.3).otherwise(1.0))
    sums = weighed.groupBy("series", "frame").agg(F.sum("r").alias("novelty"), F.sum(F.greatest(F.lit(0.0), F.col("m") - F.col("before"))).alias("up"), F.sum("m").alias("total"))
    return sums.select("series", "frame", F.when(F.col("up") / F.greatest(F.lit(1e-9), F.col("total")) > 0.005, F.col("novelty")).otherwise(0.0).alias("flux"))


def centroid(frames: DataFrame) -> DataFrame:
    """Mean bin by squared magnitude."""
    return bins(frames).groupBy("series").agg((F.sum(F.col("bin") * F.col("m") * F.col("m")) / F.greatest(F.lit(1.0), F.sum(F.col("m") * F.col("m")))).alias("centroid"))


def band_share(frames: DataFrame, edges: tuple[int, ...] = (0, 8, 20, 40, 63)) -> DataFrame:
    """Per frame and band the rise by the whole magnitude; a bin on an edge counts in both bands, the first frame is 0."""
    rise = F.when(F.col("frame") > 0, F.greatest(F.lit(0.0), F.col("m") - F.col("before"))).otherwise(0.0)
    parts = [F.sum(F.when(F.col("bin").between(a, b), rise).otherwise(0.0)).alias(f"u{i}") for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    sums = bins(frames).groupBy("series", "frame").agg(F.sum("m").alias("total"), *parts)
    return sums.select("series", "frame", *[F.when(F.col("total") > 0, F.col(f"u{i}") / F.col("total")).otherwise(0.0).alias(f"b{i}") for i in range(len(parts))])


def dft_power(signal: DataFrame, n: int, harmonics: int) -> DataFrame:
    """Power of the first ``harmonics`` of the first ``n`` samples, by sums of products."""
    asked = signal.where(F.col("k") < n).withColumn("h", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(harmonics - 1).cast("long"))))
    angle = 2 * math.pi * F.col("h") * F.col("k") / n
    return asked.groupBy("series", "h").agg(F.sum(F.col("x") * F.cos(angle)).alias("re"), F.sum(F.col("x") * F.sin(angle)).alias("im")).select("series", "h", (F.col("re") ** 2 + F.col("im") ** 2).alias("power"))


# The tone profiles of major and minor keys, and the names of the twelve tones.
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)
TONES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


def compatible(root_a: Column, minor_a: Column, root_b: Column, minor_b: Column) -> Column:
    """Whether two keys mix: same mode at 0, 5 or 7 semitones, or a minor key and its relative major."""
    apart = F.pmod(root_b - root_a, F.lit(12))
    relative = F.pmod(F.when(minor_a, root_a - root_b).otherwise(root_b - root_a), F.lit(12)) == 9
    return F.when(minor_a == minor_b, apart.isin(0, 5, 7)).otherwise(relative)


def key_scores(chroma: DataFrame) -> DataFrame:
    """Correlation of every series' twelve chroma values (series, tone, v) with the 24 rotated profiles."""
    spark = chroma.sparkSession
    profiles = spark.createDataFrame([(root, mode == 1, (root + j) % 12, p) for root in range(12) for mode, profile in enumerate((MAJOR, MINOR)) for j, p in enumerate(profile)], "root int, minor boolean, tone int, p double")
    return chroma.join(F.broadcast(profiles), "tone").groupBy("series", "root", "minor").agg(F.corr("v", "p").alias("score"))


def keys(chroma: DataFrame) -> DataFrame:
    """The best key of each series, and how far it is above the best key that doesn't mix with it; ``unknown`` without any spread."""
    scores = key_scores(chroma)
    order = Window.partitionBy("series").orderBy(F.desc("score"), "root", "minor")
    best = scores.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("series", F.col("root").alias("br"), F.col("minor").alias("bm"), F.col("score").alias("top"))
    others = scores.join(best, "series").where(~compatible(F.col("br"), F.col("bm"), F.col("root"), F.col("minor")))
    second = others.groupBy("series", "br", "bm", "top").agg(F.max("score").alias("other"))
    names = F.array(*map(F.lit, TONES))
    label = F.concat(F.get(names, F.col("br")), F.when(F.col("bm"), F.lit(" minor")).otherwise(F.lit(" major")))
    flat = chroma.groupBy("series").agg((F.sqrt(F.var_pop("v") * F.count(F.lit(1))) < 1e-9).alias("_flat"))
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("top") - F.col("other")))
    return flat.join(second, "series", "left").select("series", F.when(F.col("_flat"), "unknown").otherwise(label).alias("key"), F.when(F.col("_flat"), 0.0).otherwise(sure).alias("confidence"))


def parse_key(label: Column) -> tuple[Column, Column]:
    """Root (0 to 11) and mode of a label such as ``F# minor`` or ``B♭ major``; null if it is none."""
    text = F.translate(F.trim(label), "♯♭", "#b")
    letter, sign = F.regexp_extract(text, r"^([A-Ga-g])([#b]?)\s+(?i:(major|minor))$", 1), F.regexp_extract(text, r"^([A-Ga-g])([#b]?)\s+(?i:(major|minor))$", 2)
    mode = F.lower(F.regexp_extract(text, r"^([A-Ga-g])([#b]?)\s+(?i:(major|minor))$", 3))
    base = F.element_at(F.create_map(*[F.lit(x) for pair in {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}.items() for x in pair]), F.upper(letter))
    root = F.pmod(base + F.when(sign == "#", 1).when(sign == "b", -1).otherwise(0), F.lit(12))
    return F.when(letter != "", root), F.when(letter != "", mode == "minor")


def midi(frequency: Column) -> dict[str, Column]:
    """Nearest note of a frequency: number, name with octave, and distance in cents."""
    exact = 69 + 12 * F.log2(frequency / 440.0)
    note = F.floor(exact + 0.5).cast("int")
    name = F.concat(F.get(F.array(*map(F.lit, TONES)), F.pmod(note, F.lit(12))), (F.floor(note / 12) - 1).cast("string"))
    return {"midi": note, "note": name, "cents": 100 * (exact - note)}


def yin_difference(signal: DataFrame, window: int, max_lag: int) -> DataFrame:
    """Mean squared difference of the first ``window`` samples and their copy at each lag. A group is a window's samples."""
    from .kernel_ops import ship

    ship(signal.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.full(window, np.nan)
        x[pdf["k"].to_numpy()] = pdf["x"].to_numpy(float)
        lags = np.arange(min(max_lag, window - 1) + 1)
        sums = [np.square(x[lag:] - x[: window - lag]) for lag in lags.tolist()]
        met = np.array([np.count_nonzero(~np.isnan(d)) for d in sums])
        total = np.array([np.nansum(d) for d in sums])
        return pd.DataFrame({"series": pdf["series"].iloc[0], "lag": lags[met > 0], "d": total[met > 0] / met[met > 0]})

    schema = T.StructType([T.StructField("series", signal.schema["series"].dataType), T.StructField("lag", T.LongType()), T.StructField("d", T.DoubleType())])
    return signal.where((F.col("k") >= 0) & (F.col("k") < window)).select("series", "k", "x").groupBy("series").applyInPandas(run, schema)


def lerp(signal: DataFrame, probes: DataFrame) -> DataFrame:
    """Value at a fractional position (series, t), linear between samples, held at the ends."""
    ends = signal.groupBy("series").agg(F.max("k").alias("_last"))
    held = probes.join(ends, "series").withColumn("_t", F.least(F.greatest(F.col("t"), F.lit(0.0)), F.col("_last").cast("double"))).withColumn("k", F.floor("_t"))
    pairs = signal.select("series", "k", "x", F.lead("x").over(_by_k()).alias("next"))
    return held.join(pairs, ["series", "k"]).select("series", "t", (F.col("x") + (F.col("_t") - F.col("k")) * (F.coalesce("next", "x") - F.col("x"))).alias("value"))


def plateau_peaks(signal: DataFrame, threshold: float, radius: int = 3) -> DataFrame:
    """Samples above ``threshold`` that are the largest within +-radius; neighbouring ones are one peak at their mean place."""
    largest = F.max("x").over(_by_k().rowsBetween(-radius, radius))
    peaks = signal.withColumn("_m", largest).where((F.col("x") > threshold) & (F.col("x") == F.col("_m")))
    at = _by_k()
    runs = peaks.withColumn("_new", F.when(F.coalesce(F.col("k") - F.lag("k").over(at) > 1, F.lit(True)), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(at.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("series", "_run").agg(F.avg("k").alias("frame"), F.max("x").alias("x"), F.count(F.lit(1)).alias("n")).drop("_run")


def chunks(sizes: DataFrame, size: int = 1500, border: int = 6) -> DataFrame:
    """Overlapping chunks (series, chunk, start) over ``n`` frames: stride size - 2 * border, the last one right-aligned."""
    stride = size - 2 * border
    count = F.greatest(F.lit(1), F.ceil((F.col("n") - 2 * border) / stride)).cast("long")
    made = sizes.withColumn("_c", count).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_c") - 1)))
    last = F.greatest(F.lit(0), F.col("n") - size)
    return made.select("series", "n", "chunk", F.when((F.col("chunk") == F.col("_c") - 1) & (F.col("n") > size), last).otherwise(F.col("chunk") * stride).cast("long").alias("start"))


def stitch(made: DataFrame, size: int = 1500, border: int = 6) -> DataFrame:
    """Which chunk gives each frame: the first that holds it inside its borders (borders count at the ends)."""
    inner = made.withColumn("frame", F.explode(F.sequence(F.when(F.col("chunk") == 0, F.lit(0).cast("long")).otherwise(F.col("start") + border), F.least(F.col("n") - 1, F.col("start") + size - 1 - F.when(F.col("start") + size >= F.col("n"), 0).otherwise(border)))))
    first = Window.partitionBy("series", "frame").orderBy("chunk")
    return inner.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("series", "frame", "chunk")
