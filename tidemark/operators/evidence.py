"""Evidence for a pulse: phase against a reference, recurrence under a permutation null, range tests, alternatives."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .clock import measured_period
from .kernel_ops import ship
from .sequence import asof

# Limits of the recurrence and the phase audits.
BINS, WINDOW, PERMUTATIONS = 32, 8, 255
MIN_CONTRAST, MAX_P = 0.005, 0.01
PHASE_GATE = 0.80


def circular_distance(a: Column, b: Column) -> Column:
    """Distance of two phases in cycles, at most a half."""
    d = F.abs(a - b) - F.floor(F.abs(a - b))
    return F.least(d, 1 - d)


def phases(events: DataFrame, reference: DataFrame, reach_s: float = 0.075, most: float = 0.16) -> DataFrame:
    """Events between measured reference beats with their phase in cycles and the tolerance at that period."""
    bracket = measured_period(reference).where("period_us is not null").select("series", F.col("us").alias("left_us"), F.col("end_us").alias("right_us"), "period_us")
    found = asof(events, bracket, "us", "left_us", ["series"], ["left_us", "right_us", "period_us"], strict=True)
    inside = found.where(F.col("us") <= F.col("right_us"))
    return inside.withColumn("phase", (F.col("us") - F.col("left_us")) / F.col("period_us")).withColumn("tolerance", F.least(F.lit(most), reach_s * 1e6 / F.col("period_us"))).drop("left_us", "right_us")


def circular_stats(found: DataFrame, keys: list[str]) -> DataFrame:
    """Mean phase, concentration, and number of phases."""
    x, y = F.avg(F.cos(2 * math.pi * F.col("phase"))), F.avg(F.sin(2 * math.pi * F.col("phase")))
    return found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.atan2(y, x) / (2 * math.pi)).alias("center"), F.hypot(x, y).alias("concentration"))


def phase_summary(found: DataFrame) -> DataFrame:
    """Circular statistics of a series with its share of inliers and of phases near 0."""
    stats = circular_stats(found, ["series"])
    near = circular_distance(F.col("phase"), F.col("center")) <= F.col("tolerance")
    direct = circular_distance(F.col("phase"), F.lit(0.0)) <= F.col("tolerance")
    joined = found.join(stats, "series")
    return joined.groupBy("series", "n", "center", "concentration").agg(F.avg(F.when(near, 1.0).otherwise(0.0)).alias("inliers"), F.avg(F.when(direct, 1.0).otherwise(0.0)).alias("direct"))


def window_stability(found: DataFrame, width: int = 16, hop: int = 8, least: int = 8) -> DataFrame:
    """Share of hopping windows whose phases concentrate at the series' mean phase."""
    at = found.withColumn("i", F.row_number().over(Window.partitionBy("series").orderBy("us", "idx")) - 1)
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - width + 1) / hop)).cast("long")
    placed = at.withColumn("w", F.explode(F.sequence(first, F.floor(F.col("i") / hop))))
    windows = circular_stats(placed, ["series", "w"]).where(F.col("n") >= least)
    middles = placed.groupBy("series", "w").agg(F.array_sort(F.collect_list("tolerance")).alias("_t")).withColumn("tolerance", F.get("_t", F.floor(F.size("_t") / 2).cast("int"))).drop("_t")
    whole = circular_stats(found, ["series"]).select("series", F.col("center").alias("_c"))
    good = (F.col("concentration") >= PHASE_GATE) & (circular_distance(F.col("center"), F.col("_c")) <= F.col("tolerance"))
    return windows.join(middles, ["series", "w"]).join(whole, "series").groupBy("series").agg(F.count(F.lit(1)).alias("windows"), F.avg(F.when(good, 1.0).otherwise(0.0)).alias("stable"))


def relation(n: Column, stable: Column, direct: Column, regional: Column) -> Column:
    """How a clock lies to its reference."""
    return (
        F.when((n >= 8) & stable & (direct >= 0.45), "DIRECT_ALIGNMENT")
        .when((n >= 16) & stable, "STABLE_OFFSET")
        .when(regional >= 0.55, "REGIONAL_SUPPORT")
        .when(n < 8, "INSUFFICIENT")
        .otherwise("INCOHERENT")
    )


def profiles(frames: DataFrame) -> DataFrame:
    """Rows (series, i, bin, v) of frames' bins: what exceeds the median of their band of 32, by the frame's norm; contrast."""
    long = frames.select("series", F.col("frame").alias("i"), F.posexplode("bins").alias("bin", "m")).withColumn("band", F.floor(F.col("bin") / BINS).cast("int"))
    lifted = long.withColumn("v", F.greatest(F.lit(0.0), F.col("m") - F.median("m").over(Window.partitionBy("series", "i", "band"))))
    frame = Window.partitionBy("series", "i")
    shaped = lifted.withColumn("contrast", F.max("v").over(frame)).withColumn("_n", F.sqrt(F.sum(F.col("v") * F.col("v")).over(frame)))
    return shaped.select("series", "i", "band", (F.col("bin") % BINS).alias("bin"), F.when(F.col("contrast") >= MIN_CONTRAST, F.col("v") / F.col("_n")).otherwise(0.0).alias("v"), "contrast")


def _dense(n: int, size: int, place: pa.ListArray, value: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists of places and values as rows of ``size``: values added up, which places are there, and which have a value."""
    at = np.repeat(np.arange(n), place.value_lengths().to_numpy()) * size + place.flatten().to_numpy()
    flat = value.flatten()
    known = flat.is_valid().to_numpy(zero_copy_only=False)
    v = flat.to_numpy(zero_copy_only=False)[known]
    return tuple(x.reshape(n, -1, BINS) for x in (np.bincount(at[known], v, n * size), np.bincount(at, minlength=n * size) > 0, np.bincount(at[known], minlength=n * size) > 0))


def _correlate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for k in range(0, whole.num_rows, 1024):
            part = whole.slice(k, 1024)
            n = part.num_rows
            size = (1 + max(int(part.column(c).flatten().to_numpy().max(initial=0)) for c in ("_pa", "_pb")) // BINS) * BINS
            a, a_there, a_known = _dense(n, size, part.column("_pa"), part.column("_va"))
            b, b_there, b_known = _dense(n, size, part.column("_pb"), part.column("_vb"))
            r, met, sure = np.zeros((n, BINS)), np.zeros((n, BINS), bool), np.zeros((n, BINS), bool)
            for shift in range(BINS):
                both = a_known & np.roll(b_known, shift, 2)
                r[:, shift] = np.where(both, a * np.roll(b, shift, 2), 0.0).sum((1, 2))
                met[:, shift], sure[:, shift] = (a_there & np.roll(b_there, shift, 2)).any((1, 2)), both.any((1, 2))
            row, shift = met.nonzero()
            out = [part.column(c).take(pa.array(row)) for c in ("series", "i")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(shift.astype(np.int32)), pa.array(r[row, shift], mask=~sure[row, shift])], ["series", "i", "shift", "r"])


def circular_correlation(found: DataFrame, apart: int = 1) -> DataFrame:
    """Correlation of each profile with the one ``apart`` later, at every shift of the bins.

    Two profiles meet as two arrays and are shifted in a batched function: no row is repeated for each shift.
    """
    ship(found.sparkSession)
    place = (F.col("band") * BINS + F.col("bin")).cast("long").alias("p")
    each = found.groupBy("series", "i").agg(F.collect_list(F.struct(place, F.col("v").cast("double").alias("v"))).alias("_l"))
    side = lambda name: [F.col("_l.p").alias(f"_p{name}"), F.col("_l.v").alias(f"_v{name}")]
    met = each.select("series", "i", *side("a")).join(each.select("series", (F.col("i") - apart).alias("i"), *side("b")), ["series", "i"])
    return met.mapInArrow(_correlate, T.StructType([*met.select("series", "i").schema, T.StructField("shift", T.IntegerType()), T.StructField("r", T.DoubleType())]))


def shift_table() -> np.ndarray:
    """The frozen null: shifts of each permutation's intervals."""
    return np.random.default_rng(12499).integers(0, BINS, (PERMUTATIONS, WINDOW))


def permutation_test(windows: np.ndarray, shifts: np.ndarray) -> dict[str, np.ndarray]:
    """Statistics of windows (n, WINDOW, bands, BINS) against random shifts of their intervals.

    The sum over all pairs of intervals is the squared norm of the sum of their shifted profiles.
    """
    at = (np.arange(BINS)[None, None, :] - shifts[:, :, None]) % BINS
    moved = sum(windows[:, o][:, :, at[:, o]] for o in range(WINDOW))
    null = (moved**2).sum(axis=(1, 3)) / WINDOW**2
    observed = (windows.sum(axis=1) ** 2).sum(axis=(1, 2)) / WINDOW**2
    spread = np.sqrt(np.maximum(0, (null**2).mean(axis=1) - null.mean(axis=1) ** 2))
    return {"statistic": observed, "null_mean": null.mean(axis=1), "null_std": spread, "p_value": ((null >= observed[:, None] - 1e-12).sum(axis=1) + 1) / (len(shifts) + 1)}


def recurrence(found: DataFrame, stride: int = WINDOW) -> DataFrame:
    """Windows of eight profiles, every ``stride``: mean correlation of all pairs against that under random shifts.

    A window is gathered as one bounded array and tested in a batched function. Columns: series, first, active,
    statistic, null_mean, null_std, p_value, supported.
    """
    starts = found.groupBy("series").agg(F.max("i").alias("_last"))
    placed = found.join(starts, "series").withColumn("first", F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col("i") - WINDOW + 1) / stride) * stride).cast("long"), F.floor(F.col("i") / stride) * stride, F.lit(stride).cast("long")))).where((F.col("first") + WINDOW - 1 <= F.col("_last")) & (F.col("i") < F.col("first") + WINDOW))
    each = F.array_sort(F.collect_list(F.struct("i", "band", "bin", "v")))
    active = F.avg(F.when(F.col("contrast") >= MIN_CONTRAST, 1.0).otherwise(0.0))
    windows = placed.groupBy("series", "first").agg(active.alias("active"), F.transform(each, lambda x: x["v"]).alias("_v"))
    shifts = shift_table()

    @F.pandas_udf("statistic double, null_mean double, null_std double, p_value double")
    def test(values: pd.Series) -> pd.DataFrame:
        out = []
        for k in range(0, len(values), 64):
            part = np.stack(values.iloc[k : k + 64])
            out.append(pd.DataFrame(permutation_test(part.reshape(len(part), WINDOW, -1, BINS), shifts)))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype=float) for c in ("statistic", "null_mean", "null_std", "p_value")})

    ship(found.sparkSession)
    tested = windows.withColumn("_t", test("_v")).select("series", "first", "active", "_t.*")
    return tested.withColumn("supported", (F.col("active") >= 0.5) & (F.col("p_value") <= MAX_P))


def prefix_index(intervals: DataFrame) -> DataFrame:
    """Prefix counts before each interval (series, i, active, missing, nonrecurring), with one row past the last."""
    w = Window.partitionBy("series").orderBy("i")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    quiet_pair = F.when(~F.col("active") & ~F.coalesce(F.lag("active").over(w), F.lit(True)), 1).otherwise(0)
    ends = intervals.groupBy("series").agg((F.max("i") + 1).alias("i")).select("series", "i", F.lit(False).alias("active"), F.lit(False).alias("missing"), F.lit(False).alias("nonrecurring"))
    flags = intervals.select("series", "i", "active", "missing", "nonrecurring").unionByName(ends).withColumn("_q", quiet_pair)
    count = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    one = lambda c: F.when(F.col(c), 1).otherwise(0)
    return flags.select("series", "i", count(one("active")).alias("p_active"), count(one("missing")).alias("p_missing"), count(one("nonrecurring")).alias("p_nonrecurring"), count(F.col("_q")).alias("p_quiet"))


def assess_rows(index: DataFrame, rows: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` (series, start, end and others) with active_fraction, issues and supported by differences of prefixes.

    With ``how`` left, rows stay that the index doesn't cover: their supported is null.
    """
    after = Window.partitionBy("series").orderBy("i")
    begun = index.withColumn("n_p_quiet", F.when(F.lead("i").over(after) == F.col("i") + 1, F.lead("p_quiet").over(after)))
    at = lambda rows, name, key: rows.select("series", F.col("i").alias(key), *[F.col(c).alias(f"{name}_{c}") for c in ("p_active", "p_missing", "p_nonrecurring", "p_quiet")], *[c for c in rows.columns if c == "n_p_quiet"])
    asked = rows.withColumn("_e", F.col("end") - 1)
    # Ranges may be exploded and count as far fewer than they are, so they are sorted, not sent to the driver.
    found = asked.join(at(begun.where("n_p_quiet is not null"), "s", "start").hint("merge"), ["series", "start"], how).join(at(index, "e", "_e").hint("merge"), ["series", "_e"], how)
    fraction = (F.col("e_p_active") - F.col("s_p_active")) / (F.col("_e") - F.col("start"))
    codes = F.array_compact(
        F.array(
            F.when(F.col("e_p_missing") > F.col("s_p_missing"), F.lit("INSUFFICIENT_CONTEXT")),
            F.when(F.col("e_p_nonrecurring") > F.col("s_p_nonrecurring"), F.lit("NONRECURRING_ATTACKS")),
            F.when((F.col("e_p_quiet") > F.col("n_p_quiet")) | (fraction < 0.5), F.lit("INSUFFICIENT_LOCAL_ATTACKS")),
        )
    )
    covered = F.col("s_p_active").isNotNull() & F.col("e_p_active").isNotNull()
    return found.select(*rows.columns, fraction.alias("active_fraction"), F.array_join(codes, ",").alias("issues"), F.when(covered, F.size(codes) == 0).alias("supported"))


def assess_ranges(index: DataFrame, ranges: DataFrame) -> DataFrame:
    """Range tests by differences of prefixes. ranges: series, start, end (one past the last boundary event)."""
    return assess_rows(index, ranges).select("series", "start", "end", "active_fraction", "issues", "supported")


def unsupported_runs(rows: DataFrame) -> DataFrame:
    """Runs of unsupported rows (series, i, ok) as issues: first, last and length."""
    w = Window.partitionBy("series").orderBy("i")
    bad = rows.where(~F.col("ok")).withColumn("_g", F.col("i") - F.row_number().over(w))
    return bad.groupBy("series", "_g").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count(F.lit(1)).alias("n")).drop("_g")


def suppress_near(candidates: DataFrame, tolerance: float = 0.04) -> DataFrame:
    """Candidates (series, bpm, support) by falling support without those near one kept, in log tempo."""
    listed = candidates.groupBy("series").agg(F.array_sort(F.collect_list(F.struct((-F.col("support")).alias("o"), "bpm"))).alias("c"))
    kept = F.aggregate("c", F.array().cast("array<double>"), lambda acc, x: F.when(F.exists(acc, lambda k: F.abs(F.ln(x["bpm"] / k)) < tolerance), acc).otherwise(F.concat(acc, F.array(x["bpm"]))))
    return listed.select("series", F.posexplode(kept).alias("rank", "bpm"))


RATIOS = ((1, 2), (2, 1), (1, 3), (3, 1))


def metrical_alternatives(candidates: DataFrame, selected: DataFrame, tolerance: float = 0.04) -> DataFrame:
    """Per ratio to the selected tempo the best supported candidate near it. candidates: series, bpm, support; selected: series, bpm."""
    ratios = F.explode(F.array(*[F.struct(F.lit(a).alias("num"), F.lit(b).alias("den")) for a, b in RATIOS]))
    best = candidates.groupBy("series").agg(F.max("support").alias("top"))
    wanted = selected.select("series", F.col("bpm").alias("chosen")).withColumn("_q", ratios).select("series", "chosen", F.col("_q.num").alias("num"), F.col("_q.den").alias("den"))
    near = wanted.join(candidates, "series").where((F.col("bpm") != F.col("chosen")) & (F.abs(F.ln(F.col("bpm") / F.col("chosen") * F.col("den") / F.col("num"))) < tolerance))
    order = Window.partitionBy("series", "num", "den").orderBy(F.desc("support"), "bpm")
    found = near.withColumn("_r", F.row_number().over(order)).where("_r = 1").join(best, "series")
    return found.select("series", "num", "den", "bpm", "support", ((F.col("support") >= 0.06) & (F.col("support") >= F.col("top") * 0.35)).alias("independent"))


def meter_families(alternatives: DataFrame, counts: tuple[int, ...] = (2, 3, 4, 6, 8)) -> DataFrame:
    """Configured bar lengths that an alternative rate (num, den) would turn into a fraction or an unlisted length."""
    listed = alternatives.withColumn("count", F.explode(F.array(*map(F.lit, counts))))
    n, d = F.col("count") * F.col("den"), F.col("num")
    divisor = F.aggregate(F.sequence(F.lit(1), F.lit(max(b for _, b in RATIOS))), F.lit(1), lambda acc, k: F.when((n % k == 0) & (d % k == 0), k).otherwise(acc))
    reduced = listed.withColumn("n", (n / divisor).cast("int")).withColumn("d", (d / divisor).cast("int"))
    code = F.when(F.col("d") != 1, F.lit("FRACTIONAL_CANONICAL_PULSE_COUNT")).when(~F.col("n").isin(*counts), F.lit("COUNT_OUTSIDE_CONFIGURED_FAMILY"))
    return reduced.withColumn("reason", code).where("reason is not null").select("series", "num", "den", "count", "n", "d", "reason")


def interval_agreement(intervals: DataFrame, candidates: DataFrame, tolerance: float = 0.22) -> DataFrame:
    """Share of a series' intervals within ``tolerance`` of a candidate's period (series, bpm)."""
    near = F.abs(F.col("interval_us") / (60e6 / F.col("bpm")) - 1) < tolerance
    return intervals.join(candidates.select("series", "bpm"), "series").groupBy("series", "bpm").agg(F.avg(F.when(near, 1.0).otherwise(0.0)).alias("agreement"))
