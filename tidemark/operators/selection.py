"""Choosing among pulse candidates, regional phase support, and declared subsets of a clock."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import beats as kernels
from .kernel_ops import ship

RANGES = "series long, first long, last long, n long, center double, concentration double, inliers double"


def phase_ranges(phases: DataFrame) -> DataFrame:
    """Ranges of events (series, idx, us, phase, tolerance, segment) that keep one phase to their reference."""
    ship(phases.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["us", "idx"])
        found = kernels.stable_ranges(pdf["phase"].to_numpy(float), pdf["tolerance"].to_numpy(float), pdf["segment"].to_numpy())
        idx = pdf["idx"].to_numpy()
        out = pd.DataFrame(found, columns=["first", "last", "n", "center", "concentration", "inliers"])
        return out.assign(series=int(pdf["series"].iloc[0]), first=[int(idx[f["first"]]) for f in found], last=[int(idx[f["last"]]) for f in found])[["series", "first", "last", "n", "center", "concentration", "inliers"]]

    return phases.select("series", "idx", "us", "phase", "tolerance", "segment").groupBy("series").applyInPandas(run, RANGES)


def reference_segments(periods: DataFrame) -> DataFrame:
    """Reference intervals (series, idx, period_us) with a number that rises after every unmeasured one."""
    before = Window.partitionBy("series").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return periods.withColumn("segment", F.coalesce(F.sum(F.when(F.col("period_us").isNull(), 1).otherwise(0)).over(before), F.lit(0)))


def evaluate(candidates: DataFrame) -> DataFrame:
    """Score and reasons of candidates.

    candidates: series, bpm, support, tracked_bpm, agreement, consistency, onset_agreement, relation.
    """
    best = F.max("support").over(Window.partitionBy("series"))
    score = 0.55 * F.col("agreement") + 0.25 * F.col("consistency") + 0.10 * F.col("onset_agreement") + 0.10 * F.col("support") / F.greatest(F.lit(1e-9), best)
    supports = F.col("relation").isin("DIRECT_ALIGNMENT", "STABLE_OFFSET", "REGIONAL_SUPPORT")
    reasons = F.array_compact(
        F.array(
            F.when((F.col("tracked_bpm") <= 0) | (F.abs(F.ln(F.col("tracked_bpm") / F.col("bpm"))) > 0.08), F.lit("TEMPO_NOT_PRESERVED")),
            F.when(F.col("agreement") < 0.55, F.lit("CADENCE_NOT_CORROBORATED")),
            F.when(~supports, F.lit("NO_PHASE_SUPPORT")),
            F.when((F.col("relation") == "STABLE_OFFSET") & (F.col("onset_agreement") < 0.50), F.lit("OFFSET_WITHOUT_ATTACKS")),
            F.when(F.col("onset_agreement") < 0.35, F.lit("TOO_FEW_ATTACKS")),
        )
    )
    return candidates.withColumn("score", score).withColumn("reasons", reasons)


def choose(evaluated: DataFrame, margin: float = 0.08) -> DataFrame:
    """The best candidate without a reason against it; ambiguous if another such one of a different tempo is within the margin."""
    good = evaluated.where(F.size("reasons") == 0)
    order = Window.partitionBy("series").orderBy(F.desc("score"), "bpm")
    ranked = good.withColumn("_r", F.row_number().over(order)).withColumn("_top", F.first("score").over(order)).withColumn("_bpm", F.first("bpm").over(order))
    rival = (F.col("_r") > 1) & (F.col("_top") - F.col("score") < margin) & (F.abs(F.ln(F.col("bpm") / F.col("_bpm"))) > 0.04)
    return ranked.groupBy("series").agg(F.first(F.when(F.col("_r") == 1, F.col("bpm")), ignorenulls=True).alias("bpm"), F.max("score").alias("score"), F.bool_or(rival).alias("ambiguous"))


def declared_grid(declared: DataFrame, clock: DataFrame) -> DataFrame:
    """Check declared main beats (series, m, canonical_idx, boundary) against their clock: one row per series with a code or null.

    Indices must rise with m, lie inside the clock, and begin and end on a bar boundary.
    """
    size = clock.groupBy("series").agg((F.max("idx") + 1).alias("_size"))
    w = Window.partitionBy("series").orderBy("m")
    stepped = declared.withColumn("_up", F.coalesce(F.col("canonical_idx") > F.lag("canonical_idx").over(w), F.lit(True)))
    found = stepped.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.bool_and("_up").alias("_up"), F.min("canonical_idx").alias("_low"), F.max("canonical_idx").alias("_high"), F.min_by("boundary", "m").alias("_first"), F.max_by("boundary", "m").alias("_last"))
    code = (
        F.when(F.col("_size").isNull(), "NO_CLOCK")
        .when(F.col("n") < 2, "TOO_FEW_MAIN_BEATS")
        .when(~F.col("_up"), "NOT_INCREASING")
        .when((F.col("_low") < 0) | (F.col("_high") >= F.col("_size")), "OUTSIDE_CLOCK")
        .when(~F.col("_first") | ~F.col("_last"), "OPEN_BAR")
    )
    return found.join(size, "series", "left").select("series", "n", code.alias("declined"))


def declared_bars(declared: DataFrame, clock: DataFrame) -> DataFrame:
    """Bars between declared boundaries: series, bar, m_start, m_end, start and end index and time in the clock."""
    w = Window.partitionBy("series").orderBy("m")
    edges = declared.where("boundary").withColumn("bar", (F.row_number().over(w) - 1).cast("long")).withColumn("m_end", F.lead("m").over(w)).withColumn("end_idx", F.lead("canonical_idx").over(w)).where("m_end is not null")
    at = lambda key, name: clock.select("series", F.col("idx").alias(key), F.col("us").alias(name))
    found = edges.select("series", "bar", F.col("m").alias("m_start"), "m_end", F.col("canonical_idx").alias("start_idx"), "end_idx")
    return found.join(at("start_idx", "start_us"), ["series", "start_idx"]).join(at("end_idx", "end_us"), ["series", "end_idx"])


def pinned_main_beats(pins: DataFrame, declared: DataFrame) -> DataFrame:
    """Pinned beats of the clock as main beats; null where a pin is none."""
    return pins.join(declared.select("series", F.col("canonical_idx").alias("idx"), "m"), ["series", "idx"], "left")


def consistency(direct: Column, concentration: Column) -> Column:
    return F.greatest(direct, concentration)


def merged_reasons(ranges: DataFrame) -> DataFrame:
    """Union of intervals (series, start, end, reason) with the set of reasons of all that went into one."""
    order = Window.partitionBy("series").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    runs = ranges.withColumn("_n", new).withColumn("_run", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("series", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_set("reason")).alias("reasons")).drop("_run")


