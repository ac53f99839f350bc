"""Ordered-sequence primitives: as-of and nearest matching, range joins, islands, interval algebra, order statistics.

Every window is partitioned by the series, and range joins get an equi key from time buckets, so no operator
falls back on a nested-loop join or a global sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(probe: DataFrame, build: DataFrame, at: str, time: str, keys: list[str], values: list[str], before: bool = True, strict: bool = False) -> DataFrame:
    """``probe`` with the values of the last build row at or before ``at`` (``before=False``: the first at or after).

    One union, one exchange and one sort by key and time replace a range join. ``strict`` leaves out equal times.
    """
    kept = [c for c in probe.columns if c not in keys]
    left = probe.select(*keys, F.col(at).alias("_t"), F.struct(*[F.col(c) for c in kept]).alias("_p"))
    right = build.select(*keys, F.col(time).alias("_t"), F.struct(*[F.col(v) for v in values]).alias("_b"))
    both = left.unionByName(right, allowMissingColumns=True)
    probe_first = strict == before
    side = F.when(F.col("_p").isNotNull(), 0 if probe_first else 1).otherwise(1 if probe_first else 0)
    order = Window.partitionBy(*keys).orderBy(F.col("_t"), side)
    found = F.last("_b", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)) if before else F.first("_b", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    return both.withColumn("_f", found).where("_p is not null").select(*keys, *[F.col(f"_p.{c}").alias(c) for c in kept], *[F.col(f"_f.{v}").alias(v) for v in values])


def nearest(probe: DataFrame, build: DataFrame, at: str, time: str, keys: list[str], values: list[str], within: float | None = None) -> DataFrame:
    """``probe`` with the nearest build row's time (``near``) and values; the earlier one on a tie, null beyond ``within``."""
    prior, later = build.select(*keys, F.col(time).alias("_pt"), *[F.col(v).alias(f"_p_{v}") for v in values]), build.select(*keys, F.col(time).alias("_nt"), *[F.col(v).alias(f"_n_{v}") for v in values])
    found = asof(probe, prior, at, "_pt", keys, ["_pt", *[f"_p_{v}" for v in values]])
    found = asof(found, later, at, "_nt", keys, ["_nt", *[f"_n_{v}" for v in values]], before=False)
    early = F.col("_nt").isNull() | (F.col("_pt").isNotNull() & (F.col(at) - F.col("_pt") <= F.col("_nt") - F.col(at)))
    chosen = found.withColumn("near", F.when(early, F.col("_pt")).otherwise(F.col("_nt")))
    for v in values:
        chosen = chosen.withColumn(v, F.when(early, F.col(f"_p_{v}")).otherwise(F.col(f"_n_{v}")))
    if within is not None:
        far = F.abs(F.col("near") - F.col(at)) > within
        for c in ("near", *values):
            chosen = chosen.withColumn(c, F.when(~far, F.col(c)))
    return chosen.drop("_pt", "_nt", *[f"_{s}_{v}" for s in "pn" for v in values])


def range_join(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str, keys: list[str], width: int, how: str = "inner") -> DataFrame:
    """Join points with start <= point <= end by time buckets of ``width``; pairs come once. ``how``: inner or left_semi."""
    cut = lambda c: F.floor(F.col(c) / width)
    # Fresh names on both sides: the tables may come from one another.
    left = points.withColumn("_point", F.col(at)).withColumn("_bucket", cut(at))
    right = ranges.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in ranges.columns], F.col(start).alias("_low"), F.col(end).alias("_high"), F.explode(F.sequence(cut(start), cut(end))).alias("_r_bucket"))
    match = (F.col("_point") >= F.col("_low")) & (F.col("_point") <= F.col("_high"))
    for k in ["_bucket", *keys]:
        match = match & (F.col(k) == F.col("_r_bucket" if k == "_bucket" else f"_r_{k}"))
    return left.join(right, match, how).drop("_point", "_bucket", "_low", "_high", "_r_bucket", *[f"_r_{k}" for k in keys])


def islands(df: DataFrame, keys: list[str], order: str, breaks: Column, name: str = "island") -> DataFrame:
    """Number the runs of each key's rows; a run begins where ``breaks`` is true (and at the first row)."""
    at = Window.partitionBy(*keys).orderBy(order)
    begun = df.withColumn("_new", F.when(F.lag(F.lit(1)).over(at).isNull() | F.coalesce(breaks, F.lit(False)), 1).otherwise(0))
    return begun.withColumn(name, F.sum("_new").over(at.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merge_intervals(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Union of intervals; touching ones merge."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = df.withColumn("_reach", F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach")), 1).otherwise(0)
    grouped = reach.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("_run")


def complement(df: DataFrame, keys: list[str], low: Column, high: Column, start: str = "start", end: str = "end") -> DataFrame:
    """The gaps that disjoint intervals leave in [low, high]."""
    order = Window.partitionBy(*keys).orderBy(start)
    gaps = df.select(*keys, F.col(end).alias("gap_start"), F.coalesce(F.lead(start).over(order), high).alias("gap_end"))
    head = df.groupBy(*keys).agg(F.min(start).alias("gap_end")).select(*keys, low.alias("gap_start"), "gap_end")
    return gaps.unionByName(head).where("gap_end > gap_start")


def upper_median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """The element at n / 2 of the sorted values (not the mean of the middles)."""
    order = Window.partitionBy(*keys).orderBy(value)
    everything = Window.partitionBy(*keys)
    ranked = df.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(everything))
    return ranked.where("_r = floor(_n / 2) + 1").select(*keys, F.col("_n").alias("n"), F.col(value).alias(name))


def weighted_upper_median(df: DataFrame, keys: list[str], value: str, weight: str, tie: str, name: str = "median") -> DataFrame:
    """The first value, in order, at which the running weight exceeds half the total."""
    order = Window.partitionBy(*keys).orderBy(value, tie)
    run = df.withColumn("_w", F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_t", F.sum(weight).over(Window.partitionBy(*keys)))
    return run.where("_w > _t / 2").groupBy(*keys).agg(F.min(value).alias(name))


def sorted_middle(values: Column) -> Column:
    """The upper median of an array."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def longest_common_run(left: DataFrame, right: DataFrame, pair: list[str], value: str) -> DataFrame:
    """Per pair of sequences the longest run of equal values: length, and its first indices (smallest on ties).

    Rows (pair..., i, value) and (pair..., j, value) meet by value; on a diagonal i - j a run has a constant i minus row number.
    """
    met = left.join(right, [*pair, value]).withColumn("d", F.col("i") - F.col("j"))
    order = Window.partitionBy(*pair, "d").orderBy("i")
    runs = met.withColumn("g", F.col("i") - F.row_number().over(order)).groupBy(*pair, "d", "g").agg(F.count(F.lit(1)).alias("length"), F.min("i").alias("i"), F.min("j").alias("j"))
    best = Window.partitionBy(*pair).orderBy(F.desc("length"), "i", "j")
    return runs.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(*pair, "length", "i", "j")
