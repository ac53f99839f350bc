"""Pair search, bars, regions and cues, and the mixing of two timelines.

bars: series, bar (from 0), pulses, score. Searches block on the meter signature, so candidates meet by equality.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequence import asof, range_join

BAR_COUNTS = (2, 4, 8, 16, 32)


def boundaries(bars: DataFrame) -> DataFrame:
    """Bars with the index of their first and one past their last pulse."""
    order = Window.partitionBy("series").orderBy("bar")
    end = F.sum("pulses").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return bars.withColumn("end_idx", end).withColumn("start_idx", F.col("end_idx") - F.col("pulses"))


def aligned_selection(bars: DataFrame, beats: int) -> DataFrame:
    """Starts of exactly ``beats`` pulses that end on a bar boundary: series, bar, n_bars."""
    at = boundaries(bars)
    ends = at.select("series", F.col("bar").alias("last_bar"), "end_idx")
    wanted = at.select("series", "bar", (F.col("start_idx") + beats).alias("end_idx"))
    return wanted.join(ends, ["series", "end_idx"]).select("series", "bar", (F.col("last_bar") - F.col("bar") + 1).alias("n_bars"))


def compatible_counts(selection: DataFrame, counts: tuple[int, ...] = BAR_COUNTS) -> DataFrame:
    """The selections whose number of bars is a listed one."""
    listed = selection.sparkSession.createDataFrame([(c,) for c in counts], "n_bars long")
    return selection.join(F.broadcast(listed), "n_bars", "left_semi")


def signatures(bars: DataFrame, n: int) -> DataFrame:
    """Starts of ``n`` consecutive bars with their meter signature and summed score."""
    ahead = Window.partitionBy("series").orderBy("bar").rowsBetween(0, n - 1)
    found = bars.withColumn("signature", F.collect_list("pulses").over(ahead)).withColumn("score", F.sum("score").over(ahead))
    return found.where(F.size("signature") == n).select("series", "bar", "signature", "score")


def meter_pairs(outgoing: DataFrame, incoming: DataFrame) -> DataFrame:
    """How many starts of both sides share a signature. Sides are counted first, so a common signature stays two rows."""
    a = outgoing.groupBy("signature").agg(F.count(F.lit(1)).alias("outgoing"))
    b = incoming.groupBy("signature").agg(F.count(F.lit(1)).alias("incoming"))
    return a.join(b, "signature").withColumn("pairs", F.col("outgoing") * F.col("incoming"))


def ranked_pairs(outgoing: DataFrame, incoming: DataFrame, budget: int) -> DataFrame:
    """The first ``budget`` pairs of each signature along the diagonals of both sides' ranks.

    A pair within the budget has ranks within it, so only that many of a side are kept before the join.
    """

    def ranked(side: DataFrame, name: str) -> DataFrame:
        order = Window.partitionBy("signature").orderBy(F.desc("score"), "series", "bar")
        return side.withColumn("r", F.row_number().over(order)).where(F.col("r") <= budget).select("signature", F.col("series").alias(f"{name}_series"), F.col("bar").alias(f"{name}_bar"), F.col("score").alias(f"{name}_score"), F.col("r").alias(f"{name}_rank"))

    both = ranked(outgoing, "out").join(ranked(incoming, "in"), "signature").where(F.col("out_rank") + F.col("in_rank") <= budget + 1)
    order = Window.partitionBy("signature").orderBy(F.col("out_rank") + F.col("in_rank"), "out_rank")
    return both.withColumn("position", F.row_number().over(order)).where(F.col("position") <= budget)


def best_pairs(outgoing: DataFrame, incoming: DataFrame, k: int) -> DataFrame:
    """Per signature the ``k`` pairs of series with the largest summed scores: signature, out_series, in_series, position.

    Ties go to the smaller in_series, then to the larger out_series. outgoing, incoming: signature, series, score, a row per
    series. A pair's sum is no larger than with one of its side's k largest scores, and smaller where the score is lower by more
    than sums are rounded; so a side keeps those and what comes as near, of equal scores the first k in the order of ties, and
    the first k of all, among which sums that are null, infinite or no number tie.
    """

    def side(rows: DataFrame, name: str, tie: Column) -> DataFrame:
        first = lambda by: rows.withColumn("_r", F.row_number().over(Window.partitionBy("signature").orderBy(by))).where(F.col("_r") <= k)
        least = first(F.desc_nulls_last("score")).groupBy("signature").agg(F.min("score").alias("_least"))
        near = rows.join(least, "signature").join(slack, "signature", "left").where("score is null or _least is null or score >= _least - coalesce(_slack, 0.0D)")
        equal = Window.partitionBy("signature", "score").orderBy(tie)
        kept = near.withColumn("_r", F.row_number().over(equal)).where(F.col("_r") <= k).select("signature", "series", "score")
        return kept.unionByName(first(tie).select("signature", "series", "score")).distinct().select("signature", F.col("series").alias(f"{name}_series"), F.col("score").alias(f"_{name}"))

    finite = lambda rows: rows.select("signature", F.abs("score").alias("_s")).where("_s < double('Infinity')").groupBy("signature").agg(F.max("_s").alias("_s"))
    slack = finite(outgoing).unionByName(finite(incoming)).groupBy("signature").agg((F.sum("_s") * 2.0**-50).alias("_slack"))
    both = side(outgoing, "out", F.desc("series")).join(side(incoming, "in", F.asc("series")), "signature")
    order = Window.partitionBy("signature").orderBy(F.desc(F.col("_out") + F.col("_in")), "in_series", F.desc("out_series"))
    return both.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k).select("signature", "out_series", "in_series", "position")


def fair_budgets(demands: DataFrame, maximum: int) -> DataFrame:
    """Max-min fair whole budgets of each series' demands (series, i, demand) under ``maximum``.

    The level is read off the running sum of the sorted demands; what is left goes by one to the first unmet.
    """
    up = Window.partitionBy("series").orderBy("demand", "i")
    whole = Window.partitionBy("series")
    n, j = F.count(F.lit(1)).over(whole), F.row_number().over(up)
    run = F.sum("demand").over(up.rowsBetween(Window.unboundedPreceding, 0))
    met = demands.withColumn("_n", n).withColumn("_j", j).withColumn("_run", run).withColumn("_fits", F.col("_run") + (F.col("_n") - F.col("_j")) * F.col("demand") <= maximum)
    met = met.withColumn("_full", F.count_if("_fits").over(whole)).withColumn("_sum", F.coalesce(F.max(F.when(F.col("_fits"), F.col("_run"))).over(whole), F.lit(0)))
    level = F.when(F.col("_n") > F.col("_full"), F.floor((maximum - F.col("_sum")) / (F.col("_n") - F.col("_full")))).otherwise(F.col("demand"))
    base = met.withColumn("budget", F.least("demand", level)).withColumn("_left", F.lit(maximum) - F.sum("budget").over(whole)).withColumn("_open", F.when(F.col("budget") < F.col("demand"), 1).otherwise(0))
    in_turn = F.sum("_open").over(Window.partitionBy("series").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return base.select("series", "i", "demand", (F.col("budget") + F.when((F.col("_open") == 1) & (in_turn <= F.col("_left")), 1).otherwise(0)).cast("long").alias("budget"))


def ordered_scan(pairs: DataFrame) -> DataFrame:
    """Of each pair's matches (pair, incoming, outgoing) the earliest incoming, then the latest outgoing."""
    order = Window.partitionBy("pair").orderBy("incoming", F.desc("outgoing"))
    return pairs.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def mean_change(blocks: DataFrame, probes: DataFrame, window: float, scale: Column) -> DataFrame:
    """Change of level at t: mean after minus mean before by ``scale``, held in -1 to 1; 0 with less than half a side covered.

    blocks: series, start, end, level, without overlap. Means come from prefix integrals met as of each time.
    """
    order = Window.partitionBy("series").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    area = (F.col("end") - F.col("start")) * F.col("level")
    table = blocks.withColumn("_a", F.coalesce(F.sum(area).over(order), F.lit(0.0))).withColumn("_c", F.coalesce(F.sum(F.col("end") - F.col("start")).over(order), F.lit(0)).cast("double"))
    asked = probes.withColumn("_s", F.explode(F.array(*[F.lit(x) for x in (-1, 0, 1)]))).withColumn("_at", F.col("t") + F.col("_s") * window)
    found = asof(asked, table, "_at", "start", ["series"], ["start", "end", "level", "_a", "_c"])
    part = F.greatest(F.lit(0.0), F.least(F.col("_at"), F.col("end")) - F.col("start"))
    sums = found.withColumn("_area", F.coalesce(F.col("_a") + part * F.col("level"), F.lit(0.0))).withColumn("_cover", F.coalesce(F.col("_c") + part, F.lit(0.0)))
    wide = sums.groupBy("series", "t").agg(*[F.max(F.when(F.col("_s") == s, F.col(c))).alias(f"{c}{i}") for i, s in enumerate((-1, 0, 1)) for c in ("_area", "_cover")])
    mean = blocks.groupBy("series").agg((F.sum(area) / F.sum(F.col("end") - F.col("start"))).alias("mean"))
    before, after = F.col("_cover1") - F.col("_cover0"), F.col("_cover2") - F.col("_cover1")
    rise = (F.col("_area2") - F.col("_area1")) / F.nullif(after, F.lit(0.0)) - (F.col("_area1") - F.col("_area0")) / F.nullif(before, F.lit(0.0))
    known = (before >= window / 2) & (after >= window / 2) & (scale > 1e-9)
    held = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rise / F.nullif(scale, F.lit(0.0))))
    return wide.join(mean, "series").select("series", "t", F.when(known, held).otherwise(0.0).alias("change"))


def cue_change(blocks: DataFrame, probes: DataFrame, window: float, scale: float, activity: DataFrame | None = None) -> DataFrame:
    """How much the music changes at t: 0.8 of the change of level by ``scale`` and 0.2 of that of activity by twice its mean.

    blocks and activity: series, start, end, level. Silent or missing activity changes nothing.
    """
    loud = mean_change(blocks, probes, window, F.lit(float(scale)))
    if activity is None:
        return loud.withColumn("change", 0.8 * F.col("change"))
    busy = mean_change(activity, probes, window, 2 * F.col("mean")).withColumnRenamed("change", "_busy")
    both = loud.join(busy, ["series", "t"], "left")
    return both.select("series", "t", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 0.8 * F.col("change") + 0.2 * F.coalesce("_busy", F.lit(0.0)))).alias("change"))


def bar_spans(clock: DataFrame, pulses: int) -> DataFrame:
    """Whole bars of ``pulses`` beats: series, bar, start_idx, end_idx (the next bar's first beat)."""
    ends = clock.groupBy("series").agg(F.max("idx").alias("last"))
    return ends.where(F.col("last") >= pulses).withColumn("bar", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / pulses) - 1))).select("series", "bar", (F.col("bar") * pulses).alias("start_idx"), ((F.col("bar") + 1) * pulses).alias("end_idx"))


def bar_minimum(clock: DataFrame, spans: DataFrame) -> DataFrame:
    """Least strength over each bar's beats, both ends included."""
    width = 16
    met = range_join(clock.select("series", "idx", "strength"), spans, "idx", "start_idx", "end_idx", ["series"], width)
    return met.groupBy("series", "bar").agg(F.min("strength").alias("least"), F.count(F.lit(1)).alias("n"))


def bar_conflicts(clock: DataFrame, spans: DataFrame, limit: float) -> DataFrame:
    """Whether a beat inside a bar, not at its ends, is as strong as ``limit``."""
    met = range_join(clock.select("series", "idx", "strength"), spans, "idx", "start_idx", "end_idx", ["series"], 16)
    inside = (F.col("idx") > F.col("start_idx")) & (F.col("idx") < F.col("end_idx"))
    return met.groupBy("series", "bar").agg(F.bool_or(inside & (F.col("strength") >= limit)).alias("conflict"))


def bar_issues(boundaries: DataFrame, bars: DataFrame, removed: DataFrame, pulse: DataFrame | None = None, acoustic: DataFrame | None = None, least: float = 0.9, weak: float = 0.5) -> DataFrame:
    """Per bar all of the seven codes that speak against it, and whether there are none.

    boundaries: series, boundary (from 0), idx, us, score, complete (its observation window); bar i lies between i and
    i + 1. bars: series, bar, posterior, region (whether its meter region has enough evidence). removed: raw downbeats
    that are no boundary, as series, idx (nearest beat), us, score. pulse: accepted regions of beats (series, from, to one
    past the last). acoustic: ``assess_ranges`` of the bars with both end beats (series, start, end, supported). Without
    pulse or acoustic that code isn't given; a bar that they don't cover has it.
    """
    order = Window.partitionBy("series").orderBy("boundary")
    ahead = {c: F.lead(c).over(order).alias(f"_{c}") for c in ("idx", "us", "score", "complete")}
    spans = boundaries.select("series", F.col("boundary").alias("bar"), "idx", "us", "score", "complete", *ahead.values()).where("_idx is not null and series is not null and bar is not null")
    strong = removed.where(F.col("score") >= weak).select("series", F.col("idx").alias("_at"), F.col("us").alias("_at_us"))
    met = range_join(strong, spans.select("series", "bar", "idx", "us", "_idx", "_us"), "_at", "idx", "_idx", ["series"], 16)
    inside = (F.col("_at") > F.col("idx")) & (F.col("_at") < F.col("_idx")) & (F.col("_at_us") > F.col("us")) & (F.col("_at_us") < F.col("_us"))
    found = spans.join(met.where(inside).select("series", "bar", F.lit(True).alias("_conflict")).distinct(), ["series", "bar"], "left")
    found = found.join(bars.select("series", "bar", "posterior", "region"), ["series", "bar"], "left")
    found = found.withColumn("start", F.col("idx")).withColumn("end", F.col("_idx") + 1)
    found = mark_contained(found, pulse, "_pulse") if pulse is not None else found.withColumn("_pulse", F.lit(True))
    found = found.join(acoustic.select("series", "start", "end", F.col("supported").alias("_acoustic")), ["series", "start", "end"], "left") if acoustic is not None else found.withColumn("_acoustic", F.lit(True))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    faults = {
        "UNSUPPORTED_PULSE": no(F.col("_pulse")),
        "UNSUPPORTED_ACOUSTIC_PULSE": no(F.col("_acoustic")),
        "INCOMPLETE_OBSERVATION_WINDOW": no(F.col("complete") & F.col("_complete")),
        "WEAK_BOUNDARY_EVIDENCE": no((F.col("score") >= weak) & (F.col("_score") >= weak)),
        "CONFLICTING_DOWNBEAT_EVIDENCE": F.coalesce("_conflict", F.lit(False)),
        "INSUFFICIENT_METER_EVIDENCE": no(F.col("region")),
        "UNCERTAIN_METER_PHASE": no(F.col("posterior") >= least),
    }
    codes = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in faults.items()]))
    return found.select("series", "bar", F.array_join(codes, ",").alias("codes"), (F.size(codes) == 0).alias("usable"))


def coverage_runs(usable: DataFrame) -> DataFrame:
    """Longest runs of usable bars: series, first_bar, end_bar (one past the last)."""
    order = Window.partitionBy("series").orderBy("bar")
    kept = usable.where("usable").withColumn("_g", F.col("bar") - F.row_number().over(order))
    return kept.groupBy("series", "_g").agg(F.min("bar").alias("first_bar"), (F.max("bar") + 1).alias("end_bar")).drop("_g")


def inherited_tail(clock: DataFrame, bars: DataFrame, selections: DataFrame, most: int = 8, drift: float = 0.1) -> DataFrame:
    """Whether the bar before a selection's weak tail may speak for it: series, from_bar, to_bar, tail, anchor_bar, inherits.

    bars: series, bar, start_idx, end_idx, codes (of ``bar_issues``) and acoustic (issues of ``assess_ranges``; empty
    where supported). selections: series, from_bar, to_bar (one past the last). The tail begins at the first bar without
    acoustic support. It is inherited if it has at most ``most`` bars, the bar before it has no fault at all, and all its
    bars lack only local attacks or context, have as many beats, and beat periods within ``drift`` of that bar's.
    """
    order = Window.partitionBy("series").orderBy("idx")
    periods = clock.withColumn("_p", F.lead("us").over(order) - F.col("us")).where("_p is not null").select("series", "idx", "_p")
    beats = bars.select("series", "bar", "start_idx", (F.col("end_idx") - 1).alias("_last"))
    timed = range_join(periods, beats, "idx", "start_idx", "_last", ["series"], 16).groupBy("series", "bar").agg(F.min("_p").alias("_low"), F.max("_p").alias("_high"), F.avg("_p").alias("_mean"))
    known = bars.join(timed, ["series", "bar"], "left").withColumn("_beats", F.col("end_idx") - F.col("start_idx"))
    met = known.join(selections, "series").where((F.col("bar") >= F.col("from_bar") - 1) & (F.col("bar") < F.col("to_bar")))
    own = Window.partitionBy("series", "from_bar", "to_bar")
    met = met.withColumn("_weak", F.min(F.when((F.col("bar") >= F.col("from_bar")) & (F.col("acoustic") != ""), F.col("bar"))).over(own))
    anchor = lambda c: F.max(F.when(F.col("bar") == F.col("_weak") - 1, c)).over(own)
    met = met.withColumn("_sound", anchor((F.col("codes") == "") & (F.col("acoustic") == ""))).withColumn("_a", anchor(F.col("_mean"))).withColumn("_n", anchor(F.col("_beats")))
    sparse = F.array_contains(F.split("acoustic", ","), "INSUFFICIENT_LOCAL_ATTACKS") | (F.col("acoustic") == "INSUFFICIENT_CONTEXT")
    steady = (F.col("_beats") == F.col("_n")) & (1 - F.col("_low") / F.col("_a") <= drift) & (F.col("_high") / F.col("_a") - 1 <= drift)
    fine = F.coalesce(sparse & F.col("codes").isin("", "UNSUPPORTED_ACOUSTIC_PULSE") & steady, F.lit(False))
    weak = F.coalesce(F.col("bar") >= F.col("_weak"), F.lit(False))
    found = met.groupBy("series", "from_bar", "to_bar").agg((F.col("to_bar") - F.min("_weak")).alias("_t"), (F.min("_weak") - 1).alias("_anchor"), F.count_if(weak & fine).alias("_fine"), F.coalesce(F.bool_or("_sound"), F.lit(False)).alias("_ok"))
    inherits = F.coalesce(F.col("_ok") & F.col("_t").between(1, most) & (F.col("_fine") == F.col("_t")), F.lit(False))
    return found.select("series", "from_bar", "to_bar", F.coalesce("_t", F.lit(0)).alias("tail"), F.when(inherits, F.col("_anchor")).alias("anchor_bar"), inherits.alias("inherits"))


def edits(boundaries: DataFrame, raw: DataFrame) -> DataFrame:
    """Boundaries without a raw event are INFERRED, raw events that are no boundary REMOVED. Both: series, idx."""
    inferred = boundaries.join(raw, ["series", "idx"], "left_anti").select("series", "idx", F.lit("INFERRED").alias("edit"))
    return inferred.unionByName(raw.join(boundaries, ["series", "idx"], "left_anti").select("series", "idx", F.lit("REMOVED").alias("edit")))


def contained(spans: DataFrame, regions: DataFrame, width: int) -> DataFrame:
    """The spans (start, end) inside one region (from, to)."""
    ends = range_join(spans, regions.select("series", "from", "to"), "start", "from", "to", ["series"], width)
    return ends.where(F.col("end") <= F.col("to")).drop("from", "to").distinct()


def mark_contained(rows: DataFrame, regions: DataFrame, name: str) -> DataFrame:
    """``rows`` (start, end and others) with ``name``: whether one region (from, to) holds them.

    As ``contained``, but the rows are read once and meet no repeated regions: one holds a row if the furthest end of those
    that begin by its start reaches its end.
    """
    reach = regions.where("from is not null").select("series", "from", F.max("to").over(Window.partitionBy("series").orderBy("from")).alias("_reach"))
    found = asof(rows, reach, "start", "from", ["series"], ["_reach"])
    return found.select(*rows.columns, F.coalesce((F.col("_reach") >= F.col("start")) & (F.col("_reach") >= F.col("end")), F.lit(False)).alias(name))


def reason_counts(rows: DataFrame, keys: list[str], reason: str) -> DataFrame:
    """How often each reason occurs, and all of a key's counts as a map."""
    counts = rows.groupBy(*keys, reason).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(reason, "n")))).alias("counts"), F.sum("n").alias("total"))


def default_cue(clock: DataFrame, downbeats: DataFrame, within_us: int, least: float) -> DataFrame:
    """The first beat of enough strength with a downbeat within reach, else the first of enough strength."""
    spans = downbeats.select("series", (F.col("us") - within_us).alias("_from"), (F.col("us") + within_us).alias("_to"))
    strong = clock.where(F.col("strength") >= least)
    near = range_join(strong, spans, "us", "_from", "_to", ["series"], max(1, 4 * within_us), "left_semi").groupBy("series").agg(F.min("idx").alias("_near"))
    return strong.groupBy("series").agg(F.min("idx").alias("_any")).join(near, "series", "left").select("series", F.coalesce("_near", "_any").alias("idx"), F.col("_near").isNotNull().alias("on_downbeat"))


def gains(t: Column, start: float, end: float) -> tuple[Column, Column]:
    """Sine-squared crossfade gains of the outgoing and the incoming side, summing to 1."""
    fade = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (t - start) / (end - start)))
    b = F.sin(fade * math.pi / 2) ** 2
    return 1.0 - b, b


def crossfade(outgoing: DataFrame, incoming: DataFrame, offset: int, start: int, end: int) -> DataFrame:
    """Two sample tables (frame, x) on one timeline, the incoming one ``offset`` frames later; silence outside either."""
    a, b = gains(F.col("frame").cast("double"), start, end)
    right = incoming.select((F.col("frame") + offset).alias("frame"), F.col("x").alias("y"))
    both = outgoing.join(right, "frame", "full_outer")
    return both.select("frame", (F.coalesce("x", F.lit(0.0)) * a + F.coalesce("y", F.lit(0.0)) * b).alias("mix"))


def overlap(outgoing: DataFrame, incoming: DataFrame, offset: int, gain: float = 0.46) -> DataFrame:
    """Both sides at a constant gain."""
    right = incoming.select((F.col("frame") + offset).alias("frame"), F.col("x").alias("y"))
    return outgoing.join(right, "frame", "full_outer").select("frame", (gain * (F.coalesce("x", F.lit(0.0)) + F.coalesce("y", F.lit(0.0)))).alias("mix"))


def timeline_bounds(plans: DataFrame) -> DataFrame:
    """First and end frame of a mix per mode. plans: plan_id, out_frames, origin, in_frames, fade_end."""
    in_end = F.col("origin") + F.col("in_frames")
    modes = F.explode(F.array(F.lit("OVERLAP"), F.lit("TRANSITION")))
    both = plans.withColumn("mode", modes)
    start = F.when(F.col("mode") == "OVERLAP", F.least(F.lit(0).cast("long"), F.col("origin"))).otherwise(0)
    out_end = F.when(F.col("mode") == "OVERLAP", F.col("out_frames")).otherwise(F.least("out_frames", "fade_end"))
    end = F.greatest(F.lit(0).cast("long"), out_end, in_end)
    return both.select("plan_id", "mode", start.alias("start_frame"), end.alias("end_frame"), (end - start).alias("frames"))


def read_range(chunks: DataFrame, first: int, count: int, size: int) -> DataFrame:
    """Frames first to first + count of every series as rows, silence where it has none. chunks: series, start_frame, samples."""
    spine = chunks.select("series").distinct().withColumn("frame", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(first + count - 1).cast("long"))))
    near = chunks.where((F.col("start_frame") > first - size) & (F.col("start_frame") < first + count))
    rows = near.select("series", "start_frame", F.posexplode("samples").alias("p", "x")).select("series", (F.col("start_frame") + F.col("p")).alias("frame"), "x")
    return spine.join(rows, ["series", "frame"], "left").withColumn("x", F.coalesce("x", F.lit(0.0)))
