"""What may be asked of a song: guarded ranges of its pulse, its bars, and re-audits. Nothing is relaxed: what isn't supported has a code.

A song is a clock (series, idx, us) with ``safe`` (series, safe: the whole clock's audit), pulse regions (series, from, to: one past
the last beat) and, where it was assessed, a prefix index of its acoustic evidence (``evidence.prefix_index``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clock import issues as clock_issues
from .evidence import assess_rows
from .planning import BAR_COUNTS, contained, mark_contained
from .repair import annotated_bars

#: Beats of a time bucket in which ranges meet regions.
WIDTH = 64
#: Codes of a bar that an inherited bar may have.
ACOUSTIC = "UNSUPPORTED_ACOUSTIC_PULSE"


def _refused(rows: DataFrame, clock: DataFrame, safe: DataFrame, regions: DataFrame, acoustic: DataFrame | None = None, spared: Column | None = None) -> DataFrame:
    """``rows`` (series, start, end and others) with declined, as of ``guard_ranges``; of ``spared`` rows no attacks are asked.

    Every lookup is added to the rows where they stand: what gives the rows is planned once, however large its plan.
    """
    sizes = clock.groupBy("series").agg((F.max("idx") + 1).alias("_size"))
    found = mark_contained(rows, regions, "_held").join(sizes, "series", "left").join(safe.select("series", F.col("safe").alias("_safe")), "series", "left")
    inside = (F.col("start") >= 0) & (F.col("end") <= F.coalesce("_size", F.lit(0))) & (F.col("end") - F.col("start") >= 2)
    found = found.withColumn("declined", F.when(~inside, "OUT_OF_BOUNDS").when(~F.coalesce("_safe", F.lit(False)) & ~F.col("_held"), "UNSUPPORTED_PULSE"))
    if acoustic is not None:
        wide = found.withColumn("_end", F.col("end")).withColumn("end", F.when(F.col("end") - F.col("start") >= 2, F.col("end")))
        found = assess_rows(acoustic, wide, "left").withColumn("end", F.col("_end"))
        unheard = ~F.coalesce("supported", F.lit(False))
        found = found.withColumn("declined", F.when(F.col("declined").isNotNull(), F.col("declined")).when(unheard if spared is None else unheard & ~spared, ACOUSTIC))
    return found.select(*rows.columns, "declined")


def guard_ranges(asked: DataFrame, clock: DataFrame, safe: DataFrame, regions: DataFrame, acoustic: DataFrame | None = None) -> DataFrame:
    """``asked`` (series, start, end: one past the last beat) with declined: the code that refuses a range, null if none.

    A range has two beats of the clock at least; the whole clock is safe or one region holds the range; and, with
    ``acoustic`` (a prefix index), all its intervals have recurring attacks. Without it the guard is geometric alone.
    """
    found = _refused(asked.select("series", "start", "end").distinct(), clock, safe, regions, acoustic)
    return asked.join(found, ["series", "start", "end"])


def matching_grid(guarded: DataFrame, clock: DataFrame) -> DataFrame:
    """The beats of every range that isn't declined, numbered from 0, at their unchanged times: series, start, end, i, us."""
    ranges = guarded.where("declined is null").select("series", "start", "end").distinct()
    at = ranges.withColumn("idx", F.explode(F.sequence("start", F.col("end") - 1)))
    return at.join(clock.select("series", "idx", "us"), ["series", "idx"]).select("series", "start", "end", (F.col("idx") - F.col("start")).alias("i"), "us")


def tracked_grid(boundaries: DataFrame) -> DataFrame:
    """Bars between the boundaries (series, boundary, idx) of a tracked song: series, bar, start_idx, end_idx."""
    order = Window.partitionBy("series").orderBy("boundary")
    return boundaries.select("series", F.col("boundary").alias("bar"), F.col("idx").alias("start_idx"), F.lead("idx").over(order).alias("end_idx")).where("end_idx is not null")


def song_bars(tracked: DataFrame, clock: DataFrame, downbeats: DataFrame, within_us: int) -> DataFrame:
    """A song's proposed bars: the tracked ones, or, without any, those between annotated downbeats. Columns as ``tracked_grid`` and origin."""
    own = tracked.select("series", "bar", "start_idx", "end_idx", F.lit("TRACKED").alias("origin"))
    left = downbeats.join(tracked.select("series").distinct(), "series", "left_anti")
    said = annotated_bars(left, clock, within_us).where("ok").select("series", "bar", "start_idx", "end_idx", F.lit("ANNOTATED").alias("origin"))
    return own.unionByName(said)


def with_pulse_support(bars: DataFrame, regions: DataFrame) -> DataFrame:
    """``bars`` (series, bar, start_idx, end_idx) with pulse: whether one accepted region holds the bar with both its end beats."""
    spans = bars.select("series", "bar", F.col("start_idx").alias("start"), (F.col("end_idx") + 1).alias("end"))
    held = contained(spans, regions, WIDTH).select("series", "bar", F.lit(True).alias("pulse"))
    return bars.join(held, ["series", "bar"], "left").withColumn("pulse", F.coalesce("pulse", F.lit(False)))


def latest_accepted_beat(clock: DataFrame, safe: DataFrame, regions: DataFrame) -> DataFrame:
    """The last beat of every series that is geometrically accepted: the clock's last if all of it is safe, else that of
    the last region of two beats and more inside the clock; null if none."""
    sizes = clock.groupBy("series").agg((F.max("idx") + 1).alias("_size"))
    inside = regions.join(sizes, "series").where((F.col("from") >= 0) & (F.col("to") <= F.col("_size")) & (F.col("to") - F.col("from") >= 2))
    ends = inside.groupBy("series").agg((F.max("to") - 1).alias("_last"))
    found = sizes.join(safe.select("series", "safe"), "series", "left").join(ends, "series", "left")
    return found.select("series", F.when(F.coalesce("safe", F.lit(False)), F.col("_size") - 1).otherwise(F.col("_last")).alias("idx"))


def require_bars(asked: DataFrame, bars: DataFrame, inherited: DataFrame, clock: DataFrame, safe: DataFrame, regions: DataFrame, acoustic: DataFrame | None = None) -> DataFrame:
    """``asked`` with the first bar that refuses it and why: failed_bar and declined, null if all its bars hold.

    asked: ask, series, first_bar, n_bars, end_idx (the last beat that is used, in or at the end of the last bar; null: its end).
    bars: series, bar, start_idx, end_idx, codes (as of ``planning.bar_issues``). inherited: ask, bar, the bars that an anchor
    speaks for. Every bar needs a supported pulse up to the beat that is used. A bar used in part may lack recurring
    attacks as a whole; an inherited one may lack them altogether, but must lie in an accepted region.
    """
    each = asked.withColumn("bar", F.explode(F.sequence("first_bar", F.col("first_bar") + F.col("n_bars") - 1))).select("ask", "series", "bar", F.col("end_idx").alias("_used"))
    # What is exploded counts as its source's size: both sides are sorted, else a bar for each few beats would be sent to the driver.
    met = each.join(bars.select("series", "bar", "start_idx", "end_idx", F.split("codes", ",").alias("_codes")).hint("merge"), ["series", "bar"], "left")
    met = met.join(inherited.select("ask", "bar", F.lit(True).alias("_inherited")).hint("merge"), ["ask", "bar"], "left").withColumn("_inherited", F.coalesce("_inherited", F.lit(False)))
    used = F.least("end_idx", F.coalesce("_used", "end_idx"))
    placed = met.withColumn("start", F.col("start_idx")).withColumn("end", F.when(F.col("_inherited"), F.col("end_idx")).otherwise(used) + 1)
    whole = F.coalesce("_used", "end_idx") >= F.col("end_idx")
    faults = F.filter("_codes", lambda c: (c != "") & ((c != ACOUSTIC) | (~F.col("_inherited") & whole)))
    placed = placed.withColumn("_fault", F.when(F.col("start").isNull(), "NO_SUCH_BAR").otherwise(F.get(faults, F.lit(0)))).select("ask", "series", "bar", "start", "end", "_inherited", "_fault")
    found = _refused(placed, clock, safe, regions, acoustic, F.col("_inherited"))
    first = found.withColumn("_code", F.coalesce("_fault", "declined")).where("_code is not null").groupBy("ask").agg(F.min(F.struct("bar", "_code")).alias("_f"))
    return asked.join(first, "ask", "left").select(*asked.columns, F.col("_f.bar").alias("failed_bar"), F.col("_f._code").alias("declined"))


def supported_regions(bars: DataFrame, clock: DataFrame, safe: DataFrame, regions: DataFrame, acoustic: DataFrame | None = None) -> DataFrame:
    """Longest runs of bars that all hold, and hold together: series, first_bar, end_bar, start_idx, end_idx.

    bars: series, bar, start_idx, end_idx, codes. A bar counts without codes and with its own pulse supported. Adjacent bars may
    still lie in different accepted regions, or have rests on both sides of the bound between them: there a run ends.
    """
    rows = bars.where("codes = ''").withColumn("start", F.col("start_idx")).withColumn("end", F.col("end_idx") + 1)
    fine = guard_ranges(rows.select("series", "start", "end"), clock, safe, regions, acoustic).where("declined is null").select("series", "start", "end").distinct()
    order = Window.partitionBy("series").orderBy("bar")
    sound = rows.join(fine, ["series", "start", "end"], "left_semi").withColumn("_before", F.lag("start_idx").over(order)).withColumn("_next", F.col("bar") - F.lag("bar").over(order) == 1)
    joins = sound.where("_next")
    whole = guard_ranges(joins.select("series", F.col("_before").alias("start"), "end"), clock, safe, regions)
    bound = guard_ranges(joins.select("series", (F.col("start_idx") - 1).alias("start"), (F.col("start_idx") + 2).alias("end")), clock, safe, regions, acoustic)
    apart = lambda rows: rows.where("declined is null").select("series", "start", "end").distinct()
    held = joins.select("series", "bar", F.col("_before").alias("start"), "end", "start_idx").join(apart(whole), ["series", "start", "end"], "left_semi")
    held = held.select("series", "bar", (F.col("start_idx") - 1).alias("start"), (F.col("start_idx") + 2).alias("end")).join(apart(bound), ["series", "start", "end"], "left_semi")
    linked = sound.join(held.select("series", "bar", F.lit(0).alias("_new")), ["series", "bar"], "left").withColumn("_run", F.sum(F.coalesce("_new", F.lit(1))).over(order))
    return linked.groupBy("series", "_run").agg(F.min("bar").alias("first_bar"), (F.max("bar") + 1).alias("end_bar"), F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx")).drop("_run")


def reaudited(clock: DataFrame, additional: DataFrame, repairs: DataFrame) -> DataFrame:
    """A repaired clock's report: beats, repairs, all issues of the new audit and the ``additional`` (series, code) as counts, and usable.

    repairs: series and a row for each. A clock is usable without any issue.
    """
    found = clock_issues(clock).select("series", "code").unionByName(additional.select("series", "code"))
    counts = found.groupBy("series", "code").agg(F.count(F.lit(1)).alias("n")).groupBy("series").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("code", "n"))), lambda x: F.concat_ws(":", x["code"], x["n"].cast("string"))), ",").alias("issues"))
    done = repairs.groupBy("series").agg(F.count(F.lit(1)).alias("repairs"))
    sizes = clock.groupBy("series").agg(F.count(F.lit(1)).alias("n_beats"))
    whole = sizes.join(done, "series", "left").join(counts, "series", "left")
    return whole.select("series", "n_beats", F.coalesce("repairs", F.lit(0)).alias("repairs"), F.coalesce("issues", F.lit("")).alias("issues"), F.col("issues").isNull().alias("usable"))


def prepared(plans: DataFrame, durations: DataFrame, slack_s: float = 0.002) -> DataFrame:
    """How each accepted plan is rendered, or why not: ``plans`` (plan_id, a, b, a_s, b_s, translation) with method and declined.

    a_s and b_s are the lengths that were analysed, durations (series, seconds) those of the decoded audio: they may differ
    by ``slack_s``, as a trimmed source has another clock. A map that only shifts is COPIED, any other STRETCHED.
    """
    near = lambda own, said: F.coalesce(F.abs(F.col(own) - F.col(said)) <= slack_s, F.lit(False))
    sides = plans.join(durations.select(F.col("series").alias("a"), F.col("seconds").alias("_a")), "a", "left").join(durations.select(F.col("series").alias("b"), F.col("seconds").alias("_b")), "b", "left")
    same = near("_a", "a_s") & near("_b", "b_s")
    method: Column = F.when(same, F.when(F.col("translation"), "COPIED").otherwise("STRETCHED"))
    return sides.select(*plans.columns, method.alias("method"), F.when(~same, "DURATION_DIFFERS").alias("declined"))


def supported_lengths(selections: DataFrame) -> DataFrame:
    """``selections`` with declined where n_bars isn't a number of bars that transitions have."""
    return selections.withColumn("declined", F.when(~F.col("n_bars").isin(*BAR_COUNTS), "UNSUPPORTED_BAR_COUNT"))
