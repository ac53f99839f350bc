"""The ways to ask for a transition of pairs of songs; each gives one row per question, a checked plan or the code that declines it.

Songs are bars (series, bar, pulses, usable, score) and clocks (series, idx, us), as for ``transitions``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evidence import prefix_index
from .guards import guard_ranges, supported_lengths
from .kernel_ops import ship
from .planning import BAR_COUNTS, boundaries
from .selection import declared_bars, declared_grid
from .sequence import nearest
from .transitions import MAX_FITS, MOST_PULSES, _fit, fit_candidates, plan, plan_pulses

#: Fewest bars of an overlap.
LEAST_OVERLAP = 2


def transition(selections: DataFrame, bars: DataFrame, clocks: DataFrame) -> DataFrame:
    """Plans of exact selections (pair, a, b, a_bar, b_bar, n_bars), as ``plan_pulses``; other numbers of bars than listed are declined."""
    checked = supported_lengths(selections)
    found = plan_pulses(checked.where("declined is null").drop("declined"), bars, clocks)
    return found.unionByName(checked.where("declined is not null").withColumn("tried", F.lit(0)), allowMissingColumns=True)


def auto_transition(pairs: DataFrame, bars: DataFrame, clocks: DataFrame, n_bars: int = 16) -> DataFrame:
    """The best transition of each pair (pair, a, b) with exactly ``n_bars`` bars; it is never shortened."""
    if n_bars not in BAR_COUNTS:
        raise ValueError(f"transitions have {', '.join(map(str, BAR_COUNTS))} bars")
    return plan(pairs, bars, clocks, (n_bars,))


def best_transition(pairs: DataFrame, bars: DataFrame, clocks: DataFrame) -> DataFrame:
    """The best transition of each pair (pair, a, b) over all numbers of bars and all cues."""
    return plan(pairs, bars, clocks)


def overlap_candidates(pairs: DataFrame, bars: DataFrame, clocks: DataFrame, least: int = LEAST_OVERLAP, budget: int = MAX_FITS, rate: int = 48_000) -> DataFrame:
    """The longest common runs of usable bars of equal pulses: per pair the best ``budget`` starts, by length in output frames.

    Every start in a run counts with what is left of the run. Columns as ``transitions.candidates`` gives them. Songs meet
    bar by bar of equal pulses, by a join on them; runs lie on diagonals, so that no search goes over pairs again.
    """
    at = boundaries(bars).where("usable")
    side = lambda s: at.select(F.col("series").alias(s), F.col("bar").alias(f"{s}_bar"), "pulses", F.col("start_idx").alias(f"{s}_start_idx"), F.col("end_idx").alias(f"{s}_last"))
    met = pairs.join(side("a"), "a").join(side("b"), ["b", "pulses"])
    diagonal = Window.partitionBy("pair", "_d").orderBy("a_bar")
    runs = met.withColumn("_d", F.col("a_bar") - F.col("b_bar")).withColumn("_g", F.col("a_bar") - F.row_number().over(diagonal))
    rest = Window.partitionBy("pair", "_d", "_g").orderBy("a_bar").rowsBetween(0, Window.unboundedFollowing)
    whole = runs.select("*", F.count(F.lit(1)).over(rest).alias("n_bars"), F.max("a_last").over(rest).alias("a_end_idx"), F.max("b_last").over(rest).alias("b_end_idx")).where(F.col("n_bars") >= least)
    time = lambda i, name: clocks.select(F.col("series").alias("a"), F.col("idx").alias(i), F.col("us").alias(name))
    timed = whole.join(time("a_start_idx", "_from"), ["a", "a_start_idx"]).join(time("a_end_idx", "_to"), ["a", "a_end_idx"])
    order = Window.partitionBy("pair").orderBy(F.desc("_frames"), "b_bar", "a_bar")
    ranked = timed.withColumn("_frames", F.floor((F.col("_to") - F.col("_from")) / 1e6 * rate + 0.5)).withColumn("position", F.row_number().over(order)).withColumn("found", F.count(F.lit(1)).over(Window.partitionBy("pair")))
    return ranked.where(F.col("position") <= budget).select("pair", "position", "found", "a", "b", "n_bars", *[f"{s}_{c}" for s in "ab" for c in ("bar", "start_idx", "end_idx")])


def overlap(pairs: DataFrame, bars: DataFrame, clocks: DataFrame, least: int = LEAST_OVERLAP, budget: int = MAX_FITS) -> DataFrame:
    """Each pair's longest common span of bars whose clock is accepted, or the code that declines the pair."""
    tried = fit_candidates(overlap_candidates(pairs, bars, clocks, least, budget), clocks)
    first = Window.partitionBy("pair").orderBy("position")
    accepted = tried.where("accepted").withColumn("_r", F.row_number().over(first)).where("_r = 1").select("pair", "position", "n_bars", "a_bar", "b_bar", "fitted", "min_speed", "max_speed", "max_rate", "p95_s", "max_s")
    seen = tried.groupBy("pair").agg(F.max("found").alias("found"), F.count(F.lit(1)).alias("tried"))
    known = bars.where("usable").select("series").distinct()
    has = lambda s: known.select(F.col("series").alias(s), F.lit(True).alias(f"_{s}"))
    both = pairs.join(has("a"), "a", "left").join(has("b"), "b", "left").join(seen, "pair", "left").join(accepted, "pair", "left")
    code = (
        F.when(F.col("position").isNotNull(), F.lit(None).cast("string"))
        .when(F.col("_a").isNull() | F.col("_b").isNull(), "NO_CONFIDENT_BAR_GRID")
        .when(F.col("found").isNull(), "NO_COMPATIBLE_BAR_RANGE")
        .when(F.col("found") > F.col("tried"), "SEARCH_LIMIT_REACHED")
        .otherwise("CLOCK_REJECTED")
    )
    return both.select("pair", "a", "b", "n_bars", "a_bar", "b_bar", "position", "fitted", "min_speed", "max_speed", "max_rate", "p95_s", "max_s", F.coalesce("tried", F.lit(0)).alias("tried"), code.alias("declined"))


DECLARED = "pair long, a long, b long, a_bar long, b_bar long, n_bars int, fitted boolean, min_speed double, max_speed double, max_rate double, p95_s double, max_s double, declined string"


def _declared_bars(declared: DataFrame, clock: DataFrame) -> DataFrame:
    """Declared bars with their main beats and whether their provider supports them."""
    own = declared.where("boundary").select("series", F.col("m").alias("m_start"), "supported")
    return declared_bars(declared, clock).join(own, ["series", "m_start"]).withColumn("mains", F.col("m_end") - F.col("m_start"))


def declared_transition(selections: DataFrame, declared: DataFrame, clock: DataFrame, safe: DataFrame, regions: DataFrame, acoustic: DataFrame | None = None, pins: DataFrame | None = None) -> DataFrame:
    """Plans of exact selections of declared bars, main beat by main beat, or the code that declines them.

    selections: pair, a, b, a_bar, b_bar, n_bars. declared: series, m (main beat, from 0), canonical_idx, boundary (a bar begins),
    supported (by whoever declares; of a bar's first beat). pins: pair, idx, beats of b's own clock that mustn't move.
    Corresponding bars have equally many main beats; the whole range and each bar alone need supported pulses, also where
    beats lie between the main ones; pins must be main beats of the selection. The fit holds every downbeat and pin.
    """
    ship(selections.sparkSession)
    asked = supported_lengths(selections).withColumnRenamed("declined", "_length")
    invalid = declared_grid(declared, clock).where("declined is not null").select("series", F.col("declined").alias("_grid"))
    bars = _declared_bars(declared, clock).select("series", "bar", "m_start", "m_end", "start_idx", "end_idx", "supported", "mains")
    side = lambda s: bars.select(F.col("series").alias(s), F.col("bar").alias(f"{s}_at"), *[F.col(c).alias(f"{s}_{c}") for c in ("m_start", "m_end", "start_idx", "end_idx", "supported", "mains")])
    each = asked.where("_length is null").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n_bars").cast("int") - 1))).select("pair", "a", "b", (F.col("a_bar") + F.col("k")).alias("a_at"), (F.col("b_bar") + F.col("k")).alias("b_at"))
    each = each.join(side("a"), ["a", "a_at"], "left").join(side("b"), ["b", "b_at"], "left")
    held = F.coalesce(F.col("a_supported") & F.col("b_supported"), F.lit(False))
    spans = each.groupBy("pair", "a", "b").agg(
        F.bool_and(held).alias("_held"), F.bool_and(F.coalesce(F.col("a_mains") == F.col("b_mains"), F.lit(False))).alias("_meter"), F.sum("a_mains").alias("_count"),
        *[f(f"{s}_{c}").alias(f"{s}_{c}") for s in "ab" for c, f in (("m_start", F.min), ("m_end", F.max), ("start_idx", F.min), ("end_idx", F.max))],
        F.sort_array(F.collect_list("b_m_start")).alias("_downbeats"),
    )
    one = lambda rows, s: rows.where(f"{s}_start_idx is not null").select("pair", F.col(s).alias("series"), F.col(f"{s}_start_idx").alias("start"), (F.col(f"{s}_end_idx") + 1).alias("end"))
    ranges = one(each, "a").unionByName(one(each, "b")).unionByName(one(spans, "a")).unionByName(one(spans, "b"))
    refused = guard_ranges(ranges, clock, safe, regions, acoustic).where("declined is not null").select("pair").distinct().withColumn("_pulse", F.lit(True))

    listed = declared.groupBy("series").agg(F.transform(F.array_sort(F.collect_list(F.struct("m", "canonical_idx"))), lambda x: x["canonical_idx"]).alias("idx"))
    timed = declared.join(clock.select("series", F.col("idx").alias("canonical_idx"), "us"), ["series", "canonical_idx"]).groupBy("series").agg(F.transform(F.array_sort(F.collect_list(F.struct("m", "us"))), lambda x: x["us"] / 1e6).alias("t"))
    mains = listed.join(timed, "series")
    pinned = pins.groupBy("pair").agg(F.collect_set("idx").alias("_pins")) if pins is not None else selections.select("pair").limit(0).withColumn("_pins", F.array().cast("array<long>"))
    found = asked.join(spans.drop("a", "b"), "pair", "left").join(refused, "pair", "left").join(pinned, "pair", "left")
    for s in "ab":
        found = found.join(invalid.select(F.col("series").alias(s), F.col("_grid").alias(f"_{s}_grid")), s, "left").join(mains.select(F.col("series").alias(s), F.col("idx").alias(f"_{s}_idx"), F.col("t").alias(f"_{s}_t")), s, "left")
    cut = lambda s, c: F.slice(F.col(f"_{s}_{c}"), F.col(f"{s}_m_start").cast("int") + 1, (F.col(f"{s}_m_end") - F.col(f"{s}_m_start")).cast("int") + 1)
    none = F.array().cast("array<long>")
    stray = F.size(F.array_except(F.coalesce("_pins", none), F.coalesce(cut("b", "idx"), none))) > 0
    code: Column = (
        F.when(F.col("_length").isNotNull(), F.col("_length"))
        .when(F.coalesce("_a_grid", "_b_grid").isNotNull(), F.coalesce("_a_grid", "_b_grid"))
        .when(~F.coalesce("_held", F.lit(False)), "UNSUPPORTED_BAR_RANGE")
        .when(~F.coalesce("_meter", F.lit(False)) | (F.col("_count") > MOST_PULSES), "INCOMPATIBLE_MAIN_METER")
        .when(F.coalesce("_pulse", F.lit(False)), "UNSUPPORTED_PULSE_RANGE")
        .when(stray, "UNMAPPED_CANONICAL_PIN")
    )
    coded = found.withColumn("declined", code)
    fits = coded.select("pair", "a", "b", "a_bar", "b_bar", "n_bars", "declined", F.when(F.col("declined").isNull(), cut("a", "t")).alias("ta"), F.when(F.col("declined").isNull(), cut("b", "t")).alias("tb"), cut("b", "idx").alias("bi"), F.transform("_downbeats", lambda m: m - F.col("b_m_start")).alias("downbeats"), F.coalesce("_pins", none).alias("pins"))

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                code, got = row.declined, (None,) * 6
                if code is None:
                    x, y = np.asarray(row.ta, float), np.asarray(row.tb, float)
                    held = {int(k) for k in row.downbeats} | {len(y) - 1} | {int(k) for k in np.flatnonzero(np.isin(row.bi, row.pins))}
                    ok, fitted, rates, p95, most = _fit(x, y, None, tuple(sorted(held)))
                    got, code = (fitted, *rates, p95, most), None if ok else "CLOCK_REJECTED"
                out.append((row.pair, row.a, row.b, row.a_bar, row.b_bar, row.n_bars, *(got if code is None else (None,) * 6), code))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in DECLARED.split(", ")], dtype=object)

    return fits.mapInPandas(run, DECLARED)


def declared_auto_transition(pairs: DataFrame, declared: DataFrame, clock: DataFrame, safe: DataFrame, regions: DataFrame, acoustic: DataFrame | None = None, n_bars: int = 16, budget: int = MAX_FITS) -> DataFrame:
    """The earliest entry of each pair's second song, and for it the latest exit of the first, that is accepted with ``n_bars`` declared bars.

    Starts meet by the main beats of their bars; of a pair at most ``budget`` are fitted, in that order.
    """
    if n_bars not in BAR_COUNTS:
        raise ValueError(f"transitions have {', '.join(map(str, BAR_COUNTS))} bars")
    ahead = Window.partitionBy("series").orderBy("bar").rowsBetween(0, n_bars - 1)
    starts = _declared_bars(declared, clock).select("series", "bar", F.collect_list("mains").over(ahead).alias("_l"), F.bool_and("supported").over(ahead).alias("_ok"), F.sum("mains").over(ahead).alias("_n"))
    starts = starts.where((F.size("_l") == n_bars) & F.col("_ok") & (F.col("_n") <= MOST_PULSES)).select("series", "bar", F.array_join(F.transform("_l", lambda x: x.cast("string")), "-").alias("signature"))
    side = lambda s: starts.select(F.col("series").alias(s), "signature", F.col("bar").alias(f"{s}_bar"))
    order = Window.partitionBy("pair").orderBy("b_bar", F.desc("a_bar"))
    met = pairs.join(side("a"), "a").join(side("b"), ["b", "signature"]).withColumn("position", F.row_number().over(order)).withColumn("found", F.count(F.lit(1)).over(Window.partitionBy("pair")))
    chosen = met.where(F.col("position") <= budget)
    asked = chosen.select((F.col("pair") * budget + F.col("position") - 1).alias("pair"), "a", "b", "a_bar", "b_bar", F.lit(n_bars).alias("n_bars"))
    tried = declared_transition(asked, declared, clock, safe, regions, acoustic)
    tried = tried.withColumn("position", F.pmod("pair", F.lit(budget)).cast("int") + 1).withColumn("pair", F.floor(F.col("pair") / budget))
    first = Window.partitionBy("pair").orderBy("position")
    accepted = tried.where("declined is null").withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "a", "b", "declined", "n_bars")
    seen = met.groupBy("pair").agg(F.max("found").alias("found"))
    whole = pairs.join(seen, "pair", "left").join(accepted, "pair", "left")
    code = F.when(F.col("position").isNotNull(), F.lit(None).cast("string")).when(F.col("found") > budget, "SEARCH_LIMIT_REACHED").otherwise("NO_COMPATIBLE_SUPPORTED_RANGE")
    return whole.select("pair", "a", "b", "a_bar", "b_bar", "position", "fitted", "min_speed", "max_speed", "max_rate", "p95_s", "max_s", code.alias("declined"))


def supported_cues(clock: DataFrame, downbeats: DataFrame, safe: DataFrame, regions: DataFrame, acoustic: DataFrame | None = None, within_us: int = 70_000) -> DataFrame:
    """Where each series (series, idx) may be entered: its first downbeat with a beat in reach whose pulse is supported,
    or else its first beat whose pulse is; null if none. A beat's pulse is that of its interval, the last beat's the last one."""
    sizes = clock.groupBy("series").agg((F.max("idx") + 1).alias("_size"))
    at = clock.join(sizes, "series").select("series", "idx", "us", F.least("idx", F.col("_size") - 2).alias("start")).withColumn("end", F.col("start") + 2)
    fine = guard_ranges(at.select("series", "start", "end"), clock, safe, regions, acoustic).where("declined is null").select("series", "start", "end").distinct()
    good = at.join(fine, ["series", "start", "end"], "left_semi")
    met = nearest(downbeats.select("series", F.col("us").alias("_said")), clock.select("series", "us", F.col("idx").alias("near_idx")), "_said", "us", ["series"], ["near_idx"], within_us)
    cued = met.where("near_idx is not null").join(good.select("series", F.col("idx").alias("near_idx")), ["series", "near_idx"], "left_semi").groupBy("series").agg(F.min_by("near_idx", "_said").alias("_cue"))
    first = good.groupBy("series").agg(F.min("idx").alias("_first"))
    return sizes.join(cued, "series", "left").join(first, "series", "left").select("series", F.coalesce("_cue", "_first").alias("idx"))


SPAN = "pair long, a long, b long, a_cue long, b_cue long, a_start long, a_end long, b_start long, b_end long, fitted boolean, min_speed double, max_speed double, max_rate double, p95_s double, max_s double, declined string"


def beat_overlap_plan(pairs: DataFrame, clock: DataFrame, safe: DataFrame, regions: DataFrame, flags: DataFrame, downbeats: DataFrame) -> DataFrame:
    """Two clocks paired beat by beat through a cue of each, or the code that declines the pair.

    pairs: pair, a, b, and optionally a_cue and b_cue, beats of theirs (null: ``supported_cues``). flags: series, i, active,
    missing, nonrecurring, the acoustic evidence of every interval. All beats that both have are paired; their geometry must be
    accepted throughout. Intervals at the ends without complete observation leave the matched span, which must keep
    both cues, and needs supported pulse throughout: nothing inside is skipped.
    """
    ship(pairs.sparkSession)
    acoustic = prefix_index(flags)
    cues = supported_cues(clock, downbeats, safe, regions, acoustic)
    sizes = clock.groupBy("series").agg((F.max("idx") + 1).alias("size"))
    heard = flags.where("not missing").groupBy("series").agg(F.min("i").alias("low"), F.max("i").alias("high"))
    found = pairs.select("pair", "a", "b", *[(F.col(f"{s}_cue") if f"{s}_cue" in pairs.columns else F.lit(None)).cast("long").alias(f"_{s}_cue") for s in "ab"])
    for s in "ab":
        own = cues.select(F.col("series").alias(s), F.col("idx").alias(f"_{s}_own")).join(sizes.select(F.col("series").alias(s), F.col("size").alias(f"_{s}_size")), s).join(heard.select(F.col("series").alias(s), F.col("low").alias(f"_{s}_low"), F.col("high").alias(f"_{s}_high")), s, "left")
        found = found.join(own, s, "left").withColumn(f"{s}_cue", F.coalesce(f"_{s}_cue", f"_{s}_own"))
    # A given cue counts only where its own interval is supported.
    asked = found.select("pair", *[F.least(F.col(f"{s}_cue"), F.col(f"_{s}_size") - 2).alias(s) for s in "ab"], F.col("a").alias("_sa"), F.col("b").alias("_sb"))
    entry = asked.select("pair", F.col("_sa").alias("series"), F.col("a").alias("start")).unionByName(asked.select("pair", F.col("_sb").alias("series"), F.col("b").alias("start"))).where("start is not null").withColumn("end", F.col("start") + 2)
    bad = guard_ranges(entry, clock, safe, regions, acoustic).where("declined is not null").select("pair").distinct().withColumn("_no_cue", F.lit(True))
    start = F.greatest(F.lit(0).cast("long"), F.col("a_cue") - F.col("b_cue"))
    end = F.least(F.col("_a_size") - 1, F.col("a_cue") + F.col("_b_size") - 1 - F.col("b_cue"))
    found = found.join(bad, "pair", "left").withColumn("a_from", start).withColumn("a_to", end)
    found = found.withColumn("b_from", F.col("b_cue") + F.col("a_from") - F.col("a_cue")).withColumn("b_to", F.col("b_cue") + F.col("a_to") - F.col("a_cue"))
    cut = lambda c: F.greatest(F.lit(0).cast("long"), c)
    ahead = F.greatest(cut(F.col("_a_low") - F.col("a_from")), cut(F.col("_b_low") - F.col("b_from")))
    behind = F.greatest(cut(F.col("a_to") - F.col("_a_high") - 1), cut(F.col("b_to") - F.col("_b_high") - 1))
    found = found.withColumn("_ahead", ahead).withColumn("_behind", behind)
    found = found.select("*", *[(F.col(f"{s}_from") + F.col("_ahead")).alias(f"{s}_start") for s in "ab"], *[(F.col(f"{s}_to") - F.col("_behind")).alias(f"{s}_end") for s in "ab"])

    def refused(low: str, high: str, name: str, *index) -> DataFrame:
        rows = None
        for s in "ab":
            part = found.select("pair", F.col(s).alias("series"), F.col(f"{s}_{low}").alias("start"), (F.col(f"{s}_{high}") + 1).alias("end")).where("start is not null and end - start >= 2")
            rows = part if rows is None else rows.unionByName(part)
        return guard_ranges(rows, clock, safe, regions, *index).where("declined is not null").select("pair").distinct().withColumn(name, F.lit(True))

    coded = found.join(refused("from", "to", "_geometry"), "pair", "left").join(refused("start", "end", "_pulse", acoustic), "pair", "left")
    inside = (F.col("a_end") > F.col("a_start")) & F.col("a_cue").between(F.col("a_start"), F.col("a_end"))
    code = (
        F.when(F.col("a_cue").isNull() | F.col("b_cue").isNull() | F.col("_no_cue").isNotNull(), "NO_SUPPORTED_CUE")
        .when(F.col("a_to") <= F.col("a_from"), "INSUFFICIENT_SHARED_COVERAGE")
        .when(F.col("_geometry").isNotNull() | F.col("_a_low").isNull() | F.col("_b_low").isNull(), "UNSUPPORTED_SHARED_COVERAGE")
        .when(~inside, "INSUFFICIENT_SHARED_COVERAGE")
        .when(F.col("_pulse").isNotNull(), "UNSUPPORTED_SHARED_COVERAGE")
    )
    coded = coded.withColumn("declined", code)
    listed = clock.groupBy("series").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "us"))), lambda x: x["us"] / 1e6).alias("t"))
    for s in "ab":
        coded = coded.join(listed.select(F.col("series").alias(s), F.col("t").alias(f"_t{s}")), s, "left")
    spans = coded.select("pair", "a", "b", "a_cue", "b_cue", *[f"{s}_{e}" for s in "ab" for e in ("start", "end")], "declined", *[F.when(F.col("declined").isNull(), F.slice(F.col(f"_t{s}"), (F.col(f"{s}_start") + 1).cast("int"), (F.col(f"{s}_end") - F.col(f"{s}_start") + 1).cast("int"))).alias(f"t{s}") for s in "ab"])

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                code, got = row.declined, (None,) * 6
                if code is None:
                    ok, fitted, rates, p95, most = _fit(np.asarray(row.ta, float), np.asarray(row.tb, float), None, ())
                    code, got = (None, (fitted, *rates, p95, most)) if ok else ("CLOCK_REJECTED", got)
                out.append((*[None if pd.isna(x) else x for x in row[1:10]], *got, code))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SPAN.split(", ")], dtype=object)

    return spans.mapInPandas(run, SPAN)
