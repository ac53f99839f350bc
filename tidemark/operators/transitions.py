"""Transitions between pairs of series: candidates blocked by meter, fitted until one is accepted, or declined by a code.

Nothing is relaxed to get an answer: a pair without an accepted candidate has a code and no plan.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import fit
from .kernel_ops import ship
from .planning import BAR_COUNTS, boundaries
from .repair import length_preference

# Search budgets and acceptance limits.
MAX_FITS = 64
MIN_SPEED, MAX_SPEED, MAX_RATE = 0.5, 2.0, 0.8
P95_S, MOST_S = 0.015, 0.025


def starts(bars: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """Runs of usable bars as starts: series, bar, n_bars, signature, start_idx, end_idx, score.

    bars: series, bar, pulses, usable, score. The windows over n bars are cut where a bar is missing or not usable.
    """
    at = boundaries(bars)
    out = None
    for n in lengths:
        ahead = Window.partitionBy("series").orderBy("bar").rowsBetween(0, n - 1)
        found = at.select(
            "series",
            "bar",
            F.lit(n).alias("n_bars"),
            F.array_join(F.transform(F.collect_list("pulses").over(ahead), lambda p: p.cast("string")), "-").alias("signature"),
            "start_idx",
            F.max("end_idx").over(ahead).alias("end_idx"),
            F.avg("score").over(ahead).alias("score"),
            F.bool_and("usable").over(ahead).alias("_ok"),
            (F.max("bar").over(ahead) - F.col("bar") + 1).alias("_n"),
            F.count(F.lit(1)).over(ahead).alias("_c"),
        )
        found = found.where(F.col("_ok") & (F.col("_n") == n) & (F.col("_c") == n)).drop("_ok", "_n", "_c")
        out = found if out is None else out.unionByName(found)
    return out


def candidates(pairs: DataFrame, table: DataFrame, budget: int = MAX_FITS) -> DataFrame:
    """The best ``budget`` matches of each pair (pair, a, b): late in a, early in b, equal meter, liked lengths first.

    A side's starts of a signature beyond the budget can't be among a pair's best, so they go before the join.
    """

    def side(name: str, late: bool) -> DataFrame:
        rank = F.desc("bar") if late else F.asc("bar")
        order = Window.partitionBy("series", "n_bars", "signature").orderBy(F.desc("score"), rank)
        kept = table.withColumn("r", F.row_number().over(order)).where(F.col("r") <= budget)
        return kept.select(F.col("series").alias(name), "n_bars", "signature", *[F.col(c).alias(f"{name}_{c}") for c in ("bar", "start_idx", "end_idx", "score", "r")])

    met = pairs.join(side("a", True), "a").join(side("b", False), ["b", "n_bars", "signature"])
    score = 10 * length_preference(F.col("n_bars")) + F.col("a_score") + F.col("b_score")
    order = Window.partitionBy("pair").orderBy(F.desc("score"), F.col("a_r") + F.col("b_r"), "b_bar", F.desc("a_bar"), "n_bars")
    ranked = met.withColumn("score", score).withColumn("position", F.row_number().over(order)).withColumn("found", F.count(F.lit(1)).over(Window.partitionBy("pair")))
    return ranked.where(F.col("position") <= budget)


FITTED = "pair long, position int, found long, a long, b long, n_bars int, a_bar long, b_bar long, accepted boolean, fitted boolean, min_speed double, max_speed double, max_rate double, p95_s double, max_s double"


def fit_candidates(found: DataFrame, clocks: DataFrame) -> DataFrame:
    """Each candidate's clock pair, as it is if that is acceptable, else after a bounded fit of the incoming beats."""
    ship(found.sparkSession)
    listed = clocks.groupBy("series").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "us"))), lambda x: x["us"] / 1e6).alias("t"))
    span = lambda c, a, b: F.slice(c, F.col(a) + 1, F.col(b) - F.col(a) + 1)
    with_a = found.join(listed.select(F.col("series").alias("a"), F.col("t").alias("ta")), "a")
    both = with_a.join(listed.select(F.col("series").alias("b"), F.col("t").alias("tb")), "b")
    cut = both.withColumn("ta", span(F.col("ta"), "a_start_idx", "a_end_idx")).withColumn("tb", span(F.col("tb"), "b_start_idx", "b_end_idx"))

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                x, y = np.asarray(row.ta, float), np.asarray(row.tb, float)
                n = min(len(x), len(y))
                x, y = x[:n], y[:n]
                moved, fitted, ok = np.zeros(n), False, n >= 3 and (np.diff(x) > 0).all() and (np.diff(y) > 0).all()
                rates = fit.warp_rates(x, y) if ok else (np.nan, np.nan, np.nan)
                fine = lambda r: r[0] >= MIN_SPEED - 1e-6 and r[1] <= MAX_SPEED + 1e-6 and r[2] <= MAX_RATE + 1e-6
                if ok and not fine(rates):
                    moved, done, _ = fit.bounded_clock(y, x, fit.displacement_bounds(y))
                    fitted, rates = True, fit.warp_rates(x, y + moved)
                    ok = done and fine(rates) and np.quantile(np.abs(moved), 0.95) <= P95_S and np.abs(moved).max() <= MOST_S
                out.append((row.pair, row.position, row.found, row.a, row.b, row.n_bars, row.a_bar, row.b_bar, bool(ok), fitted, *rates, float(np.quantile(np.abs(moved), 0.95)) if n else 0.0, float(np.abs(moved).max()) if n else 0.0))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FITTED.split(", ")])

    return cut.select("pair", "position", "found", "a", "b", "n_bars", "a_bar", "b_bar", "ta", "tb").mapInPandas(run, FITTED)


def plan(pairs: DataFrame, bars: DataFrame, clocks: DataFrame, lengths: tuple[int, ...] = BAR_COUNTS, budget: int = MAX_FITS) -> DataFrame:
    """One row per pair: the first accepted candidate, or the code that declines the pair."""
    tried = fit_candidates(candidates(pairs, starts(bars, lengths), budget), clocks)
    first = Window.partitionBy("pair").orderBy("position")
    accepted = tried.where("accepted").withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "found", "a", "b", "accepted")
    seen = tried.groupBy("pair").agg(F.max("found").alias("found"), F.count(F.lit(1)).alias("tried"))
    known = bars.where("usable").select("series").distinct()
    sides = pairs.join(known.select(F.col("series").alias("a"), F.lit(True).alias("_a")), "a", "left").join(known.select(F.col("series").alias("b"), F.lit(True).alias("_b")), "b", "left")
    all_of = sides.join(seen, "pair", "left").join(accepted, "pair", "left")
    code = (
        F.when(F.col("position").isNotNull(), F.lit(None).cast("string"))
        .when(F.col("_a").isNull() | F.col("_b").isNull(), F.lit("NO_CONFIDENT_BAR_GRID"))
        .when(F.col("found").isNull(), F.lit("NO_COMPATIBLE_BAR_RANGE"))
        .when(F.col("found") > F.col("tried"), F.lit("SEARCH_LIMIT_REACHED"))
        .otherwise(F.lit("CLOCK_REJECTED"))
    )
    return all_of.select("pair", "a", "b", "n_bars", "a_bar", "b_bar", "position", "fitted", "min_speed", "max_speed", "max_rate", "p95_s", "max_s", F.coalesce("tried", F.lit(0)).alias("tried"), code.alias("declined"))


# How far from an octave two beat periods may be to be mapped 2:1 or 1:2, and the longest fade.
OCTAVE, MOST_PULSES = 1.15, 512


def _fit(x: np.ndarray, y: np.ndarray, end: tuple[float, float] | None, pins: tuple[int, ...]) -> tuple[bool, bool, tuple[float, float, float], float, float]:
    """(accepted, fitted, rates, 95th percentile and largest output residual) of source beats y at output times x.

    ``end`` is the fade's end as (output, source) where no beat falls on it. Beats in ``pins`` stay.
    """
    nan = (np.nan, np.nan, np.nan)
    whole = lambda z: (np.append(x, end[0]), np.append(z, end[1])) if end else (x, z)
    if len(x) < 2 or any((np.diff(c) <= 0).any() for c in whole(y)):
        return False, False, nan, 0.0, 0.0
    fine = lambda r: r[0] >= MIN_SPEED - 1e-6 and r[1] <= MAX_SPEED + 1e-6 and r[2] <= MAX_RATE + 1e-6
    rates = fit.warp_rates(*whole(y))
    if fine(rates):
        return True, False, rates, 0.0, 0.0
    if len(x) < 3:
        return False, False, rates, 0.0, 0.0
    moved, done, _ = fit.bounded_clock(y, x, fit.displacement_bounds(y, pins=pins))
    rates, off = fit.warp_rates(*whole(y + moved)), np.abs(np.interp(y, y + moved, x) - x)
    p95, most = float(np.quantile(off, 0.95)), float(off.max())
    return bool(done and fine(rates) and p95 <= P95_S + 1e-9 and most <= MOST_S + 1e-9), True, rates, p95, most


def _pulses(ta: np.ndarray, a: np.ndarray, a_ok: np.ndarray, tb: np.ndarray, b: np.ndarray, b_ok: np.ndarray, out: int, into: int, n: int) -> dict:
    """The plan of one selection over the clocks ta and tb, whose bars lie between the beats a and b."""
    none = {"a_pulses": None, "b_pulses": None, "end_position": None, "fitted": None, "rates": (None, None, None), "p95_s": None, "max_s": None, "tried": 0}
    if not (0 <= out and n > 0 and out + n < len(a) and 0 <= into and into + 1 < len(b)) or a[-1] >= len(ta) or b[-1] >= len(tb):
        return none | {"declined": "NO_BAR_RANGE"}
    first, last, begin = int(a[out]), int(a[out + n]), int(b[into])
    count = last - first
    if count > MOST_PULSES:
        return none | {"declined": "FADE_TOO_LONG"}
    if not a_ok[out : out + n].all():
        return none | {"declined": "UNUSABLE_BARS"}
    ta = ta[first : last + 1]
    cycles = [(1, 1)]
    if not np.array_equal(np.diff(a[out : out + n + 1]), np.diff(b[into : into + n + 1])):
        ratio = np.median(np.diff(tb[begin : b[into + 1] + 1])) / np.median(np.diff(ta))
        for cycle, octave in (((2, 1), ratio / 2), ((1, 2), ratio * 2)):
            if octave > 0 and abs(np.log(octave)) <= np.log(OCTAVE):
                cycles.insert(0, cycle)
    said = ""
    for tried, (p, q) in enumerate(cycles, 1):
        position = begin + count * q / p
        end = int(np.ceil(position))
        touched = int(np.searchsorted(b, end))
        if end > b[-1] or not b_ok[into:touched].all():
            said = "NO_BAR_RANGE" if end > b[-1] else "UNUSABLE_BARS"
            continue
        beat = np.arange(begin, int(position) + 1)
        x = np.interp((beat - begin) * p / q, np.arange(count + 1), ta)
        tail = (float(ta[-1]), float((tb[end - 1] + tb[end]) / 2)) if position < end else None
        pins = tuple(int(k) - begin for k in b if begin <= k <= beat[-1])
        ok, fitted, rates, p95, most = _fit(x, tb[beat], tail, pins)
        if ok:
            return {"a_pulses": p, "b_pulses": q, "end_position": position, "fitted": fitted, "rates": rates, "p95_s": p95, "max_s": most, "tried": tried, "declined": None}
        said = "CLOCK_REJECTED"
    return none | {"tried": len(cycles), "declined": said}


PULSES = "pair long, a long, b long, a_bar long, b_bar long, n_bars int, a_pulses int, b_pulses int, end_position double, fitted boolean, min_speed double, max_speed double, max_rate double, p95_s double, max_s double, tried int, declined string"


def plan_pulses(selections: DataFrame, bars: DataFrame, clocks: DataFrame) -> DataFrame:
    """A plan per selection (pair, a, b, a_bar, b_bar, n_bars) whose sides may differ in pulses, or the code that declines it.

    Bars of equal meter pair beat by beat. Else a_pulses of a meet b_pulses of b: 2:1 or 1:2 first where the median
    periods are within 15 % of an octave, then 1:1; each is fitted with b's downbeats held, and the first accepted one
    stays. end_position is the beat of b at the fade's end, half a beat where it falls between two. bars are numbered
    from 0 without a gap.
    """
    ship(selections.sparkSession)
    listed = boundaries(bars).groupBy("series").agg(F.array_sort(F.collect_list(F.struct("bar", "start_idx", "end_idx", "usable"))).alias("_g"))
    edges = listed.select("series", F.concat(F.transform("_g", lambda x: x["start_idx"]), F.array(F.element_at("_g", -1)["end_idx"])).alias("edges"), F.transform("_g", lambda x: x["usable"]).alias("ok"))
    timed = clocks.groupBy("series").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "us"))), lambda x: x["us"] / 1e6).alias("t"))
    songs = edges.join(timed, "series")
    side = lambda s: songs.select(F.col("series").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("edges", "ok", "t")])
    columns = ["pair", "a", "b", "a_bar", "b_bar", "n_bars"]
    both = selections.select(*columns).join(side("a"), "a", "left").join(side("b"), "b", "left")

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                if row.a_t is None or row.b_t is None:
                    got = _pulses(np.zeros(0), np.zeros(1, int), np.zeros(0, bool), np.zeros(0), np.zeros(1, int), np.zeros(0, bool), 0, 0, 1)
                else:
                    one = [np.asarray(x, kind) for s in "ab" for x, kind in ((getattr(row, f"{s}_t"), float), (getattr(row, f"{s}_edges"), int), (getattr(row, f"{s}_ok"), bool))]
                    got = _pulses(*one, int(row.a_bar), int(row.b_bar), int(row.n_bars))
                out.append((*[getattr(row, c) for c in columns], got["a_pulses"], got["b_pulses"], got["end_position"], got["fitted"], *got["rates"], got["p95_s"], got["max_s"], got["tried"], got["declined"]))
            found = pd.DataFrame(out, columns=[c.split()[0] for c in PULSES.split(", ")], dtype=object)
            yield found.astype({"a_pulses": "Int32", "b_pulses": "Int32"})

    return both.mapInPandas(run, PULSES)
