"""Measured support for events, proposals and candidates: peaks near a time, nearest matches, gates and reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clock import against_reference, local_period
from .sequence import nearest, range_join


def snap(x: Column, units: float = 4.0) -> Column:
    """A frame count: the whole number next to x if it is within that many rounding units of x, else x rounded down."""
    slack = units * 2.220446049250313e-16 * F.greatest(F.lit(1.0), F.abs(x))
    return F.when(F.abs(x - F.rint(x)) <= slack, F.rint(x)).otherwise(F.floor(x)).cast("long")


def sigmoid(logit: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-logit))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def emissions(logit: Column) -> tuple[Column, Column]:
    """Log probability of the logit where a bar begins, and where none does."""
    return -softplus(-logit), -softplus(logit)


def log_add(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def peak_near(expected: DataFrame, activations: DataFrame, tolerance: int, least: float) -> DataFrame:
    """Per expected place (series, id, at) the local maximum within ``tolerance`` frames of the largest Gaussian-weighted value.

    activations: series, k, x. A peak is no lower than its neighbours. Null where there is none, or it is under ``least``.
    """
    w = Window.partitionBy("series").orderBy("k")
    peaks = activations.withColumn("_b", F.lag("x").over(w)).withColumn("_a", F.lead("x").over(w)).where((F.coalesce("_b", "x") <= F.col("x")) & (F.coalesce("_a", "x") <= F.col("x"))).select("series", "k", "x")
    spans = expected.select("series", "id", "at", (F.col("at") - tolerance).alias("_from"), (F.col("at") + tolerance).alias("_to"))
    met = range_join(peaks, spans, "k", "_from", "_to", ["series"], max(1, 4 * tolerance))
    weight = F.col("x") * F.exp(-0.5 * ((F.col("k") - F.col("at")) / (tolerance * 0.6)) ** 2)
    best = Window.partitionBy("series", "id").orderBy(F.desc("_w"), "k")
    found = met.withColumn("_w", weight).withColumn("_r", F.row_number().over(best)).where("_r = 1").select("series", "id", "k", "x")
    strong = F.col("x") >= least
    return expected.join(found, ["series", "id"], "left").select("series", "id", "at", F.when(strong, F.col("k")).alias("frame"), F.when(strong, F.col("x")).alias("strength"))


def match_events(raw: DataFrame, clock: DataFrame, within_us: int) -> DataFrame:
    """Raw events on the nearest beat in reach (the earlier on a tie); of several on a beat the closest, then earliest, stays."""
    found = nearest(raw.select("series", "us", "strength"), clock.select("series", F.col("us").alias("beat_us"), "idx"), "us", "beat_us", ["series"], ["idx"], within_us).where("near is not null")
    order = Window.partitionBy("series", "idx").orderBy(F.abs(F.col("near") - F.col("us")), "us")
    return found.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("series", "idx", F.col("near").alias("beat_us"), "us", "strength")


def before_end(events: DataFrame, duration_us: int) -> DataFrame:
    return events.where(F.col("us") < duration_us)


def onset_agreement(clock: DataFrame, envelope: DataFrame, hop_us: int, reach_us: int, least: float) -> DataFrame:
    """Share of the beats inside the envelope with a value of at least ``least`` in reach, and the share inside.

    With less than 55 % of the beats inside, nothing is said of the rest: the agreement is 0. An envelope without a column
    series is that of every clock, and isn't repeated for each.
    """
    keys = ["series"] if "series" in envelope.columns else []
    if keys:
        joined = clock.join(envelope.groupBy("series").agg(F.max("k").alias("_last")), "series", "left")
    else:
        joined = clock.withColumn("_last", envelope.agg(F.max("k").alias("_last")).scalar())
    covered = joined.withColumn("covered", F.coalesce((F.col("us") >= 0) & (F.col("us") <= F.col("_last") * hop_us), F.lit(False)))
    high = envelope.where(F.col("x") >= least).select(*keys, (F.col("k") * hop_us - reach_us).alias("_from"), (F.col("k") * hop_us + reach_us).alias("_to"))
    met = range_join(covered.where("covered").select("series", "idx", "us"), high, "us", "_from", "_to", keys, max(1, 4 * reach_us), "left_semi").groupBy("series").agg(F.count(F.lit(1)).alias("hits"))
    sums = covered.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.count_if("covered").alias("inside"))
    return sums.join(met, "series", "left").select("series", (F.col("inside") / F.col("n")).alias("coverage"), F.when(F.col("inside") / F.col("n") >= 0.55, F.coalesce("hits", F.lit(0)) / F.col("inside")).otherwise(0.0).alias("agreement"))


def cadence_agreement(clock: DataFrame, tolerance: float = 0.22) -> DataFrame:
    """Share of intervals near their own local period."""
    near = F.abs(F.col("interval_us") / F.col("period_us") - 1) < tolerance
    return local_period(clock).groupBy("series").agg(F.avg(F.when(near, 1.0).otherwise(0.0)).alias("agreement"))


def interpolable(clock: DataFrame, reference: DataFrame, supported: Column, reach: float = 3.1) -> DataFrame:
    """Unsupported beats with a supported one at most ``reach`` local periods away on both sides."""
    w = Window.partitionBy("series").orderBy("idx")
    known = against_reference(clock, reference).select("series", "idx", "ref_us")
    flagged = clock.withColumn("_at", F.when(supported, F.col("us")))
    around = flagged.withColumn("before_us", F.last("_at", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("after_us", F.first("_at", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    weak = around.where("_at is null").join(known, ["series", "idx"], "left")
    close = (F.col("us") - F.col("before_us") <= reach * F.col("ref_us")) & (F.col("after_us") - F.col("us") <= reach * F.col("ref_us"))
    return weak.select("series", "idx", F.coalesce(close, F.lit(False)).alias("interpolable"))


def repair_gate(counts: DataFrame, most: float = 0.25) -> DataFrame:
    """Whether a series' repairs (series, repairs, removed, n) are few enough, with a warning where there are any.

    Removed duplicates, which are among the repairs, don't count against the share: they add no beat.
    """
    share = (F.col("repairs") - F.col("removed")) / F.greatest(F.lit(1), F.col("n"))
    return counts.withColumn("accepted", share <= most).withColumn("warning", F.when(share > most, "EXCESS_REPAIRS").when(F.col("repairs") > 0, "REPAIRED"))


def preferred(candidates: DataFrame, asked: DataFrame, tolerance: float = 0.055, least: float = 0.03) -> DataFrame:
    """The best supported candidate near the asked tempo, else the asked tempo with its own support.

    asked: series, wanted, and optionally support, that of the wanted tempo itself (0 without). A pulse with less than
    ``least`` support is none: bpm and support are 0.
    """
    own = F.col("support") if "support" in asked.columns else F.lit(0.0)
    asked = asked.select("series", "wanted", own.alias("_own"))
    near = candidates.join(asked, "series").where(F.abs(F.ln(F.col("bpm") / F.col("wanted"))) < tolerance)
    best = near.groupBy("series").agg(F.max(F.struct("support", "bpm")).alias("_b"))
    found = asked.join(best, "series", "left").select("series", F.coalesce("_b.bpm", F.col("wanted").cast("double")).alias("bpm"), F.coalesce("_b.support", "_own").alias("support"))
    weak = F.col("support") < least
    return found.select("series", F.when(weak, 0.0).otherwise(F.col("bpm")).alias("bpm"), F.when(weak, 0.0).otherwise(F.col("support")).alias("support"))


def detection_summary(candidates: DataFrame, strengths: DataFrame, share: float = 0.82, apart: float = 0.07, full: float = 0.35) -> DataFrame:
    """First-ranked tempo with its confidence as a tempo and as beats, and whether another one rivals it.

    candidates: series, rank, bpm, support, ranked. strengths: series, strength, the evidence at each tracked beat. A
    rival is more than ``apart`` away in log tempo and ranked at ``share`` of the first at least. Beats are as sure as
    the tempo, less where the upper median of their strengths is under ``full``. Scores, not probabilities.
    """
    first = candidates.where("rank = 1").select("series", F.col("bpm").alias("_bpm"), F.col("ranked").alias("_top"), F.col("support").alias("_s"))
    rival = (F.col("ranked") >= share * F.col("_top")) & (F.abs(F.ln(F.col("bpm") / F.col("_bpm"))) > apart)
    found = candidates.join(first, "series").groupBy("series", "_bpm", "_s").agg(F.bool_or(rival).alias("ambiguous"))
    order = Window.partitionBy("series").orderBy("strength")
    middle = strengths.withColumn("_k", F.row_number().over(order) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("series"))).where(F.col("_k") == F.floor(F.col("_n") / 2))
    held = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    sure = held(F.col("_s"))
    beats = held(sure * F.least(F.lit(1.0), F.coalesce("strength", F.lit(0.0)) / full))
    return found.join(middle.select("series", "strength"), "series", "left").select("series", F.col("_bpm").alias("bpm"), sure.alias("tempo_confidence"), beats.alias("beat_confidence"), "ambiguous")


def warnings(summary: DataFrame) -> DataFrame:
    """What a user is to be told of a detection, as codes in a fixed order.

    summary: series, constrained (a tempo was asked for), tempo_confidence, ambiguous, beat_confidence, n_beats, observed (the
    clock comes from an external detector), n_downbeats.
    """
    codes = F.array_compact(
        F.array(
            F.when(F.col("constrained"), F.lit("PULSE_CONSTRAINED")),
            F.when(F.col("tempo_confidence") < 0.2, F.lit("UNRELIABLE_GRID")),
            F.when(F.col("ambiguous"), F.lit("AMBIGUOUS_TEMPO")),
            F.when(F.col("beat_confidence") < 0.35, F.lit("WEAK_BEATS")),
            F.when(F.col("n_beats") < 12, F.lit("FEW_BEATS")),
            F.when(F.col("observed"), F.lit("UNCALIBRATED_DETECTOR")),
            F.when(F.col("n_downbeats") > 0, F.lit("DETECTED_DOWNBEATS")).otherwise("NO_DOWNBEATS"),
        )
    )
    return summary.withColumn("warnings", F.array_join(codes, ",")).withColumn("n_warnings", F.size(codes))


def regions(clock: DataFrame, bad: DataFrame, guard: int = 8, least: int = 8) -> DataFrame:
    """Runs of at least ``least`` beats that stay ``guard`` beats clear of every bad beat (series, idx)."""
    spans = bad.select("series", (F.col("idx") - guard).alias("_from"), (F.col("idx") + guard).alias("_to")).distinct()
    blocked = range_join(clock.select("series", "idx"), spans, "idx", "_from", "_to", ["series"], 4 * guard, "left_semi")
    free = clock.select("series", "idx").join(blocked, ["series", "idx"], "left_anti")
    w = Window.partitionBy("series").orderBy("idx")
    runs = free.withColumn("_g", F.col("idx") - F.row_number().over(w)).groupBy("series", "_g").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count(F.lit(1)).alias("n"))
    return runs.where(F.col("n") >= least).drop("_g")


def annotated_bars(downbeats: DataFrame, clock: DataFrame, within_us: int) -> DataFrame:
    """Bars between annotated downbeats on their nearest beats: series, bar, start_idx, end_idx; ``ok`` is false beyond reach."""
    found = nearest(downbeats.select("series", "us"), clock.select("series", F.col("us").alias("beat_us"), "idx"), "us", "beat_us", ["series"], ["idx"])
    w = Window.partitionBy("series").orderBy("us")
    placed = found.withColumn("ok", F.abs(F.col("near") - F.col("us")) <= within_us).withColumn("bar", F.row_number().over(w) - 1).withColumn("end_idx", F.lead("idx").over(w))
    return placed.where("end_idx is not null").select("series", F.col("bar").cast("long").alias("bar"), F.col("idx").alias("start_idx"), "end_idx", F.coalesce(F.col("ok") & (F.col("end_idx") > F.col("idx")), F.lit(False)).alias("ok"))


def first_failure(rows: DataFrame) -> DataFrame:
    """The first bar of every series that isn't usable, with the first of its codes."""
    order = Window.partitionBy("series").orderBy("bar")
    return rows.where("not usable").withColumn("_r", F.row_number().over(order)).where("_r = 1").select("series", "bar", F.element_at(F.split("codes", ","), 1).alias("reason"))


def paired_coverage(plans: DataFrame) -> DataFrame:
    """Whole output beats that both clocks of a plan cover, with p output to q source beats a cycle.

    plans: plan_id, first_beat, second_beat, first_last, second_last, p, q.
    """
    back = F.least(F.col("first_beat"), F.floor(F.col("second_beat") * F.col("p") / F.col("q")))
    on = F.least(F.col("first_last") - F.col("first_beat"), F.floor((F.col("second_last") - F.col("second_beat")) * F.col("p") / F.col("q")))
    return plans.select("plan_id", (F.col("first_beat") - back).alias("start_beat"), (F.col("first_beat") + on).alias("end_beat"))


def tempo_release(t: Column, start: Column, speed: Column, seconds: float = 2.0) -> Column:
    """Source seconds since ``start`` while the speed goes back to 1 within ``seconds``, and 1 from there on.

    The speed's distance from 1 falls as the square of the time left, so speed and position have no jump at either end.
    """
    dt, extra = t - start, speed - 1.0
    eased = extra * (dt - dt * dt / seconds + dt * dt * dt / (3.0 * seconds * seconds))
    return F.when(dt <= 0, dt * speed).when(dt >= seconds, dt + extra * seconds / 3.0).otherwise(dt + eased)


def schedule_audit(anchors: DataFrame, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Least and largest speed of a quantised schedule (plan_id, i, source_frame, output_frame), and whether it moves on."""
    w = Window.partitionBy("plan_id").orderBy("i")
    ds, do = F.col("source_frame") - F.lag("source_frame").over(w), F.col("output_frame") - F.lag("output_frame").over(w)
    steps = anchors.withColumn("_s", ds).withColumn("_o", do).where("_s is not null")
    speed = F.col("_s") / F.nullif("_o", F.lit(0))
    return steps.groupBy("plan_id").agg(F.min(speed).alias("min_speed"), F.max(speed).alias("max_speed"), F.bool_and((F.col("_s") > 0) & (F.col("_o") > 0)).alias("monotone")).withColumn("accepted", F.col("monotone") & (F.col("min_speed") >= low - 1e-6) & (F.col("max_speed") <= high + 1e-6))


def fit_report(moves: DataFrame) -> DataFrame:
    """How far beats moved: count, mean, 95th percentile and largest."""
    size = F.abs("moved_s")
    return moves.groupBy("series").agg(F.count_if(size > 0).alias("moved"), F.avg(size).alias("mean_s"), F.percentile(size, 0.95).alias("p95_s"), F.max(size).alias("max_s"))


def supported_runs(usable: DataFrame) -> DataFrame:
    """For each usable bar the end (one past the last bar) of the run it begins in."""
    w = Window.partitionBy("series").orderBy("bar")
    kept = usable.where("usable").withColumn("_g", F.col("bar") - F.row_number().over(w))
    return kept.withColumn("end_bar", F.max("bar").over(Window.partitionBy("series", "_g")) + 1).select("series", "bar", "end_bar")


def beat_overlap(first: DataFrame, second: DataFrame, offset: Column, pairs: DataFrame) -> DataFrame:
    """Span in which two clocks with an index offset both have beats. pairs: pair, a, b, and what ``offset`` needs."""
    ends = lambda c, name: c.groupBy(F.col("series").alias(name)).agg(F.max("idx").alias(f"_{name}"))
    both = pairs.withColumn("offset", offset).join(ends(first, "a"), "a").join(ends(second, "b"), "b")
    start, end = F.greatest(F.lit(0).cast("long"), -F.col("offset")), F.least("_a", F.col("_b") - F.col("offset"))
    return both.select("pair", "a", "b", "offset", start.alias("first_idx"), end.alias("last_idx"), F.when(end - start < 1, "NO_COMMON_SPAN").alias("declined"))


def octave_ratio(a: Column, b: Column, tolerance: float = 0.15) -> Column:
    """The pulse ratio 1:1, 2:1 or 1:2 under which two tempi are within the tolerance; null if none is."""
    near = lambda q: F.abs(b * q / a - 1) <= tolerance
    return F.when(near(1.0), "1:1").when(near(2.0), "2:1").when(near(0.5), "1:2")


# How much a number of bars is liked.
LENGTHS = {8: 0.65, 4: 0.42, 16: 0.15, 2: -0.40}


def length_preference(bars: Column) -> Column:
    out = F.lit(-0.25)
    for n, value in LENGTHS.items():
        out = F.when(bars == n, value).otherwise(out)
    return out


def finite(x: Column) -> Column:
    """Whether a number is there and finite."""
    return F.coalesce(F.abs(x) < float("inf"), F.lit(False))


def harmonic_keys(a: Column, b: Column) -> Column:
    """Whether two keys ("F# minor") are the same, a fifth apart in one mode, or relative; false for any that isn't a key."""

    def part(key: Column, group: int) -> Column:
        return F.regexp_extract(key, r"^\s*([A-Ga-g])([#♯b♭]?)\s+((?i:major|minor))\s*$", group)

    def pitch(key: Column) -> Column:
        sharp = F.when(part(key, 2).isin("#", "♯"), 1).when(part(key, 2).isin("b", "♭"), -1).otherwise(0)
        return F.instr(F.lit("C-D-EF-G-A-B"), F.upper(part(key, 1))) - 1 + sharp

    minor_a, minor_b = F.lower(part(a, 3)) == "minor", F.lower(part(b, 3)) == "minor"
    apart = F.pmod(pitch(a) - pitch(b), F.lit(12))
    related = F.when(minor_a == minor_b, apart.isin(0, 5, 7)).otherwise(F.when(minor_a, apart == 9).otherwise(apart == 3))
    return F.coalesce((part(a, 1) != "") & (part(b, 1) != "") & related, F.lit(False))


def song_affinity(a: Column, b: Column, available: Column | None = None) -> Column:
    """How well two songs (structs of key, key_confidence, bpm, centroid_hz, rms_db) bear a long blend, from 0 to 1.

    0 unless the keys are related and confident, and tempo, timbre and loudness each agree; ``available`` says whether
    both songs have level evidence at all.
    """
    sure = F.least(a["key_confidence"], b["key_confidence"])
    known = F.lit(True) if available is None else available
    for side in (a, b):
        known = known & finite(side["key_confidence"]) & finite(side["rms_db"])
        for c in ("bpm", "centroid_hz"):
            known = known & finite(side[c]) & (side[c] > 0)
    ratio = lambda c, most: F.greatest(F.lit(0.0), 1 - F.abs(F.ln(a[c] / b[c])) / math.log(most))
    tempo, timbre = ratio("bpm", 1.04), ratio("centroid_hz", 1.25)
    loudness = F.greatest(F.lit(0.0), 1 - F.abs(a["rms_db"] - b["rms_db"]) / 6.0)
    agreed = known & harmonic_keys(a["key"], b["key"]) & (sure >= 0.12) & (tempo >= 0.8) & (timbre >= 0.5) & (loudness >= 0.5)
    return F.when(agreed, 0.30 * F.least(F.lit(1.0), sure / 0.16) + 0.25 * tempo + 0.25 * timbre + 0.20 * loudness).otherwise(0.0)


def cue_evidence(parts: DataFrame, levels: DataFrame, points: int = 8) -> DataFrame:
    """Evidence of a pair of ranges: parts with balance, long_bonus, length, penalty and score.

    parts: pair, n_bars, out_score, in_score, in_end_change, in_build, affinity. levels: pair, out_db, in_db at
    ``points`` places of the overlap; with a level missing the mismatch counts as 6 dB and the balance as 0. The bonus
    of a long blend goes only to incoming ranges that hold their level.
    """
    both = finite(F.col("out_db")) & finite(F.col("in_db"))
    measured = levels.groupBy("pair").agg(F.when((F.count(F.lit(1)) == points) & F.bool_and(both), F.avg(F.abs(F.col("out_db") - F.col("in_db")))).alias("mismatch_db"))
    found = parts.join(measured, "pair", "left").withColumn("mismatch_db", F.coalesce("mismatch_db", F.lit(6.0)))
    found = found.withColumn("balance", F.greatest(F.lit(0.0), 1 - F.col("mismatch_db") / 6.0))
    gain = F.when(F.col("n_bars") == 8, 1.0).when(F.col("n_bars") == 16, 5.5).when(F.col("n_bars") == 32, 3.0).otherwise(0.0)
    holds = (F.col("in_end_change") >= -0.02) & (F.col("in_build") >= -0.20)
    found = found.withColumn("long_bonus", F.when(holds, gain * F.col("affinity") * F.col("balance")).otherwise(0.0))
    found = found.withColumn("length", length_preference(F.col("n_bars")) + F.col("long_bonus")).withColumn("penalty", 0.5 * F.greatest(F.lit(0.0), F.col("mismatch_db") - 2.0))
    return found.withColumn("score", F.col("out_score") + F.col("in_score") + F.col("length") - F.col("penalty"))


def validate_chunks(chunks: DataFrame, size: int) -> DataFrame:
    """Chunks (series, start_frame, samples) of the wrong size or with samples that aren't finite."""
    last = F.max("start_frame").over(Window.partitionBy("series"))
    wrong = (F.size("samples") > size) | ((F.size("samples") < size) & (F.col("start_frame") < last))
    odd = F.exists("samples", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return chunks.withColumn("fault", F.when(wrong, "WRONG_SIZE").when(odd, "NOT_FINITE")).select("series", "start_frame", "fault")




def with_halo(chunks: DataFrame, before: int, after: int, size: int | None = None) -> DataFrame:
    """Chunks (series, start_frame, samples) with the last ``before`` samples ahead of them and the first ``after`` behind.

    ``lead_in`` says how many samples come from before. ``size`` is the chunks' size where a halo is longer than one, so
    that it is put together from several.
    """
    w = Window.partitionBy("series").orderBy("start_frame")
    reach = lambda n: -(-n // size) if size else 1
    near = lambda a, b: F.flatten(F.collect_list("samples").over(w.rowsBetween(a, b)))
    held = chunks.withColumn("samples", F.transform("samples", lambda x: x.cast("double")))
    both = held.withColumn("_b", near(-reach(before), -1)).withColumn("_a", near(1, reach(after)))
    tail = F.slice("_b", F.greatest(F.lit(1), F.size("_b") - before + 1), F.lit(max(before, 0)))
    return both.select("series", "start_frame", F.concat(tail, "samples", F.slice("_a", F.lit(1), F.lit(after))).alias("samples"), F.least(F.size("_b"), F.lit(before)).alias("lead_in"))


def local_support(phases: DataFrame, ranges: DataFrame, distance) -> DataFrame:
    """Events (series, idx, us, phase, tolerance) near the phase of a range (series, from_us, to_us, center) that holds them."""
    met = range_join(phases, ranges, "us", "from_us", "to_us", ["series"], 24 * 3_600_000_000)
    return met.where(distance(F.col("phase"), F.col("center")) <= F.col("tolerance")).select("series", "idx").distinct()


def bars_with_support(bars: DataFrame, assessed: DataFrame) -> DataFrame:
    """Usable bars (series, bar, start_idx, end_idx, usable) that recurrence evidence of their own range supports too."""
    known = assessed.select("series", F.col("start").alias("start_idx"), (F.col("end") - 1).alias("end_idx"), "supported")
    return bars.join(known, ["series", "start_idx", "end_idx"], "left").withColumn("usable", F.col("usable") & F.coalesce("supported", F.lit(False))).drop("supported")


def observations(clock: DataFrame, activations: DataFrame, hop_us: int, most_us: int) -> DataFrame:
    """Largest activation (series, k, x) near each beat, at most a quarter of the way to its neighbours, and whether all
    of that window lies inside the series' activations. Activations without a column series are those of every clock, and aren't repeated for each."""
    keys = ["series"] if "series" in activations.columns else []
    w = Window.partitionBy("series").orderBy("idx")
    gap = F.least(F.coalesce(F.col("us") - F.lag("us").over(w), F.lit(1 << 62)), F.coalesce(F.lead("us").over(w) - F.col("us"), F.lit(1 << 62)))
    reach = clock.withColumn("_r", F.least(F.lit(most_us), F.floor(gap / 4))).select("series", "idx", (F.col("us") - F.col("_r")).alias("_from"), (F.col("us") + F.col("_r")).alias("_to"))
    at = activations.select(*keys, (F.col("k") * hop_us).alias("_us"), "x")
    met = range_join(at, reach, "_us", "_from", "_to", keys, max(1, 4 * most_us))
    found = met.groupBy("series", "idx").agg(F.max("x").alias("x"))
    first, last = (F.min("k") * hop_us).alias("_first"), (F.max("k") * hop_us).alias("_last")
    whole = F.coalesce((F.col("_from") >= F.col("_first")) & (F.col("_to") <= F.col("_last")), F.lit(False))
    rows = reach.join(found, ["series", "idx"], "left")
    rows = rows.join(activations.groupBy("series").agg(first, last), "series", "left") if keys else rows.withColumn("_first", activations.agg(first).scalar()).withColumn("_last", activations.agg(last).scalar())
    return rows.select("series", "idx", F.coalesce("x", F.lit(-1000.0)).alias("logit"), whole.alias("complete"))


def phase_cost(a: Column, b: Column) -> Column:
    """How far two neighbouring distances are from whole periods, one at least."""
    off = lambda x: F.abs(x - F.greatest(F.lit(1.0), F.rint(x)))
    return off(a) + off(b)


def relocations(clock: DataFrame, reference: DataFrame, candidates: DataFrame, strong: float = 0.65, lead: float = 0.08) -> DataFrame:
    """Weak beats with a candidate that makes their neighbours' distances far more whole: series, idx, us, moved_us.

    candidates: series, idx, at_us, the attack found for a beat. A beat is weak under ``strong`` and clearly under its
    neighbours' mean; the new place must cost at most 0.24 periods, under half of the old one and 0.15 less, and lie
    0.02 to 0.4 periods away between the neighbours.
    """
    w = Window.partitionBy("series").orderBy("idx")
    around = clock.withColumn("_l", F.lag("us").over(w)).withColumn("_r", F.lead("us").over(w)).withColumn("_m", (F.lag("strength").over(w) + F.lead("strength").over(w)) / 2)
    weak = around.where((F.col("strength") < strong) & (F.col("strength") + lead < F.col("_m")))
    periods = against_reference(clock, reference).select("series", "idx", F.col("ref_us").alias("_p")).where("_p is not null")
    met = weak.join(periods, ["series", "idx"]).join(candidates, ["series", "idx"])
    total = (F.col("_r") - F.col("_l")) / F.col("_p")
    cost = lambda t: phase_cost((t - F.col("_l")) / F.col("_p"), (F.col("_r") - t) / F.col("_p"))
    old, new, move = cost(F.col("us")), cost(F.col("at_us")), F.abs(F.col("at_us") - F.col("us")) / F.col("_p")
    good = F.rint(total).between(2, 5) & (F.abs(total - F.rint(total)) <= 0.24) & move.between(0.02, 0.4) & (F.col("at_us") > F.col("_l")) & (F.col("at_us") < F.col("_r")) & (new <= 0.24) & (new < old * 0.5) & (old - new >= 0.15)
    return met.where(good).select("series", "idx", "us", F.col("at_us").alias("moved_us"))


def midpoint_relocations(clock: DataFrame, reference: DataFrame, candidates: DataFrame, strong: float = 0.65, lead: float = 0.08, support: float = 0.30) -> DataFrame:
    """Weak beats of a lopsided pair of intervals, moved to an attack near their middle: series, idx, us, moved_us, strength.

    candidates: series, idx, at_us, strength, support, the attack found near the middle of a beat's neighbours. The neighbours are
    two reference periods apart; the attack lies within 0.15 periods of the middle, nearer to it than half of the beat's own
    distance, and within 0.4 periods of the beat, and has ``support``. Neighbours are taken as they were before.
    """
    w = Window.partitionBy("series").orderBy("idx")
    around = clock.withColumn("_l", F.lag("us").over(w)).withColumn("_r", F.lead("us").over(w)).withColumn("_m", (F.lag("strength").over(w) + F.lead("strength").over(w)) / 2)
    before, after = F.col("us") - F.col("_l"), F.col("_r") - F.col("us")
    weak = around.where((before > 0) & (after > 0)).where((F.greatest(before / after, after / before) > 1.48) & (F.col("strength") < strong) & (F.col("strength") + lead < F.col("_m"))).drop("strength")
    periods = against_reference(clock, reference).select("series", "idx", F.col("ref_us").alias("_p")).where("_p is not null")
    met = weak.join(periods, ["series", "idx"]).join(candidates.select("series", "idx", "at_us", F.col("strength").alias("_s"), "support"), ["series", "idx"])
    middle = (F.col("_l") + F.col("_r")) / 2
    off = F.abs(F.col("at_us") - middle)
    whole = F.abs((F.col("_r") - F.col("_l")) / F.col("_p") - 2) <= 0.24
    near = (off <= 0.15 * F.col("_p")) & (F.abs(F.col("at_us") - F.col("us")) <= 0.4 * F.col("_p")) & (off < 0.5 * F.abs(F.col("us") - middle))
    return met.where(whole & near & (F.col("support") >= support)).select("series", "idx", "us", F.col("at_us").alias("moved_us"), F.least(F.lit(0.5), "_s").alias("strength"))


def part_scores(parts: DataFrame) -> DataFrame:
    """Scores of a part as an exit and as an entry. parts: part, from_s, to_s, window_s, duration_s, entry, exit, quiet, build."""
    held = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    own = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("to_s") - F.col("from_s")) / (2.0 * F.col("window_s"))))
    place = F.col("from_s") / F.col("duration_s")
    falls, rises = lambda c: F.greatest(F.lit(0.0), -F.col(c)), lambda c: F.greatest(F.lit(0.0), F.col(c))
    out = own * (1.2 * falls("entry") + 0.45 * falls("exit")) + 1.1 * held((place - 0.70) / 0.20) + 0.15 * F.col("quiet")
    into = own * (2.0 * rises("exit") + 0.65 * rises("entry")) + 0.45 * F.col("build") + 0.25 * F.col("quiet") + 0.25 * held((0.45 - place) / 0.4)
    return parts.select("part", out.alias("outgoing"), into.alias("incoming"))


def longest_constant(starts: DataFrame, k: int) -> DataFrame:
    """The ``k`` longest matches of every pair (pair, incoming, outgoing, length): longer, then earlier in, then earlier out."""
    order = Window.partitionBy("pair").orderBy(F.desc("length"), "incoming", "outgoing")
    return starts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def translation_only(anchors: DataFrame, tolerance: int = 0) -> DataFrame:
    """Plans whose anchors (plan_id, source_frame, output_frame) only shift the source, and by how much: these need no resampling."""
    shift = F.col("output_frame") - F.col("source_frame")
    found = anchors.groupBy("plan_id").agg(F.min(shift).alias("shift"), F.max(shift).alias("_high"))
    return found.select("plan_id", "shift", (F.col("_high") - F.col("shift") <= tolerance).alias("translation"))


def yin_layout(signals: DataFrame, low: float = 50.0, hop_s: float = 0.02, window_s: float = 0.08) -> DataFrame:
    """Window, hop and number of complete windows of signals (series, rate, n)."""
    lag = F.ceil(F.col("rate") / low)
    made = signals.withColumn("window", F.greatest(F.ceil(F.col("rate") * window_s), 4 * lag + 1)).withColumn("hop", F.greatest(F.lit(1).cast("long"), F.floor(F.col("rate") * hop_s + 0.5)))
    return made.select("series", "window", "hop", F.when(F.col("n") >= F.col("window"), 1 + F.floor((F.col("n") - F.col("window")) / F.col("hop"))).otherwise(0).alias("frames"))


def steady_choice(energies: DataFrame, margin_db: float = 1.0) -> DataFrame:
    """Which of two channels to use per frame (series, frame, e0, e1): a lead of ``margin_db`` makes the choice change."""
    w = Window.partitionBy("series").orderBy("frame")
    floor = F.lit(1e-16)
    lead_db = 10 * F.log10(F.greatest(floor, F.col("e1")) / F.greatest(floor, F.col("e0")))
    says = F.when(lead_db > margin_db, 1).when(lead_db < -margin_db, 0)
    first = F.when(F.row_number().over(w) == 1, F.when(lead_db > 0, 1).otherwise(0)).otherwise(says)
    return energies.withColumn("_s", first).select("series", "frame", F.last("_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("channel"))
