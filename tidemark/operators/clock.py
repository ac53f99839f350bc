"""Event-clock statistics, audits and algebra. A clock has columns series, idx (dense from 0), us (microseconds), strength."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .sequence import asof, sorted_middle, upper_median



def _series() -> WindowSpec:
    return Window.partitionBy("series")


def _by_idx() -> WindowSpec:
    return _series().orderBy("idx")


# Acceptance limits of the audits.
SUBDIVISION_US = 160_000
LOW_RATIO, HIGH_RATIO = 0.62, 1.48
MIN_BEATS = 8
MIN_REFERENCE_COVERAGE = 0.80
AGREEMENT_TOLERANCE = 0.22
GAP_TOLERANCE, MAX_GAP = 0.24, 4


def intervals(clock: DataFrame) -> DataFrame:
    """Adjacent intervals: a row per beat but the last, with its end and length."""
    return clock.withColumn("end_us", F.lead("us").over(_by_idx())).where("end_us is not null").withColumn("interval_us", F.col("end_us") - F.col("us"))


def robust_interval(clock: DataFrame) -> DataFrame:
    """Upper median of nine-beat spans; of adjacent intervals where a clock has fewer than nine beats."""
    spans = clock.withColumn("n_beats", F.count(F.lit(1)).over(_series())).withColumn("span", F.when(F.col("n_beats") >= 9, F.col("us") - F.lag("us", 8).over(_by_idx())).otherwise(F.col("us") - F.lag("us", 1).over(_by_idx())))
    middle = upper_median(spans, ["series", "n_beats"], "span", "span_us")
    return middle.select("series", "n_beats", (F.col("span_us") / F.when(F.col("n_beats") >= 9, 8.0).otherwise(1.0) / 1e6).alias("interval_s"))


def robust_bpm(clock: DataFrame) -> DataFrame:
    """60 by the robust interval, and the mean of strengths held between 0 and 1."""
    strength = clock.groupBy("series").agg(F.avg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("strength")))).alias("mean_strength"))
    return robust_interval(clock).join(strength, "series").select("series", (60.0 / F.col("interval_s")).alias("bpm"), "mean_strength")


def validity(clock: DataFrame, duration_us: int) -> DataFrame:
    """Whether all times are in [0, duration) and strictly increase, and all strengths are finite."""
    before = F.lag("us").over(_by_idx())
    sound = (F.col("us") >= 0) & (F.col("us") < duration_us) & (before.isNull() | (F.col("us") > before)) & F.col("strength").isNotNull() & ~F.isnan("strength")
    return clock.withColumn("_ok", F.coalesce(sound, F.lit(False))).groupBy("series").agg(F.bool_and("_ok").alias("valid"), F.count(F.lit(1)).alias("n_beats"))


def local_period(clock: DataFrame) -> DataFrame:
    """Per interval the upper median of up to 16 intervals around its midpoint."""
    around = _by_idx().rowsBetween(-7, 8)
    return intervals(clock).withColumn("period_us", sorted_middle(F.collect_list("interval_us").over(around)))


def measured_period(clock: DataFrame) -> DataFrame:
    """As local_period without the interval under test, and null unless the interval is within 0.62 to 1.48 of it."""
    before, after = _by_idx().rowsBetween(-7, -1), _by_idx().rowsBetween(1, 8)
    found = intervals(clock).withColumn("_p", sorted_middle(F.concat(F.collect_list("interval_us").over(before), F.collect_list("interval_us").over(after))))
    ratio = F.col("interval_us") / F.col("_p")
    return found.withColumn("period_us", F.when(ratio.between(LOW_RATIO, HIGH_RATIO), F.col("_p"))).drop("_p")


def against_reference(clock: DataFrame, reference: DataFrame) -> DataFrame:
    """Per interval the measured period of the reference interval that brackets its midpoint, null if none does."""
    probes = intervals(clock).withColumn("mid2", F.col("us") + F.col("end_us"))
    bracket = measured_period(reference).select("series", (F.col("us") * 2).alias("from2"), (F.col("end_us") * 2).alias("to2"), F.col("period_us").alias("ref_us"))
    found = asof(probes, bracket, "mid2", "from2", ["series"], ["to2", "ref_us"], strict=True)
    return found.withColumn("ref_us", F.when(F.col("mid2") <= F.col("to2"), F.col("ref_us")))


def reference_coverage(clock: DataFrame, reference: DataFrame) -> DataFrame:
    """Share of intervals with a measured reference period, and whether it passes the gate."""
    share = F.avg(F.when(F.col("ref_us").isNotNull(), 1.0).otherwise(0.0))
    return against_reference(clock, reference).groupBy("series").agg(share.alias("coverage")).withColumn("passes", F.col("coverage") >= MIN_REFERENCE_COVERAGE)


def canonical_agreement(clock: DataFrame, reference: DataFrame) -> DataFrame:
    """Share of the measured intervals within 22 % of the reference period."""
    near = F.abs(F.col("interval_us") / F.col("ref_us") - 1) < AGREEMENT_TOLERANCE
    found = against_reference(clock, reference).where("ref_us is not null")
    return found.groupBy("series").agg(F.count(F.lit(1)).alias("measured"), F.count_if(near).alias("matched")).withColumn("agreement", F.col("matched") / F.col("measured"))


def issues(clock: DataFrame, duration_us: int | None = None) -> DataFrame:
    """A row per violated rule: series, code, start_us, end_us, severity.

    A clock whose times aren't finite, from 0 on, before ``duration_us`` and strictly increasing is invalid as a whole and
    isn't looked at further. All these rules are errors; what repairs add (``repair.repair_gate``) are warnings.
    """
    zero = F.lit(0).cast("long")
    before = F.lag("us").over(_by_idx())
    odd = F.col("us").isNull() | (F.col("us") < 0) | (F.col("us") <= before) | F.isnan("strength") | (F.abs("strength") == float("inf")) | F.col("strength").isNull()
    odd = F.coalesce(odd, F.lit(False)) | (F.col("us") >= duration_us if duration_us is not None else F.lit(False))
    invalid = clock.withColumn("_odd", odd).where("_odd").select("series").distinct()
    found = local_period(clock.join(invalid, "series", "left_anti")).withColumn("_before", F.lag("interval_us").over(_by_idx()))
    ratio = F.col("interval_us") / F.col("period_us")
    step = F.greatest(F.col("interval_us") / F.col("_before"), F.col("_before") / F.col("interval_us"))
    codes = F.array_compact(
        F.array(
            F.when(F.col("interval_us") < SUBDIVISION_US, F.lit("DUPLICATE_OR_SUBDIVISION")),
            F.when((ratio < LOW_RATIO) | (ratio > HIGH_RATIO), F.lit("PULSE_LEVEL_DISCONTINUITY")),
            F.when(step > HIGH_RATIO, F.lit("ABRUPT_PULSE_CHANGE")),
        )
    )
    rules = found.select("series", F.explode(codes).alias("code"), F.col("us").alias("start_us"), F.col("end_us"))
    few = clock.groupBy("series").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < MIN_BEATS)
    whole = lambda rows, code: rows.select("series", F.lit(code).alias("code"), zero.alias("start_us"), zero.alias("end_us"))
    return rules.unionByName(whole(few, "INSUFFICIENT_BEATS")).unionByName(whole(invalid, "INVALID_TIMESTAMPS")).withColumn("severity", F.lit("ERROR"))


def usable(clock: DataFrame, duration_us: int | None = None, additional: DataFrame | None = None) -> DataFrame:
    """Whether a clock has at least eight beats and no error; ``additional`` (series, severity) adds issues of other audits."""
    found = issues(clock, duration_us).select("series", "severity")
    found = found if additional is None else found.unionByName(additional.select("series", "severity"))
    bad = found.where("severity = 'ERROR'").select("series").distinct().withColumn("bad", F.lit(True))
    counts = clock.groupBy("series").agg(F.count(F.lit(1)).alias("n_beats"))
    return counts.join(bad, "series", "left").select("series", "n_beats", ((F.col("n_beats") >= MIN_BEATS) & F.col("bad").isNull()).alias("usable"))


def gap_inserts(clock: DataFrame, reference: DataFrame) -> DataFrame:
    """Expected positions in gaps of 2 to 4 whole reference periods."""
    ratio = F.col("interval_us") / F.col("ref_us")
    found = against_reference(clock, reference).withColumn("ratio", ratio).where(F.col("ratio") >= HIGH_RATIO).withColumn("count", F.floor(F.col("ratio") + 0.5))
    fits = found.where(F.col("count").between(2, MAX_GAP) & (F.abs(F.col("ratio") - F.col("count")) <= GAP_TOLERANCE))
    placed = fits.withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count") - 1)))
    return placed.select("series", "idx", "count", "j", (F.col("us") + F.col("interval_us") * F.col("j") / F.col("count")).alias("expected_us"))


def smooth(clock: DataFrame, radius: int = 4) -> DataFrame:
    """Local linear regression of time on index over +-radius beats (fewer at the ends), taken at the beat."""
    w = _by_idx().rowsBetween(-radius, radius)
    x, y = F.col("idx").cast("double"), F.col("us") / 1e6
    n, sx, sy = F.count(F.lit(1)).over(w), F.sum(x).over(w), F.sum(y).over(w)
    # Centred on the beat, so that the sums stay small.
    moved = clock.withColumn("_n", n).withColumn("_mx", sx / n).withColumn("_my", sy / n).withColumn("_sxx", F.sum(x * x).over(w) - sx * sx / n).withColumn("_sxy", F.sum(x * y).over(w) - sx * sy / n)
    slope = F.when(F.col("_sxx") > 0, F.col("_sxy") / F.col("_sxx")).otherwise(0.0)
    return moved.withColumn("smooth_s", F.col("_my") + slope * (x - F.col("_mx"))).drop("_n", "_mx", "_my", "_sxx", "_sxy")


def quantile(df: DataFrame, keys: list[str], value: str, q: float, name: str) -> DataFrame:
    """Linearly interpolated quantile."""
    return df.groupBy(*keys).agg(F.percentile(value, q).alias(name))


def at_index(clock: DataFrame, probes: DataFrame) -> DataFrame:
    """Time at a fractional index: linear between beats, extrapolated by the first and last interval. probes: series, x."""
    ends = clock.groupBy("series").agg(F.max("idx").alias("_last"))
    lower = F.least(F.greatest(F.floor("x"), F.lit(0)), F.col("_last") - 1)
    placed = probes.join(ends.where("_last > 0"), "series").withColumn("idx", lower)
    found = placed.join(intervals(clock).select("series", "idx", "us", "interval_us"), ["series", "idx"])
    return found.select("series", "x", (F.col("us") + (F.col("x") - F.col("idx")) * F.col("interval_us")).alias("us"))


def index_at(clock: DataFrame, probes: DataFrame, at: str = "t") -> DataFrame:
    """Fractional index of a time inside the clock; null outside. probes: series and ``at``."""
    found = asof(probes, intervals(clock).select("series", F.col("us").alias("from_us"), "idx", "interval_us", "end_us"), at, "from_us", ["series"], ["from_us", "idx", "interval_us", "end_us"])
    inside = F.col(at) <= F.col("end_us")
    return found.withColumn("x", F.when(inside, F.col("idx") + (F.col(at) - F.col("from_us")) / F.col("interval_us"))).select("series", at, "x")


def fixed_grid(series: DataFrame, bpm: Column, offset_us: Column, beats: int) -> DataFrame:
    """A clock of constant tempo per row of ``series``."""
    at = series.withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(beats - 1).cast("long"))))
    return at.select("series", "idx", (offset_us + F.round(F.col("idx") * 60e6 / bpm).cast("long")).alias("us"))


def knot_slopes(knots: DataFrame) -> DataFrame:
    """Slope at every knot (series, idx, x, y): harmonic mean of the secants beside it, the one secant at the ends."""
    left = (F.col("y") - F.lag("y").over(_by_idx())) / (F.col("x") - F.lag("x").over(_by_idx()))
    right = (F.lead("y").over(_by_idx()) - F.col("y")) / (F.lead("x").over(_by_idx()) - F.col("x"))
    both = knots.withColumn("_l", left).withColumn("_r", right)
    mean = F.when((F.col("_l") > 0) & (F.col("_r") > 0), 2.0 / (1.0 / F.col("_l") + 1.0 / F.col("_r"))).otherwise(0.0)
    return both.withColumn("slope", F.when(F.col("_l").isNull(), F.col("_r")).when(F.col("_r").isNull(), F.col("_l")).otherwise(mean)).drop("_l", "_r")


def hermite(knots: DataFrame, probes: DataFrame, at: str = "t") -> DataFrame:
    """The cubic through the knots at ``at``, linear beyond them: value, speed and acceleration. probes: series and ``at``."""
    shaped = knot_slopes(knots)
    seg = shaped.select("series", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("slope").alias("m0"), F.lead("x").over(_by_idx()).alias("x1"), F.lead("y").over(_by_idx()).alias("y1"), F.lead("slope").over(_by_idx()).alias("m1"))
    found = asof(probes, seg, at, "x0", ["series"], ["x0", "y0", "m0", "x1", "y1", "m1"])
    head = shaped.where("idx = 0").select("series", F.col("x").alias("hx"), F.col("y").alias("hy"), F.col("slope").alias("hm"))
    found = found.join(head, "series")
    h = F.col("x1") - F.col("x0")
    u = (F.col(at) - F.col("x0")) / h
    value = (2 * u**3 - 3 * u**2 + 1) * F.col("y0") + (u**3 - 2 * u**2 + u) * h * F.col("m0") + (3 * u**2 - 2 * u**3) * F.col("y1") + (u**3 - u**2) * h * F.col("m1")
    speed = (6 * u**2 - 6 * u) / h * F.col("y0") + (3 * u**2 - 4 * u + 1) * F.col("m0") + (6 * u - 6 * u**2) / h * F.col("y1") + (3 * u**2 - 2 * u) * F.col("m1")
    bend = (12 * u - 6) / h**2 * F.col("y0") + (6 * u - 4) / h * F.col("m0") + (6 - 12 * u) / h**2 * F.col("y1") + (6 * u - 2) / h * F.col("m1")
    before, after = F.col("x0").isNull(), F.col("x1").isNull()
    return found.select(
        "series",
        at,
        F.when(before, F.col("hy") + F.col("hm") * (F.col(at) - F.col("hx"))).when(after, F.col("y0") + F.col("m0") * (F.col(at) - F.col("x0"))).otherwise(value).alias("y"),
        F.when(before, F.col("hm")).when(after, F.col("m0")).otherwise(speed).alias("speed"),
        F.when(before | after, F.lit(0.0)).otherwise(bend).alias("acceleration"),
    )


def warp_quality(knots: DataFrame, step: float = 0.005, samples: int = 8, min_speed: float = 0.5, max_speed: float = 2.0, max_rate: float = 0.8) -> DataFrame:
    """Per series the least and largest speed and rate of log speed of the map, where each is, and issue codes.

    Every section between knots is looked at every ``step`` of x, and at ``samples`` places at least, and the
    last knot too; so a spike in a long section doesn't hide. A row is a section, and its samples stay in it.
    """
    shaped = knot_slopes(knots)
    ahead = {c: F.lead(c).over(_by_idx()) for c in ("x", "y", "slope")}
    sections = shaped.select("series", "idx", "x", "y", "slope", *[v.alias(f"_{c}") for c, v in ahead.items()], (F.lead("x", 2).over(_by_idx()).isNull()).alias("_last")).where("_x is not null")
    h = F.col("_x") - F.col("x")
    sections = sections.withColumn("_h", h).withColumn("_n", F.greatest(F.lit(samples).cast("long"), F.ceil(h / step)))

    def rates(k: Column) -> Column:
        u = k / F.col("_n")
        speed = (6 * u * u - 6 * u) / F.col("_h") * (F.col("y") - F.col("_y")) + (3 * u * u - 4 * u + 1) * F.col("slope") + (3 * u * u - 2 * u) * F.col("_slope")
        bend = (12 * u - 6) / (F.col("_h") * F.col("_h")) * (F.col("y") - F.col("_y")) + ((6 * u - 4) * F.col("slope") + (6 * u - 2) * F.col("_slope")) / F.col("_h")
        return F.struct(speed.alias("speed"), F.abs(bend / F.nullif(speed, F.lit(0.0))).alias("rate"), (-(F.col("x") + F.col("_h") * u)).alias("before"))

    looked = sections.withColumn("_s", F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - F.when(F.col("_last"), 0).otherwise(1)), rates))
    worst = looked.select(
        "series",
        F.array_min(F.transform("_s", lambda s: F.struct(s["speed"].alias("v"), (-s["before"]).alias("t")))).alias("low"),
        F.array_max(F.transform("_s", lambda s: F.struct(s["speed"].alias("v"), s["before"].alias("t")))).alias("high"),
        F.array_max(F.transform("_s", lambda s: F.struct(s["rate"].alias("v"), s["before"].alias("t")))).alias("rate"),
    )
    slack = 1e-6
    found = worst.groupBy("series").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("rate").alias("rate"))
    found = found.select("series", F.col("low.v").alias("min_speed"), F.col("high.v").alias("max_speed"), F.col("rate.v").alias("max_rate"), F.col("low.t").alias("min_speed_at"), (-F.col("high.t")).alias("max_speed_at"), (-F.col("rate.t")).alias("max_rate_at"))
    codes = F.array_compact(
        F.array(
            F.when(F.col("min_speed") <= 0, F.lit("NOT_MONOTONE")),
            F.when(F.col("min_speed") < min_speed - slack, F.lit("SPEED_TOO_LOW")),
            F.when(F.col("max_speed") > max_speed + slack, F.lit("SPEED_TOO_HIGH")),
            F.when(F.col("max_rate") > max_rate + slack, F.lit("ABRUPT_TEMPO")),
        )
    )
    return found.withColumn("issues", F.array_join(codes, ","))


def inverse(knots: DataFrame, probes: DataFrame, steps: int = 36, at: str = "y") -> DataFrame:
    """x at which the monotone cubic takes ``at``, by bisection inside the section; null outside the knots."""
    shaped = knot_slopes(knots)
    seg = shaped.select("series", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("slope").alias("m0"), F.lead("x").over(_by_idx()).alias("x1"), F.lead("y").over(_by_idx()).alias("y1"), F.lead("slope").over(_by_idx()).alias("m1"))
    found = asof(probes, seg, at, "y0", ["series"], ["x0", "y0", "m0", "x1", "y1", "m1"]).where(F.col(at) <= F.col("y1"))
    h = F.col("x1") - F.col("x0")

    def value(u: Column) -> Column:
        return (2 * u * u * u - 3 * u * u + 1) * F.col("y0") + (u * u * u - 2 * u * u + u) * h * F.col("m0") + (3 * u * u - 2 * u * u * u) * F.col("y1") + (u * u * u - u * u) * h * F.col("m1")

    half = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")),
        lambda a, _: F.when(value((a["lo"] + a["hi"]) / 2) < F.col(at), F.struct(((a["lo"] + a["hi"]) / 2).alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), ((a["lo"] + a["hi"]) / 2).alias("hi"))),
    )
    return found.withColumn("_u", half).select("series", at, (F.col("x0") + h * (F.col("_u.lo") + F.col("_u.hi")) / 2).alias("x"))


def identity_schedule(frames: DataFrame, step: int) -> DataFrame:
    """Anchors (i, source_frame, output_frame) of an unchanged source. frames: plan_id, n_frames."""
    at = frames.withColumn("source_frame", F.explode(F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), F.col("n_frames"), F.lit(step).cast("long")), F.array("n_frames")))))
    order = Window.partitionBy("plan_id").orderBy("source_frame")
    return at.select("plan_id", (F.row_number().over(order) - 1).cast("long").alias("i"), "source_frame", F.col("source_frame").alias("output_frame"))


def retained(events: DataFrame, kept: DataFrame, within_us: int) -> DataFrame:
    """Events within ``within_us`` of a kept beat; order and repeats stay."""
    from .sequence import range_join

    spans = kept.select("series", (F.col("us") - within_us).alias("from_us"), (F.col("us") + within_us).alias("to_us"))
    return range_join(events, spans, "us", "from_us", "to_us", ["series"], max(1, 4 * within_us), "left_semi")


def same_clock(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether two clocks have the same times in the same order, series by series: evidence is bound to a clock by it."""
    counted = a.select("series", "idx", "us").join(b.select("series", "idx", F.col("us").alias("_us")), ["series", "idx"], "full")
    return counted.groupBy("series").agg(F.bool_and(F.col("us").eqNullSafe(F.col("_us"))).alias("same"))


def clock_hash(clock: DataFrame) -> DataFrame:
    """A hash of a clock's times in order: evidence is bound to a clock by it."""
    times = F.transform(F.array_sort(F.collect_list(F.struct("idx", "us"))), lambda x: x["us"])
    return clock.groupBy("series").agg(F.xxhash64(times).alias("clock_hash"))
