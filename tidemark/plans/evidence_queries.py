"""Phase, recurrence and range evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clock as C
from ..operators import evidence as E
from ..operators import signal as S
from ..sources import tables as T
from . import clock_queries as CQ
from . import signal_queries as SQ
from .registry import register

CLICKS = T.CLOCK_SQL.replace("FROM events)", "FROM events WHERE event_type = 'click')")
#: The events' periods are hours: the reach is 2,700 s in place of 75 ms.
REACH_S = 2700.0
PHASES = (
    "ph AS (SELECT c.series, c.idx, c.us, (c.us - r.us)::DOUBLE / r.period_us AS phase, least(0.16::DOUBLE, 2700.0 * 1e6 / r.period_us) AS tolerance FROM clock c JOIN rm r ON r.series = c.series AND c.us > r.us AND c.us <= r.end_us AND r.period_us IS NOT NULL), "
    "ps AS (SELECT series, count(*) AS n, atan2(avg(sin(2 * pi() * phase)), avg(cos(2 * pi() * phase))) / (2 * pi()) AS center, sqrt(power(avg(cos(2 * pi() * phase)), 2) + power(avg(sin(2 * pi() * phase)), 2)) AS concentration FROM ph GROUP BY series)"
)
BASE = (CLICKS, T.REF_SQL, CQ.RIV, CQ.REF_MEASURED, PHASES)


def _dist(a: str, b: str) -> str:
    return f"least(abs({a} - {b}) - floor(abs({a} - {b})), 1 - (abs({a} - {b}) - floor(abs({a} - {b}))))"


def _phases(spark, sf):
    return E.phases(T.clock(spark, sf, "click"), T.clock(spark, sf, "view"), REACH_S)


@register("event_phases", "SELECT series, idx, round(phase, 6) AS phase, round(tolerance, 6) AS tolerance FROM ph", *BASE)
def event_phases(spark, sf):
    return _phases(spark, sf).select("series", "idx", F.round("phase", 6).alias("phase"), F.round("tolerance", 6).alias("tolerance"))


_SUMMARY = f"pp AS (SELECT ps.series, ps.n, center, concentration, avg(CASE WHEN {_dist('phase', 'center')} <= tolerance THEN 1.0::DOUBLE ELSE 0.0 END) AS inliers, avg(CASE WHEN {_dist('phase', '0.0')} <= tolerance THEN 1.0::DOUBLE ELSE 0.0 END) AS direct FROM ps JOIN ph USING (series) GROUP BY ALL)"


@register("circular_stats", "SELECT series, n, round(center, 6) AS center, round(concentration, 6) AS concentration, round(inliers, 6) AS inliers, round(direct, 6) AS direct FROM pp", *BASE, _SUMMARY)
def circular_stats(spark, sf):
    return E.phase_summary(_phases(spark, sf)).select("series", "n", *[F.round(c, 6).alias(c) for c in ("center", "concentration", "inliers", "direct")])


_STABLE = (
    "pi AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY us, idx) - 1 AS i FROM ph), "
    "pw AS (SELECT *, unnest(range(greatest(0, ceil((i - 15) / 8.0))::BIGINT, i // 8 + 1)) AS w FROM pi), "
    "wn AS (SELECT series, w, count(*) AS n, atan2(avg(sin(2 * pi() * phase)), avg(cos(2 * pi() * phase))) / (2 * pi()) AS c, sqrt(power(avg(cos(2 * pi() * phase)), 2) + power(avg(sin(2 * pi() * phase)), 2)) AS r, list_sort(list(tolerance)) AS t FROM pw GROUP BY series, w), "
    f"st AS (SELECT wn.series, count(*) AS windows, avg(CASE WHEN r >= 0.8 AND {_dist('c', 'center')} <= t[len(t) // 2 + 1] THEN 1.0::DOUBLE ELSE 0.0 END) AS stable FROM wn JOIN ps ON ps.series = wn.series WHERE wn.n >= 8 GROUP BY wn.series)"
)


@register("hop_window_stability", "SELECT series, windows, round(stable, 6) AS stable FROM st", *BASE, _STABLE)
def hop_window_stability(spark, sf):
    return E.window_stability(_phases(spark, sf)).withColumn("stable", F.round("stable", 6))


@register(
    "phase_relation",
    "SELECT pp.series, CASE WHEN n >= 8 AND ok AND direct >= 0.45 THEN 'DIRECT_ALIGNMENT' WHEN n >= 16 AND ok THEN 'STABLE_OFFSET' WHEN inliers >= 0.55 THEN 'REGIONAL_SUPPORT' WHEN n < 8 THEN 'INSUFFICIENT' ELSE 'INCOHERENT' END AS relation FROM (SELECT pp.*, concentration >= 0.8 AND inliers >= 0.8 AND coalesce(stable, 0.0) >= 0.8 AS ok FROM pp LEFT JOIN st USING (series)) pp",
    *BASE,
    _SUMMARY,
    _STABLE,
)
def phase_relation(spark, sf):
    found = _phases(spark, sf)
    both = E.phase_summary(found).join(E.window_stability(found), "series", "left")
    ok = (F.col("concentration") >= 0.8) & (F.col("inliers") >= 0.8) & (F.coalesce("stable", F.lit(0.0)) >= 0.8)
    return both.select("series", E.relation(F.col("n"), ok, F.col("direct"), F.col("inliers")).alias("relation"))


PROFILES = (
    "pr0 AS (SELECT series, frame AS i, (bin // 32)::INT AS band, (bin % 32)::INT AS bin, greatest(0.0::DOUBLE, m - median(m) OVER (PARTITION BY series, frame, bin // 32)) AS v FROM bins), "
    "pr AS (SELECT series, i, band, bin, CASE WHEN max(v) OVER w >= 0.005 THEN v / sqrt(sum(v * v) OVER w) ELSE 0.0 END AS v, max(v) OVER w AS contrast FROM pr0 WINDOW w AS (PARTITION BY series, i))"
)


@register("interval_profiles", "SELECT series, i, band, bin, round(v, 6) AS v FROM pr", T.FRAMES_SQL, T.BINS_SQL, PROFILES)
def interval_profiles(spark, sf):
    return E.profiles(T.frames(spark, sf)).select("series", "i", "band", "bin", F.round("v", 6).alias("v"))


@register("circular_xcorr", "SELECT a.series, a.i, s.shift::INT AS shift, round(sum(a.v * b.v), 6) AS r FROM pr a CROSS JOIN (SELECT unnest(range(0, 32)) AS shift) s JOIN pr b ON b.series = a.series AND b.i = a.i + 1 AND b.band = a.band AND b.bin = (a.bin - shift + 32) % 32 GROUP BY a.series, a.i, s.shift", T.FRAMES_SQL, T.BINS_SQL, PROFILES)
def circular_xcorr(spark, sf):
    return E.circular_correlation(E.profiles(T.frames(spark, sf))).withColumn("r", F.round("r", 6))


_SHIFTS = ", ".join(f"({p}, {o}, {int(s)})" for p, row in enumerate(E.shift_table()) for o, s in enumerate(row))


@register(
    "perm_pvalue",
    f"SELECT o.series, o.first, any_value(active) AS active, round(any_value(o.q), 6) AS statistic, round(avg(n.q), 6) AS null_mean, (count(*) FILTER (n.q >= o.q - 1e-12) + 1) / 256.0::DOUBLE AS p_value, any_value(active) >= 0.5 AND (count(*) FILTER (n.q >= o.q - 1e-12) + 1) / 256.0 <= 0.01 AS supported FROM q o JOIN q n ON n.series = o.series AND n.first = o.first AND n.p >= 0 JOIN act ON act.series = o.series AND act.first = o.first WHERE o.p = -1 GROUP BY o.series, o.first",
    T.FRAMES_SQL,
    T.BINS_SQL,
    PROFILES,
    f"sh(p, o, shift) AS (SELECT * FROM (VALUES {_SHIFTS}) UNION ALL SELECT -1, unnest(range(0, 8)), 0)",
    "pl AS (SELECT pr.*, i // 8 * 8 AS first, i % 8 AS o FROM pr JOIN (SELECT series, max(i) AS last FROM pr GROUP BY series) USING (series) WHERE i // 8 * 8 + 7 <= last)",
    "act AS (SELECT series, first, avg(CASE WHEN contrast >= 0.005 THEN 1.0::DOUBLE ELSE 0.0 END) AS active FROM pl GROUP BY series, first)",
    "q AS (SELECT series, first, p, sum(s * s) / 64 AS q FROM (SELECT series, first, p, band, (bin + shift) % 32 AS b, sum(v) AS s FROM pl JOIN sh USING (o) GROUP BY ALL) GROUP BY series, first, p)",
)
def perm_pvalue(spark, sf):
    found = E.recurrence(E.profiles(T.frames(spark, sf)))
    return found.select("series", "first", "active", F.round("statistic", 6).alias("statistic"), F.round("null_mean", 6).alias("null_mean"), "p_value", "supported")


_FLAGS = "fl AS (SELECT series, idx AS i, strength >= 10 AS active, idx < 4 AS missing, strength > 480 AS nonrecurring FROM clock)"


def _flags(spark, sf):
    return T.clock(spark, sf).select("series", F.col("idx").alias("i"), (F.col("strength") >= 10).alias("active"), (F.col("idx") < 4).alias("missing"), (F.col("strength") > 480).alias("nonrecurring"))


@register(
    "prefix_range_support",
    "SELECT series, start, \"end\", round(f, 6) AS active_fraction, concat_ws(',', CASE WHEN miss THEN 'INSUFFICIENT_CONTEXT' END, CASE WHEN nonrec THEN 'NONRECURRING_ATTACKS' END, CASE WHEN quiet OR f < 0.5 THEN 'INSUFFICIENT_LOCAL_ATTACKS' END) AS issues, NOT (miss OR nonrec OR quiet OR f < 0.5) AS supported "
    "FROM (SELECT r.series, r.start, r.\"end\", avg(active::INT::DOUBLE) AS f, bool_or(missing) AS miss, bool_or(nonrecurring) AS nonrec, bool_or(q AND i > r.start) AS quiet FROM (SELECT series, unnest(range(0, m - 4, 4)) AS start, start + 5 AS \"end\" FROM (SELECT series, max(i) AS m FROM fl GROUP BY series)) r "
    "JOIN (SELECT *, NOT active AND NOT coalesce(lag(active) OVER (PARTITION BY series ORDER BY i), true) AS q FROM fl) f ON f.series = r.series AND f.i BETWEEN r.start AND r.\"end\" - 2 GROUP BY ALL)",
    T.CLOCK_SQL,
    _FLAGS,
)
def prefix_range_support(spark, sf):
    flags = _flags(spark, sf)
    ranges = flags.groupBy("series").agg(F.max("i").alias("m")).where("m > 4").withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 5, F.lit(4).cast("long")))).select("series", "start", (F.col("start") + 5).alias("end"))
    return E.assess_ranges(E.prefix_index(flags), ranges).withColumn("active_fraction", F.round("active_fraction", 6))


@register("unsupported_runs", "SELECT series, min(i) AS first, max(i) AS last, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY series ORDER BY i) AS g FROM fl WHERE NOT active) GROUP BY series, g", T.CLOCK_SQL, _FLAGS)
def unsupported_runs(spark, sf):
    return E.unsupported_runs(_flags(spark, sf).withColumnRenamed("active", "ok"))


TEMPO = (T.SIGNAL_SQL, SQ._acf(100), SQ.SUPPORT, "top AS (SELECT series, round(bpm, 6) AS bpm, round(support, 6) AS support, rank FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY support * (1.0 + 0.12 * ln(bpm / 40.0)) DESC, i) AS rank FROM scored) WHERE rank <= 8)")


def _tempo(spark, sf):
    found = S.tempo_top(S.candidates(SQ._support(spark, sf)), 0.05)
    return found.select("series", F.round("bpm", 6).alias("bpm"), F.round("support", 6).alias("support"), "rank")


@register(
    "suppress_near",
    "SELECT series, (row_number() OVER (PARTITION BY series ORDER BY support DESC, bpm) - 1)::INT AS rank, bpm FROM keep WHERE ok",
    *TEMPO,
    "ord AS (SELECT series, bpm, support, row_number() OVER (PARTITION BY series ORDER BY support DESC, bpm) AS r FROM top)",
    "lst AS (SELECT series, list(bpm ORDER BY r) AS l FROM ord GROUP BY series)",
    "red AS (SELECT series, list_reduce(list_transform(l, lambda x: [x]), lambda a, x: CASE WHEN len(list_filter(a, lambda k: abs(ln(x[1] / k)) < 0.04)) > 0 THEN a ELSE a || x END) AS kept FROM lst)",
    "keep AS (SELECT ord.*, list_contains(kept, bpm) AS ok FROM ord JOIN red USING (series))",
)
def suppress_near(spark, sf):
    return E.suppress_near(_tempo(spark, sf))


_ALT = "alt AS (SELECT series, num, den, bpm, support, support >= 0.06 AND support >= top * 0.35 AS independent FROM (SELECT s.series, num, den, c.bpm, c.support, m.top, row_number() OVER (PARTITION BY s.series, num, den ORDER BY c.support DESC, c.bpm) AS r FROM (SELECT series, bpm AS chosen FROM top WHERE rank = 1) s CROSS JOIN (VALUES (1, 2), (2, 1), (1, 3), (3, 1)) v(num, den) JOIN top c ON c.series = s.series AND c.bpm <> chosen AND abs(ln(c.bpm / chosen * den / num)) < 0.15 JOIN (SELECT series, max(support) AS top FROM top GROUP BY series) m ON m.series = s.series) WHERE r = 1)"


def _alternatives(spark, sf):
    found = _tempo(spark, sf)
    return E.metrical_alternatives(found, found.where("rank = 1"), 0.15)


@register("metrical_alternatives", "SELECT * FROM alt", *TEMPO, _ALT)
def metrical_alternatives(spark, sf):
    return _alternatives(spark, sf)


@register(
    "meter_families",
    "SELECT series, num, den, count, n, d, CASE WHEN d <> 1 THEN 'FRACTIONAL_CANONICAL_PULSE_COUNT' ELSE 'COUNT_OUTSIDE_CONFIGURED_FAMILY' END AS reason FROM (SELECT series, num, den, count, (count * den // gcd(count * den, num))::INT AS n, (num // gcd(count * den, num))::INT AS d FROM alt CROSS JOIN (SELECT unnest([2, 3, 4, 6, 8]) AS count)) WHERE d <> 1 OR n NOT IN (2, 3, 4, 6, 8)",
    *TEMPO,
    _ALT,
)
def meter_families(spark, sf):
    return E.meter_families(_alternatives(spark, sf))


@register("interval_agreement", "SELECT series, bpm, round(avg(CASE WHEN abs(interval_us / (60e6 / bpm) - 1) < 0.22 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS agreement FROM iv CROSS JOIN (SELECT unnest([0.005, 0.01, 0.02, 0.05])::DOUBLE AS bpm) GROUP BY series, bpm", T.CLOCK_SQL, CQ.IV)
def interval_agreement(spark, sf):
    clock = T.clock(spark, sf)
    asked = clock.select("series").distinct().withColumn("bpm", F.explode(F.array(*[F.lit(x) for x in (0.005, 0.01, 0.02, 0.05)])))
    return E.interval_agreement(C.intervals(clock), asked).withColumn("agreement", F.round("agreement", 6))
