"""Clock statistics, audits and algebra over the events' clocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clock as C
from ..sources import tables as T
from .registry import register

IV = "iv AS (SELECT *, lead(us) OVER (PARTITION BY series ORDER BY idx) AS end_us, lead(us) OVER (PARTITION BY series ORDER BY idx) - us AS interval_us FROM clock QUALIFY end_us IS NOT NULL)"
RIV = IV.replace("iv AS", "riv AS").replace("FROM clock", "FROM refclock")
MEASURED = (
    "mp AS (SELECT *, list_sort(coalesce(list(interval_us) OVER (PARTITION BY series ORDER BY idx ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), []) || "
    "coalesce(list(interval_us) OVER (PARTITION BY series ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING), [])) AS l FROM {src}), "
    "mq AS (SELECT *, l[len(l) // 2 + 1] AS p FROM mp), "
    "{name} AS (SELECT * EXCLUDE (l, p), CASE WHEN interval_us::DOUBLE / p BETWEEN 0.62 AND 1.48 THEN p END AS period_us FROM mq)"
)
REF_MEASURED = MEASURED.format(src="riv", name="rm")
AGAINST = (
    "ag AS (SELECT iv.series, iv.idx, iv.us, iv.end_us, iv.interval_us, rm.period_us AS ref_us FROM iv LEFT JOIN rm "
    "ON iv.series = rm.series AND iv.us + iv.end_us > 2 * rm.us AND iv.us + iv.end_us <= 2 * rm.end_us)"
)
ROBUST = (
    "sp AS (SELECT series, count(*) OVER (PARTITION BY series) AS n_beats, us - lag(us, 8) OVER (PARTITION BY series ORDER BY idx) AS s8, us - lag(us) OVER (PARTITION BY series ORDER BY idx) AS s1 FROM clock), "
    "sq AS (SELECT series, n_beats, CASE WHEN n_beats >= 9 THEN s8 ELSE s1 END AS span FROM sp), "
    "sr AS (SELECT series, n_beats, list_sort(list(span) FILTER (span IS NOT NULL)) AS l FROM sq GROUP BY series, n_beats), "
    "robust AS (SELECT series, n_beats, l[len(l) // 2 + 1] / CASE WHEN n_beats >= 9 THEN 8.0::DOUBLE ELSE 1.0::DOUBLE END / 1e6 AS interval_s FROM sr WHERE len(l) > 0)"
)
def codes(duration_us: int | None = None) -> str:
    late = f" OR us >= {duration_us}" if duration_us else ""
    return (
        f"inv AS (SELECT DISTINCT series FROM (SELECT *, lag(us) OVER (PARTITION BY series ORDER BY idx) AS before FROM clock) WHERE us < 0 OR us <= before{late}), "
        "lp AS (SELECT *, list_sort(list(interval_us) OVER (PARTITION BY series ORDER BY idx ROWS BETWEEN 7 PRECEDING AND 8 FOLLOWING)) AS l, lag(interval_us) OVER (PARTITION BY series ORDER BY idx) AS before FROM iv WHERE series NOT IN (SELECT series FROM inv)), "
        "lq AS (SELECT *, interval_us::DOUBLE / l[len(l) // 2 + 1] AS ratio FROM lp), "
        "issues AS (SELECT *, 'ERROR' AS severity FROM (SELECT series, 'DUPLICATE_OR_SUBDIVISION' AS code, us AS start_us, end_us FROM lq WHERE interval_us < 160000 "
        "UNION ALL SELECT series, 'PULSE_LEVEL_DISCONTINUITY', us, end_us FROM lq WHERE ratio < 0.62 OR ratio > 1.48 "
        "UNION ALL SELECT series, 'ABRUPT_PULSE_CHANGE', us, end_us FROM lq WHERE greatest(interval_us::DOUBLE / before, before::DOUBLE / interval_us) > 1.48 AND before IS NOT NULL "
        "UNION ALL SELECT series, 'INVALID_TIMESTAMPS', 0, 0 FROM inv "
        "UNION ALL SELECT series, 'INSUFFICIENT_BEATS', 0, 0 FROM clock GROUP BY series HAVING count(*) < 8))"
    )


#: The recording's length in the queries: some clocks go on behind it.
LENGTH_US = 2_584_000_000_000


@register("clock_intervals", "SELECT series, idx, interval_us FROM iv", T.CLOCK_SQL, IV)
def clock_intervals(spark, sf):
    return C.intervals(T.clock(spark, sf)).select("series", "idx", "interval_us")


@register("robust_interval", "SELECT series, n_beats, round(interval_s, 6) AS interval_s FROM robust", T.CLOCK_SQL, ROBUST)
def robust_interval(spark, sf):
    return C.robust_interval(T.clock(spark, sf)).withColumn("interval_s", F.round("interval_s", 6))


@register("robust_bpm", "SELECT series, round(60.0 / interval_s, 6) AS bpm, round(s, 6) AS mean_strength FROM robust JOIN (SELECT series, avg(least(1.0::DOUBLE, greatest(0.0::DOUBLE, strength))) AS s FROM clock GROUP BY series) USING (series)", T.CLOCK_SQL, ROBUST)
def robust_bpm(spark, sf):
    return C.robust_bpm(T.clock(spark, sf)).select("series", F.round("bpm", 6).alias("bpm"), F.round("mean_strength", 6).alias("mean_strength"))


DAY = 86_400_000_000


@register(
    "clock_validity",
    f"SELECT series, bool_and(us >= 0 AND us < {29 * DAY} AND coalesce(us > before, true) AND NOT isnan(strength)) AS valid, count(*) AS n_beats FROM (SELECT *, lag(us) OVER (PARTITION BY series ORDER BY idx) AS before FROM clock) GROUP BY series",
    T.CLOCK_SQL,
)
def clock_validity(spark, sf):
    return C.validity(T.clock(spark, sf), 29 * DAY)


@register(
    "clock_smooth_r4",
    "SELECT series, idx, round(regr_slope(us / 1e6, idx) OVER w * idx + regr_intercept(us / 1e6, idx) OVER w, 3) AS smooth_s FROM clock WINDOW w AS (PARTITION BY series ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)",
    T.CLOCK_SQL,
)
def clock_smooth(spark, sf):
    return C.smooth(T.clock(spark, sf)).select("series", "idx", F.round("smooth_s", 3).alias("smooth_s"))


@register("interval_p95", "SELECT series, round(quantile_cont(interval_us::DOUBLE, 0.95), 3) AS p95_us FROM iv GROUP BY series", T.CLOCK_SQL, IV)
def interval_p95(spark, sf):
    return C.quantile(C.intervals(T.clock(spark, sf)), ["series"], "interval_us", 0.95, "p95_us").withColumn("p95_us", F.round("p95_us", 3))


@register("local_period", "SELECT series, idx, l[len(l) // 2 + 1] AS period_us FROM (SELECT *, list_sort(list(interval_us) OVER (PARTITION BY series ORDER BY idx ROWS BETWEEN 7 PRECEDING AND 8 FOLLOWING)) AS l FROM iv)", T.CLOCK_SQL, IV)
def local_period(spark, sf):
    return C.local_period(T.clock(spark, sf)).select("series", "idx", "period_us")


@register("measured_period", "SELECT series, idx, period_us FROM m", T.CLOCK_SQL, IV, MEASURED.format(src="iv", name="m"))
def measured_period(spark, sf):
    return C.measured_period(T.clock(spark, sf)).select("series", "idx", "period_us")


@register("grid_issues", "SELECT * FROM issues", T.CLOCK_SQL, IV, codes(LENGTH_US))
def grid_issues(spark, sf):
    return C.issues(T.clock(spark, sf), LENGTH_US)


@register("grid_usable", "SELECT series, count(*) AS n_beats, count(*) >= 8 AND series NOT IN (SELECT series FROM issues) AS usable FROM clock GROUP BY series", T.CLOCK_SQL, IV, codes(LENGTH_US))
def grid_usable(spark, sf):
    return C.usable(T.clock(spark, sf), LENGTH_US)


REFERENCE = (T.CLOCK_SQL, T.REF_SQL, IV, RIV, REF_MEASURED, AGAINST)


@register("reference_coverage", "SELECT series, round(avg((ref_us IS NOT NULL)::INT), 6) AS coverage, avg((ref_us IS NOT NULL)::INT) >= 0.8 AS passes FROM ag GROUP BY series", *REFERENCE)
def reference_coverage(spark, sf):
    return C.reference_coverage(T.clock(spark, sf), T.clock(spark, sf, "view")).withColumn("coverage", F.round("coverage", 6))


@register(
    "canonical_agreement",
    "SELECT series, count(*) AS measured, count(*) FILTER (abs(interval_us::DOUBLE / ref_us - 1) < 0.22) AS matched, round(count(*) FILTER (abs(interval_us::DOUBLE / ref_us - 1) < 0.22)::DOUBLE / count(*), 6) AS agreement FROM ag WHERE ref_us IS NOT NULL GROUP BY series",
    *REFERENCE,
)
def canonical_agreement(spark, sf):
    return C.canonical_agreement(T.clock(spark, sf), T.clock(spark, sf, "view")).withColumn("agreement", F.round("agreement", 6))


@register(
    "gap_inserts",
    "SELECT series, idx, n AS count, j, round((us + interval_us * j / n::DOUBLE) / 1e6, 3) AS expected_s FROM (SELECT *, unnest(range(1, n)) AS j FROM (SELECT *, interval_us::DOUBLE / ref_us AS ratio, floor(interval_us::DOUBLE / ref_us + 0.5)::BIGINT AS n FROM ag WHERE ref_us IS NOT NULL) WHERE ratio >= 1.48 AND n BETWEEN 2 AND 4 AND abs(ratio - n) <= 0.24)",
    T.CLOCK_SQL.replace("FROM events)", "FROM events WHERE event_type = 'click')"),
    *REFERENCE[1:],
)
def gap_inserts(spark, sf):
    found = C.gap_inserts(T.clock(spark, sf, "click"), T.clock(spark, sf, "view"))
    return found.select("series", "idx", "count", "j", F.round(F.col("expected_us") / 1e6, 3).alias("expected_s"))


PROBE = "probe AS (SELECT series, x FROM (SELECT DISTINCT series FROM clock) CROSS JOIN (SELECT unnest([-1.5, 0.25, 3.75, 10.0, 1000.5])::DOUBLE AS x))"


@register(
    "index_to_time",
    "SELECT p.series, p.x, round((iv.us + (p.x - iv.idx) * iv.interval_us) / 1e6, 3) AS seconds FROM probe p JOIN (SELECT series, max(idx) AS last FROM clock GROUP BY series) e ON p.series = e.series JOIN iv ON iv.series = p.series AND iv.idx = least(greatest(floor(p.x), 0), e.last - 1)",
    T.CLOCK_SQL,
    IV,
    PROBE,
)
def index_to_time(spark, sf):
    clock = T.clock(spark, sf)
    probes = clock.select("series").distinct().withColumn("x", F.explode(F.array(*[F.lit(v) for v in (-1.5, 0.25, 3.75, 10.0, 1000.5)])))
    return C.at_index(clock, probes).select("series", "x", F.round(F.col("us") / 1e6, 3).alias("seconds"))


@register(
    "time_to_index",
    "SELECT r.series, r.us AS t, round(iv.idx + (r.us - iv.us)::DOUBLE / iv.interval_us, 6) AS x FROM refclock r LEFT JOIN iv ON iv.series = r.series AND r.us >= iv.us AND r.us < iv.end_us",
    T.CLOCK_SQL.replace("FROM events)", "FROM events WHERE event_type = 'click')"),
    T.REF_SQL,
    IV,
)
def time_to_index(spark, sf):
    return C.index_at(T.clock(spark, sf, "click"), T.clock(spark, sf, "view").select("series", F.col("us").alias("t"))).withColumn("x", F.round("x", 6))


@register("fixed_grid", "SELECT series, idx, series * 1000 + round(idx * 60e6 / (60 + series % 120))::BIGINT AS us FROM (SELECT DISTINCT user_id AS series FROM events) CROSS JOIN (SELECT unnest(range(0, 16)) AS idx)")
def fixed_grid(spark, sf):
    users = T.clock(spark, sf).select("series").distinct()
    return C.fixed_grid(users, 60 + F.col("series") % 120, F.col("series") * 1000, 16)


#: Knots of a monotone map: index to seconds, shrunk so that speeds lie near 1.
KNOTS = "knots AS (SELECT series, idx, idx::DOUBLE AS x, idx * 1.0::DOUBLE + (strength / 1000.0::DOUBLE) AS y FROM clock)"
SLOPES = (
    "ks AS (SELECT *, (y - lag(y) OVER w) / (x - lag(x) OVER w) AS l, (lead(y) OVER w - y) / (lead(x) OVER w - x) AS r FROM knots WINDOW w AS (PARTITION BY series ORDER BY idx)), "
    "kt AS (SELECT *, CASE WHEN l IS NULL THEN r WHEN r IS NULL THEN l WHEN l > 0 AND r > 0 THEN 2.0 / (1.0 / l + 1.0 / r) ELSE 0.0 END AS slope FROM ks), "
    "seg AS (SELECT series, idx, x AS x0, y AS y0, slope AS m0, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(slope) OVER w AS m1 FROM kt WINDOW w AS (PARTITION BY series ORDER BY idx))"
)


def _knots(spark, sf):
    return T.clock(spark, sf).select("series", "idx", F.col("idx").cast("double").alias("x"), (F.col("idx") * 1.0 + F.col("strength") / 1000.0).alias("y"))


@register("knot_slopes", "SELECT series, idx, round(slope, 6) AS slope FROM kt", T.CLOCK_SQL, KNOTS, SLOPES)
def knot_slopes(spark, sf):
    return C.knot_slopes(_knots(spark, sf)).select("series", "idx", F.round("slope", 6).alias("slope"))


@register(
    "hermite_map",
    """SELECT series, t, round(CASE WHEN x0 IS NULL THEN hy + hm * (t - hx) WHEN x1 IS NULL THEN y0 + m0 * (t - x0) ELSE (2*u*u*u - 3*u*u + 1) * y0 + (u*u*u - 2*u*u + u) * m0 + (3*u*u - 2*u*u*u) * y1 + (u*u*u - u*u) * m1 END, 6) AS y,
    round(CASE WHEN x0 IS NULL THEN hm WHEN x1 IS NULL THEN m0 ELSE (6*u*u - 6*u) * y0 + (3*u*u - 4*u + 1) * m0 + (6*u - 6*u*u) * y1 + (3*u*u - 2*u) * m1 END, 6) AS speed
    FROM (SELECT p.series, p.t, s.*, h.*, p.t - s.x0 AS u FROM probes p LEFT JOIN (SELECT series AS s_series, x0, y0, m0, x1, y1, m1 FROM seg) s ON s_series = p.series AND p.t >= x0 AND (p.t < x1 OR x1 IS NULL)
    JOIN (SELECT series AS h_series, x0 AS hx, y0 AS hy, m0 AS hm FROM seg WHERE idx = 0) h ON h_series = p.series)""",
    T.CLOCK_SQL,
    KNOTS,
    SLOPES,
    "probes AS (SELECT series, t FROM (SELECT DISTINCT series FROM clock) CROSS JOIN (SELECT unnest([-2.371, 0.3137, 1.7519, 7.4903, 12.1171, 22.9337, 30.2191])::DOUBLE AS t))",
)
def hermite_map(spark, sf):
    at = T.clock(spark, sf).select("series").distinct().withColumn("t", F.explode(F.array(*[F.lit(v) for v in (-2.371, 0.3137, 1.7519, 7.4903, 12.1171, 22.9337, 30.2191)])))
    return C.hermite(_knots(spark, sf), at).select("series", "t", F.round("y", 6).alias("y"), F.round("speed", 6).alias("speed"))


@register(
    "warp_quality",
    """SELECT series, round(min(speed), 6) AS min_speed, round(max(speed), 6) AS max_speed, round(max(rate), 6) AS max_rate,
    concat_ws(',', CASE WHEN min(speed) <= 0 THEN 'NOT_MONOTONE' END, CASE WHEN min(speed) < 0.5 - 1e-6 THEN 'SPEED_TOO_LOW' END, CASE WHEN max(speed) > 2.0 + 1e-6 THEN 'SPEED_TOO_HIGH' END, CASE WHEN max(rate) > 0.8 + 1e-6 THEN 'ABRUPT_TEMPO' END) AS issues
    FROM (SELECT series, speed, abs(acc / nullif(speed, 0.0)) AS rate FROM (SELECT series, (6*u*u - 6*u) / h * (y0 - y1) + (3*u*u - 4*u + 1) * m0 + (3*u*u - 2*u) * m1 AS speed, (12*u - 6) / (h*h) * (y0 - y1) + ((6*u - 4) * m0 + (6*u - 2) * m1) / h AS acc
    FROM (SELECT *, unnest(range(0, n + (x1 = max(x1) OVER (PARTITION BY series))::INT))::DOUBLE / n AS u FROM (SELECT *, x1 - x0 AS h, greatest(8, ceil((x1 - x0) / 0.05::DOUBLE))::BIGINT AS n FROM seg WHERE x1 IS NOT NULL)))) GROUP BY series""",
    T.CLOCK_SQL,
    KNOTS,
    SLOPES,
)
def warp_quality(spark, sf):
    found = C.warp_quality(_knots(spark, sf), 0.05)
    return found.select("series", *[F.round(c, 6).alias(c) for c in ("min_speed", "max_speed", "max_rate")], "issues")


@register("identity_anchors", "SELECT plan_id, row_number() OVER (PARTITION BY plan_id ORDER BY f) - 1 AS i, f AS source_frame, f AS output_frame FROM (SELECT DISTINCT o_orderkey AS plan_id, unnest(range(0, n + 1, 44100) || [n]) AS f FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS n FROM orders))")
def identity_anchors(spark, sf):
    return C.identity_schedule(T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("plan_id"), F.floor("o_totalprice").alias("n_frames")), 44100)


@register(
    "retained_semi",
    "SELECT series, idx, us FROM clock WHERE EXISTS (SELECT 1 FROM refclock r WHERE r.series = clock.series AND abs(r.us - clock.us) <= 3600000000)",
    T.CLOCK_SQL.replace("FROM events)", "FROM events WHERE event_type = 'click')"),
    T.REF_SQL,
)
def retained_semi(spark, sf):
    return C.retained(T.clock(spark, sf, "click"), T.clock(spark, sf, "view"), T.HOUR_US).select("series", "idx", "us")
