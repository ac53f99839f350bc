"""Guards of songs and bars over the events' clocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import guards as G
from ..operators import planning as P
from ..operators import repair as R
from ..sources import tables as T
from . import clock_queries as CQ
from . import evidence_queries as EQ
from . import join_queries as JQ
from . import repair_queries as RQ
from .registry import register

REGIONS = (
    'regions AS (SELECT series, min(idx) AS "from", max(idx) + 1 AS "to" FROM (SELECT *, idx - row_number() OVER (PARTITION BY series ORDER BY idx) AS g FROM clock c WHERE NOT EXISTS (SELECT 1 FROM clock b WHERE b.series = c.series AND b.strength >= 300 AND abs(b.idx - c.idx) <= 8)) GROUP BY series, g HAVING count(*) >= 8)'
)
SAFE = "safe AS (SELECT DISTINCT series, series % 10 = 0 AS safe FROM clock)"
ASKED = 'asked AS (SELECT DISTINCT series, idx - 2 AS start, idx - 2 + n AS "end" FROM (SELECT *, unnest([1, 5, 9]) AS n FROM clock WHERE idx % 3 = 0))'
GUARDED = (
    "guarded AS (SELECT a.series, a.start, a.\"end\", CASE WHEN a.start < 0 OR a.\"end\" > z.size OR a.\"end\" - a.start < 2 THEN 'OUT_OF_BOUNDS' "
    "WHEN NOT safe AND NOT EXISTS (SELECT 1 FROM regions r WHERE r.series = a.series AND r.\"from\" <= a.start AND a.\"end\" <= r.\"to\") THEN 'UNSUPPORTED_PULSE' "
    "WHEN NOT (SELECT NOT (bool_or(missing) OR bool_or(nonrecurring) OR bool_or(q AND i > a.start) OR avg(active::INT::DOUBLE) < 0.5) FROM fq f WHERE f.series = a.series AND f.i BETWEEN a.start AND a.\"end\" - 2) THEN 'UNSUPPORTED_ACOUSTIC_PULSE' END AS declined "
    "FROM asked a JOIN (SELECT series, max(idx) + 1 AS size FROM clock GROUP BY series) z ON z.series = a.series JOIN safe s ON s.series = a.series)"
)
QUIET = "fq AS (SELECT *, NOT active AND NOT coalesce(lag(active) OVER (PARTITION BY series ORDER BY i), true) AS q FROM fl)"
SONG = (T.CLOCK_SQL, EQ._FLAGS, QUIET, REGIONS, SAFE)


def _song(spark, sf):
    clock = T.clock(spark, sf)
    safe = clock.select("series").distinct().withColumn("safe", F.col("series") % 10 == 0)
    regions = R.regions(clock, clock.where("strength >= 300")).select("series", F.col("first_idx").alias("from"), (F.col("last_idx") + 1).alias("to"))
    return clock, safe, regions


def _guarded(spark, sf):
    clock, safe, regions = _song(spark, sf)
    asked = clock.where("idx % 3 = 0").withColumn("n", F.explode(F.array(*map(F.lit, (1, 5, 9))))).select("series", (F.col("idx") - 2).alias("start"), (F.col("idx") - 2 + F.col("n")).alias("end"))
    return G.guard_ranges(asked, clock, safe, regions, E.prefix_index(EQ._flags(spark, sf)))


@register("pulse_ranges", "SELECT * FROM guarded", *SONG, ASKED, GUARDED)
def pulse_ranges(spark, sf):
    return _guarded(spark, sf)


@register("matching_grid", 'SELECT g.series, start, "end", idx - start AS i, us FROM guarded g JOIN clock c ON c.series = g.series AND c.idx >= start AND c.idx < "end" WHERE declined IS NULL', *SONG, ASKED, GUARDED)
def matching_grid(spark, sf):
    return G.matching_grid(_guarded(spark, sf), T.clock(spark, sf))


@register("latest_pulse_beat", 'SELECT z.series, CASE WHEN safe THEN size - 1 ELSE last END AS idx FROM (SELECT series, max(idx) + 1 AS size FROM clock GROUP BY series) z JOIN safe s ON s.series = z.series LEFT JOIN (SELECT series, max("to") - 1 AS last FROM regions GROUP BY series) r ON r.series = z.series', *SONG)
def latest_pulse_beat(spark, sf):
    return G.latest_accepted_beat(*_song(spark, sf))


@register("bars_with_pulse", 'SELECT series, bar, s AS start_idx, e AS end_idx, EXISTS (SELECT 1 FROM regions r WHERE r.series = p.series AND r."from" <= s AND e + 1 <= r."to") AS pulse FROM spans p', *SONG, JQ.SPANS)
def bars_with_pulse(spark, sf):
    clock, _, regions = _song(spark, sf)
    return G.with_pulse_support(G.tracked_grid(clock.where("idx % 4 = 0").select("series", F.floor(F.col("idx") / 4).alias("boundary"), "idx")), regions)


@register(
    "song_bars",
    f"SELECT series, bar, s AS start_idx, e AS end_idx, 'TRACKED' AS origin FROM spans WHERE series % 2 = 0 UNION ALL SELECT series, bar, idx, end_idx, 'ANNOTATED' FROM (SELECT *, row_number() OVER w - 1 AS bar, lead(idx) OVER w AS end_idx FROM (SELECT v.series, v.us, c.us AS near, c.idx FROM refclock v LEFT JOIN LATERAL (SELECT us, idx FROM clicks WHERE clicks.series = v.series ORDER BY abs(clicks.us - v.us), clicks.us LIMIT 1) c ON true) WINDOW w AS (PARTITION BY series ORDER BY us)) WHERE end_idx IS NOT NULL AND series NOT IN (SELECT series FROM spans WHERE series % 2 = 0) AND abs(near - us) <= {T.HOUR_US} AND end_idx > idx",
    T.CLOCK_SQL,
    JQ.CLICKS,
    T.REF_SQL,
    JQ.SPANS,
)
def song_bars(spark, sf):
    """Every second song is tracked; the others have the downbeats of one kind of event over the beats of another."""
    return G.song_bars(P.bar_spans(T.clock(spark, sf), 4).where("series % 2 = 0"), T.clock(spark, sf, "click"), T.clock(spark, sf, "view"), T.HOUR_US)


_USED = "used AS (SELECT p.series, p.bar, bar // 3 AS k, s, CASE WHEN bar % 3 = 2 AND NOT inh THEN CASE WHEN bar // 3 % 2 = 0 THEN e ELSE e - 2 END ELSE e END AS fin, e, inh, codes, bar // 3 % 2 = 0 OR bar % 3 < 2 AS entire FROM (SELECT *, bar % 3 = 1 AND bar // 3 % 4 = 0 AS inh FROM spans) p JOIN usable u USING (series, bar))"


@register(
    "required_bars",
    "SELECT ask, first_bar, CASE WHEN list_count(l) > 0 THEN l[1].bar END AS failed_bar, CASE WHEN list_count(l) > 0 THEN l[1].code END AS declined FROM (SELECT series * 1000 + k AS ask, k * 3 AS first_bar, list_sort(list({'bar': bar, 'code': code}) FILTER (code IS NOT NULL)) AS l, count(*) AS n FROM (SELECT *, CASE WHEN fault IS NOT NULL THEN fault WHEN NOT safe AND NOT held THEN 'UNSUPPORTED_PULSE' WHEN NOT inh AND NOT heard THEN 'UNSUPPORTED_ACOUSTIC_PULSE' END AS code FROM ("
    "SELECT u.*, safe, list_filter(string_split(codes, ','), lambda c: c <> '' AND (c <> 'UNSUPPORTED_ACOUSTIC_PULSE' OR NOT inh AND entire))[1] AS fault, EXISTS (SELECT 1 FROM regions r WHERE r.series = u.series AND r.\"from\" <= s AND fin + 1 <= r.\"to\") AS held, "
    "(SELECT NOT (bool_or(missing) OR bool_or(nonrecurring) OR bool_or(q AND i > u.s) OR avg(active::INT::DOUBLE) < 0.5) FROM fq f WHERE f.series = u.series AND f.i BETWEEN u.s AND u.fin - 1) AS heard FROM used u JOIN safe z ON z.series = u.series)) GROUP BY series, k) WHERE n = 3",
    *SONG,
    JQ.SPANS,
    RQ.ISSUES,
    _USED,
)
def required_bars(spark, sf):
    """Three bars at a time; of every second ask the last bar is used in part, and of every fourth the middle one is inherited."""
    clock, safe, regions = _song(spark, sf)
    spans = P.bar_spans(clock, 4)
    bars = spans.join(RQ._issues(spark, sf).hint("merge"), ["series", "bar"])
    k = F.floor(F.col("bar") / 3)
    # Every bar has its issues' row, so the asks come from the spans alone.
    whole = spans.where("series is not null").groupBy("series", k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.max("end_idx").alias("last")).where("n = 3")
    asked = whole.select((F.col("series") * 1000 + F.col("k")).alias("ask"), "series", (F.col("k") * 3).alias("first_bar"), F.lit(3).alias("n_bars"), F.when(F.col("k") % 2 == 1, F.col("last") - 2).alias("end_idx"))
    inherited = whole.where("k % 4 = 0").select((F.col("series") * 1000 + F.col("k")).alias("ask"), (F.col("k") * 3 + 1).alias("bar"))
    found = G.require_bars(asked, bars, inherited, clock, safe, regions, E.prefix_index(EQ._flags(spark, sf)))
    return found.select("ask", "first_bar", "failed_bar", "declined")


@register(
    "supported_regions",
    "SELECT series, min(bar) AS first_bar, max(bar) + 1 AS end_bar, min(s) AS start_idx, max(e) AS end_idx FROM (SELECT *, sum(CASE WHEN linked THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY bar) AS run FROM (SELECT *, coalesce(bar - prev = 1 AND (safe OR EXISTS (SELECT 1 FROM regions r WHERE r.series = b.series AND r.\"from\" <= ps AND e + 1 <= r.\"to\")) AND "
    "(SELECT NOT (bool_or(missing) OR bool_or(nonrecurring) OR bool_or(q AND i > b.s - 1) OR avg(active::INT::DOUBLE) < 0.5) FROM fq f WHERE f.series = b.series AND f.i BETWEEN b.s - 1 AND b.s), false) AS linked FROM (SELECT *, lag(bar) OVER (PARTITION BY series ORDER BY bar) AS prev, lag(s) OVER (PARTITION BY series ORDER BY bar) AS ps FROM (SELECT p.series, p.bar, s, e, safe FROM spans p JOIN safe z ON z.series = p.series "
    "WHERE p.bar % 5 <> 4 AND (safe OR EXISTS (SELECT 1 FROM regions r WHERE r.series = p.series AND r.\"from\" <= s AND e + 1 <= r.\"to\")) AND (SELECT NOT (bool_or(missing) OR bool_or(nonrecurring) OR bool_or(q AND i > p.s) OR avg(active::INT::DOUBLE) < 0.5) FROM fq f WHERE f.series = p.series AND f.i BETWEEN p.s AND p.e - 1))) b)) GROUP BY series, run",
    *SONG,
    JQ.SPANS,
)
def supported_regions(spark, sf):
    """Every fifth bar has a code against it."""
    clock, safe, regions = _song(spark, sf)
    bars = P.bar_spans(clock, 4).withColumn("codes", F.when(F.col("bar") % 5 == 4, "UNCERTAIN_METER_PHASE").otherwise(""))
    return G.supported_regions(bars, clock, safe, regions, E.prefix_index(EQ._flags(spark, sf)))


@register(
    "reaudited_clock",
    "SELECT c.series, c.n_beats, coalesce(r.n, 0) AS repairs, coalesce(i.l, '') AS issues, i.l IS NULL AS usable FROM (SELECT series, count(*) AS n_beats FROM clock GROUP BY series) c LEFT JOIN (SELECT series, count(*) AS n FROM clock WHERE strength < 3 GROUP BY series) r ON r.series = c.series LEFT JOIN (SELECT series, string_agg(code || ':' || n, ',' ORDER BY code) AS l FROM (SELECT series, code, count(*) AS n FROM (SELECT series, code FROM issues UNION ALL SELECT series, 'REPAIRED' FROM clock WHERE strength < 3 AND idx % 2 = 0) GROUP BY series, code) GROUP BY series) i ON i.series = c.series",
    T.CLOCK_SQL,
    CQ.IV,
    CQ.codes(),
)
def reaudited_clock(spark, sf):
    """Faint beats count as repairs, every second of which gives an issue beside the audit's."""
    clock = T.clock(spark, sf)
    faint = clock.where("strength < 3")
    return G.reaudited(clock, faint.where("idx % 2 = 0").select("series", F.lit("REPAIRED").alias("code")), faint.select("series"))


@register(
    "prepared_plans",
    "SELECT o_orderkey AS plan_id, CASE WHEN fits THEN CASE WHEN o_orderkey % 3 = 0 THEN 'COPIED' ELSE 'STRETCHED' END END AS method, CASE WHEN NOT fits THEN 'DURATION_DIFFERS' END AS declined FROM (SELECT o_orderkey, o_custkey % 100 < 90 AND (o_custkey + 7) % 100 < 90 AND o_orderkey % 5 < 3 AS fits FROM orders)",
)
def prepared_plans(spark, sf):
    """Songs 90 to 99 weren't decoded; the first song's length is off by up to 4 ms."""
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    plans = T.table(spark, sf, "orders").select(k.alias("plan_id"), (c % 100).alias("a"), ((c + 7) % 100).alias("b"), (180.0 + c % 100 + (k % 5) * 0.00099).alias("a_s"), (180.0 + (c + 7) % 100).alias("b_s"), (k % 3 == 0).alias("translation"))
    durations = spark.range(90).select(F.col("id").alias("series"), (180.0 + F.col("id")).alias("seconds"))
    return G.prepared(plans, durations).select("plan_id", "method", "declined")
