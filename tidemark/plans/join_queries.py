"""Matching, interval algebra, pair search and mixing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import planning as P
from ..operators import sequence as Q
from ..sources import tables as T
from .registry import register

HOUR = T.HOUR_US
CLICKS = T.CLOCK_SQL.replace("clock AS", "clicks AS").replace("FROM events)", "FROM events WHERE event_type = 'click')")
SESSIONS = f"ses0 AS (SELECT *, CASE WHEN us - lag(us) OVER w > {6 * HOUR} OR lag(us) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM clock WINDOW w AS (PARTITION BY series ORDER BY idx)), ses1 AS (SELECT *, sum(new) OVER (PARTITION BY series ORDER BY idx) AS island FROM ses0), sessions AS (SELECT series, island::BIGINT AS island, min(us) AS start, max(us) AS \"end\", count(*) AS n FROM ses1 GROUP BY series, island)"


def _sessions(spark, sf):
    clock = T.clock(spark, sf)
    gap = F.col("us") - F.lag("us").over(Window.partitionBy("series").orderBy("idx")) > 6 * HOUR
    found = Q.islands(clock, ["series"], "idx", gap)
    return found.groupBy("series", F.col("island").cast("long").alias("island")).agg(F.min("us").alias("start"), F.max("us").alias("end"), F.count(F.lit(1)).alias("n"))


@register(
    "nearest_match",
    f"SELECT series, idx, CASE WHEN abs(near - us) <= {2 * HOUR} THEN near END AS near FROM (SELECT c.series, c.idx, c.us, (SELECT min_by(r.us, abs(r.us - c.us) * 2 + CASE WHEN r.us > c.us THEN 1 ELSE 0 END) FROM refclock r WHERE r.series = c.series) AS near FROM clicks c)",
    CLICKS,
    T.REF_SQL,
)
def nearest_match(spark, sf):
    return Q.nearest(T.clock(spark, sf, "click"), T.clock(spark, sf, "view"), "us", "us", ["series"], [], 2 * HOUR).select("series", "idx", "near")


@register("asof_prev", "SELECT c.series, c.idx, (SELECT max(r.us) FROM refclock r WHERE r.series = c.series AND r.us <= c.us) AS prev_us, (SELECT min(r.us) FROM refclock r WHERE r.series = c.series AND r.us >= c.us) AS next_us FROM clicks c", CLICKS, T.REF_SQL)
def asof_prev(spark, sf):
    views = T.clock(spark, sf, "view")
    found = Q.asof(T.clock(spark, sf, "click"), views.withColumnRenamed("us", "prev_us"), "us", "prev_us", ["series"], ["prev_us"])
    return Q.asof(found, views.withColumnRenamed("us", "next_us"), "us", "next_us", ["series"], ["next_us"], before=False).select("series", "idx", "prev_us", "next_us")


@register("islands_sessions", 'SELECT series, island, start, "end", n FROM sessions', T.CLOCK_SQL, SESSIONS)
def islands_sessions(spark, sf):
    return _sessions(spark, sf)


@register("point_in_interval_count", 'SELECT c.series, count(*) AS inside FROM clicks c WHERE EXISTS (SELECT 1 FROM sessions s WHERE s.series = c.series AND c.us BETWEEN s.start AND s."end" AND s.n >= 3) GROUP BY c.series', T.CLOCK_SQL, CLICKS, SESSIONS)
def point_in_interval_count(spark, sf):
    return Q.range_join(T.clock(spark, sf, "click"), _sessions(spark, sf).where("n >= 3").select("series", "start", "end"), "us", "start", "end", ["series"], 24 * HOUR, "left_semi").groupBy("series").agg(F.count(F.lit(1)).alias("inside"))


@register("dilated_blocks", 'SELECT DISTINCT c.series, c.idx FROM clock c JOIN clock e ON c.series = e.series AND abs(c.idx - e.idx) <= 8 WHERE e.strength >= 400', T.CLOCK_SQL)
def dilated_blocks(spark, sf):
    clock = T.clock(spark, sf)
    spans = clock.where("strength >= 400").select("series", (F.col("idx") - 8).alias("from"), (F.col("idx") + 8).alias("to"))
    return Q.range_join(clock.select("series", "idx"), spans, "idx", "from", "to", ["series"], 32, "left_semi")


_MERGED = (
    f"iv AS (SELECT series, us AS start, us + (strength * {HOUR // 100})::BIGINT AS \"end\" FROM clock), "
    "m0 AS (SELECT *, max(\"end\") OVER (PARTITION BY series ORDER BY start, \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv), "
    "m1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY start, \"end\" ROWS UNBOUNDED PRECEDING) AS run FROM m0), "
    "merged AS (SELECT series, min(start) AS start, max(\"end\") AS \"end\", count(*) AS n FROM m1 GROUP BY series, run)"
)


def _merged(spark, sf):
    spans = T.clock(spark, sf).select("series", F.col("us").alias("start"), (F.col("us") + F.round(F.col("strength") * (HOUR // 100)).cast("long")).alias("end"))
    return Q.merge_intervals(spans, ["series"])


@register("merge_intervals", 'SELECT series, start, "end", n FROM merged', T.CLOCK_SQL, _MERGED)
def merge_intervals(spark, sf):
    return _merged(spark, sf)


@register(
    "interval_complement",
    f'SELECT * FROM (SELECT series, "end" AS gap_start, coalesce(lead(start) OVER (PARTITION BY series ORDER BY start), {720 * HOUR}) AS gap_end FROM merged UNION ALL SELECT series, 0, min(start) FROM merged GROUP BY series) WHERE gap_end > gap_start',
    T.CLOCK_SQL,
    _MERGED,
)
def interval_complement(spark, sf):
    return Q.complement(_merged(spark, sf), ["series"], F.lit(0).cast("long"), F.lit(720 * HOUR).cast("long"))


@register("aligned_selection", "SELECT a.series, a.bar, b.bar - a.bar + 1 AS n_bars FROM bd a JOIN bd b ON a.series = b.series AND b.e = a.s + 16", T.BARS_SQL, "bd AS (SELECT series, bar, (sum(pulses) OVER w)::BIGINT AS e, (sum(pulses) OVER w)::BIGINT - pulses AS s FROM bars WINDOW w AS (PARTITION BY series ORDER BY bar))")
def aligned_selection(spark, sf):
    return P.aligned_selection(T.bars(spark, sf), 16)


@register("compatible_counts", "SELECT n_bars, series, bar FROM (SELECT a.series, a.bar, b.bar - a.bar + 1 AS n_bars FROM bd a JOIN bd b ON a.series = b.series AND b.e = a.s + 16) WHERE n_bars IN (2, 4, 8, 16, 32)", T.BARS_SQL, "bd AS (SELECT series, bar, (sum(pulses) OVER w)::BIGINT AS e, (sum(pulses) OVER w)::BIGINT - pulses AS s FROM bars WINDOW w AS (PARTITION BY series ORDER BY bar))")
def compatible_counts(spark, sf):
    return P.compatible_counts(P.aligned_selection(T.bars(spark, sf), 16))


SIGNATURES = "sg AS (SELECT series, bar, list(pulses) OVER w AS signature, sum(score) OVER w AS score FROM bars WINDOW w AS (PARTITION BY series ORDER BY bar ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)), sig AS (SELECT series, bar, array_to_string(signature, '-') AS signature, score FROM sg WHERE len(signature) = 3)"


def _sides(spark, sf):
    found = P.signatures(T.bars(spark, sf), 3).withColumn("signature", F.array_join(F.transform("signature", lambda x: x.cast("string")), "-"))
    return found.where("series % 2 = 0"), found.where("series % 2 = 1")


@register("meter_equijoin", "SELECT signature, outgoing, incoming, outgoing * incoming AS pairs FROM (SELECT signature, count(*) FILTER (series % 2 = 0) AS outgoing, count(*) FILTER (series % 2 = 1) AS incoming FROM sig GROUP BY signature) WHERE outgoing > 0 AND incoming > 0", T.BARS_SQL, SIGNATURES)
def meter_equijoin(spark, sf):
    return P.meter_pairs(*_sides(spark, sf))


_RANKED = "SELECT signature, series, bar, row_number() OVER (PARTITION BY signature ORDER BY score DESC, series, bar) AS r FROM sig WHERE series % 2 = "


@register(
    "ranked_pairs",
    f"SELECT signature, position::INT AS position, o_series AS out_series, o_bar AS out_bar, i_series AS in_series, i_bar AS in_bar FROM (SELECT o.signature, o.series AS o_series, o.bar AS o_bar, i.series AS i_series, i.bar AS i_bar, row_number() OVER (PARTITION BY o.signature ORDER BY o.r + i.r, o.r) AS position FROM ({_RANKED}0) o JOIN ({_RANKED}1) i ON o.signature = i.signature AND o.r <= 6 AND i.r <= 6) WHERE position <= 6",
    T.BARS_SQL,
    SIGNATURES,
)
def ranked_pairs(spark, sf):
    return P.ranked_pairs(*_sides(spark, sf), 6).select("signature", "position", "out_series", "out_bar", "in_series", "in_bar")


@register(
    "fair_budgets",
    "SELECT d.series, d.bar AS i, pulses AS demand, (least(pulses, lv) + CASE WHEN pulses > lv AND sum(CASE WHEN pulses > lv THEN 1 ELSE 0 END) OVER (PARTITION BY d.series ORDER BY d.bar) <= 20 - used THEN 1 ELSE 0 END)::BIGINT AS budget FROM bars d JOIN (SELECT series, max(lv) AS lv, max_by(used, lv) AS used FROM (SELECT series, lv, sum(least(pulses, lv)) AS used FROM bars CROSS JOIN (SELECT unnest(range(0, 21)) AS lv) GROUP BY series, lv) WHERE used <= 20 GROUP BY series) l ON l.series = d.series",
    T.BARS_SQL,
)
def fair_budgets(spark, sf):
    return P.fair_budgets(T.bars(spark, sf).select("series", F.col("bar").alias("i"), F.col("pulses").alias("demand")), 20)


@register("ordered_scan", "SELECT pair, incoming, outgoing FROM (SELECT a.series AS pair, b.bar AS incoming, a.bar AS outgoing, row_number() OVER (PARTITION BY a.series ORDER BY b.bar, a.bar DESC) AS r FROM sig a JOIN sig b ON b.series = a.series + 1 AND a.signature = b.signature) WHERE r = 1", T.BARS_SQL, SIGNATURES)
def ordered_scan(spark, sf):
    found = P.signatures(T.bars(spark, sf), 3)
    a = found.select(F.col("series").alias("pair"), F.col("bar").alias("outgoing"), "signature")
    b = found.select((F.col("series") - 1).alias("pair"), F.col("bar").alias("incoming"), "signature")
    return P.ordered_scan(a.join(b, ["pair", "signature"]).select("pair", "incoming", "outgoing"))


@register(
    "longest_common_run",
    "SELECT pair, length, i, j FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY length DESC, i, j) AS r FROM (SELECT pair, count(*) AS length, min(i) AS i, min(j) AS j FROM (SELECT a.series AS pair, a.bar AS i, b.bar AS j, a.bar - row_number() OVER (PARTITION BY a.series, a.bar - b.bar ORDER BY a.bar) AS g FROM bars a JOIN bars b ON b.series = a.series + 1 AND a.pulses = b.pulses) GROUP BY pair, i - j, g)) WHERE r = 1",
    T.BARS_SQL,
)
def longest_common_run(spark, sf):
    bars = T.bars(spark, sf)
    a = bars.select(F.col("series").alias("pair"), F.col("bar").alias("i"), "pulses")
    b = bars.select((F.col("series") - 1).alias("pair"), F.col("bar").alias("j"), "pulses")
    return Q.longest_common_run(a, b, ["pair"], "pulses")


@register("weighted_median", 'SELECT series, min(level) AS median FROM (SELECT *, sum(w) OVER (PARTITION BY series ORDER BY level, start ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY series) AS t FROM (SELECT *, "end" - start + (start // 7) % 5 AS w FROM blocks)) WHERE c > t / 2 GROUP BY series', T.BLOCKS_SQL)
def weighted_median(spark, sf):
    blocks = T.blocks(spark, sf).withColumn("w", F.col("end") - F.col("start") + F.floor(F.col("start") / 7) % 5)
    return Q.weighted_upper_median(blocks, ["series"], "level", "w", "start")


_SIDES = ", ".join(
    f'coalesce(sum(greatest(0.0::DOUBLE, least("end"::DOUBLE, {hi}) - greatest(start::DOUBLE, {lo})) * {w}), 0.0) AS {n}'
    for n, lo, hi, w in (("cb", "t - 28", "t", "1"), ("ca", "t", "t + 28", "1"), ("ab", "t - 28", "t", "level"), ("aa", "t", "t + 28", "level"))
)
_CHANGE = "{name} AS (SELECT p.series, p.t, CASE WHEN cb < 14 OR ca < 14 THEN 0.0 ELSE greatest(-1.0, least(1.0, (aa / ca - ab / cb) / {scale})) END AS change FROM (SELECT p.series, p.t, " + _SIDES + " FROM probes p JOIN {table} b ON b.series = p.series GROUP BY p.series, p.t) p JOIN (SELECT series, sum((\"end\" - start) * level) / sum(\"end\" - start) AS mean FROM {table} GROUP BY series) m ON m.series = p.series)"


@register(
    "cue_change",
    "SELECT a.series, a.t, round(0.8 * a.change + 0.2 * b.change, 4) AS change FROM loud a JOIN busy b ON b.series = a.series AND b.t = a.t",
    T.BLOCKS_SQL,
    T.BLOCKS_SQL.replace("blocks AS", "quantities AS").replace("avg(l_extendedprice)", "avg(l_quantity)"),
    "probes AS (SELECT series, t FROM (SELECT DISTINCT series FROM blocks) CROSS JOIN (SELECT (unnest(range(0, 300)) * 10 + 3)::DOUBLE AS t))",
    _CHANGE.format(name="loud", scale="6171.0", table="blocks"),
    _CHANGE.format(name="busy", scale="(2 * mean)", table="quantities"),
)
def cue_change(spark, sf):
    """Weekly prices as level and weekly quantities as activity."""
    blocks = T.blocks(spark, sf)
    probes = blocks.select("series").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(299)))).select("series", (F.col("i") * 10 + 3).cast("double").alias("t"))
    return P.cue_change(blocks, probes, 28.0, 6171.0, T.blocks(spark, sf, "l_quantity")).withColumn("change", F.round("change", 4))


SPANS = "spans AS (SELECT series, bar, bar * 4 AS s, bar * 4 + 4 AS e FROM (SELECT series, unnest(range(0, last // 4)) AS bar FROM (SELECT series, max(idx) AS last FROM clock GROUP BY series) WHERE last >= 4))"


@register("bar_min", "SELECT p.series, p.bar, min(strength) AS least, count(*) AS n FROM spans p JOIN clock c ON c.series = p.series AND c.idx BETWEEN s AND e GROUP BY p.series, p.bar", T.CLOCK_SQL, SPANS)
def bar_min(spark, sf):
    clock = T.clock(spark, sf)
    return P.bar_minimum(clock, P.bar_spans(clock, 4))


@register("bar_conflicts", "SELECT p.series, p.bar, bool_or(idx > s AND idx < e AND strength >= 200) AS conflict FROM spans p JOIN clock c ON c.series = p.series AND c.idx BETWEEN s AND e GROUP BY p.series, p.bar", T.CLOCK_SQL, SPANS)
def bar_conflicts(spark, sf):
    clock = T.clock(spark, sf)
    return P.bar_conflicts(clock, P.bar_spans(clock, 4), 200.0)


@register(
    "sparse_tail",
    "SELECT series, from_bar, to_bar, CASE WHEN weak IS NULL THEN 0 ELSE to_bar - weak END AS tail, CASE WHEN inherits THEN weak - 1 END AS anchor_bar, inherits FROM (SELECT s.*, coalesce(weak >= 1 AND to_bar - weak <= 8 AND a.acoustic = '' AND a.codes = '' AND (SELECT bool_and(t.acoustic <> '' AND t.codes = '' AND (SELECT bool_and(p.period / a.mean <= 1.1 AND p.period / a.mean >= 0.9) FROM beat p WHERE p.series = t.series AND p.idx BETWEEN t.s AND t.e - 1)) FROM b t WHERE t.series = s.series AND t.bar >= weak), false) AS inherits FROM sel s LEFT JOIN b a ON a.series = s.series AND a.bar = weak - 1)",
    T.CLOCK_SQL,
    SPANS,
    "beat AS (SELECT series, idx, lead(us) OVER (PARTITION BY series ORDER BY idx) - us AS period FROM (SELECT series, idx, idx * 400000 + (idx * 7919 + series) % 50000 AS us FROM clock))",
    "b AS (SELECT p.series, p.bar, s, e, CASE WHEN count(*) FILTER (strength < 50) >= 4 THEN 'INSUFFICIENT_LOCAL_ATTACKS' ELSE '' END AS acoustic, CASE WHEN min(strength) < 1.5 THEN 'UNCERTAIN_METER_PHASE' ELSE '' END AS codes, (SELECT avg(period) FROM beat q WHERE q.series = p.series AND q.idx BETWEEN s AND e - 1) AS mean FROM spans p JOIN clock c ON c.series = p.series AND c.idx BETWEEN s AND e GROUP BY p.series, p.bar, s, e)",
    "sel AS (SELECT series, greatest(max(bar) - 3, 0) AS from_bar, max(bar) + 1 AS to_bar, (SELECT min(bar) FROM b x WHERE x.series = b.series AND x.acoustic <> '' AND x.bar >= (SELECT greatest(max(bar) - 3, 0) FROM b y WHERE y.series = b.series)) AS weak FROM b GROUP BY series)",
)
def sparse_tail(spark, sf):
    """The last four bars of a near-regular clock; a bar is weak with four faint beats and uncertain with a very faint one."""
    clock = T.clock(spark, sf)
    steady = clock.select("series", "idx", (F.col("idx") * 400_000 + (F.col("idx") * 7919 + F.col("series")) % 50_000).alias("us"))
    spans = P.bar_spans(clock, 4)
    met = Q.range_join(clock.select("series", "idx", "strength"), spans, "idx", "start_idx", "end_idx", ["series"], 16)
    bars = met.groupBy("series", "bar", "start_idx", "end_idx").agg(F.when(F.count_if(F.col("strength") < 50) >= 4, "INSUFFICIENT_LOCAL_ATTACKS").otherwise("").alias("acoustic"), F.when(F.min("strength") < 1.5, "UNCERTAIN_METER_PHASE").otherwise("").alias("codes"))
    last = spans.groupBy("series").agg(F.greatest(F.max("bar") - 3, F.lit(0)).alias("from_bar"), (F.max("bar") + 1).alias("to_bar"))
    return P.inherited_tail(steady, bars, last)


@register("removed_anti", "SELECT series, idx, 'INFERRED' AS edit FROM bd WHERE (series, idx) NOT IN (SELECT (series, idx) FROM raw) UNION ALL SELECT series, idx, 'REMOVED' FROM raw WHERE (series, idx) NOT IN (SELECT (series, idx) FROM bd)", T.CLOCK_SQL, "bd AS (SELECT series, idx FROM clock WHERE idx % 4 = 0)", "raw AS (SELECT series, idx FROM clock WHERE strength >= 50)")
def removed_anti(spark, sf):
    clock = T.clock(spark, sf)
    return P.edits(clock.where("idx % 4 = 0").select("series", "idx"), clock.where("strength >= 50").select("series", "idx"))


@register("contained_bars", 'SELECT DISTINCT p.series, p.bar FROM (SELECT p.series, p.bar, a.us AS start, b.us AS "end" FROM spans p JOIN clock a ON a.series = p.series AND a.idx = s JOIN clock b ON b.series = p.series AND b.idx = e) p JOIN sessions m ON m.series = p.series AND p.start BETWEEN m.start AND m."end" AND p."end" <= m."end"', T.CLOCK_SQL, SPANS, SESSIONS)
def contained_bars(spark, sf):
    clock = T.clock(spark, sf)
    at = lambda i, name: clock.select("series", F.col("idx").alias(i), F.col("us").alias(name))
    spans = P.bar_spans(clock, 4).join(at("start_idx", "start"), ["series", "start_idx"]).join(at("end_idx", "end"), ["series", "end_idx"]).select("series", "bar", "start", "end")
    regions = _sessions(spark, sf).select("series", F.col("start").alias("from"), F.col("end").alias("to"))
    return P.contained(spans, regions, 24 * HOUR).select("series", "bar")


@register("reason_counts", "SELECT series, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS counts, sum(n)::BIGINT AS total FROM (SELECT user_id AS series, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY series")
def reason_counts(spark, sf):
    found = P.reason_counts(T.events(spark, sf).withColumnRenamed("user_id", "series"), ["series"], "event_type")
    return found.select("series", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("counts"), "total")


@register("default_cue", f"SELECT series, coalesce(min(idx) FILTER (near), min(idx)) AS idx, coalesce(bool_or(near), false) AS on_downbeat FROM (SELECT c.series, c.idx, EXISTS (SELECT 1 FROM refclock r WHERE r.series = c.series AND abs(r.us - c.us) <= {HOUR}) AS near FROM clicks c WHERE strength >= 40) GROUP BY series", CLICKS, T.REF_SQL)
def default_cue(spark, sf):
    return P.default_cue(T.clock(spark, sf, "click"), T.clock(spark, sf, "view"), HOUR, 40.0)


_MIX = "a AS (SELECT k AS frame, x FROM signal WHERE series = 'click'), b AS (SELECT k + 480 AS frame, x AS y FROM signal WHERE series = 'view')"


def _two(spark, sf):
    signal = T.signal(spark, sf)
    side = lambda s: signal.where(F.col("series") == s).select(F.col("k").alias("frame"), "x")
    return side("click"), side("view")


@register("crossfade_mix", "SELECT frame, round(coalesce(x, 0.0) * (1.0 - power(sin(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (frame - 500) / 200.0::DOUBLE)) * pi() / 2), 2)) + coalesce(y, 0.0) * power(sin(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (frame - 500) / 200.0::DOUBLE)) * pi() / 2), 2), 6) AS mix FROM a FULL JOIN b USING (frame)", T.SIGNAL_SQL, _MIX)
def crossfade_mix(spark, sf):
    return P.crossfade(*_two(spark, sf), 480, 500, 700).withColumn("mix", F.round("mix", 6))


@register("overlap_mix", "SELECT frame, round(0.46::DOUBLE * (coalesce(x, 0.0) + coalesce(y, 0.0)), 6) AS mix FROM a FULL JOIN b USING (frame)", T.SIGNAL_SQL, _MIX)
def overlap_mix(spark, sf):
    return P.overlap(*_two(spark, sf), 480).withColumn("mix", F.round("mix", 6))


@register(
    "timeline_bounds",
    "SELECT plan_id, mode, s AS start_frame, e AS end_frame, e - s AS frames FROM (SELECT plan_id, mode, CASE WHEN mode = 'OVERLAP' THEN least(0, origin) ELSE 0 END AS s, greatest(0, CASE WHEN mode = 'OVERLAP' THEN n ELSE least(n, fade) END, origin + m) AS e FROM (SELECT o_orderkey AS plan_id, floor(o_totalprice)::BIGINT AS n, o_custkey * 100 - 50000 AS origin, o_orderkey % 1000 * 300 AS m, o_custkey * 200 AS fade FROM orders) CROSS JOIN (VALUES ('OVERLAP'), ('TRANSITION')) t(mode))",
)
def timeline_bounds(spark, sf):
    plans = T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("plan_id"), F.floor("o_totalprice").alias("out_frames"), (F.col("o_custkey") * 100 - 50000).alias("origin"), (F.col("o_orderkey") % 1000 * 300).alias("in_frames"), (F.col("o_custkey") * 200).alias("fade_end"))
    return P.timeline_bounds(plans)


@register("range_read", "SELECT s.series, f.frame, coalesce(g.x, 0.0) AS x FROM (SELECT DISTINCT series FROM signal) s CROSS JOIN (SELECT unnest(range(700, 760)) AS frame) f LEFT JOIN signal g ON g.series = s.series AND g.k = f.frame", T.SIGNAL_SQL)
def range_read(spark, sf):
    chunks = T.signal(spark, sf).groupBy("series", (F.floor(F.col("k") / 64) * 64).alias("start_frame")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda e: e["x"]).alias("samples"))
    return P.read_range(chunks, 700, 60, 64)
