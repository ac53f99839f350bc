"""Candidate evaluation, regional phase support and declared grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import selection as X
from ..operators.clock import measured_period
from ..sources import tables as T
from . import clock_queries as CQ
from .registry import register

HOUR = T.HOUR_US


@register("reference_segments", "SELECT series, idx, coalesce(sum(CASE WHEN period_us IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS segment FROM rm", T.REF_SQL, CQ.RIV, CQ.REF_MEASURED)
def reference_segments(spark, sf):
    return X.reference_segments(measured_period(T.clock(spark, sf, "view"))).select("series", "idx", "segment")


@register("phase_ranges")
def phase_ranges(spark, sf):
    """Twenty events keep a phase, give or take a twentieth, before the next one; every fifty are a segment of the reference."""
    i = F.col("idx")
    held = (F.floor(i / 20) * 0.13 + (i * 7919 + F.col("series")) % 100 / 1000.0) % 1
    return X.phase_ranges(T.clock(spark, sf).select("series", "idx", "us", held.alias("phase"), F.lit(0.08).alias("tolerance"), F.floor(i / 50).alias("segment")))


_CANDIDATES = "cd AS (SELECT o_custkey AS series, 60.0::DOUBLE + o_orderkey % 100 AS bpm, (o_orderkey % 37) / 37.0::DOUBLE AS support, 60.0::DOUBLE + (o_orderkey + o_orderkey % 7) % 100 AS tracked_bpm, (50 + o_orderkey % 50) / 100.0::DOUBLE AS agreement, (o_orderkey % 11) / 11.0::DOUBLE AS consistency, (o_orderkey % 13) / 13.0::DOUBLE AS onset, (['DIRECT_ALIGNMENT', 'STABLE_OFFSET', 'REGIONAL_SUPPORT', 'INCOHERENT'])[1 + o_orderkey % 4] AS relation FROM orders)"
_EVALUATED = (
    "ev AS (SELECT *, 0.55 * agreement + 0.25 * consistency + 0.10 * onset + 0.10 * support / greatest(1e-9, max(support) OVER (PARTITION BY series)) AS score, "
    "concat_ws(',', CASE WHEN abs(ln(tracked_bpm / bpm)) > 0.08 THEN 'TEMPO_NOT_PRESERVED' END, CASE WHEN agreement < 0.55 THEN 'CADENCE_NOT_CORROBORATED' END, CASE WHEN relation = 'INCOHERENT' THEN 'NO_PHASE_SUPPORT' END, CASE WHEN relation = 'STABLE_OFFSET' AND onset < 0.5 THEN 'OFFSET_WITHOUT_ATTACKS' END, CASE WHEN onset < 0.35 THEN 'TOO_FEW_ATTACKS' END) AS reasons FROM cd)"
)


def _candidates(spark, sf):
    k = F.col("o_orderkey")
    relation = F.get(F.array(*map(F.lit, ("DIRECT_ALIGNMENT", "STABLE_OFFSET", "REGIONAL_SUPPORT", "INCOHERENT"))), (k % 4).cast("int"))
    return T.table(spark, sf, "orders").select(F.col("o_custkey").alias("series"), (60.0 + k % 100).alias("bpm"), (k % 37 / 37.0).alias("support"), (60.0 + (k + k % 7) % 100).alias("tracked_bpm"), ((50 + k % 50) / 100.0).alias("agreement"), (k % 11 / 11.0).alias("consistency"), (k % 13 / 13.0).alias("onset_agreement"), relation.alias("relation"))


@register("candidate_scores", "SELECT series, bpm, round(score, 6) AS score, reasons FROM ev", _CANDIDATES, _EVALUATED)
def candidate_scores(spark, sf):
    found = X.evaluate(_candidates(spark, sf))
    return found.select("series", "bpm", F.round("score", 6).alias("score"), F.array_join("reasons", ",").alias("reasons"))


@register(
    "candidate_choice",
    "SELECT a.series, any_value(a.bpm) AS bpm, round(any_value(a.score), 6) AS score, bool_or(b.r > 1 AND a.score - b.score < 0.08 AND abs(ln(b.bpm / a.bpm)) > 0.04) AS ambiguous FROM gd a JOIN gd b USING (series) WHERE a.r = 1 GROUP BY a.series",
    _CANDIDATES,
    _EVALUATED,
    "gd AS (SELECT series, bpm, score, row_number() OVER (PARTITION BY series ORDER BY score DESC, bpm) AS r FROM ev WHERE reasons = '')",
)
def candidate_choice(spark, sf):
    return X.choose(X.evaluate(_candidates(spark, sf))).withColumn("score", F.round("score", 6))


_DECLARED = "dc AS (SELECT series, idx // 2 AS m, idx + CASE WHEN series % 17 = 0 AND idx = 8 THEN 1000 ELSE 0 END AS canonical_idx, idx % 8 = 0 AS boundary FROM clock WHERE idx % 2 = 0)"


def _declared(spark, sf):
    wrong = F.when((F.col("series") % 17 == 0) & (F.col("idx") == 8), 1000).otherwise(0)
    return T.clock(spark, sf).where("idx % 2 = 0").select("series", F.floor(F.col("idx") / 2).alias("m"), (F.col("idx") + wrong).alias("canonical_idx"), (F.col("idx") % 8 == 0).alias("boundary"))


@register(
    "declared_grid",
    "SELECT d.series, n, CASE WHEN n < 2 THEN 'TOO_FEW_MAIN_BEATS' WHEN NOT up THEN 'NOT_INCREASING' WHEN low < 0 OR high >= size THEN 'OUTSIDE_CLOCK' WHEN NOT f OR NOT l THEN 'OPEN_BAR' END AS declined FROM (SELECT series, count(*) AS n, bool_and(up) AS up, min(canonical_idx) AS low, max(canonical_idx) AS high, min_by(boundary, m) AS f, max_by(boundary, m) AS l FROM (SELECT *, coalesce(canonical_idx > lag(canonical_idx) OVER (PARTITION BY series ORDER BY m), true) AS up FROM dc) GROUP BY series) d JOIN (SELECT series, max(idx) + 1 AS size FROM clock GROUP BY series) c ON c.series = d.series",
    T.CLOCK_SQL,
    _DECLARED,
)
def declared_grid(spark, sf):
    return X.declared_grid(_declared(spark, sf), T.clock(spark, sf))


@register(
    "declared_bars",
    "SELECT e.series, bar, m_start, m_end, start_idx, end_idx, a.us AS start_us, b.us AS end_us FROM (SELECT series, row_number() OVER w - 1 AS bar, m AS m_start, lead(m) OVER w AS m_end, canonical_idx AS start_idx, lead(canonical_idx) OVER w AS end_idx FROM dc WHERE boundary WINDOW w AS (PARTITION BY series ORDER BY m)) e JOIN clock a ON a.series = e.series AND a.idx = start_idx JOIN clock b ON b.series = e.series AND b.idx = end_idx",
    T.CLOCK_SQL,
    _DECLARED,
)
def declared_bars(spark, sf):
    return X.declared_bars(_declared(spark, sf), T.clock(spark, sf))


@register("pinned_main_beats", "SELECT c.series, c.idx, d.m FROM clock c LEFT JOIN dc d ON d.series = c.series AND d.canonical_idx = c.idx WHERE strength >= 200", T.CLOCK_SQL, _DECLARED)
def pinned_main_beats(spark, sf):
    return X.pinned_main_beats(T.clock(spark, sf).where("strength >= 200").select("series", "idx"), _declared(spark, sf))


@register(
    "merged_reasons",
    f"SELECT series, min(start) AS start, max(\"end\") AS \"end\", array_to_string(list_sort(list(DISTINCT reason)), ',') AS reasons FROM (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY start, \"end\" ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, max(\"end\") OVER (PARTITION BY series ORDER BY start, \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT user_id AS series, epoch_us(ts) - 1704067200000000 AS start, epoch_us(ts) - 1704067200000000 + {8 * HOUR} AS \"end\", event_type AS reason FROM events))) GROUP BY series, run",
)
def merged_reasons(spark, sf):
    ranges = T.events(spark, sf).select(F.col("user_id").alias("series"), F.col("us").alias("start"), (F.col("us") + 8 * HOUR).alias("end"), F.col("event_type").alias("reason"))
    return X.merged_reasons(ranges).withColumn("reasons", F.array_join("reasons", ","))
