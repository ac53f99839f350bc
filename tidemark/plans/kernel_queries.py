"""Queries over sequential and dense kernels; SQL can't state them, the tests hold them against analytic cases."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import facade as FC
from ..operators import kernel_ops as K
from ..operators import signal as S
from ..sources import tables as T
from .clock_queries import _knots
from .registry import register


def _waves(spark, sf, rate: int):
    """All embeddings of a label end to end, as one signal."""
    found = T.table(spark, sf, "embeddings").groupBy(F.col("label").cast("string").alias("series"))
    listed = found.agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("_l"))
    return listed.select("series", F.lit(rate).alias("rate"), F.flatten(F.transform("_l", lambda x: F.transform(x["embedding"], lambda v: v.cast("double")))).alias("samples"))


@register("dp_beat_track")
def dp_beat_track(spark, sf):
    return K.beat_track(T.signal(spark, sf), 24.0, 0.05)


@register("hmm_bars")
def hmm_bars(spark, sf):
    clock = T.clock(spark, sf)
    return K.track_bars(clock.select("series", "idx", ((F.col("strength") - 50.0) / 20.0).alias("logit")))


@register("meter_regions")
def meter_regions(spark, sf):
    return K.meter_regions(hmm_bars(spark, sf))


@register("greedy_dedupe")
def greedy_dedupe(spark, sf):
    return K.remove_duplicates(T.clock(spark, sf), T.clock(spark, sf, "view"))


@register("clock_fit")
def clock_fit(spark, sf):
    paired = T.clock(spark, sf).select("series", "idx", (F.col("idx") * 0.4 + 0.02 * (F.col("strength") % 1.0)).alias("raw_s"), (F.col("idx") * 0.4).alias("output_s"))
    return K.regularise(paired)


@register("adaptive_anchors")
def adaptive_anchors(spark, sf):
    return K.anchors(_knots(spark, sf))


@register("yin_pitch")
def yin_pitch(spark, sf):
    return K.yin_pitch(_waves(spark, sf, 10000))


@register("logmel")
def logmel(spark, sf):
    return K.log_mel(_waves(spark, sf, 22050))


@register("stft_features")
def stft_features(spark, sf):
    return K.stft_features(_waves(spark, sf, 4000))


@register("model_stitch")
def model_stitch(spark, sf):
    """Log mel frames in overlapping chunks through the stand-in model, stitched keeping the first chunk of a frame."""
    mel = logmel(spark, sf)
    sizes = mel.groupBy("series").agg((F.max("frame") + 1).alias("n"))
    placed = S.chunks(sizes, 64, 6).join(mel, "series").where((F.col("frame") >= F.col("start")) & (F.col("frame") < F.col("start") + 64))
    packed = placed.groupBy("series", "chunk", "start").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "bins"))), lambda x: x["bins"]).alias("bins"))
    return K.infer(packed, K.energy_backend).join(S.stitch(S.chunks(sizes, 64, 6), 64, 6), ["series", "chunk", "frame"])


def _songs(spark, sf):
    """Customers as songs, each paired with the next: orders are bars, their lines the pulses of a near-regular clock."""
    bars = T.bars(spark, sf)
    marked = bars.select("series", "bar", "pulses", (F.col("score") > 30_000).alias("usable"), (F.col("score") / 1e6).alias("score"))
    ends = bars.groupBy("series").agg(F.sum("pulses").alias("n"))
    clocks = ends.withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n")))).select("series", "idx", (F.col("idx") * 400_000 + (F.col("idx") * F.col("idx") * 7919 + F.col("series")) % 20_000).alias("us"))
    pairs = ends.select(F.col("series").alias("pair"), F.col("series").alias("a"), (F.col("series") + 1).alias("b"))
    return pairs, marked, clocks


@register("transition_plans")
def transition_plans(spark, sf):
    return FC.best_transition(*_songs(spark, sf))


@register("exact_plans")
def exact_plans(spark, sf):
    return FC.auto_transition(*_songs(spark, sf), 2)


@register(
    "overlap_candidates",
    "SELECT pair, position, a_bar, b_bar, n_bars, a_start_idx, a_end_idx FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY t(a_end_idx, a) - t(a_start_idx, a) DESC, b_bar, a_bar) AS position FROM (SELECT *, count(*) OVER rest AS n_bars, max(a_last) OVER rest AS a_end_idx FROM (SELECT *, a_bar - row_number() OVER (PARTITION BY pair, a_bar - b_bar ORDER BY a_bar) AS g FROM (SELECT a.series AS pair, a.series AS a, a.bar AS a_bar, b.bar AS b_bar, a.s AS a_start_idx, a.e AS a_last FROM ub a JOIN ub b ON b.series = a.series + 1 AND a.pulses = b.pulses)) WINDOW rest AS (PARTITION BY pair, a_bar - b_bar, g ORDER BY a_bar ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) WHERE n_bars >= 2) WHERE position <= 64".replace("t(a_end_idx, a)", "(a_end_idx * 400000 + (a_end_idx * a_end_idx * 7919 + a) % 20000)").replace("t(a_start_idx, a)", "(a_start_idx * 400000 + (a_start_idx * a_start_idx * 7919 + a) % 20000)"),
    T.BARS_SQL,
    "ub AS (SELECT * FROM (SELECT series, bar, pulses, score > 30000 AS ok, sum(pulses) OVER (PARTITION BY series ORDER BY bar)::BIGINT AS e, (sum(pulses) OVER (PARTITION BY series ORDER BY bar) - pulses)::BIGINT AS s FROM bars) WHERE ok)",
)
def overlap_candidates(spark, sf):
    found = FC.overlap_candidates(*_songs(spark, sf), rate=1_000_000)
    return found.select("pair", "position", "a_bar", "b_bar", "n_bars", "a_start_idx", "a_end_idx")


@register("overlap_plans")
def overlap_plans(spark, sf):
    return FC.overlap(*_songs(spark, sf))


def _declared(spark, sf):
    """Every second pulse of a customer's clock as a main beat, four of them a bar; every fifth bar lacks its provider's support."""
    pairs, _, clocks = _songs(spark, sf)
    mains = clocks.where("idx % 2 = 0").withColumn("m", F.floor(F.col("idx") / 2)).withColumn("n", F.max("m").over(Window.partitionBy("series")))
    declared = mains.where(F.col("m") <= F.floor(F.col("n") / 4) * 4).select("series", "m", F.col("idx").alias("canonical_idx"), (F.col("m") % 4 == 0).alias("boundary"), (F.col("m") % 20 != 16).alias("supported"))
    safe = clocks.select("series").distinct().withColumn("safe", F.col("series") % 7 != 0)
    regions = clocks.groupBy("series").agg(F.lit(0).cast("long").alias("from"), (F.floor(F.max("idx") / 2)).alias("to"))
    return pairs, declared, clocks, safe, regions


@register("declared_plans")
def declared_plans(spark, sf):
    pairs, *songs = _declared(spark, sf)
    asked = pairs.select("*", (F.col("pair") % 3).alias("a_bar"), (F.col("pair") % 2).alias("b_bar"), F.lit(2).alias("n_bars"))
    return FC.declared_transition(asked, *songs)


@register("declared_auto_plans")
def declared_auto_plans(spark, sf):
    return FC.declared_auto_transition(*_declared(spark, sf), n_bars=2)


@register("pulse_plans")
def pulse_plans(spark, sf):
    """Two bars from each customer to the next, whose clocks are now an octave apart and now not."""
    bars = T.bars(spark, sf)
    marked = bars.select("series", "bar", "pulses", (F.col("score") > 1_000).alias("usable"), "score")
    ends = bars.groupBy("series").agg(F.sum("pulses").alias("n"))
    period = F.when(F.col("series") % 3 == 0, 800_000).otherwise(400_000)
    clocks = ends.withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n")))).select("series", "idx", (F.col("idx") * period + (F.col("idx") * F.col("idx") * 7919 + F.col("series")) % 20_000).alias("us"))
    chosen = ends.select(F.col("series").alias("pair"), F.col("series").alias("a"), (F.col("series") + 1).alias("b"), F.lit(1).cast("long").alias("a_bar"), F.lit(0).cast("long").alias("b_bar"), F.lit(2).alias("n_bars"))
    return FC.transition(chosen, marked, clocks)
