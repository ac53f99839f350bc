"""Transitions: accepted as they are, after a fit, or declined by code."""

import inspect

import numpy as np
from pyspark.sql import functions as F

from tidemark import api
from tidemark.kernels import fit
from tidemark.operators import transitions
from tidemark.plans import catalog


def song(series, meters, period, jitter=0.0, usable=True, seed=0):
    n = sum(meters)
    rng = np.random.default_rng(seed)
    times = 0.2 + period * np.arange(n + 1) + jitter * rng.uniform(-1, 1, n + 1)
    bars = [(series, i, m, usable, 0.1 * i) for i, m in enumerate(meters)]
    return bars, [(series, i, int(round(t * 1e6))) for i, t in enumerate(times)]


def plans(spark, *songs, pairs, lengths=(2, 4)):
    bars = spark.createDataFrame([b for s in songs for b in s[0]], "series long, bar long, pulses long, usable boolean, score double")
    clocks = spark.createDataFrame([c for s in songs for c in s[1]], "series long, idx long, us long")
    asked = spark.createDataFrame(pairs, "pair long, a long, b long")
    return {r.pair: r for r in api.plan_transitions(asked, bars, clocks, lengths).collect()}


def test_plans_and_codes(spark):
    got = plans(
        spark,
        song(1, [4] * 12, 0.4),
        song(2, [4] * 12, 0.41),
        song(3, [3] * 12, 0.4),
        song(4, [4] * 12, 0.4, usable=False),
        song(5, [4] * 12, 0.4, jitter=0.021, seed=3),
        song(6, [4] * 12, 1.3),
        pairs=[(1, 1, 2), (2, 1, 3), (3, 1, 4), (4, 1, 5), (5, 1, 6)],
    )
    assert got[1].declined is None and not got[1].fitted and got[1].n_bars == 4 and abs(got[1].min_speed - 0.41 / 0.4) < 1e-3
    assert got[2].declined == "NO_COMPATIBLE_BAR_RANGE" and got[3].declined == "NO_CONFIDENT_BAR_GRID"
    assert got[4].declined is None and got[4].fitted and got[4].max_s <= 0.020 + 1e-9
    assert got[5].declined in ("CLOCK_REJECTED", "SEARCH_LIMIT_REACHED")


def test_all_of_the_reference_lengths_are_candidates(spark):
    songs = [song(1, [4] * 40, 0.4), song(2, [4] * 40, 0.41)]
    bars = spark.createDataFrame([b for s in songs for b in s[0]], "series long, bar long, pulses long, usable boolean, score double")
    clocks = spark.createDataFrame([c for s in songs for c in s[1]], "series long, idx long, us long")
    (got,) = api.plan_transitions(spark.createDataFrame([(1, 1, 2)], "pair long, a long, b long"), bars.withColumn("score", F.lit(0.0)), clocks).collect()
    assert got.declined is None and got.n_bars == 8
    wanted = {n: 2 * (40 - n + 1) for n in (2, 4, 8, 16, 32)}
    assert {r.n_bars: r["count"] for r in transitions.starts(bars, inspect.signature(transitions.plan).parameters["lengths"].default).groupBy("n_bars").count().collect()} == wanted


def test_the_query_prefers_eight_bars_of_a_steady_meter(spark, tmp_path):
    orders = [(100 * c + i, c, f"2024-01-{i + 1:02d}", 50_000.0) for c in (1, 2) for i in range(12)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(o[0],) for o in orders for _ in range(4)], "l_orderkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.pair: r for r in catalog.queries()["transition_plans"](spark, str(tmp_path)).collect()}
    assert got[1].declined is None and got[1].n_bars == 8


def test_pulse_ratios(spark):
    songs = [
        song(1, [4] * 8, 0.4),
        song(2, [2] * 16, 0.8),
        song(3, [3] * 20, 0.2),
        song(4, [3] * 20, 0.41),
        song(5, [3] * 20, 1.3),
        song(6, [3, 4, 4, 4], 0.8),
        song(7, [3] * 20, 0.4, jitter=0.021, seed=8),
        song(8, [2, 2], 0.4),
        song(9, [5] * 8, 0.4, usable=False),
        song(10, [4] * 8, 0.8),
        song(11, [5] * 8, 0.4),
        song(12, [2] * 40, 0.8, jitter=0.1, seed=1),
    ]
    bars = spark.createDataFrame([b for s in songs for b in s[0]], "series long, bar long, pulses long, usable boolean, score double")
    clocks = spark.createDataFrame([c for s in songs for c in s[1]], "series long, idx long, us long")
    asked = [(i, 1, i, 2, 0, 2) for i in range(2, 13)] + [(20, 11, 2, 1, 0, 1), (21, 1, 99, 0, 0, 2), (22, 1, 2, 7, 0, 2), (23, 9, 1, 0, 0, 1)]
    got = {r.pair: r for r in api.plan_pulses(spark.createDataFrame(asked, "pair long, a long, b long, a_bar long, b_bar long, n_bars int"), bars, clocks).collect()}
    ratio = {i: (r.a_pulses, r.b_pulses, r.end_position) for i, r in got.items() if r.declined is None}
    assert ratio[2] == (2, 1, 4.0) and abs(got[2].min_speed - 1) < 1e-6 and not got[2].fitted  # octave slower
    assert ratio[3] == (1, 2, 16.0) and got[3].tried == 1  # octave faster
    assert ratio[4] == (1, 1, 8.0)  # other meter, same tempo
    assert ratio[6] == (2, 1, 4.0)  # the fade ends inside a bar of b
    assert ratio[7] == (1, 1, 8.0) and got[7].fitted and got[7].max_s <= 0.025  # accepted after a fit
    assert ratio[10] == (1, 1, 8.0) and abs(got[10].min_speed - 2) < 1e-6  # equal bars keep the beats paired
    assert ratio[20] == (2, 1, 2.5)  # an odd count ends between two beats of b
    assert got[5].declined == "CLOCK_REJECTED" and got[8].declined == "NO_BAR_RANGE" and got[9].declined == "UNUSABLE_BARS"
    assert (got[12].declined, got[12].tried) == ("CLOCK_REJECTED", 2)  # 2:1 rejected, then 1:1
    assert got[21].declined == got[22].declined == "NO_BAR_RANGE" and got[23].declined == "UNUSABLE_BARS"


def test_the_next_cycle_is_tried_when_one_is_rejected():
    ta, a = np.arange(9) * 0.4, np.array([0, 4, 8])
    tb = np.arange(30) * 0.8
    tb[14:] += 2.0  # 1:1 would need beats up to here, 2:1 does not
    ok = np.ones(2, bool)
    assert transitions._pulses(ta, a, ok, tb, np.arange(10) * 3, np.ones(9, bool), 0, 3, 2)["a_pulses"] == 2
    short = transitions._pulses(ta, a, ok, tb[:13] / 2.0, np.array([0, 3, 6, 9, 12]), np.ones(4, bool), 0, 0, 2)
    assert (short["a_pulses"], short["tried"]) == (1, 1)
    fast = np.arange(10) * 0.22  # an octave faster, but 1:2 needs 16 beats and there are 9
    got = transitions._pulses(ta, a, ok, fast, np.array([0, 3, 6, 9]), np.ones(3, bool), 0, 0, 2)
    assert (got["a_pulses"], got["b_pulses"], got["tried"]) == (1, 1, 2) and got["declined"] is None


def test_rates_of_a_known_map():
    x = np.arange(0, 40, 0.4)
    y = x + 0.06 * np.sin(x / 2)
    low, high, rate = fit.warp_rates(x, y)
    assert abs(low - 0.97) < 2e-3 and abs(high - 1.03) < 2e-3 and rate < 0.05


def test_every_name_of_the_api_is_there():
    assert all(callable(getattr(api, n)) for n in api.__all__)


def test_overlap_is_trimmed_to_both(spark):
    clock = spark.createDataFrame([(s, i, i) for s, n in ((1, 10), (2, 5)) for i in range(n)], "series long, idx long, us long")
    pairs = spark.createDataFrame([(1, 1, 2)], "pair long, a long, b long")
    r = api.beat_overlap(clock, clock, F.lit(-2).cast("long"), pairs).first()
    assert (r.first_idx, r.last_idx, r.declined) == (2, 6, None)
