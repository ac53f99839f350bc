"""The ways to ask for a transition, on cases worked out by hand."""

import collections

import pytest
from pyspark.sql import functions as F

from tidemark.operators import facade

from test_transitions import song


def tables(spark, *songs):
    bars = spark.createDataFrame([b for s in songs for b in s[0]], "series long, bar long, pulses long, usable boolean, score double")
    return bars, spark.createDataFrame([c for s in songs for c in s[1]], "series long, idx long, us long")


def pairs_of(spark, *pairs):
    return spark.createDataFrame([(i + 1, a, b) for i, (a, b) in enumerate(pairs)], "pair long, a long, b long")


def test_exact_lengths(spark):
    bars, clocks = tables(spark, song(1, [4] * 20, 0.4), song(2, [4] * 20, 0.41), song(3, [4] * 6, 0.4))
    pairs = pairs_of(spark, (1, 2), (1, 3))
    got = {r.pair: r for r in facade.auto_transition(pairs, bars, clocks, 16).collect()}
    assert got[1].n_bars == 16 and got[1].declined is None and got[2].declined == "NO_COMPATIBLE_BAR_RANGE"
    assert {r.pair: r.n_bars for r in facade.best_transition(pairs, bars, clocks).collect()} == {1: 8, 2: 4}
    with pytest.raises(ValueError):
        facade.auto_transition(pairs, bars, clocks, 3)
    asked = spark.createDataFrame([(1, 1, 2, 4, 0, 8), (2, 1, 2, 4, 0, 5), (3, 1, 2, 15, 0, 8)], "pair long, a long, b long, a_bar long, b_bar long, n_bars int")
    assert {r.pair: r.declined for r in facade.transition(asked, bars, clocks).collect()} == {1: None, 2: "UNSUPPORTED_BAR_COUNT", 3: "NO_BAR_RANGE"}


def test_overlaps_are_the_longest_common_spans(spark):
    one = [3, 4, 4, 4, 4, 3, 3, 4, 4]
    two = [4, 4, 4, 3, 3, 4, 4, 4]
    bars, clocks = tables(spark, song(1, one, 0.4), song(2, two, 0.405), song(3, [5] * 9, 0.4), song(4, two, 0.4, usable=False), song(5, one, 1.4))
    pairs = pairs_of(spark, (1, 2), (1, 3), (1, 4), (1, 5))
    brute = []
    for i in range(len(one)):
        for j in range(len(two)):
            n = 0
            while i + n < len(one) and j + n < len(two) and one[i + n] == two[j + n]:
                n += 1
            if n >= 2:
                brute.append((-sum(one[i : i + n]), j, i, n))
    got = facade.overlap_candidates(pairs.where("pair = 1"), bars, clocks).orderBy("position").collect()
    assert [(r.b_bar, r.a_bar, r.n_bars) for r in got] == [(j, i, n) for _, j, i, n in sorted(brute)]
    assert all(r.a_end_idx - r.a_start_idx == sum(one[r.a_bar : r.a_bar + r.n_bars]) == r.b_end_idx - r.b_start_idx for r in got)
    plans = {r.pair: r for r in facade.overlap(pairs, bars, clocks).collect()}
    best = sorted(brute)[0]
    assert (plans[1].b_bar, plans[1].a_bar, plans[1].n_bars) == best[1:] and plans[1].declined is None
    assert plans[2].declined == "NO_COMPATIBLE_BAR_RANGE" and plans[3].declined == "NO_CONFIDENT_BAR_GRID" and plans[4].declined in ("CLOCK_REJECTED", "SEARCH_LIMIT_REACHED")


def declared_songs(spark, periods, per_bar=(4,) * 12, every=2, unsupported=(), broken=()):
    """Songs whose main beats are every ``every``-th beat of their clock."""
    clock, declared = [], []
    for series, period in periods.items():
        n = sum(per_bar) * every + 1
        clock += [(series, i, round((0.3 + period * i) * 1e6)) for i in range(n)]
        edges = [sum(per_bar[:i]) for i in range(len(per_bar) + 1)]
        for m in range(sum(per_bar) + 1):
            at = m * every + (1000 if (series, m) in broken else 0)
            declared.append((series, m, at, m in edges, not (m in edges and (series, edges.index(m)) in unsupported)))
    return spark.createDataFrame(clock, "series long, idx long, us long"), spark.createDataFrame(declared, "series long, m long, canonical_idx long, boundary boolean, supported boolean")


def regions_of(spark, *regions):
    return spark.createDataFrame([*regions], "series long, from long, to long")


def test_declared_transitions_and_their_codes(spark):
    clock, declared = declared_songs(spark, {1: 0.2, 2: 0.205, 3: 0.9, 4: 0.2}, unsupported=[(1, 9)], broken=[(4, 7)])
    odd_clock, odd = declared_songs(spark, {5: 0.2}, per_bar=(4, 4, 3, 4, 4, 4, 4, 4))
    clock, declared = clock.unionByName(odd_clock), declared.unionByName(odd)
    safe = spark.createDataFrame([(s, s != 2) for s in (1, 2, 3, 4, 5)], "series long, safe boolean")
    regions = regions_of(spark, (2, 0, 49), (2, 48, 97))
    cases = {
        1: ((1, 2, 4, 1, 4), None), 2: ((1, 2, 4, 4, 4), "UNSUPPORTED_PULSE_RANGE"), 3: ((1, 2, 7, 0, 4), "UNSUPPORTED_BAR_RANGE"), 4: ((1, 2, 2, 11, 2), "UNSUPPORTED_BAR_RANGE"),
        5: ((1, 5, 0, 1, 2), "INCOMPATIBLE_MAIN_METER"), 6: ((1, 5, 0, 3, 4), None), 7: ((1, 3, 0, 0, 4), "CLOCK_REJECTED"), 8: ((1, 4, 0, 0, 4), "OUTSIDE_CLOCK"), 9: ((1, 2, 0, 0, 3), "UNSUPPORTED_BAR_COUNT"),
    }
    asked = spark.createDataFrame([(k, *v) for k, (v, _) in cases.items()], "pair long, a long, b long, a_bar long, b_bar long, n_bars int")
    got = {r.pair: r for r in facade.declared_transition(asked, declared, clock, safe, regions).collect()}
    said = {k: r.declined for k, r in got.items()}
    assert {k: v if v != "NOT_INCREASING" else "OUTSIDE_CLOCK" for k, v in said.items()} == {k: v for k, (_, v) in cases.items()}
    assert abs(got[1].min_speed - 1.025) < 1e-6 and not got[1].fitted
    pins = lambda *idx: spark.createDataFrame([(1, i) for i in idx], "pair long, idx long")
    one = asked.where("pair = 1")
    assert [r.declined for r in facade.declared_transition(one, declared, clock, safe, regions, pins=pins(8, 12, 40)).collect()] == [None]
    for stray in (9, 42, 0):
        assert [r.declined for r in facade.declared_transition(one, declared, clock, safe, regions, pins=pins(10, stray)).collect()] == ["UNMAPPED_CANONICAL_PIN"]


def test_declared_cues_are_early_in_and_late_out(spark):
    clock, declared = declared_songs(spark, {1: 0.2, 2: 0.203, 3: 0.95}, unsupported=[(2, 0), (1, 11)])
    safe = clock.select("series").distinct().withColumn("safe", F.lit(True))
    none = spark.createDataFrame([], "series long, from long, to long")
    got = {r.pair: r for r in facade.declared_auto_transition(pairs_of(spark, (1, 2), (1, 3), (2, 1)), declared, clock, safe, none, n_bars=4).collect()}
    assert (got[1].b_bar, got[1].a_bar, got[1].declined) == (1, 7, None) and got[2].declined in ("NO_COMPATIBLE_SUPPORTED_RANGE", "SEARCH_LIMIT_REACHED")
    assert (got[3].b_bar, got[3].a_bar) == (0, 8)
    weak = regions_of(spark, (2, 24, 97), (1, 0, 97))
    unsafe = safe.withColumn("safe", F.lit(False))
    got = {r.pair: r for r in facade.declared_auto_transition(pairs_of(spark, (1, 2)), declared, clock, unsafe, weak, n_bars=4, budget=40).collect()}
    assert (got[1].b_bar, got[1].a_bar) == (3, 7)
    assert collections.Counter(r.declined for r in facade.declared_auto_transition(pairs_of(spark, (1, 2)), declared, clock, unsafe, weak, n_bars=4, budget=3).collect()) == {"SEARCH_LIMIT_REACHED": 1}


def test_beat_overlaps_pair_all_shared_beats(spark):
    sizes = {1: 60, 2: 50, 3: 40, 4: 40, 5: 60}
    clock = spark.createDataFrame([(s, i, round((0.2 + (0.4 if s != 5 else 1.3) * i) * 1e6)) for s, n in sizes.items() for i in range(n)], "series long, idx long, us long")
    flags = [(s, i, not (s == 4 and i in (20, 21)), i < 2 or i >= n - 3, False) for s, n in sizes.items() for i in range(n - 1)]
    flags = spark.createDataFrame(flags, "series long, i long, active boolean, missing boolean, nonrecurring boolean")
    safe = spark.createDataFrame([(s, s != 3) for s in sizes], "series long, safe boolean")
    regions = regions_of(spark, (3, 0, 20), (3, 19, 40))
    downbeats = spark.createDataFrame([(1, 200_000), (1, 1_850_000), (1, 2_300_000), (2, 1_400_000)], "series long, us long")
    cues = {r.series: r.idx for r in facade.supported_cues(clock, downbeats, safe, regions, facade.prefix_index(flags)).collect()}
    # 1's first downbeat lies where evidence is missing, its second is 50 ms from beat 4; 2's is on beat 3; the others have none.
    assert cues == {1: 4, 2: 3, 3: 2, 4: 2, 5: 2}
    pairs = spark.createDataFrame([(1, 1, 2, None, None), (2, 1, 3, None, None), (3, 1, 4, None, None), (4, 1, 5, None, None), (5, 1, 2, 56, 4), (6, 1, 2, 0, 4), (7, 2, 1, 40, 3)], "pair long, a long, b long, a_cue long, b_cue long")
    got = {r.pair: r for r in facade.beat_overlap_plan(pairs, clock, safe, regions, flags, downbeats).collect()}
    assert {k: r.declined for k, r in got.items()} == {1: None, 2: "UNSUPPORTED_SHARED_COVERAGE", 3: "UNSUPPORTED_SHARED_COVERAGE", 4: "CLOCK_REJECTED", 5: None, 6: "NO_SUPPORTED_CUE", 7: None}
    # Beats 1 to 50 of the first meet 0 to 49 of the second; what isn't observed at either end goes.
    assert tuple(got[1])[5:9] == (3, 48, 2, 47)
    assert tuple(got[5])[3:9] == (56, 4, 54, 57, 2, 5) and tuple(got[7])[5:9] == (39, 47, 2, 10)
    assert got[1].min_speed == pytest.approx(1) and not got[1].fitted
