"""Rules of the reference, on cases worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import api
from tidemark.kernels import beats, dsp
from tidemark.operators import evidence, planning, repair

SONG = "struct<key:string,key_confidence:double,bpm:double,centroid_hz:double,rms_db:double>"
BASE = {"key": "C major", "key_confidence": 0.2, "bpm": 120.0, "centroid_hz": 2000.0, "rms_db": -10.0}


def affinities(spark, *others):
    rows = [(i, BASE, BASE | o) for i, o in enumerate(others)]
    found = spark.createDataFrame(rows, f"i int, a {SONG}, b {SONG}").select("i", api.song_affinity(F.col("a"), F.col("b")).alias("x")).collect()
    return [r.x for r in sorted(found)]


def test_affinity_gates_and_weights(spark):
    got = affinities(spark, {}, {"key": "a MINOR"}, {"key": "G major"}, {"key": "D major"}, {"key": "G minor"}, {"key": "unknown"}, {"key": None}, {"key_confidence": 0.119}, {"key_confidence": 0.12})
    assert got == pytest.approx([1, 1, 1, 0, 0, 0, 0, 0, 0.30 * 0.75 + 0.7])
    got = affinities(spark, {"bpm": 120 * 1.04**0.19}, {"bpm": 120 * 1.04**0.21}, {"centroid_hz": 2000 * 1.25**0.49}, {"centroid_hz": 2000 * 1.25**0.51}, {"rms_db": -13.0}, {"rms_db": -13.1}, {"bpm": math.nan}, {"bpm": 0.0}, {"rms_db": -math.inf}, {"centroid_hz": None})
    assert got == pytest.approx([1 - 0.25 * 0.19, 0, 1 - 0.25 * 0.49, 0, 0.9, 0, 0, 0, 0, 0])


def test_affinity_of_flat_and_sharp_keys(spark):
    rows = [("Bb minor", "D♭ major", True), ("F♯ minor", "A major", True), ("A major", "F# minor", True), ("Cb major", "B major", True), ("C major", "F major", True), ("C major", "C minor", False), ("H major", "H major", False), ("C", "C", False)]
    from tidemark.operators.repair import harmonic_keys

    got = spark.createDataFrame(rows, "a string, b string, wanted boolean").withColumn("x", harmonic_keys(F.col("a"), F.col("b"))).collect()
    assert [r.x for r in got] == [r.wanted for r in got]


def test_cue_evidence(spark):
    parts = [(i, n, 1.0, 2.0, e, b, 0.5) for i, (n, e, b) in enumerate([(16, 0.0, 0.0), (16, -0.03, 0.0), (16, 0.0, -0.21), (4, 0.0, 0.0), (32, 0.0, 0.0), (8, 0.0, 0.0), (16, 0.0, 0.0)])]
    levels = [(i, 0.0, 3.0) for i in range(5) for _ in range(8)] + [(5, 0.0, 3.0)] * 7 + [(6, 0.0, 0.0)] * 7 + [(6, None, 0.0)]
    got = api.cue_evidence(spark.createDataFrame(parts, "pair int, n_bars int, out_score double, in_score double, in_end_change double, in_build double, affinity double"), spark.createDataFrame(levels, "pair int, out_db double, in_db double"))
    rows = {r.pair: r for r in got.collect()}
    assert [rows[i].long_bonus for i in range(7)] == pytest.approx([5.5 * 0.25, 0, 0, 0, 3 * 0.25, 0, 0])
    assert [rows[i].balance for i in range(7)] == pytest.approx([0.5] * 5 + [0, 0])
    assert [rows[i].penalty for i in range(7)] == pytest.approx([0.5] * 5 + [2, 2])
    assert rows[0].score == pytest.approx(3 + 0.15 + 5.5 * 0.25 - 0.5) and rows[5].score == pytest.approx(3 + 0.65 - 2)


ATTACKS, CONTEXT = "INSUFFICIENT_LOCAL_ATTACKS", "INSUFFICIENT_CONTEXT"


def test_tails_are_inherited_only_from_a_sound_bar_of_the_same_pulse(spark):
    steady = ["", "", *[ATTACKS] * 3]
    cases = {  # acoustic issues of each bar, codes by bar, beats by bar, period by bar, first bar, wanted
        "steady": (steady, {}, {}, {}, 0, (3, 1, True)),
        "own code": (steady, {3: "UNSUPPORTED_ACOUSTIC_PULSE"}, {}, {}, 0, (3, 1, True)),
        "conflict": (steady, {3: "CONFLICTING_DOWNBEAT_EVIDENCE"}, {}, {}, 0, (3, None, False)),
        "anchor fault": (steady, {1: "WEAK_BOUNDARY_EVIDENCE"}, {}, {}, 0, (3, None, False)),
        "within drift": (steady, {}, {}, {3: 0.43}, 0, (3, 1, True)),
        "drift": (steady, {}, {}, {3: 0.45}, 0, (3, None, False)),
        "faster": (steady, {}, {}, {4: 0.35}, 0, (3, None, False)),
        "beats": (steady, {}, {3: 3}, {}, 0, (3, None, False)),
        "context": (["", CONTEXT], {}, {}, {}, 0, (1, 0, True)),
        "context and more": (["", f"{CONTEXT},NONRECURRING_ATTACKS"], {}, {}, {}, 0, (1, None, False)),
        "attacks and more": (["", f"{CONTEXT},{ATTACKS}"], {}, {}, {}, 0, (1, 0, True)),
        "gap": (["", ATTACKS, "", ATTACKS], {}, {}, {}, 0, (3, None, False)),
        "no anchor": ([ATTACKS, ATTACKS], {}, {}, {}, 0, (2, None, False)),
        "anchor before": (["", ATTACKS], {}, {}, {}, 1, (1, 0, True)),
        "eight": (["", *[ATTACKS] * 8], {}, {}, {}, 0, (8, 0, True)),
        "nine": (["", *[ATTACKS] * 9], {}, {}, {}, 0, (9, None, False)),
        "none weak": (["", ""], {}, {}, {}, 0, (0, None, False)),
    }
    bars, clock, chosen = [], [], []
    for name, (acoustic, codes, beats, periods, first, _) in cases.items():
        idx, us = 0, 0
        for bar, a in enumerate(acoustic):
            bars.append((name, bar, idx, idx + beats.get(bar, 4), codes.get(bar, ""), a))
            for _ in range(beats.get(bar, 4)):
                clock.append((name, idx, us))
                idx, us = idx + 1, us + round(periods.get(bar, 0.4) * 1e6)
        clock.append((name, idx, us))
        chosen.append((name, first, len(acoustic)))
    got = planning.inherited_tail(
        spark.createDataFrame(clock, "series string, idx long, us long"),
        spark.createDataFrame(bars, "series string, bar long, start_idx long, end_idx long, codes string, acoustic string"),
        spark.createDataFrame(chosen, "series string, from_bar long, to_bar long"),
    )
    assert {r.series: (r.tail, r.anchor_bar, r.inherits) for r in got.collect()} == {k: v[-1] for k, v in cases.items()}


CODES = ["UNSUPPORTED_PULSE", "UNSUPPORTED_ACOUSTIC_PULSE", "INCOMPLETE_OBSERVATION_WINDOW", "WEAK_BOUNDARY_EVIDENCE", "CONFLICTING_DOWNBEAT_EVIDENCE", "INSUFFICIENT_METER_EVIDENCE", "UNCERTAIN_METER_PHASE"]


def issues(spark, weak=(), clipped=(), posterior={}, thin=(), removed=(), pulse=((0, 25),), acoustic={}, audited=True):
    """The codes of six bars of four beats of 0.4 s."""
    bounds = [("s", i, 4 * i, 1_600_000 * i, 0.49 if i in weak else 0.5, i not in clipped) for i in range(7)]
    got = api.bar_issues(
        spark.createDataFrame(bounds, "series string, boundary long, idx long, us long, score double, complete boolean"),
        spark.createDataFrame([("s", i, posterior.get(i, 0.9), i not in thin) for i in range(6)], "series string, bar long, posterior double, region boolean"),
        spark.createDataFrame([("s", *r) for r in removed], "series string, idx long, us long, score double"),
        spark.createDataFrame([("s", *r) for r in pulse], "series string, from long, to long") if audited else None,
        spark.createDataFrame([("s", 4 * i, 4 * i + 5, acoustic.get(i, True)) for i in range(6) if acoustic.get(i, True) is not None], "series string, start long, end long, supported boolean") if audited else None,
    )
    rows = sorted(got.collect(), key=lambda r: r.bar)
    assert [r.bar for r in rows] == list(range(6)) and all(r.usable == (r.codes == "") for r in rows)
    return {r.bar: r.codes for r in rows if r.codes}


def test_all_seven_codes(spark):
    assert issues(spark) == {}
    assert issues(spark, pulse=[(0, 20), (16, 25)]) == {}
    assert issues(spark, pulse=[(0, 12), (12, 25)]) == {2: CODES[0]}  # the end beat must lie in the same region
    assert issues(spark, pulse=[]) == dict.fromkeys(range(6), CODES[0])
    assert issues(spark, acoustic={1: False, 4: None}) == {1: CODES[1], 4: CODES[1]}
    assert issues(spark, clipped=[0, 6]) == {0: CODES[2], 5: CODES[2]}
    assert issues(spark, weak=[3]) == {2: CODES[3], 3: CODES[3]}
    assert issues(spark, thin=[1], posterior={4: 0.89}) == {1: CODES[5], 4: CODES[6]}
    assert issues(spark, pulse=[], acoustic={0: False}, audited=False) == {}


def test_conflicts_are_strictly_inside_and_strong(spark):
    inside, faint, at_bound, before = (6, 2_400_000, 0.5), (10, 4_000_000, 0.49), (12, 4_900_000, 0.9), (17, 6_400_000, 0.9)
    assert issues(spark, removed=[inside, inside, faint, at_bound, before]) == {1: CODES[4]}


def test_all_codes_of_one_bar(spark):
    got = issues(spark, weak=[0], clipped=[0], posterior={0: 0.0}, thin=[0], removed=[(2, 800_000, 1.0)], pulse=[(4, 25)], acoustic={0: False})
    assert got == {0: ",".join(CODES)}


def test_tempo_release_ends_a_third_of_the_difference_ahead(spark):
    at = [-1.0, 0.0, 0.5, 1.0, 1.9999, 2.0, 5.0]
    rows = spark.createDataFrame([(t, v) for t in at for v in (0.8, 1.3)], "t double, v double")
    got = {(r.t, r.v): r.s for r in rows.withColumn("s", repair.tempo_release(F.col("t") + 10.0, F.lit(10.0), F.col("v"))).collect()}
    for v in (0.8, 1.3):
        c = v - 1
        assert got[-1.0, v] == pytest.approx(-v) and got[0.0, v] == 0
        for dt in (0.5, 1.0, 1.9999):
            steps = 20_000  # the speed is 1 + c (1 - dt / T)^2
            want = sum((1 + c * (1 - (i + 0.5) * dt / steps / 2) ** 2) * dt / steps for i in range(steps))
            assert got[dt, v] == pytest.approx(want, abs=1e-7)
        assert got[2.0, v] == pytest.approx(2 + c * 2 / 3) and got[5.0, v] == pytest.approx(5 + c * 2 / 3)


def test_rivals_are_told_by_log_tempo_and_confidence_by_the_beats(spark):
    def summary(bpm, ranked, strengths, support=0.5):
        tempi = [("s", 1, 100.0, support, 1.0), ("s", 2, bpm, 0.4, ranked)]
        found = repair.detection_summary(spark.createDataFrame(tempi, "series string, rank int, bpm double, support double, ranked double"), spark.createDataFrame([("s", x) for x in strengths], "series string, strength double"))
        (r,) = found.collect()
        return r.ambiguous, round(r.tempo_confidence, 6), round(r.beat_confidence, 6)

    assert summary(100 * math.exp(0.0701), 0.82, [0.1, 0.7, 0.2, 0.9]) == (True, 0.5, 0.5)
    assert summary(100 * math.exp(0.0699), 0.99, [0.1, 0.07, 0.2]) == (False, 0.5, round(0.5 * 0.1 / 0.35, 6))
    assert summary(100 * math.exp(-0.0701), 0.82, [0.0]) == (True, 0.5, 0)  # a slower one rivals from 6.8 %
    assert summary(50.0, 0.8199, [1.0], support=1.4) == (False, 1, 1)


def test_warnings(spark):
    rows = [(1, False, 0.2, False, 0.35, 12, False, 3), (2, True, 0.19, True, 0.34, 11, True, 0), (3, False, 0.5, True, 0.9, 99, True, 1)]
    found = repair.warnings(spark.createDataFrame(rows, "i int, constrained boolean, tempo_confidence double, ambiguous boolean, beat_confidence double, n_beats long, observed boolean, n_downbeats long"))
    assert {r.i: r.warnings for r in found.collect()} == {
        1: "DETECTED_DOWNBEATS",
        2: "PULSE_CONSTRAINED,UNRELIABLE_GRID,AMBIGUOUS_TEMPO,WEAK_BEATS,FEW_BEATS,UNCALIBRATED_DETECTOR,NO_DOWNBEATS",
        3: "AMBIGUOUS_TEMPO,UNCALIBRATED_DETECTOR,DETECTED_DOWNBEATS",
    }


def test_a_spike_in_a_long_section_is_seen_and_placed(spark):
    # After a fast section the cubic over the long one is slowest at two thirds of it, between its eighths.
    knots = [(0, 0.0, 0.0), (1, 100.0, 100.0), (2, 100.1, 100.3), (3, 200.0, 200.2), (4, 200.5, 200.7)]
    table = spark.createDataFrame([("s", *k) for k in knots], "series string, idx long, x double, y double")
    (fine,) = api.warp_quality(table).collect()
    (coarse,) = api.warp_quality(table, step=1e9).collect()
    assert fine.min_speed < coarse.min_speed - 0.002 and fine.max_speed >= coarse.max_speed
    x = [k[1] for k in knots]
    found = api.hermite(table, spark.createDataFrame([("s", float(t)) for t in (fine.max_speed_at, fine.min_speed_at, fine.max_rate_at, 200.5)], "series string, t double"))
    speeds = {r.t: (r.speed, r.acceleration) for r in found.collect()}
    assert speeds[fine.max_speed_at][0] == pytest.approx(fine.max_speed) and speeds[fine.min_speed_at][0] == pytest.approx(fine.min_speed)
    assert abs(speeds[fine.max_rate_at][1] / speeds[fine.max_rate_at][0]) == pytest.approx(fine.max_rate) or fine.max_rate_at in x


def test_wanted_tempi_without_support_are_none(spark):
    found = spark.createDataFrame([("a", 100.0, 0.029), ("b", 101.0, 0.03), ("b", 99.0, 0.5)], "series string, bpm double, support double")
    asked = spark.createDataFrame([("a", 100.0), ("b", 100.0), ("c", 100.0)], "series string, wanted double")
    assert sorted((r.series, r.bpm, r.support) for r in repair.preferred(found, asked).collect()) == [("a", 0.0, 0.0), ("b", 99.0, 0.5), ("c", 0.0, 0.0)]
    own = asked.withColumn("support", F.lit(0.2))
    assert {r.series: r.bpm for r in repair.preferred(found, own).collect()}["c"] == 100.0


def test_frame_counts_snap_within_rounding_only(spark):
    values = [3.0, 2.9999999999999996, 2.999999999, 2.9999, 1e9 + 0.99999, 1e9 + 0.9999999]
    got = [r.n for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(repair.snap(F.col("v")).alias("n")).collect()]
    assert got == [3, 3, 2, 2, 10**9, 10**9 + 1]


def clicks(bpm, rate=4000, seconds=24, weak=1.0):
    """Decaying clicks, every other one by ``weak``."""
    n = int(rate * seconds)
    x, step = np.zeros(n), 60 / bpm
    for k in range(int(seconds / step)):
        at = int((0.2 + k * step) * rate)
        tail = np.arange(min(n - at, rate // 20))
        x[at : at + len(tail)] += (weak if k % 2 else 1.0) * np.exp(-tail / (rate * 0.008)) * np.sin(2 * np.pi * 700 * tail / rate)
    return x


@pytest.mark.parametrize(("bpm", "weak", "low", "high"), [(100, 1.0, 97, 206), (200, 0.25, 97, 103), (120, 1.0, 117, 246)])
def test_octaves_move_between_candidates_only(bpm, weak, low, high):
    x = clicks(bpm, weak=weak)
    f = dsp.features(x, 4000)
    found = beats.detect(f["flux"], x, 4000, f["hop"], f["window"])
    near = [c for c in found.candidates if abs(math.log(c[0] / found.bpm)) < 0.04]
    assert low < found.bpm < high and near  # the tempo is one of the candidates' own


def test_refinement_weighs_by_the_whole_reach():
    rate, hop, window = 4000, 32, 256
    x = np.zeros(4000)
    for k, size in ((1328, 0.30), (1424, 0.52)):  # 4 ms before and 20 ms after the place that is refined, at a block's begin
        x[k : k + 400] += size * np.exp(-np.arange(400) / 20)
    (got,) = beats.refine(x, rate, np.array([40]), hop, window)
    # 0.52 * exp(-0.5 * 0.8^2) = 0.38 beats 0.30; with half the reach it would be 0.14.
    assert got == 1424 / rate


def test_circular_correlation_of_profiles_with_gaps(spark):
    rows = [("a", 0, 0, 0, 2.0), ("a", 0, 1, 31, 3.0), ("a", 1, 0, 5, 4.0), ("a", 1, 1, 30, None), ("a", 3, 0, 0, 1.0), ("b", 2, 0, 0, 1.0)]
    found = evidence.circular_correlation(spark.createDataFrame(rows, "series string, i long, band int, bin int, v double"))
    assert found.dtypes == [("series", "string"), ("i", "bigint"), ("shift", "int"), ("r", "double")]
    assert sorted(map(tuple, found.collect())) == [("a", 0, 1, None), ("a", 0, 27, 8.0)]


def shared(spark):
    clock = spark.createDataFrame([(s, i, us) for s in (1, 2) for i, us in enumerate((-5, 8, 20, 31, 40 + 9 * s))], "series long, idx long, us long")
    every = spark.createDataFrame([(0, 1.0), (1, 7.0), (2, 9.0), (3, 2.0), (4, 8.0)], "k long, x double")
    return clock, every, every.crossJoin(spark.createDataFrame([(1,), (2,)], "series long"))


def test_agreement_with_an_envelope_of_all_clocks(spark):
    clock, every, each = shared(spark)
    got = sorted(map(tuple, repair.onset_agreement(clock, every, 10, 2, 7.0).collect()))
    assert got == [(1, 0.6, 2 / 3), (2, 0.6, 2 / 3)] == sorted(map(tuple, repair.onset_agreement(clock, each, 10, 2, 7.0).collect()))
    assert {r.coverage for r in repair.onset_agreement(clock, every.limit(0), 10, 2, 7.0).collect()} == {0.0}


def test_observations_with_activations_of_all_clocks(spark):
    clock, every, each = shared(spark)
    got = sorted(map(tuple, repair.observations(clock, every, 10, 3).collect()))
    assert got == sorted(map(tuple, repair.observations(clock, each, 10, 3).collect()))
    assert got[:5] == [(1, 0, -1000.0, False), (1, 1, 7.0, True), (1, 2, 9.0, True), (1, 3, 2.0, True), (1, 4, -1000.0, False)]


def test_best_pairs_are_those_of_all_pairs(spark):
    rng, up = np.random.default_rng(3), float(np.nextafter(1.0, 2.0))
    values = [None, math.nan, math.inf, 0.1, 0.2, 0.3, 0.3, up, 1.0, 1.0, 1e16]
    rows = [(str(n), s, values[v]) for n in range(12) for s, v in enumerate(rng.integers(0 if n < 4 else 3, len(values), 2 * n + 2))]
    rows = spark.createDataFrame(rows, "signature string, series long, score double")
    out, into = rows.where("series % 2 = 0"), rows.where("series % 2 = 1")
    every = out.select("signature", F.col("series").alias("o"), F.col("score").alias("a")).join(into.select("signature", F.col("series").alias("i"), F.col("score").alias("b")), "signature")
    order = Window.partitionBy("signature").orderBy(F.desc(F.col("a") + F.col("b")), "i", F.desc("o"))
    want = every.withColumn("p", F.row_number().over(order)).where("p <= 3").select("signature", "o", "i", "p").collect()
    assert sorted(map(tuple, planning.best_pairs(out, into, 3).collect())) == sorted(map(tuple, want))


def test_required_bars(spark):
    rows = lambda data, schema: spark.createDataFrame(data, schema)
    clock = rows([(s, i, i * 500_000, 1.0) for s in (1, 2) for i in range(41)], "series long, idx long, us long, strength double")
    safe = rows([(1, False), (2, True)], "series long, safe boolean")
    # Of two regions that overlap, the one that begins later ends first.
    regions = rows([(1, 0, 21), (1, 2, 13), (1, 24, 33)], "series long, from long, to long")
    quiet = {1: (5, 6, 29, 30), 2: ()}
    flags = rows([(s, i, i not in quiet[s], False, False) for s in (1, 2) for i in range(41)], "series long, i long, active boolean, missing boolean, nonrecurring boolean")
    codes = {(1, 4): "WEAK_BOUNDARY_EVIDENCE,UNCERTAIN_METER_PHASE", (2, 3): "UNSUPPORTED_ACOUSTIC_PULSE"}
    bars = rows([(s, b, b * 4, b * 4 + 4, codes.get((s, b), "")) for s in (1, 2) for b in range(10)], "series long, bar long, start_idx long, end_idx long, codes string")
    asked = rows(
        # A rest in bar 1; bars 2 and 3 in the longer region; a faulty bar; bar 5 in no region; bar 7 inherited; a missing bar;
        # a faulty bar as a whole, in part and inherited; one beat; a series without a clock.
        [(1, 1, 0, 2, None), (2, 1, 2, 2, None), (3, 1, 4, 1, None), (4, 1, 5, 1, None), (5, 1, 6, 2, None), (6, 1, 6, 2, None), (7, 2, 8, 3, None), (8, 2, 3, 1, None), (9, 2, 3, 1, 14), (10, 2, 3, 1, None), (11, 2, 0, 1, 0), (12, 3, 0, 1, None)],
        "ask long, series long, first_bar long, n_bars long, end_idx long",
    )
    inherited = rows([(5, 7), (10, 3)], "ask long, bar long")
    found = api.require_bars(asked, bars, inherited, clock, safe, regions, evidence.prefix_index(flags))
    acoustic, pulse = "UNSUPPORTED_ACOUSTIC_PULSE", "UNSUPPORTED_PULSE"
    said = {1: (1, acoustic), 2: (None, None), 3: (4, "WEAK_BOUNDARY_EVIDENCE"), 4: (5, pulse), 5: (None, None), 6: (7, acoustic), 7: (10, "NO_SUCH_BAR"), 8: (3, acoustic), 9: (None, None), 10: (None, None), 11: (0, "OUT_OF_BOUNDS"), 12: (0, "NO_SUCH_BAR")}
    assert {r.ask: (r.failed_bar, r.declined) for r in found.collect()} == said
    plain = api.require_bars(asked.where("ask in (1, 4, 6)"), bars, inherited, clock, safe, regions)
    assert {r.ask: r.declined for r in plain.collect()} == {1: None, 4: pulse, 6: None}
