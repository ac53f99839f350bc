"""Kernels against signals and clocks whose answer is known."""

import numpy as np
import pytest

from tidemark.kernels import bars, beats, dsp, fit
from tidemark.operators.signal import MAJOR, MINOR, TONES


def clicks(rate, seconds, times, decay, turn, length):
    x = np.zeros(int(rate * seconds))
    for t in times:
        at = int(round(t * rate))
        i = np.arange(min(length, len(x) - at))
        x[at : at + len(i)] += np.exp(-i / decay) * np.sin(turn * i)
    return x


def detect(x, rate, preferred=None):
    f = dsp.features(x, rate)
    return beats.detect(f["flux"], x, rate, f["hop"], f["window"], preferred)


def test_click_train_156():
    found = detect(clicks(11025, 24, np.arange(62) * 60 / 156, 19, 0.6, 121), 11025)
    assert abs(found.bpm - 156) < 2 and len(found.beats) > 40


@pytest.mark.parametrize("rate", [11025, 44100, 48000])
def test_click_train_155_at_any_rate(rate):
    times = 0.2 + np.arange(40) * 60 / 155
    found = detect(clicks(rate, 16.5, times, 30, 0.43, 220), rate)
    assert abs(found.bpm - 155) < 0.2
    near = np.abs(found.beats[:, None] - times[None, :]).min(axis=1)
    assert len(found.beats) == 40 and near.max() < 0.006


def test_silence_and_tone_have_no_beats():
    assert len(detect(np.zeros(5 * 11025), 11025).beats) == 0
    tone = 0.4 * np.sin(2 * np.pi * 440 * np.arange(12 * 11025) / 11025)
    assert detect(tone, 11025).confidence < 0.2


def test_period_search_is_the_naive_one():
    x = np.random.default_rng(0).random(400)
    r = beats.autocorrelation(x, 50)
    c = x - x.mean()
    naive = [(c[g:] * c[: len(c) - g]).sum() / (c**2).sum() * len(c) / max(1, len(c) - g) for g in range(51)]
    assert np.allclose(r, naive)


def triad(notes, rate=11025, seconds=12, cents=0.0):
    t = np.arange(rate * seconds) / rate
    x = sum(0.22 * np.sin(2 * np.pi * f * t) + 0.08 * np.sin(4 * np.pi * f * t) for f in (440 * 2 ** ((n - 69 + cents / 100) / 12) for n in notes))
    return x * (0.75 + 0.25 * np.sin(4 * np.pi * t))


@pytest.mark.parametrize(("notes", "cents", "name"), [((59, 62, 66), 0, "B minor"), ((52, 55, 59), 0, "E minor"), ((56, 60, 63), 0, "G# major"), ((48, 52, 55), 45, "C major"), ((57, 60, 64), -45, "A minor")])
def test_key_of_triads(notes, cents, name):
    found, sure = dsp.key(dsp.chroma(triad(notes, cents=cents), 11025), MAJOR, MINOR, TONES)
    assert found == name and 0 <= sure <= 1


def test_silence_has_no_key():
    assert dsp.key(np.zeros(12), MAJOR, MINOR, TONES) == ("unknown", 0.0)


@pytest.mark.parametrize("rate", [11025, 22050, 44100])
@pytest.mark.parametrize("f", [50.0, 82.4, 220.0, 440.0, 997.0, 2000.0])
def test_pitch_of_tones(rate, f):
    x = 0.4 * np.sin(2 * np.pi * f * np.arange(int(0.4 * rate)) / rate + 0.73)
    found = dsp.yin(x, rate)
    cents = 1200 * np.log2(found["frequency_hz"] / f)
    assert np.abs(cents).max() < 8 and found["confidence"].min() > 0.9


def test_noise_and_silence_are_unvoiced():
    noise = dsp.yin(np.random.default_rng(502).standard_normal(8000) * 0.2, 11025)
    assert np.isnan(noise["frequency_hz"]).mean() > 0.9
    assert np.isnan(dsp.yin(np.zeros(8000), 11025)["frequency_hz"]).all()


def test_log_mel_has_known_values():
    i = np.arange(22050)
    x = 0.3 * np.sin(2 * np.pi * 220 * i / 22050) + 0.1 * np.sin(2 * np.pi * 997 * i / 22050)
    x[280] += 0.6
    found = dsp.log_mel(x)
    assert found.shape == (51, 128)
    for frame, b, value in ((0, 1, 6.096230984), (50, 127, 2.350139141)):
        assert abs(found[frame, b] - value) < 3e-4


def test_channel_choice_has_hysteresis():
    db = np.array([0.0, 0.5, 3.0, 0.5, -0.5, -2.0, 0.9])
    energy = np.stack([np.ones(7), 10 ** (db / 10)], axis=1)
    assert dsp.steady_channel(energy).tolist() == [0, 0, 1, 1, 1, 0, 0]


def bar_logits(meters, missing=(), extra=()):
    out, b = [], 0
    for m in meters:
        for p in range(m):
            out.append(8.0 if (p == 0 and b not in missing) or b in extra else -8.0)
            b += 1
    return np.array(out + [8.0])


@pytest.mark.parametrize("meter", bars.METERS)
def test_bars_of_one_meter(meter):
    found = bars.decode(bar_logits([meter] * 12), bars.model())
    assert (found["meter"][: meter * 11] == meter).all()
    assert (found["phase"][: meter * 11] == np.arange(meter * 11) % meter).all()


def test_missing_and_extra_downbeats_are_overruled():
    found = bars.decode(bar_logits([4] * 16, missing=(20,), extra=(30,)), bars.model())
    assert found["phase"][20] == 0 and found["phase"][30] == 2


def test_decoding_is_the_brute_force_one():
    m = bars.model((2, 3), 0.1)
    observed = np.random.default_rng(3).normal(size=7) * 2
    emit = np.where(np.isin(np.arange(5), m.begins), -np.logaddexp(0, -observed)[:, None], -np.logaddexp(0, observed)[:, None])
    import itertools

    start = -np.log(2) - np.log(m.meter)
    paths = list(itertools.product(range(5), repeat=7))
    logp = np.array([start[p[0]] + sum(m.move[a, b] for a, b in zip(p, p[1:], strict=False)) + sum(emit[t, s] for t, s in enumerate(p)) for p in paths])
    found = bars.decode(observed, m)
    best = paths[logp.argmax()]
    assert found["meter"].tolist() == m.meter[list(best)].tolist() and found["phase"].tolist() == m.phase[list(best)].tolist()
    weight = np.exp(logp - np.logaddexp.reduce(logp))
    for t in range(7):
        assert np.isclose(found["downbeat_posterior"][t], sum(w for w, p in zip(weight, paths, strict=True) if p[t] in m.begins))


def test_fit_is_the_optimum_within_bounds():
    rng = np.random.default_rng(5)
    output = 0.2 + 0.4 * np.arange(80)
    raw = output + rng.uniform(-0.024, 0.024, 80)
    bounds = fit.displacement_bounds(raw, pins=(30,))
    x, done, residual = fit.bounded_clock(raw, output, bounds)
    assert done and residual <= 1e-9 and (np.abs(x) <= bounds + 1e-12).all() and x[30] == x[0] == x[-1] == 0
    h = np.diff(output)

    def value(z):
        return (np.diff(np.diff(raw + z) / h) ** 2).sum() + 30 * (z**2).sum()

    for _ in range(300):
        trial = np.clip(x + rng.normal(size=80) * 10 ** rng.uniform(-6, -2), -bounds, bounds)
        assert value(trial) >= value(x) - 1e-12


def test_anchors_follow_the_map():
    knots = np.arange(0, 40, 0.4)
    forward = lambda t: t + 0.06 * np.sin(t / 2)
    found = fit.adaptive_anchors(forward, knots, 44100)
    assert (np.diff(found, axis=0) > 0).all()
    t = np.linspace(0, knots[-1], 5000)
    assert np.abs(np.interp(t * 44100, found[:, 0], found[:, 1]) / 44100 - forward(t)).max() < 0.0011


def test_duplicates_go_and_true_beats_stay():
    grid = np.arange(0, 20, 0.5)
    times = np.sort(np.append(grid, [3.1, 7.62]))
    strength = np.where(np.isin(times, grid), 0.9, 0.2)
    kept = beats.drop_duplicates(times, strength, grid)
    assert np.array_equal(times[kept], grid)


def test_upper_median():
    assert beats.robust_interval(np.array([0, 0.4, 1, 1.5])) == pytest.approx(0.5)
    jittered = 0.5 * np.arange(12)
    jittered[4] += 0.08
    spans = np.sort((jittered[8:] - jittered[:-8]) / 8)
    assert beats.robust_interval(jittered) == spans[len(spans) // 2]


def test_stable_ranges_find_the_steady_part():
    rng = np.random.default_rng(4)
    phase = np.concatenate([rng.random(40), 0.3 + rng.normal(0, 0.01, 60), rng.random(40)])
    reach, segment = np.full(140, 0.1), np.zeros(140, int)
    (found,) = beats.stable_ranges(phase, reach, segment)
    assert 34 <= found["first"] <= 42 and 97 <= found["last"] <= 106 and abs(found["center"] - 0.3) < 0.02
    split = beats.stable_ranges(phase, reach, (np.arange(140) >= 70).astype(int))
    assert split and all((r["last"] < 70) == (r["first"] < 70) for r in split)
    assert beats.stable_ranges(rng.random(100), reach[:100], segment[:100]) == []
    drifting = np.linspace(0, 1.0, 100)
    assert beats.stable_ranges(drifting, np.full(100, 0.05), segment[:100]) == []


def test_many_series_at_once_are_each_one_alone():
    rng = np.random.default_rng(6)
    m = bars.model()
    series = [rng.normal(size=k) * 4 for k in (1, 2, 5, 40, 41, 97)]
    together = bars.decode_many(series, m)
    for x, found in zip(series, together, strict=True):
        alone = bars.decode(x, m)
        assert all(np.allclose(alone[k], found[k]) for k in alone)
