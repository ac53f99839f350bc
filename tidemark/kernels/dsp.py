"""Framing and spectral features of one signal."""

from __future__ import annotations

import numpy as np

# Tone profiles are in operators.signal; here the geometry of the analyses.
MEL_RATE, MEL_SIZE, MEL_HOP, MEL_BINS, MEL_RANGE = 22050, 1024, 441, 128, (30.0, 11000.0)
SILENCE_DB = -60.0


def hann(n: int, periodic: bool = False) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n if periodic else n - 1))


def geometry(rate: int) -> tuple[int, int]:
    """Window (a power of two, at least 46 ms and 256 samples) and hop."""
    window = max(256, 1 << int(np.ceil(np.log2(0.046 * rate))))
    return window, max(16, window // 8)


def centred_frames(x: np.ndarray, window: int, hop: int) -> np.ndarray:
    """Frames around every hop, silence outside."""
    count = 1 + (len(x) - 1) // hop
    padded = np.concatenate([np.zeros(window // 2), x, np.zeros(window)])
    return np.lib.stride_tricks.sliding_window_view(padded, window)[: count * hop : hop][:count]


def magnitudes(x: np.ndarray, window: int, hop: int, block: int = 512) -> np.ndarray:
    """Magnitude spectra of centred frames, in blocks of frames so that memory stays bounded by the result."""
    frames, shape = centred_frames(x, window, hop), hann(window)
    return np.concatenate([np.abs(np.fft.rfft(frames[i : i + block] * shape, axis=1)) for i in range(0, len(frames), block)])


def features(x: np.ndarray, rate: int) -> dict[str, np.ndarray | float]:
    """Gated spectral flux, attack shares of four bands, centroid, levels and frame geometry."""
    window, hop = geometry(rate)
    mag = magnitudes(x, window, hop)[:, 2 : window // 2]
    hz = np.arange(2, window // 2) * rate / window
    before = np.vstack([np.zeros((1, mag.shape[1])), mag[:-1]])
    # Decayed running maximum as a plain one of log magnitude plus time.
    drift = (np.arange(len(mag)) * hop / rate / 0.8)[:, None]
    with np.errstate(divide="ignore"):
        white = np.exp(np.maximum.accumulate(np.log(mag) + drift, axis=0) - drift)
    level = np.log1p(10 * mag / np.maximum(1e-4, white))
    rise = np.maximum(0, np.diff(level, axis=0, prepend=np.zeros((1, level.shape[1]))))
    heard = (hz >= 45) & (hz <= 5000)
    novelty = (rise * np.where(hz < 180, 1.3, 1.0))[:, heard].sum(axis=1)
    up = np.maximum(0, mag - before)
    gate = up[:, heard].sum(axis=1) / np.maximum(1e-9, mag[:, heard].sum(axis=1)) > 0.005
    power = (mag[:, heard] ** 2).sum(axis=0)
    total = mag[:, (hz >= 40) & (hz <= 10000)].sum(axis=1)
    shares = np.stack([np.where(total > 0, up[:, (hz >= a) & (hz <= b)].sum(axis=1) / np.where(total > 0, total, 1), 0) for a, b in ((40, 180), (180, 1000), (1000, 4000), (4000, 10000))], axis=1)
    shares[0] = 0
    return {"flux": np.where(gate, novelty, 0.0), "attack": shares, "centroid": float((hz[heard] * power).sum() / max(1.0, power.sum())), "hop": hop, "window": window}


def chroma(x: np.ndarray, rate: int, fine: int = 12) -> np.ndarray:
    """Twelve tone strengths from long windows; each frame has norm 1, and the tuning's offset is taken out.

    Energy goes to the two nearest of ``fine`` steps per semitone; the mean phase over a semitone is the offset,
    left alone where it is too scattered to be one.
    """
    window = geometry(rate)[0] * 8
    mag = magnitudes(x, window, 2 * window if len(x) > 2 * window else window)
    hz = np.fft.rfftfreq(window, 1 / rate)
    use = (hz >= 55) & (hz <= min(5000, rate / 2 * 0.95))
    place = 12 * np.log2(hz[use] / 440.0) * fine
    energy = mag[:, use] ** 2
    peak = (energy >= np.roll(energy, 1, axis=1)) & (energy > np.roll(energy, -1, axis=1))
    energy = np.where(peak, energy, 0)
    size, low = 12 * fine, np.floor(place).astype(int)
    part = place - low
    table = np.zeros((len(energy), size))
    for at, w in ((low, 1 - part), (low + 1, part)):
        np.add.at(table.T, at % size, (np.sqrt(energy) * w).T)
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    table = (table / np.where(norm > 1e-12, norm, 1)).sum(axis=0)
    turn = np.exp(2j * np.pi * np.arange(size) / fine)
    mean = (table * turn).sum() / max(1e-12, table.sum())
    offset = np.angle(mean) / (2 * np.pi) * fine if abs(mean) >= 0.10 else 0.0
    tone = np.rint((np.arange(size) - offset) / fine).astype(int)
    out = np.zeros(12)
    np.add.at(out, (tone + 9) % 12, table)  # 440 Hz is tone 9
    return out


def key(values: np.ndarray, major: tuple[float, ...], minor: tuple[float, ...], names: tuple[str, ...]) -> tuple[str, float]:
    """Best of 24 rotated profiles by correlation, and its lead over the best key that doesn't mix with it."""
    if np.linalg.norm(values - values.mean()) < 1e-9:
        return "unknown", 0.0
    score = np.array([[np.corrcoef(np.roll(values, -root), p)[0, 1] for p in (major, minor)] for root in range(12)])
    root, mode = np.unravel_index(score.argmax(), score.shape)
    apart = (np.arange(12) - root) % 12
    same = np.isin(apart, (0, 5, 7))
    relative = (apart == 9) if mode == 0 else (apart == 3)
    mixes = np.stack([same, relative] if mode == 0 else [relative, same], axis=1)
    return f"{names[root]} {('major', 'minor')[mode]}", float(np.clip(score.max() - score[~mixes].max(), 0, 1))


def mel_filters() -> np.ndarray:
    """Triangles on a scale that is linear to 1 kHz and logarithmic above."""
    knee, slope = 15.0, np.log(6.4) / 27

    def mel(f: float) -> float:
        return f * 3 / 200 if f < 1000 else knee + np.log(f / 1000) / slope

    m = np.linspace(mel(MEL_RANGE[0]), mel(MEL_RANGE[1]), MEL_BINS + 2)
    edge = np.where(m < knee, m * 200 / 3, 1000 * np.exp((m - knee) * slope))
    f = np.arange(MEL_SIZE // 2 + 1) * MEL_RATE / MEL_SIZE
    left, mid, right = edge[:-2, None], edge[1:-1, None], edge[2:, None]
    return np.maximum(0, np.minimum((f - left) / (mid - left), (right - f) / (right - mid)))


def log_mel(x: np.ndarray, block: int = 1024) -> np.ndarray:
    """Log mel spectra (frames x 128) of a signal at 22,050 Hz, mirrored at its ends."""
    if len(x) <= MEL_SIZE // 2 or not np.isfinite(x).all():
        raise ValueError("at least 513 finite samples at 22050 Hz are needed")
    padded = np.pad(x, MEL_SIZE // 2, mode="reflect")
    count, shape, filters = 1 + len(x) // MEL_HOP, hann(MEL_SIZE, periodic=True), mel_filters().T
    views = np.lib.stride_tricks.sliding_window_view(padded, MEL_SIZE)[::MEL_HOP][:count]
    out = [np.log1p(1000 * (np.abs(np.fft.rfft(views[i : i + block] * shape, axis=1)) / np.sqrt(MEL_SIZE) @ filters)) for i in range(0, len(views), block)]
    return np.concatenate(out).astype(np.float32)


def yin(x: np.ndarray, rate: int, low: float = 50.0, high: float = 2000.0, hop_s: float = 0.02, window_s: float = 0.08, threshold: float = 0.15) -> dict[str, np.ndarray]:
    """Pitch of complete windows: seconds, frequency (NaN where unvoiced), confidence, rms_db.

    The difference function comes from the linear autocorrelation of all frames at once, by the number of products;
    its cumulative mean picks the first refined dip under the threshold, the plain difference refines it.
    """
    top = int(np.ceil(rate / low))
    window = max(int(np.ceil(window_s * rate)), 4 * top + 1)
    hop = max(1, int(np.floor(hop_s * rate + 0.5)))
    if len(x) < window:
        raise ValueError("at least one complete window is needed")
    frames = np.lib.stride_tricks.sliding_window_view(x, window)[::hop].astype(float)
    frames = frames - frames.mean(axis=1, keepdims=True)
    power = np.concatenate([np.zeros((len(frames), 1)), np.cumsum(frames**2, axis=1)], axis=1)
    total = power[:, -1:]
    size = 1 << int(np.ceil(np.log2(2 * window)))
    spectrum = np.abs(np.fft.rfft(frames, size, axis=1)) ** 2
    corr = np.fft.irfft(spectrum, size, axis=1)[:, : top + 2]
    lags = np.arange(1, top + 2)
    raw = np.full((len(frames), top + 2), np.nan)
    raw[:, 1:] = np.maximum(0, power[:, window - lags] + total - power[:, lags] - 2 * corr[:, 1:]) / (window - lags)
    running = np.cumsum(raw[:, 1:], axis=1)
    norm = np.ones_like(raw)
    norm[:, 1:] = np.where(running > 0, raw[:, 1:] * lags / np.where(running > 0, running, 1), 1.0)
    left, mid, right = norm[:, 1:-2], norm[:, 2:-1], norm[:, 3:]
    bend = left - 2 * mid + right
    shift = np.where(bend > 1e-12, np.clip(0.5 * (left - right) / np.where(bend > 1e-12, bend, 1), -1, 1), 0)
    depth = np.maximum(0, mid - 0.25 * (left - right) * shift)
    good = (mid <= left) & (mid < right) & (depth < threshold)
    rms_db = 10 * np.log10(np.maximum(total[:, 0] / window, 1e-16))
    loud, found = rms_db > SILENCE_DB, good.any(axis=1)
    pick, rows = good.argmax(axis=1) + 2, np.arange(len(frames))
    a, b, c = raw[rows, pick - 1], raw[rows, pick], raw[rows, np.minimum(pick + 1, top + 1)]
    bend = a - 2 * b + c
    moved = np.where(np.abs(bend) > 1e-12, np.clip(0.5 * (a - c) / np.where(np.abs(bend) > 1e-12, bend, 1), -1, 1), 0)
    f = rate / (pick + moved)
    cent = 2 ** (1 / 1200)
    voiced = loud & found & (f >= low / cent) & (f <= high * cent)
    confidence = np.where(found, 1 - depth[rows, pick - 2], 1 - np.minimum(1, norm[:, 2 : top + 1].min(axis=1)))
    return {"seconds": (rows * hop + (window - 1) / 2) / rate, "frequency_hz": np.where(voiced, np.clip(f, low, high), np.nan), "confidence": np.where(loud, np.clip(confidence, 0, 1), 0.0), "rms_db": rms_db}


def steady_channel(energy: np.ndarray, margin_db: float = 1.0) -> np.ndarray:
    """Which of two channels to use per frame: the louder one, but only a lead of ``margin_db`` makes it change."""
    lead = 10 * np.log10(np.maximum(energy[:, 1], 1e-16) / np.maximum(energy[:, 0], 1e-16))
    if not len(lead):
        return np.zeros(0, int)
    say = np.where(lead > margin_db, 1, np.where(lead < -margin_db, 0, -1))
    say[0] = int(lead[0] > 0)
    last = np.maximum.accumulate(np.where(say >= 0, np.arange(len(say)), 0))
    return say[last]
