"""Bar tracking: a hidden Markov model over meters and the place in the bar."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

METERS = (2, 3, 4, 6, 8)
CHANGE = 1e-7


@dataclass(frozen=True)
class Model:
    """States (meter, phase), log transitions (from, to) and the states that begin a bar."""

    meter: np.ndarray
    phase: np.ndarray
    move: np.ndarray
    begins: np.ndarray


def model(meters: tuple[int, ...] = METERS, change: float = CHANGE) -> Model:
    meter = np.repeat(meters, meters)
    phase = np.concatenate([np.arange(m) for m in meters])
    move = np.zeros((len(meter), len(meter)))
    ends, begins = phase == meter - 1, phase == 0
    inside = (~ends).nonzero()[0]
    move[inside, inside + 1] = 1
    same = meter[:, None] == meter[None, :]
    leave = change / (len(meters) - 1) if len(meters) > 1 else 0.0
    stay = 1 - change if len(meters) > 1 else 1.0
    move[np.ix_(ends, begins)] = np.where(same[np.ix_(ends, begins)], stay, leave)
    with np.errstate(divide="ignore"):
        return Model(meter, phase, np.log(move), begins.nonzero()[0])


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def observations(times: np.ndarray, logits: np.ndarray, hop: float = 0.02, reach: float = 0.06) -> tuple[np.ndarray, np.ndarray]:
    """Largest logit near each beat, at most a quarter of the way to its neighbours, and whether the series covers that."""
    gap = np.diff(times)
    radius = np.minimum(reach, np.minimum(np.append(gap, np.inf), np.insert(gap, 0, np.inf)) / 4)
    low = np.maximum(0, np.ceil((times - radius) / hop - 1e-9).astype(int))
    high = np.minimum(len(logits) - 1, np.floor((times + radius) / hop + 1e-9).astype(int))
    found = np.array([logits[a : b + 1].max() if b >= a else -1000.0 for a, b in zip(low, high, strict=True)])
    return found, (times - radius >= -1e-9) & (times + radius <= (len(logits) - 1) * hop + 1e-9)


def decode(observed: np.ndarray, m: Model) -> dict[str, np.ndarray]:
    """Best path (first state on ties) with the posterior of its states, and the posterior of a bar's beginning."""
    return decode_many([observed], m)[0]


def decode_many(series: list[np.ndarray], m: Model) -> list[dict[str, np.ndarray]]:
    """As ``decode`` for several series at once, a step of all of them per numpy call.

    Shorter series are padded at their end; a padded step is the identity, so that it changes nothing.
    """
    size = np.array([len(x) for x in series])
    n, many, states = int(size.max(initial=0)), len(series), len(m.meter)
    if not n:
        return [{k: np.zeros(0) for k in ("meter", "phase", "state_posterior", "downbeat_posterior")} for _ in series]
    logit = np.zeros((n, many))
    for k, x in enumerate(series):
        logit[: len(x), k] = x
    begins = np.isin(np.arange(states), m.begins)
    yes, no = -_softplus(-logit), -_softplus(logit)

    def emit(t: int) -> np.ndarray:
        return np.where(begins[None, :], yes[t][:, None], no[t][:, None])

    # Besides the bar ends, each state is reached from one state alone; a bar's beginning from the ends.
    ends = (m.phase == m.meter - 1).nonzero()[0]
    inside = (~begins).nonzero()[0]
    jump = m.move[np.ix_(ends, m.begins)]
    best = np.broadcast_to(-np.log(len(np.unique(m.meter))) - np.log(m.meter), (many, states)) + emit(0)
    alpha, back = np.empty((n, many, states)), np.zeros((n, many, states), np.int16)
    alpha[0] = best
    for t in range(1, n):
        live = (t < size)[:, None]
        over = best[:, ends][:, :, None] + jump
        step, reach = np.empty_like(best), np.empty_like(best)
        step[:, inside], reach[:, inside] = best[:, inside - 1], alpha[t - 1][:, inside - 1]
        step[:, m.begins] = over.max(axis=1)
        reach[:, m.begins] = _logsum(alpha[t - 1][:, ends][:, :, None] + jump, 1)
        back[t][:, inside], back[t][:, m.begins] = inside - 1, ends[over.argmax(axis=1)]
        now = emit(t)
        best = np.where(live, step + now, best)
        alpha[t] = np.where(live, reach + now, alpha[t - 1])
    path = np.empty((n, many), int)
    rows = np.arange(many)
    path[-1] = best.argmax(axis=1)
    for t in range(n - 1, 0, -1):
        path[t - 1] = np.where(t < size, back[t][rows, path[t]], path[t])
    beta, whole = np.zeros((many, states)), _logsum(alpha[-1], 1)
    state, downbeat = np.empty((n, many)), np.empty((n, many))
    for t in range(n - 1, -1, -1):
        posterior = np.exp(alpha[t] + beta - whole[:, None])
        state[t], downbeat[t] = posterior[rows, path[t]], posterior[:, m.begins].sum(axis=1)
        ahead = emit(t) + beta
        before = np.empty_like(beta)
        before[:, inside - 1] = ahead[:, inside]
        before[:, ends] = _logsum(jump[None, :, :] + ahead[:, m.begins][:, None, :], 2)
        beta = np.where((t < size)[:, None], before, beta)
    return [
        {"meter": m.meter[path[:k, i]], "phase": m.phase[path[:k, i]], "state_posterior": np.clip(state[:k, i], 0, 1), "downbeat_posterior": np.clip(downbeat[:k, i], 0, 1)}
        for i, k in enumerate(size.tolist())
    ]
