"""Least squares and fits of tracks over channels, in numpy: what a task does with the data of one window or scan."""

from __future__ import annotations

import numpy as np

from interfera.solver.models import Blocks, Delay, Flat, PerChannel, Spec, segments


def least_squares(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Minimises sum weight |a x - b|^2; the shortest of several x."""
    s = np.sqrt(weight)
    return np.linalg.lstsq(a * s[:, None], b * s, rcond=None)[0]


def penalised(a: np.ndarray, b: np.ndarray, weight: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """The same with sum penalty |x|^2 added."""
    n = a.shape[1]
    return least_squares(np.vstack([a, np.eye(n)]), np.concatenate([b, np.zeros(n)]), np.concatenate([weight, np.broadcast_to(penalty, n)]))


def constrained(a: np.ndarray, b: np.ndarray, weight: np.ndarray, c: np.ndarray, d: np.ndarray, constraint_weight: float = 1e6) -> np.ndarray:
    """The same with c x = d as further rows of large weight."""
    return least_squares(np.vstack([a, c]), np.concatenate([b, d]), np.concatenate([weight, np.full(len(d), constraint_weight)]))


def design(pairs: np.ndarray, antennas: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the pairs: 1 and 1 at its antennas (amplitudes), 1 and -1 (phases)."""
    row = np.arange(len(pairs))
    amp, phase = np.zeros((2, len(pairs), antennas))
    amp[row, pairs[:, 0]] = amp[row, pairs[:, 1]] = 1
    phase[row, pairs[:, 0]], phase[row, pairs[:, 1]] = 1, -1
    return amp, phase


def unwrap(phase: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Without jumps of whole turns, outwards from the finite value of most weight, or the first; others stay."""
    out = np.array(phase, dtype=float)
    at = np.flatnonzero(np.isfinite(out))
    if not len(at):
        return out
    seed = 0
    if weight is not None:
        w = np.where(np.isfinite(weight[at]), weight[at], -np.inf)
        seed = int(w.argmax())
    x = out[at]
    turns = np.concatenate([[0.0], np.cumsum(np.rint(np.diff(x) / (2 * np.pi)))])
    out[at] = x - 2 * np.pi * (turns - turns[seed])
    return out


def mean_of(values: np.ndarray, weight: np.ndarray, valid: np.ndarray) -> float:
    total = weight[valid].sum()
    return float((weight[valid] * values[valid]).sum() / total) if total > 0 else 0.0


def coordinate(size: int, x: np.ndarray, block: range, valid: np.ndarray) -> np.ndarray:
    """What polynomials are of: over all channels x by its largest size; in a block, by the valid ones' mean and size."""
    if not size:
        scale = np.abs(x[valid]).max()
        return x / scale if scale > 0 else np.zeros(len(x))
    out, inside = np.zeros(len(x)), np.array(block)
    some = inside[valid[inside]]
    if len(some):
        centred = x - x[some].mean()
        scale = np.abs(centred[some]).max()
        if scale > 0:
            out[inside] = centred[inside] / scale
    return out


def columns(part: Blocks, x: np.ndarray, valid: np.ndarray) -> list[np.ndarray]:
    """The part's basis over all channels: of each block those columns that raise the rank over valid channels."""
    out: list[np.ndarray] = []
    for block in segments(part.size, len(x)):
        inside = np.zeros(len(x), dtype=bool)
        inside[list(block)] = True
        if not (inside & valid).any():
            continue
        t = coordinate(part.size, x, block, valid)
        if isinstance(part.model, PerChannel):
            tried = [np.eye(len(x))[c] for c in block]
        elif isinstance(part.model, Flat):
            tried = [np.ones(len(x))]
        elif isinstance(part.model, Delay):
            tried = [t]
        else:
            tried = [t ** (k + 1) for k in range(part.model.degree)]
        taken: list[np.ndarray] = []
        for c in tried:
            c = np.where(inside, c, 0.0)
            if np.any(c[valid]) and np.linalg.matrix_rank(np.array([*taken, c])[:, valid]) > len(taken):
                taken.append(c)
        out += taken
    return out


def fit_track(track: np.ndarray, weight: np.ndarray, freqs: np.ndarray, spec: Spec, phase: bool) -> np.ndarray:
    """The track as its model has it, less its weighted mean. A free one, or one with too few valid channels, stays.

    Phases are unwrapped first; they need two valid channels, logarithmic amplitudes one.
    """
    if spec.free():
        return track
    x = freqs - freqs.mean()
    if phase:
        x, track_ = 2 * np.pi * x, unwrap(track, weight)
    else:
        track_ = track
    valid = (weight > 0) & np.isfinite(weight) & np.isfinite(track_) & np.isfinite(x)
    if valid.sum() < 1 + phase:
        return track
    basis = [c for part in spec.parts() for c in columns(part, x, valid)]
    if not basis:
        return np.zeros(len(track)) if phase else track
    a = np.array(basis).T
    if valid.sum() < a.shape[1]:
        return track
    fitted = a @ least_squares(a[valid], track_[valid], weight[valid])
    return fitted - mean_of(fitted, weight, valid)
