"""The solver's steps on dense arrays of one window: visibilities v and weights w by (scan, baseline, product, channel),
gains g by (antenna, feed, channel), source coherencies s by (scan, baseline, feed, feed)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from interfera.solver.linalg import design, fit_track, least_squares, mean_of, unwrap
from interfera.solver.models import Station


@dataclass(frozen=True)
class Setup:
    """pairs: (baselines, 2), antennas from 0; feeds: (products, 2), from 0; parallel: the products of feeds 1 and 2;
    mask: (baselines, 2), whether a pair's feeds are alike; gauge: an antenna, or None for zero means."""

    pairs: np.ndarray
    feeds: np.ndarray
    parallel: tuple[int, int]
    freqs: np.ndarray
    stations: tuple[Station, ...]
    mask: np.ndarray
    ref_ant: int | None = None
    gauge: int | None = None
    min_baselines: int = 3
    iterations: int = 8
    tolerance: float = 1e-6

    @property
    def antennas(self) -> int:
        return len(self.stations)


def usable(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (w > 0) & np.isfinite(w) & np.isfinite(v.real) & np.isfinite(v.imag)


def ratio_weight(v1, w1, v0, w0):
    """The weight of ln(v1 / v0); 0 where either says nothing."""
    with np.errstate(all="ignore"):
        p1, p0 = w1 * np.abs(v1) ** 2, w0 * np.abs(v0) ** 2
        out = 1 / (1 / p1 + 1 / p0)
    return np.where(usable(v1, w1) & usable(v0, w0) & (p1 > 0) & (p0 > 0) & np.isfinite(out), out, 0.0)


def double_ratio_weight(*samples) -> np.ndarray:
    """The weight of ln((v1 / v2) / (v3 / v4)), of v1, w1 ... v4, w4."""
    with np.errstate(all="ignore"):
        total = sum(1 / (w * np.abs(v) ** 2) for v, w in zip(samples[::2], samples[1::2]))
    return np.where(np.isfinite(total) & (total > 0), 1 / np.where(total > 0, total, 1), 0.0)


def reference_channel(w: np.ndarray, parallel: tuple[int, int]) -> int:
    """The channel of most weight in parallel hands; the first of equals, or without any."""
    some = w[:, :, list(parallel)]
    return int(np.where((some > 0) & np.isfinite(some), some, 0).sum(axis=(0, 1, 2)).argmax())


def support(w: np.ndarray, setup: Setup, parallel: bool) -> np.ndarray:
    """Weights that each antenna's feeds take part in, by (antenna, feed, channel): of all products, or of parallel hands
    of pairs with like feeds."""
    out = np.zeros((setup.antennas, 2, w.shape[3]))
    good = np.where((w > 0) & np.isfinite(w), w, 0).sum(axis=0)
    for b, (i, j) in enumerate(setup.pairs):
        for p, (fa, fb) in enumerate(setup.feeds):
            if parallel and (p not in setup.parallel or not setup.mask[b, fa]):
                continue
            out[i, fa] += good[b, p]
            out[j, fb] += good[b, p]
    return out


def precision(v: np.ndarray, w: np.ndarray, setup: Setup, feed: int) -> np.ndarray:
    """sum w |v|^2 of a parallel hand at both ends, by (antenna, channel)."""
    p, out = setup.parallel[feed], np.zeros((setup.antennas, v.shape[3]))
    with np.errstate(invalid="ignore"):
        x = np.where(usable(v[:, :, p], w[:, :, p]), w[:, :, p] * np.abs(v[:, :, p]) ** 2, 0).sum(axis=0)
    for b, (i, j) in enumerate(setup.pairs):
        if setup.mask[b, feed]:
            out[i] += x[b]
            out[j] += x[b]
    return out


def initial(v: np.ndarray, w: np.ndarray, setup: Setup) -> tuple[np.ndarray, np.ndarray]:
    """Gains from the ratios of each channel's parallel hands to the reference channel's, and which were solved."""
    channels, n = v.shape[3], setup.antennas
    g, solved = np.ones((n, 2, channels), complex), np.zeros((n, 2, channels), bool)
    a_amp, a_phase = design(setup.pairs, n)
    c0 = reference_channel(w, setup.parallel)
    for c in range(channels):
        for feed, p in enumerate(setup.parallel):
            if c == c0:
                continue
            weight = ratio_weight(v[:, :, p, c], w[:, :, p, c], v[:, :, p, c0], w[:, :, p, c0]) * setup.mask[:, feed]
            _, rows = at = np.nonzero(weight > 0)
            if len(rows) < setup.min_baselines:  # samples, not baselines
                continue
            d = v[:, :, p, c][at] / v[:, :, p, c0][at]
            ends = np.bincount(setup.pairs[rows].ravel(), minlength=n)
            active = np.flatnonzero(ends)
            fixed = local_reference(active, ends, setup, feed)
            free = active[active != fixed]
            if not len(free):
                continue
            amp, phase = np.zeros((2, n))
            amp[active] = least_squares(a_amp[np.ix_(rows, active)], np.log(np.abs(d)), weight[at])
            phase[free] = least_squares(a_phase[np.ix_(rows, free)], np.angle(d), weight[at])
            g[:, feed, c] = np.exp(amp + 1j * phase)
            solved[active, feed, c] = True
    return g, solved


def local_reference(active: np.ndarray, ends: np.ndarray, setup: Setup, feed: int) -> int:
    """The antenna whose phase is fixed: the gauge's, else the user's, else the one in most samples of those whose phase
    isn't fitted for each scan."""
    for wish in (setup.gauge, setup.ref_ant):
        if wish is not None and wish in active:
            return wish
    steady = [a for a in active if not setup.stations[a].per_scan("phase", feed + 1)] or list(active)
    return int(max(steady, key=lambda a: ends[a]))


def project(g: np.ndarray, weight: np.ndarray, setup: Setup) -> np.ndarray:
    """Gains as the stations' models have them: amplitudes, then phases; of each the reference feed, then the ratio of the
    other to it. weight: of each antenna, feed and channel."""
    g = g.copy()
    with np.errstate(all="ignore"):
        for ant, model in enumerate(setup.stations):
            ref = model.reference_feed - 1
            par = 1 - ref
            both = np.sqrt(weight[ant, ref] * weight[ant, par])
            if not model.reference.amplitude.free():
                g[ant, ref] = np.exp(fit_track(np.log(np.abs(g[ant, ref])), weight[ant, ref], setup.freqs, model.reference.amplitude, False) + 1j * np.angle(g[ant, ref]))
            if not model.relative.amplitude.free():
                fitted = fit_track(np.log(np.abs(g[ant, par] / g[ant, ref])), both, setup.freqs, model.relative.amplitude, False)
                g[ant, par] = np.abs(g[ant, ref]) * np.exp(fitted + 1j * np.angle(g[ant, par]))
        for ant, model in enumerate(setup.stations):
            ref = model.reference_feed - 1
            par = 1 - ref
            both = np.sqrt(weight[ant, ref] * weight[ant, par])
            if not model.reference.phase.free():
                g[ant, ref] = np.abs(g[ant, ref]) * np.exp(1j * fit_track(np.angle(g[ant, ref]), weight[ant, ref], setup.freqs, model.reference.phase, True))
            if not model.relative.phase.free():
                fitted = fit_track(np.angle(g[ant, par] / g[ant, ref]), both, setup.freqs, model.relative.phase, True)
                g[ant, par] = np.abs(g[ant, par]) * np.exp(1j * (np.angle(g[ant, ref]) + fitted))
    return g


def models_of(g: np.ndarray, setup: Setup) -> np.ndarray:
    """g_a conj(g_b) by (baseline, product, channel)."""
    a = g[setup.pairs[:, 0][:, None], setup.feeds[:, 0][None, :]]
    b = g[setup.pairs[:, 1][:, None], setup.feeds[:, 1][None, :]]
    return a * b.conj()


def sources(g: np.ndarray, v: np.ndarray, w: np.ndarray, setup: Setup) -> np.ndarray:
    """sum w v conj(m) / sum w |m|^2 over channels; 0 without data."""
    m = models_of(g, setup)[None]
    power = np.abs(m) ** 2
    ok = usable(v, w) & np.isfinite(power) & (power > 0)
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.where(ok, w * v * m.conj(), 0).sum(axis=3)
        d = np.where(ok, w * power, 0).sum(axis=3)
    out = np.zeros((*v.shape[:2], 2, 2), complex)
    out[:, :, setup.feeds[:, 0], setup.feeds[:, 1]] = np.where(d > 0, x / np.where(d > 0, d, 1), 0)
    return out


def objective(g: np.ndarray, s: np.ndarray, v: np.ndarray, w: np.ndarray, setup: Setup) -> float:
    model = models_of(g, setup)[None] * s[:, :, setup.feeds[:, 0], setup.feeds[:, 1], None]
    ok = usable(v, w)
    with np.errstate(invalid="ignore", over="ignore"):
        return float(np.where(ok, w * np.abs(v - model) ** 2, 0).sum())


def factor(track: np.ndarray, weight: np.ndarray) -> complex:
    """The weighted mean of logarithmic amplitude and unwrapped phase, as a factor; 1 without a valid channel."""
    valid = (weight > 0) & np.isfinite(weight) & np.isfinite(track)
    if not valid.any():
        return 1.0 + 0j
    with np.errstate(divide="ignore"):
        amp = mean_of(np.log(np.abs(track)), weight, valid)
    return complex(np.exp(amp + 1j * mean_of(unwrap(np.angle(track), weight), weight, valid)))


def factors(g: np.ndarray, weight: np.ndarray, gauge: int | None) -> np.ndarray:
    """What a gauge divides each antenna's feeds by: their own means, or those of one antenna."""
    if gauge is None:
        return np.array([[factor(g[a, f], weight[a, f]) for f in range(2)] for a in range(len(g))])
    return np.tile([factor(g[gauge, f], weight[gauge, f]) for f in range(2)], (len(g), 1))


def refine(g: np.ndarray, solved: np.ndarray, v: np.ndarray, w: np.ndarray, setup: Setup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Alternating least squares: antenna by antenna and feed by feed with the newest values of the others, then the
    models, the gauge and the sources. Ends without improvement from the second round on, or once it is small."""
    g, solved = g.copy(), solved.copy()
    every = support(w, setup, parallel=False)
    s, ok = sources(g, v, w, setup), usable(v, w)
    before = objective(g, s, v, w, setup)
    at = [[(b, p, end) for b in range(len(setup.pairs)) for p in range(len(setup.feeds)) for end in (0, 1) if (setup.pairs[b, end], setup.feeds[p, end]) == (ant, feed)] for ant in range(setup.antennas) for feed in range(2)]
    for round_ in range(setup.iterations):
        total = np.zeros(g.shape)
        for k, ends in enumerate(at):
            ant, feed = divmod(k, 2)
            x, d = np.zeros(v.shape[3], complex), np.zeros(v.shape[3])
            for b, p, end in ends:
                (fa, fb), src = setup.feeds[p], s[:, b, setup.feeds[p, 0], setup.feeds[p, 1], None]
                other = g[setup.pairs[b, 1 - end], setup.feeds[p, 1 - end]][None]
                coeff = src * other.conj() if end == 0 else (other * src).conj()
                power = np.abs(coeff) ** 2
                use = ok[:, b, p] & (power > 0)
                sample = v[:, b, p] if end == 0 else v[:, b, p].conj()
                with np.errstate(invalid="ignore", over="ignore"):
                    x += np.where(use, w[:, b, p] * coeff.conj() * sample, 0).sum(axis=0)
                    d += np.where(use, w[:, b, p] * power, 0).sum(axis=0)
            total[ant, feed] = d
            has = d > 0
            g[ant, feed, has] = x[has] / d[has]
            solved[ant, feed, has] = True
        g = project(g, total * np.abs(g) ** 2, setup)
        by = factors(g, every, setup.gauge)
        g = g / by[:, :, None]
        s = sources(g, v, w, setup)
        now = objective(g, s, v, w, setup)
        gain = before - now
        if (round_ and gain <= 0) or gain / max(before, np.finfo(float).eps) <= setup.tolerance:
            break
        before = now
    return g, solved, s


def regauged(s: np.ndarray, by: np.ndarray, setup: Setup) -> np.ndarray:
    """Sources of gains that were divided by ``by``."""
    a, b = by[setup.pairs[:, 0]], by[setup.pairs[:, 1]]
    return a[None, :, :, None] * s * b.conj()[None, :, None, :]


def neighbour_scale(amp: np.ndarray, weight: np.ndarray, c: int, window: int = 2) -> float | None:
    """The median of the good amplitudes near channel c, itself left out; with fewer than two, of all others."""
    good = (weight > 0) & np.isfinite(amp) & (amp > 0)
    good[c] = False
    near = good.copy()
    near[: max(0, c - window)] = False
    near[c + window + 1 :] = False
    some = near if near.sum() >= 2 else good
    return float(np.median(amp[some])) if some.any() else None


def sanitise(g: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, float, float]]]:
    """Broken amplitudes get their neighbours' median, if there is one; also (antenna, feed, channel, old, new) of each."""
    out, repaired, amp = g.copy(), [], np.abs(g)
    for a, f, c in np.argwhere((weight > 0) & ~(np.isfinite(amp) & (amp > 0))).tolist():
        if (new := neighbour_scale(amp[a, f], weight[a, f], c)) is not None:
            out[a, f, c] = new * np.exp(1j * np.angle(g[a, f, c]))
            repaired.append((a, f, c, float(amp[a, f, c]), new))
    return out, repaired


def settle(g: np.ndarray, w: np.ndarray, setup: Setup) -> np.ndarray:
    """Sanitised, then in the gauge."""
    weight = support(w, setup, parallel=True)
    g, _ = sanitise(g, weight)
    return g / factors(g, weight, setup.gauge)[:, :, None]


def solve(v: np.ndarray, w: np.ndarray, setup: Setup) -> tuple[np.ndarray, np.ndarray]:
    """From ratios, projected on the models and settled, to refined and settled gains; and which were solved."""
    g, solved = initial(v, w, setup)
    weight = np.stack([precision(v, w, setup, f) for f in range(2)], axis=1)
    g = settle(project(g, weight, setup), w, setup)
    if setup.iterations:
        g, solved, _ = refine(g, solved, v, w, setup)
        g = settle(g, w, setup)
    return g, solved


def random_start(rng: np.random.Generator, w: np.ndarray, setup: Setup, amplitude: float = 0.05, phase: float = 0.2) -> np.ndarray:
    """Gains with normal logarithmic amplitudes and phases, in the gauge."""
    shape = (setup.antennas, 2, w.shape[3])
    g = np.exp(amplitude * rng.normal(size=shape) + 1j * phase * rng.normal(size=shape))
    return g / factors(g, support(w, setup, parallel=False), setup.gauge)[:, :, None]


def merged(template: np.ndarray, scan: np.ndarray, solved: np.ndarray, setup: Setup) -> np.ndarray:
    """The template, with the scan's amplitudes and phases where these are fitted for each scan and were solved."""
    by = lambda what: np.array([[s.per_scan(what, f) for f in (1, 2)] for s in setup.stations])[:, :, None] & solved
    amp = np.where(by("amplitude"), np.abs(scan), np.abs(template))
    return amp * np.exp(1j * np.where(by("phase"), np.angle(scan), np.angle(template)))
