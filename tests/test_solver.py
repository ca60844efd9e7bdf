"""The bandpass solver on made-up gains: three antennas, two scans, six channels, four products; and its parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from interfera.operators import calibrate
from interfera.solver import bandpass, kernels, linalg
from interfera.solver.models import DELAY, FLAT, PER_CHANNEL, Blocks, Feed, Polynomial, Spec, Station, Sum, evaluate, segments, stations

PAIRS = [(1, 2), (1, 3), (2, 3)]
POLS = ("PP", "PQ", "QP", "QQ")
C = np.arange(1.0, 7.0)
CIS = lambda x: np.exp(1j * x)


def truth():
    one = [(0.9 + 0.03 * C) * CIS(0.04 * (C - 1)), (1.1 + 0.01 * C) * CIS(0.2 + 0.03 * (C - 1)), (0.9 - 0.02 * C) * CIS(-0.1 - 0.04 * (C - 1))]
    two = [one[0] * (1.08 - 0.01 * C) * CIS(0.3 + 0.02 * (C - 1)), one[1] * (0.93 + 0.01 * C) * CIS(-0.2 + 0.01 * (C - 1)), one[2] * (1.05 - 0.006 * C) * CIS(0.1 - 0.02 * (C - 1))]
    return np.array([one, two]).transpose(1, 0, 2)  # antenna, feed, channel


def cube(g, s):
    """v by (scan, baseline, product, channel) of gains and sources (scan, baseline, feed, feed)."""
    out = np.empty((len(s), len(PAIRS), 4, g.shape[2]), complex)
    for b, (i, j) in enumerate(PAIRS):
        for p, name in enumerate(POLS):
            fa, fb = "PQ".index(name[0]), "PQ".index(name[1])
            out[:, b, p] = g[i - 1, fa] * s[:, b, fa, fb, None] * g[j - 1, fb].conj()
    return out


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(11)
    s = rng.normal(size=(2, 3, 2, 2)) + 1j * rng.normal(size=(2, 3, 2, 2)) + 3
    return truth(), s, cube(truth(), s)


def options(**more):
    return bandpass.Options(antennas=3, freqs=tuple(C), ref_ant=1, min_baselines=3, **more)


def setup(**more):
    return options(**more).setup(np.array(PAIRS) - 1)


def rows(spark, v, w=None):
    out = []
    for s, b, p, c in np.ndindex(v.shape):
        out.append((f"k{s}", "spw_0", "", 0.5 + s, *PAIRS[b], POLS[p], c + 1, float(v[s, b, p, c].real), float(v[s, b, p, c].imag), 1.0 if w is None else float(w[s, b, p, c])))
    return spark.createDataFrame(out, "partition_key string, spw string, sub_scan_name string, ti double, ant1 int, ant2 int, pol string, chan int, re double, im double, w double")


def same_up_to_gauge(g, want, atol):
    """Each track is the truth times a factor of its own, and each channel's phases have one more in common."""
    ratio = g / want
    ratio = ratio * np.abs(ratio[0, 0]) / ratio[0, 0]
    assert np.abs(ratio / ratio[:, :, :1] - 1).max() < atol


def test_ratios_recover_gains(made):
    g, _, v = made
    got, solved = kernels.initial(v, np.ones(v.shape), setup())
    c0 = kernels.reference_channel(np.ones(v.shape), (0, 3))
    assert c0 == 0 and solved[:, :, 1:].all() and not solved[:, :, 0].any()
    for b, (i, j) in enumerate(PAIRS):
        for feed, p in enumerate((0, 3)):
            model = got[i - 1, feed] * got[j - 1, feed].conj()
            assert np.abs(model / model[c0] - v[0, b, p] / v[0, b, p, c0]).max() < 1e-10


def test_refined_gains_fit_and_are_in_the_gauge(made):
    g, s, v = made
    w = np.ones(v.shape)
    k = setup(iterations=200, tolerance=1e-14)
    start = kernels.settle(kernels.initial(v, w, k)[0], w, k)
    before = kernels.objective(start, kernels.sources(start, v, w, k), v, w, k)
    got, solved = kernels.solve(v, w, k)
    left = kernels.objective(got, kernels.sources(got, v, w, k), v, w, k)
    assert left <= before + 1e-12 and left < 1e-10 and solved.all()
    same_up_to_gauge(got, g, 1e-5)
    weight = kernels.support(w, k, parallel=True)
    for a, f in np.ndindex(3, 2):
        assert abs(linalg.mean_of(np.log(np.abs(got[a, f])), weight[a, f], weight[a, f] > 0)) < 1e-12
        assert abs(linalg.mean_of(linalg.unwrap(np.angle(got[a, f]), weight[a, f]), weight[a, f], weight[a, f] > 0)) < 1e-12
    ref = kernels.settle(got, w, setup(gauge=2))
    assert abs(linalg.mean_of(np.log(np.abs(ref[1, 0])), weight[1, 0], weight[1, 0] > 0)) < 1e-12


def test_solution_on_spark(spark, made):
    g, s, v = made
    vis = rows(spark, v)
    parts = vis.select("partition_key", "spw", "sub_scan_name").distinct()
    data = bandpass.dataset(vis.drop("spw", "sub_scan_name"), parts)
    assert data.count() == v.size and sorted({(r.slot, r.center) for r in data.select("slot", "center").collect()}) == [(0, 0.5), (1, 1.5)]
    gains = bandpass.wrap(bandpass.solve_bandpass(data, options(iterations=200, tolerance=1e-14)), 3, 6)
    got = {(r.slot, r.ant, r.feed, r.chan): complex(r.g_re, r.g_im) for r in gains.collect()}
    assert len(got) == 2 * 3 * 2 * 6
    for slot in range(2):
        same_up_to_gauge(np.array([[[got[slot, a, f, c] for c in range(1, 7)] for f in (1, 2)] for a in (1, 2, 3)]), g, 1e-5)
    # the template serves both scans alike
    assert all(got[0, a, f, c] == got[1, a, f, c] for a in (1, 2, 3) for f in (1, 2) for c in range(1, 7))
    applied = calibrate.apply_bandpass(vis, parts.withColumn("center", F.when(F.col("partition_key") == "k0", 0.5002).otherwise(7.0)), gains)
    flat = {(r.partition_key, r.ant1, r.ant2, r.pol, r.chan): complex(r.re, r.im) for r in applied.collect()}
    b = [flat["k0", 1, 2, "PP", c] for c in range(1, 7)]
    assert np.abs(np.array(b) / b[0] - 1).max() < 1e-5
    assert flat["k1", 1, 2, "PP", 3] == v[1, 0, 0, 2]  # no scan near 7 h
    with pytest.raises(Exception, match="no gains for window spw_9"):
        calibrate.apply_bandpass(vis, parts.withColumn("center", F.lit(0.5)).withColumn("spw", F.lit("spw_9")), gains).count()
    n = bandpass.parameters(gains, [], []).first().n_parameters
    assert n == 3 * 2 * 2 * 5
    assert {r.n_baselines for r in bandpass.baselines_with_data(data).collect()} == {2}
    per_scan = {1: Station(reference=Feed(phase=Spec(per_scan=True)))}
    low = bandpass.under_determined(data, options(stations=per_scan))
    assert [(r.ant, r.slot, r.feed, r.freedom) for r in low.collect()] == [(1, 0, 1, 6), (1, 1, 1, 6)]
    varied = bandpass.solve_bandpass(data, options(iterations=5, stations=per_scan))
    assert bandpass.parameters(varied, [(1, 1)], []).first().n_parameters == 3 * 2 * 2 * 5 + 5
    random = bandpass.solve_bandpass(data, options(iterations=3, seed=4))
    assert sorted(map(tuple, random.collect())) == sorted(map(tuple, random.collect()))
    with pytest.raises(Exception, match="don't fill"):
        bandpass.wrap(gains.where("chan < 6"), 3, 6).count()
    assert bandpass.solve_bandpass(data.limit(0), options()).count() == 0


def test_solution_follows_the_model(made):
    """Quadratic logarithmic amplitudes and phases, a unit source: what the model can't say must vanish."""
    rng = np.random.default_rng(5)
    n, ants = 16, 4
    x = np.linspace(-1, 1, n)
    pairs = np.array([(i, j) for i in range(ants) for j in range(i + 1, ants)])
    poly = lambda s: sum(rng.normal(scale=k) * x ** (i + 1) for i, k in enumerate(s))
    g = np.array([[np.exp(poly((0.05, 0.02)) + 1j * poly((0.1, 0.05))) for _ in range(2)] for _ in range(ants)])
    quadratic = Spec(Sum((Blocks(FLAT), Blocks(Polynomial(2)))))
    station = Station(reference=Feed(quadratic, quadratic), relative=Feed(quadratic, quadratic))
    o = bandpass.Options(antennas=ants, freqs=tuple(np.arange(n) + 1.0), stations={a: station for a in range(1, ants + 1)}, iterations=60, tolerance=1e-12)
    k = o.setup(pairs)
    v = kernels.models_of(g, k)[None] * np.where(np.isin(np.arange(4), (0, 3)), 1, 0)[None, None, :, None]
    got, _ = kernels.solve(v, np.ones(v.shape), k)
    basis = np.vander(np.arange(n) - (n - 1) / 2, 3)
    for a, f in np.ndindex(ants, 2):
        for track in (np.log(np.abs(got[a, f])), linalg.unwrap(np.angle(got[a, f]))):
            left = track - basis @ np.linalg.lstsq(basis, track, rcond=None)[0]
            assert np.abs(left).max() < 1e-6 * max(1e-3, np.abs(track).max())


def test_flat_tracks_are_filled_in_from_neighbours():
    g = np.array([[[0.9, 1.0, 0.0, 1.1, 1.2], [1.0] * 5]], complex)
    out, repaired = kernels.sanitise(g, np.ones((1, 2, 5)))
    assert repaired == [(0, 0, 2, 0.0, 1.05)] and out[0, 0, 2] == 1.05 and (out[0, 1] == 1).all()
    assert kernels.sanitise(g, np.zeros((1, 2, 5)))[1] == []


def test_least_squares():
    rng = np.random.default_rng(0)
    a, b, w = rng.normal(size=(9, 3)), rng.normal(size=9), rng.uniform(0.5, 2, 9)
    dense = np.linalg.solve(a.T @ np.diag(w) @ a, a.T @ (w * b))
    assert np.allclose(linalg.least_squares(a, b, w), dense, rtol=1e-6)
    p = linalg.penalised(a, b, w, np.array([1.0, 2.0, 3.0]))
    assert np.allclose(p, np.linalg.solve(a.T @ np.diag(w) @ a + np.diag([1.0, 2.0, 3.0]), a.T @ (w * b)))
    assert np.allclose(linalg.constrained(a, b, w, np.array([[1.0, 1.0, 0]]), np.array([2.0]))[:2].sum(), 2, atol=1e-4)
    amp, phase = linalg.design(np.array([(0, 2), (1, 2)]), 3)
    assert amp.tolist() == [[1, 0, 1], [0, 1, 1]] and phase.tolist() == [[1, 0, -1], [0, 1, -1]]


def test_models():
    assert [list(r) for r in segments(4, 6)] == [[0, 1, 2, 3], [4, 5]] and [list(r) for r in segments(0, 2)] == [[0, 1]]
    x = np.arange(1.0, 9.0)
    got = [c for p in (Blocks(FLAT, 4), Blocks(Polynomial(1), 4)) for c in linalg.columns(p, x, np.ones(8, bool))]
    assert len(got) == 4 and np.allclose(got[2][:4], [-1, -1 / 3, 1 / 3, 1]) and not got[2][4:].any()
    assert evaluate(FLAT, [], 3.0) == 0 and evaluate(DELAY, [2.0], 3.0) == 6 and evaluate(Polynomial(2), [1.0, 2.0], 3.0) == 21
    for bad in (lambda: evaluate(PER_CHANNEL, [], 1.0), lambda: evaluate(DELAY, [], 1.0), lambda: Feed(amplitude=Spec(DELAY)), lambda: Station(reference_feed=3), lambda: Sum(()), lambda: stations(["AA"], {"XX": Station()})):
        with pytest.raises(ValueError):
            bad()
    spec = Spec(Sum((Blocks(FLAT, 4), Blocks(Polynomial(2)))), per_scan=True)
    assert spec.label() == "flat@block4+poly2@global" and spec.freedom(8) == 2 + 2 and Spec(per_scan=True).freedom(8) == 8 and Spec().freedom(8) == 0
    assert Station(relative=Feed(phase=Spec(per_scan=True))).per_scan("phase", 2) and not Station(relative=Feed(phase=Spec(per_scan=True))).per_scan("phase", 1)
    assert "phase=poly1@block2" in Station(reference=Feed(phase=Spec(Polynomial(1), blocks=2))).summary("AA")
    assert stations(["AA", "AX"], {"AX": Station(2)})[1].reference_feed == 2


def test_ratio_weights():
    assert float(kernels.ratio_weight(2 + 0j, 9.0, 4 + 0j, 16.0)) == pytest.approx(1 / (1 / 36 + 1 / 256))
    assert float(kernels.ratio_weight(0j, 9.0, 4 + 0j, 16.0)) == 0 and float(kernels.ratio_weight(np.nan + 0j, 9.0, 4 + 0j, 16.0)) == 0
    assert float(kernels.double_ratio_weight(np.array(1.0), 2.0, np.array(1.0), 2.0, np.array(2.0), 1.0, np.array(2.0), 1.0)) == pytest.approx(1 / 1.5)
