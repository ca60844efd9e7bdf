"""Bandpass gains of a set: a template of all scans of each window, and each scan's own, in grouped maps.

Visibilities are averaged over scans first, by Spark. A window's averages (channels x scans x baselines x products) must
fit one task, as the template is solved from all of them; each scan is solved in a task of its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from interfera.functions.cplx import weighted
from interfera.operators import reduce
from interfera.solver import kernels
from interfera.solver.models import Station

GAIN = "spw string, slot int, center double, ant int, feed int, chan int, g_re double, g_im double, solved boolean"


@dataclass(frozen=True)
class Options:
    """stations: special models by antenna's number; gauge: an antenna, or None for zero means; labels: of antennas, their
    two feeds' (pairs of unlike feeds give no parallel hands)."""

    antennas: int
    freqs: tuple[float, ...]
    pols: tuple[str, ...] = ("PP", "PQ", "QP", "QQ")
    ref_ant: int | None = None
    gauge: int | None = None
    stations: dict[int, Station] = field(default_factory=dict)
    labels: dict[int, tuple[str, str]] = field(default_factory=dict)
    min_baselines: int = 3
    iterations: int = 8
    tolerance: float = 1e-6
    seed: int | None = None

    def __post_init__(self):
        if not {"PP", "QQ"} <= set(self.pols):
            raise ValueError("a solution needs both parallel hands")
        wishes = {self.gauge, self.ref_ant, *self.stations, *self.labels} - {None}
        if not all(1 <= a <= self.antennas for a in wishes):
            raise ValueError(f"antennas are 1 to {self.antennas}")

    def setup(self, pairs: np.ndarray) -> kernels.Setup:
        feeds = np.array([[("P", "Q").index(c) for c in p] for p in self.pols])
        label = lambda a: self.labels.get(int(a) + 1, ("R", "L"))
        mask = np.array([[label(i)[f] == label(j)[f] for f in range(2)] for i, j in pairs], dtype=bool).reshape(-1, 2)
        every = tuple(self.stations.get(a, Station()) for a in range(1, self.antennas + 1))
        zero = lambda a: None if a is None else a - 1
        return kernels.Setup(pairs, feeds, (self.pols.index("PP"), self.pols.index("QQ")), np.array(self.freqs, float), every, mask, zero(self.ref_ant), zero(self.gauge), self.min_baselines, self.iterations, self.tolerance)


def scan_slots(partitions: DataFrame) -> DataFrame:
    """Adds ``slot``, from 0, to partitions (spw, start, sub_scan_name, partition_key, others): their order in the window."""
    return partitions.withColumn("slot", (F.row_number().over(W.partitionBy("spw").orderBy("start", "sub_scan_name", "partition_key")) - 1).cast("int"))


def dataset(vis: DataFrame, partitions: DataFrame) -> DataFrame:
    """Scan averages with slots: spw, slot, center, ant1, ant2, pol, chan, re, im, w. vis: partition_key, ti (hours) and
    the usual; partitions: partition_key, spw, sub_scan_name."""
    ends = vis.groupBy("partition_key").agg(F.min("ti").alias("start"), F.max("ti").alias("stop"))
    slots = scan_slots(partitions.select("partition_key", "spw", "sub_scan_name").join(ends, "partition_key"))
    slots = slots.select("partition_key", "spw", "slot", ((F.col("start") + F.col("stop")) / 2).alias("center"))
    mean = reduce.scan_average(vis, "partition_key", "ant1", "ant2", "pol", "chan")
    return mean.join(slots, "partition_key").select("spw", "slot", "center", "ant1", "ant2", "pol", "chan", "re", "im", F.col("weight").alias("w"))


def _cube(rows: pd.DataFrame, options: Options) -> tuple[np.ndarray, np.ndarray, kernels.Setup, np.ndarray, np.ndarray]:
    """v, w, the setup, and the scans' slots and centres."""
    pairs = np.array(sorted(set(zip(rows["ant1"] - 1, rows["ant2"] - 1))), dtype=int).reshape(-1, 2)
    place = {p: i for i, p in enumerate(map(tuple, pairs.tolist()))}
    slots = np.sort(rows["slot"].unique())
    centers = rows.groupby("slot")["center"].first().loc[slots].to_numpy()
    v = np.full((len(slots), len(pairs), len(options.pols), len(options.freqs)), np.nan + 0j)
    w = np.zeros(v.shape)
    rows = rows[rows["pol"].isin(options.pols)]
    b = [place[p] for p in zip(rows["ant1"] - 1, rows["ant2"] - 1)]
    at = (np.searchsorted(slots, rows["slot"]), b, [options.pols.index(p) for p in rows["pol"]], rows["chan"].to_numpy() - 1)
    v.real[at], v.imag[at] = rows["re"].to_numpy(), rows["im"].to_numpy()
    w[at] = rows["w"].to_numpy()
    return v, w, options.setup(pairs), slots, centers


def _table(spw: str, slot: int, center: float, g: np.ndarray, solved: np.ndarray) -> pd.DataFrame:
    ant, feed, chan = (x.ravel() for x in np.indices(g.shape))
    return pd.DataFrame({"spw": spw, "slot": np.int32(slot), "center": center, "ant": (ant + 1).astype(np.int32), "feed": (feed + 1).astype(np.int32), "chan": (chan + 1).astype(np.int32), "g_re": g.real.ravel(), "g_im": g.imag.ravel(), "solved": solved.ravel()})


def _start(v: np.ndarray, w: np.ndarray, setup: kernels.Setup, seed: int | None, salt: int) -> tuple[np.ndarray, np.ndarray]:
    if seed is None:
        return kernels.solve(v, w, setup)
    g = kernels.random_start(np.random.default_rng([seed, salt]), w, setup)
    solved = np.ones(g.shape, bool)
    if setup.iterations:
        g, solved, _ = kernels.refine(g, solved, v, w, setup)
    return kernels.settle(g, w, setup), solved


def solve_bandpass(data: DataFrame, options: Options) -> DataFrame:
    """Gains (GAIN) of each scan of each window from a ``dataset``. A feed's amplitude and phase come from the template, or
    where its model is fitted for each scan, from the scan. An empty set has none.

    With options.seed the solution starts from random gains instead of the channels' ratios.
    """

    def template(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        v, w, setup, _, _ = _cube(rows, options)
        g, solved = _start(v, w, setup, options.seed, 0)
        out = _table(key[0], -1, 0.0, g, solved)
        out["support"] = kernels.support(w, setup, parallel=True).ravel()
        return out

    def scan(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        v, w, setup, slots, centers = _cube(rows, options)
        g, solved = _start(v, w, setup, options.seed, 1 + int(slots[0]))
        return _table(key[0], int(slots[0]), float(centers[0]), g, solved)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ant", "feed", "chan"])
        shape = (options.antennas, 2, len(options.freqs))
        whole = lambda a, b: (rows[a].to_numpy() + 1j * rows[b].to_numpy()).reshape(shape)
        solved = rows["solved"].to_numpy(dtype=bool).reshape(shape)
        g = kernels.merged(whole("t_re", "t_im"), whole("g_re", "g_im"), solved, options.setup(np.zeros((0, 2), int)))
        zero = None if options.gauge is None else options.gauge - 1
        g = g / kernels.factors(g, rows["support"].to_numpy().reshape(shape), zero)[:, :, None]
        return _table(rows["spw"].iloc[0], int(rows["slot"].iloc[0]), float(rows["center"].iloc[0]), g, solved)

    of_all = data.groupBy("spw").applyInPandas(template, GAIN + ", support double")
    of_scans = data.groupBy("spw", "slot").applyInPandas(scan, GAIN)
    of_all = of_all.select("spw", "ant", "feed", "chan", F.col("g_re").alias("t_re"), F.col("g_im").alias("t_im"), "support")
    return of_scans.join(of_all, ["spw", "ant", "feed", "chan"]).groupBy("spw", "slot").applyInPandas(merge, GAIN)


def wrap(gains: DataFrame, antennas: int, channels: int) -> DataFrame:
    """Gains, checked when read: a scan must have one for each antenna, feed and channel."""
    n = F.count(F.lit(1)).over(W.partitionBy("spw", "slot"))
    fits = F.when(n == 2 * antennas * channels, True).otherwise(F.raise_error(F.lit("a scan's gains don't fill its axes")).cast("boolean"))
    return gains.withColumn("fits_", fits).where("fits_").drop("fits_")


def under_determined(data: DataFrame, options: Options, most: int = 8) -> DataFrame:
    """The first ``most`` of (ant, slot, feed) whose model is fitted for each scan over fewer baselines with parallel data
    than options.min_baselines, but not none: ant, slot, feed, n_baselines, freedom."""
    rows = baselines_with_data(data)
    free = [(a, f, m.freedom(len(options.freqs)) + n.freedom(len(options.freqs))) for a, s in options.stations.items() for f in (1, 2) for part in [s.reference if f == s.reference_feed else s.relative] for m, n in [(part.phase, part.amplitude)]]
    free = data.sparkSession.createDataFrame([x for x in free if x[2]], "ant int, feed int, freedom int")
    few = rows.join(F.broadcast(free), ["ant", "feed"]).where(F.col("n_baselines") < options.min_baselines)
    return few.select("ant", "slot", "feed", "n_baselines", "freedom").orderBy("ant", "slot", "feed").limit(most)


def baselines_with_data(data: DataFrame) -> DataFrame:
    """How many baselines of each antenna, scan and feed have a parallel hand of some weight: spw, slot, ant, feed."""
    some = data.where(weighted() & F.col("pol").isin("PP", "QQ")).select("spw", "slot", "ant1", "ant2", F.when(F.col("pol") == "PP", 1).otherwise(2).alias("feed")).distinct()
    return some.select("spw", "slot", "feed", F.explode(F.array("ant1", "ant2")).alias("ant")).groupBy("spw", "slot", "ant", "feed").agg(F.count(F.lit(1)).alias("n_baselines"))


def parameters(gains: DataFrame, phase_per_scan: list[tuple[int, int]], amplitude_per_scan: list[tuple[int, int]]) -> DataFrame:
    """n_parameters of each window: a track of n finite gains has n - 1 for its amplitude and n - 1 for its phase; once for
    all scans, or, if (ant, feed) is listed, of the solved ones for each scan."""
    listed = lambda pairs: F.array(*[F.lit(f"{a}/{f}") for a, f in pairs]) if pairs else F.array().cast("array<string>")
    ok = F.coalesce(~F.isnan("g_re") & ~F.isnan("g_im"), F.lit(False))
    n = lambda c: F.greatest(F.sum(c.cast("int")) - 1, F.lit(0))
    tracks = gains.groupBy("spw", "slot", "ant", "feed").agg(n(ok).alias("n"), n(ok & F.col("solved")).alias("n_solved"))
    name = F.concat_ws("/", "ant", "feed")
    phase, amp = F.array_contains(listed(phase_per_scan), name).cast("int"), F.array_contains(listed(amplitude_per_scan), name).cast("int")
    once = F.when(F.col("slot") == F.min("slot").over(_by("spw")), (2 - phase - amp) * F.col("n")).otherwise(0)
    return tracks.withColumn("p", once + (phase + amp) * F.col("n_solved")).groupBy("spw").agg(F.sum("p").alias("n_parameters"))


def _by(*columns: str):
    return W.partitionBy(*columns)
