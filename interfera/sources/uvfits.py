"""UVFITS files: random groups read by ranges of records as a Python data source, and written as one file.

Files are opened by path on the driver and on executors, so they must lie where all of them see it.
"""

from __future__ import annotations

import datetime as dt
import logging
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from interfera.functions import names
from interfera.sources import fits
from interfera.sources.fits import Card, value
from interfera.uvset import UVSet

RECORDS = "record bigint, u float, v float, uw float, baseline int, date_1 double, date_2 double, extras map<string, array<double>>, re array<float>, im array<float>, wt array<float>"
#: Stokes codes of the standard, as products of feeds P and Q; circular, then linear.
STOKES = {-1: "PP", -2: "QQ", -3: "PQ", -4: "QP", -5: "PP", -6: "QQ", -7: "PQ", -8: "QP"}
ORDER = ["PP", "PQ", "QP", "QQ"]
#: Mounts of the standard, as coefficients of the parallactic angle and of elevation.
MOUNTS = {0: (1, 0), 1: (0, 0), 4: (1, 1), 5: (1, -1)}
TOLERANCE_H = 1e-6
_CHUNK = 4096
log = logging.getLogger(__name__)


# --- reading ---------------------------------------------------------------------------------------------------------


class UVFits(DataSource):
    """``spark.read.format("uvfits")``; option recordsPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "uvfits"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("recordsPerPartition", 50_000)))


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def _primary(self) -> fits.Hdu:
        with open(_local(self.path), "rb") as f:
            return fits.hdus(f)[0]

    def partitions(self) -> list[_Range]:
        n = int(value(self._primary().cards, "GCOUNT", 0))
        return [_Range(i, min(i + self.size, n)) for i in range(0, n, self.size)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        primary = self._primary()
        cards = primary.cards
        dims = fits.shape(cards)
        if dims[0] < 3:
            raise ValueError("visibilities without weights")
        params = [str(value(cards, f"PTYPE{i + 1}", "")) for i in range(int(value(cards, "PCOUNT", 0)))]
        scale = lambda key, i, d: float(value(cards, f"{key}{i + 1}", d))
        width = len(params) + int(np.prod(dims))
        if value(cards, "BITPIX") != -32:
            raise ValueError("records that aren't 32-bit reals")
        pscal, pzero = (np.array([scale(k, i, d) for i in range(len(params))]) for k, d in (("PSCAL", 1.0), ("PZERO", 0.0)))
        bscale, bzero = float(value(cards, "BSCALE", 1.0)), float(value(cards, "BZERO", 0.0))
        kinds = [p.split("-")[0].upper() for p in params]
        with open(_local(self.path), "rb") as f:
            for first in range(partition.first, partition.last, _CHUNK):
                n = min(_CHUNK, partition.last - first)
                f.seek(primary.offset + 4 * width * first)
                raw = np.frombuffer(f.read(4 * width * n), dtype=">f4").reshape(n, width)
                p = raw[:, : len(params)].astype(np.float64) * pscal + pzero
                data = raw[:, len(params) :].reshape(n, -1, dims[0])[:, :, :3]
                data = data * np.float32(bscale) + np.float32(bzero) if (bscale, bzero) != (1.0, 0.0) else data.astype(np.float32)
                yield _batch(first, p, params, kinds, data)


def _batch(first: int, p: np.ndarray, params: list[str], kinds: list[str], data: np.ndarray) -> pa.RecordBatch:
    n = len(p)
    at = lambda kind: [i for i, k in enumerate(kinds) if k == kind]
    one = lambda kind: p[:, at(kind)[0]] if at(kind) else np.zeros(n)
    dates = at("DATE")
    known = {i for kind in ("UU", "VV", "WW", "BASELINE", "DATE") for i in at(kind)}
    others = sorted({params[i] for i in range(len(params)) if i not in known})
    extras = [[(name, [p[r, i] for i, q in enumerate(params) if q == name]) for name in others] for r in range(n)]
    lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * data.shape[1], pa.int32()), pa.array(np.ascontiguousarray(data[:, :, k]).ravel())) for k in range(3)]
    columns = [
        pa.array(np.arange(first, first + n)), *[pa.array(one(k).astype(np.float32)) for k in ("UU", "VV", "WW")], pa.array(np.rint(one("BASELINE")).astype(np.int32)),
        pa.array(p[:, dates[0]] if dates else np.zeros(n)), pa.array(p[:, dates[1]] if len(dates) > 1 else np.zeros(n)),
        pa.array(extras, pa.map_(pa.string(), pa.list_(pa.float64()))), *lists,
    ]
    return pa.RecordBatch.from_arrays(columns, names=["record", "u", "v", "uw", "baseline", "date_1", "date_2", "extras", "re", "im", "wt"])


def _local(path: str) -> str:
    return re.sub("^file:(//)?", "", path)


def axis(cards: tuple, want) -> int | None:
    """The first axis whose type, in upper case, is as wanted."""
    kinds = sorted((int(m[1]), str(c.value)) for c in cards if (m := re.match(r"CTYPE(\d+)$", c.key)))
    return next((i for i, kind in kinds if want(kind.strip().upper())), None)


def stokes(cards: tuple, n: int) -> tuple[list[int], list[str]]:
    """Codes and products along the axis; without one no codes, and numbers as products."""
    i = axis(cards, lambda k: k == "STOKES")
    if i is None:
        return [], [str(k + 1) for k in range(n)]
    first, step, ref = (float(value(cards, f"{k}{i}", 1.0)) for k in ("CRVAL", "CDELT", "CRPIX"))
    codes = [round(first + step * (k + 1 - ref)) for k in range(n)]
    if unknown := [c for c in codes if c not in STOKES]:
        raise ValueError(f"unknown Stokes codes: {unknown}")
    return codes, [STOKES[c] for c in codes]


def _dims(cards: tuple) -> tuple[int, int]:
    """Products and channels (with windows) of a record."""
    n = int(value(cards, "NAXIS", 0))
    size = {i: int(value(cards, f"NAXIS{i}", 1)) for i in range(2, n + 1)}
    pols = size.get(axis(cards, lambda k: k == "STOKES") or 0) or (size[3] if 3 in size else 1)
    return pols, int(np.prod([*size.values()])) // size[2] // pols


def julian_date(date: str) -> float:
    """Of midnight of a date (year-month-day, or day/month/year of the last century); 0 for none."""
    if not date:
        return 0.0
    if m := re.match(r"(\d{4})-(\d\d)-(\d\d)", date):
        d = dt.date(*map(int, m.groups()))
    else:
        day, month, year = map(int, date.split("/"))
        d = dt.date(1900 + year, month, day)
    return d.toordinal() + 1721424.5


def observation(primary: tuple, antennas: tuple = ()) -> dict:
    """What is said of the whole observation, with defaults."""
    text = lambda cards, key, d="": str(value(cards, key, d))
    real = lambda key, d=0.0: float(value(antennas, key, d))
    extras = {k.replace("-", "_"): v for k in ("OBSERVER", "DATE-MAP", "BSCALE", "BZERO", "ALTRPIX") if (v := value(primary, k)) is not None}
    return {
        "telescope": text(primary, "TELESCOP"), "instrument": text(primary, "INSTRUME"), "date_obs": text(primary, "DATE-OBS"),
        "equinox": float(value(primary, "EQUINOX", 2000.0)), "bunit": text(primary, "BUNIT", "UNCALIB"), "rdate": text(antennas, "RDATE"),
        "gst_iat0": real("GSTIA0"), "earth_rot_rate": real("DEGPDY", 360.0), "ut1utc": real("UT1UTC"), "polarx": real("POLARX"), "polary": real("POLARY"),
        "datutc": real("DATUTC"), "time_sys": text(antennas, "TIMSYS", "UTC"), "frame": text(antennas, "FRAME", "ITRF"),
        "xyzhand": text(antennas, "XYZHAND", "RIGHT"), "poltype": text(antennas, "POLTYPE"), "extras": extras,
    }


def source_of(cards: tuple) -> dict:
    """Name and place in degrees; a coordinate of 0 is taken from its axis."""
    of_axis = lambda name: float(value(cards, f"CRVAL{i}", 0.0)) if (i := axis(cards, lambda k: k.startswith(name))) else 0.0
    return {"source_name": str(value(cards, "OBJECT", "")), **{k: float(value(cards, f"OBS{k.upper()}", 0.0)) or of_axis(k.upper()) for k in ("ra", "dec")}}


def antenna_rows(table: dict[str, np.ndarray], subarray: int) -> list[tuple]:
    """subarray, ant, name, x, y, z, parallactic, elevation, offset, feed_1, feed_2, angle_1, angle_2."""
    n = len(table["ANNAME"])
    get = lambda key, d: table[key].tolist() if key in table else [d] * n
    out = []
    for i, (name, mount, offset, a, b, pa_, pb) in enumerate(zip(table["ANNAME"], get("MNTSTA", 0), get("STAXOF", 0.0), get("POLTYA", "R"), get("POLTYB", "L"), get("POLAA", 0.0), get("POLAB", 0.0))):
        feeds = [str(x).strip().strip("\x00") for x in (a, b)]
        if int(mount) not in MOUNTS or not set(feeds) <= set("RLXY"):
            raise ValueError(f"unknown mount {mount} or feeds {feeds}")
        first = lambda x: float(x[0] if isinstance(x, list) else x)
        clean = "".join(c for c in str(name) if c.isascii() and c.isprintable() and not c.isspace())
        out.append((subarray, i + 1, clean, *map(float, table["STABXYZ"][i]), *MOUNTS[int(mount)], first(offset), *feeds, first(pa_), first(pb)))
    return out


ANTENNAS = "subarray int, ant int, name string, x double, y double, z double, parallactic int, elevation int, offset double, feed_1 string, feed_2 string, angle_1 double, angle_2 double"
SETUPS = "spw string, freqsel int, ref_freq double, freqs array<double>, widths array<double>, bandwidths array<double>, sidebands array<double>"


def setup_rows(cards: tuple, table: dict[str, np.ndarray], channels: int) -> list[tuple]:
    """A frequency setup for each row of the frequency table."""
    i = axis(cards, lambda k: k == "FREQ")
    ref = float(value(cards, f"CRVAL{i}", 0.0)) if i else 0.0
    wide = lambda key: np.asarray(table[key], dtype=float).reshape(len(table["IF FREQ"]), -1)
    freqs = wide("IF FREQ")
    if freqs.shape[1] != channels:
        raise ValueError(f"{freqs.shape[1]} frequencies for {channels} channels")
    select = table["FRQSEL"].tolist() if "FRQSEL" in table else list(range(1, len(freqs) + 1))
    rest = [wide(k) for k in ("CH WIDTH", "TOTAL BANDWIDTH", "SIDEBAND")]
    return [(f"spw_{r}", round(select[r]), ref, (ref + freqs[r]).tolist(), *[x[r].tolist() for x in rest]) for r in range(len(freqs))]


def warn_of_feeds(codes: list[int], antennas: list[tuple]) -> None:
    for low, high, letters, kind in ((-8, -5, "XY", "linear"), (-4, -1, "RL", "circular")):
        if codes and all(low <= c <= high for c in codes) and not all(set(a[9:11]) <= set(letters) for a in antennas):
            log.warning("the Stokes axis is %s but not all feeds are", kind)


def read_uvfits(spark: SparkSession, path: str, records_per_partition: int = 50_000) -> UVSet:
    """The set in a file: tables of antennas, frequencies and scans are required, else an error.

    Headers and tables are read by the driver; records by tasks, in ranges. A record of no scan is left out.
    """
    with open(_local(path), "rb") as f:
        every = fits.hdus(f)
        cards = every[0].cards
        named = lambda n: [h for h in every[1:] if h.name == n]
        for name in ("AIPS AN", "AIPS FQ", "AIPS NX"):
            if not named(name):
                raise ValueError(f"no table {name} in {path}")
        an = [(h.cards, fits.read_table(f, h)) for h in named("AIPS AN")]
        fq, nx = fits.read_table(f, named("AIPS FQ")[-1]), fits.read_table(f, named("AIPS NX")[-1])
    pols, channels = _dims(cards)
    codes, labels = stokes(cards, pols)
    antennas = [r for i, (_, t) in enumerate(an) for r in antenna_rows(t, i + 1)]
    warn_of_feeds(codes, antennas)
    obs = observation(cards, an[0][0])
    arrays = tuple({"name": str(value(c, "ARRNAM", "")), "xyz": tuple(float(value(c, f"ARRAY{k}", 0.0)) for k in "XYZ")} for c, _ in an)
    setups = setup_rows(cards, fq, channels)

    spark.dataSource.register(UVFits)
    raw = spark.read.format("uvfits").option("recordsPerPartition", records_per_partition).load(path)
    a, b = names.decode_baseline(F.col("baseline"))
    timed = raw.select("record", hours(raw, obs["rdate"]).alias("ti"), a.alias("ant1"), b.alias("ant2"), "u", "v", "uw", "extras")
    scans = spark.createDataFrame(nx_rows(nx), NX)
    n = int(value(cards, "GCOUNT", 0))
    ranged = complete_ranges(nx_rows(nx), n)
    placed = by_ranges(timed, scans) if ranged else by_time(timed, scans)
    placed = placed.join(F.broadcast(scans.select("row", F.col("freqid").alias("nx_freqid"), F.col("subarray").alias("nx_subarray"))), "row")  # a row for each scan
    param = lambda *keys: F.coalesce(*[F.rint(F.get(F.col("extras")[k], F.lit(0))).cast("int") for k in keys])
    placed = placed.withColumn("freqsel", F.coalesce(param("FREQSEL", "FREQID"), "nx_freqid", F.lit(1)))
    placed = dense_spw(placed, [s[1] for s in setups]).withColumn("subarray", F.coalesce(param("SUBARRAY"), "nx_subarray", F.lit(1)))
    records = placed.select("record", "ti", "ant1", "ant2", *[F.col(c).cast("double").alias(c) for c in ("u", "v", "uw")], "extras", F.col("row").cast("string").alias("scan_name"), "spw_index", "subarray")
    parts = F.posexplode(F.arrays_zip("re", "im", "wt")).alias("i", "x")
    names_ = F.array(*[F.lit(p) for p in labels])
    samples = raw.select("record", parts).select("record", F.get(names_, F.col("i") % pols).alias("pol"), (F.floor(F.col("i") / pols) + 1).cast("int").alias("chan"), *[F.col(f"x.{c}").cast("double").alias(d) for c, d in (("re", "re"), ("im", "im"), ("wt", "w"))])
    return UVSet.from_records(records, samples, spark.createDataFrame(antennas, ANTENNAS), spark.createDataFrame(setups, SETUPS), source_of(cards), obs, arrays, cards)


def hours(raw: DataFrame, rdate: str):
    """Hours since the reference date from two columns of days: whole Julian dates, or days since that date; others are an
    error."""
    total = F.col("date_1") + F.col("date_2")
    most = raw.agg(F.max(total)).first()[0]
    if most is None or most <= 1e3:
        return total * 24.0
    if most < 2.4e6:
        raise ValueError(f"dates of {most} are neither Julian dates nor days since a reference date")
    return ((F.col("date_1") - julian_date(rdate)) + F.col("date_2")) * 24.0


# --- scans of records ------------------------------------------------------------------------------------------------

NX = "row int, lower double, upper double, freqid int, subarray int, first bigint, last bigint"


def nx_rows(nx: dict[str, np.ndarray]) -> list[tuple]:
    """row (from 1), lower, upper (hours), freqid, subarray, first and last record (from 1; null if not said)."""
    n = len(nx["TIME"])
    whole = lambda key, d: [round(float(x)) for x in nx[key]] if key in nx else [d] * n
    mid, wide = np.asarray(nx["TIME"], float), np.asarray(nx["TIME INTERVAL"], float)
    return list(zip(range(1, n + 1), ((mid - wide / 2) * 24).tolist(), ((mid + wide / 2) * 24).tolist(), whole("FREQ ID", 1), whole("SUBARRAY", 1), whole("START VIS", None), whole("END VIS", None)))


def complete_ranges(rows: list[tuple], n: int) -> bool:
    """Whether the ranges of records are within bounds, don't overlap and leave none out."""
    spans = sorted((r[5], r[6]) for r in rows if r[5] is not None and r[6] is not None)
    return len(spans) == len(rows) > 0 and spans[0][0] == 1 and spans[-1][1] == n and all(a <= b for a, b in spans) and all(p[1] + 1 == q[0] for p, q in zip(spans, spans[1:]))


def by_ranges(records: DataFrame, scans: DataFrame, width: int = 4096) -> DataFrame:
    """Adds ``row`` to records (record, from 0): that of the scan whose range (first, last) has it; others are left out.
    An interval join as an equi-join by cells of records."""
    cell = lambda c: F.floor(c / width)
    wide = scans.select("row", "first", "last", F.explode(F.sequence(cell(F.col("first")), cell(F.col("last")))).alias("cell_"))
    at = F.col("record") + 1
    return records.withColumn("cell_", cell(at)).join(wide, "cell_").where(at.between(F.col("first"), F.col("last"))).drop("cell_", "first", "last")


def by_time(records: DataFrame, scans: DataFrame, tolerance: float = TOLERANCE_H, width: float = 1.0) -> DataFrame:
    """Adds ``row`` to records (ti): of the last scan that starts by then, or of the next one, if its window holds the time
    (within the tolerance), else of the nearest centre among these and two on either side of the former.

    Each distinct time is placed once: the scans' starts in its cell of ``width`` hours, and the number of those in
    cells before, give its place among them.
    """
    sorted_ = scans.select("row", "lower", "upper").withColumn("pos", F.row_number().over(W.orderBy("lower", "row")))  # the scans of a file
    cell = lambda c: F.floor(F.col(c) / width)
    times = records.select("ti").distinct().withColumn("cell_", cell("ti"))
    starts = sorted_.select("lower", cell("lower").alias("cell_"))
    cells = times.select("cell_").distinct().join(starts.groupBy("cell_").agg(F.count(F.lit(1)).alias("n_")), "cell_", "full")
    before = cells.select("cell_", F.coalesce(F.sum("n_").over(W.orderBy("cell_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before_"))  # a row for each hour
    inside = times.join(starts, "cell_", "left").groupBy("ti", "cell_").agg(F.sum(F.coalesce(F.col("lower") <= F.col("ti"), F.lit(False)).cast("long")).alias("in_"))
    placed = inside.join(before, "cell_").select("ti", (F.col("before_") + F.col("in_")).alias("at_"))
    near = placed.select("ti", "at_", F.explode(F.sequence(F.col("at_") - 2, F.col("at_") + 2)).alias("pos")).join(sorted_, "pos")
    holds = F.col("ti").between(F.col("lower") - tolerance, F.col("upper") + tolerance)
    rank = F.when((F.col("pos") == F.col("at_")) & holds, 0).when((F.col("pos") == F.col("at_") + 1) & holds, 1).otherwise(2)
    away = F.when(rank < 2, 0.0).otherwise(F.abs(F.col("ti") - (F.col("lower") + F.col("upper")) / 2))
    own = F.col("pos") == F.greatest(F.col("at_"), F.lit(1))
    best = near.groupBy("ti").agg(F.min(F.struct(rank.alias("a"), away.alias("b"), (~own).alias("c"), "pos", "row")).alias("best"))
    return records.join(best.select("ti", F.col("best.row").alias("row")), "ti")


def dense_spw(records: DataFrame, selections: list[int]) -> DataFrame:
    """Adds ``spw_index`` (from 1) to records (freqsel): its place in the frequency table; an unknown one is an error."""
    if selections == list(range(1, len(selections) + 1)):
        place = F.col("freqsel")
    else:
        place = F.array_position(F.array(*[F.lit(s) for s in selections]), F.col("freqsel"))
        place = F.when(place > 0, place).otherwise(F.raise_error(F.concat(F.lit("no frequency setup "), F.col("freqsel").cast("string"))).cast("long"))
    return records.withColumn("spw_index", place.cast("int"))


# --- writing ---------------------------------------------------------------------------------------------------------


def write_uvfits(path: str, uvset: UVSet) -> str:
    """One file of one source, all of whose partitions have the same polarisations and at least one record.

    Partitions are ordered by their start and scan; records as they were read. Tasks encode the records in that order;
    the driver puts them into the file, a part at a time.
    """
    if (n := uvset.sources().count()) != 1:
        raise ValueError(f"a file holds one source, the set has {n}")
    pols = [p for p in ORDER if p in (found := uvset.union_pol_products())] + [p for p in found if p not in ORDER]
    setups = uvset.union_frequency_axis().collect()
    if len({len(s["freqs"]) for s in setups}) != 1:
        raise ValueError("setups with unlike numbers of channels")
    channels = len(setups[0]["freqs"])
    codes, disk = stokes(uvset.cards, len(pols))
    if codes and sorted(disk) != sorted(pols):
        raise ValueError(f"the header's products {disk} aren't the set's {pols}")
    disk = disk if codes else pols
    order = uvset.partitions.join(uvset.scan_windows(), "partition_key")
    order = order.withColumn("rank", F.row_number().over(W.orderBy("lo", "scan_name", "leaf_ord"))).select("partition_key", "rank", "lo", "hi", "spw", "subarray")  # the partitions of a file
    counts = uvset.records.groupBy("partition_key").agg(F.count(F.lit(1)).alias("n"))
    scans = order.join(counts, "partition_key", "left").orderBy("rank").collect()
    total = sum(s["n"] or 0 for s in scans)
    if not total:
        raise ValueError("a set without records can't be written")
    params = ptypes(uvset.cards)
    rdate = julian_date(uvset.obs.get("rdate", ""))
    if not rdate:
        log.warning("without a reference date, dates count from Julian date 0")
    encoded = encode_records(uvset, order, params, disk, channels, rdate)
    with open(_local(path), "wb") as f:
        f.write(fits.header_bytes(primary_cards(uvset, params, len(disk), channels, total)))
        size = 0
        for row in encoded.toLocalIterator():
            size += f.write(row["bytes"])
        f.write(bytes(-size % fits.BLOCK))
        tables = distinct_tables(uvset)
        freqids = frequency_ids(setups)
        for k, (rows, array) in enumerate(tables):
            f.write(antenna_table(rows, array, uvset.obs, setups[0], channels, k + 1))
        f.write(frequency_table(setups, freqids, channels))
        f.write(scan_table(scans, {s["spw"]: i for s, i in zip(setups, freqids)}, {r["subarray"]: k + 1 for k, (rows, _) in enumerate(tables) for r in _owners(uvset, rows)}))
    return path


def ptypes(cards: tuple) -> list[str]:
    """The parameters of a record by the header; the usual ones without any. A date takes two."""
    found = sorted((int(m[1]), str(c.value).strip()) for c in cards if (m := re.match(r"PTYPE(\d+)$", c.key)))
    out = [name for _, name in found] or ["UU", "VV", "WW", "BASELINE", "DATE"]
    dates = [i for i, n in enumerate(out) if n.upper().startswith("DATE")]
    return [*out, "DATE"] if len(dates) == 1 else out


def primary_cards(uvset: UVSet, params: list[str], pols: int, channels: int, records: int) -> list[Card]:
    """The header that the set was read with, its shape and parameters made anew."""
    stale = re.compile(r"(PTYPE|PSCAL|PZERO|PUNIT|NAXIS)\d+$|(NAXIS|PCOUNT|GCOUNT|SIMPLE|BITPIX|GROUPS|EXTEND|BSCALE|BZERO)$")
    shape = [0, 3, pols, channels, 1, 1, 1]
    head = [Card("SIMPLE", True), Card("BITPIX", -32), Card("NAXIS", len(shape)), *[Card(f"NAXIS{i}", n) for i, n in enumerate(shape, 1)], Card("EXTEND", True), Card("GROUPS", True), Card("PCOUNT", len(params)), Card("GCOUNT", records)]
    return [*head, *[Card(f"PTYPE{i}", p) for i, p in enumerate(params, 1)], *[c for c in uvset.cards if not stale.match(c.key)]]


def encode_records(uvset: UVSet, order: DataFrame, params: list[str], disk: list[str], channels: int, rdate: float) -> DataFrame:
    """The bytes of each record in the file's order."""
    place = ["partition_key", "ti", "ant1", "ant2"]
    at = F.array_position(F.array(*[F.lit(p) for p in disk]), F.col("pol")) - 1
    cells = uvset.vis.groupBy(*place).agg(F.collect_list(F.struct(((F.col("chan") - 1) * len(disk) + at).cast("int").alias("i"), *[F.col(c).cast("float").alias(c) for c in ("re", "im", "w")])).alias("cells"))
    jd = F.lit(rdate) + F.col("ti") / 24.0
    rows = uvset.records.join(cells, place).join(order.select("partition_key", "rank"), "partition_key")
    rows = rows.withColumns({"code": names.encode_baseline(F.col("ant1"), F.col("ant2")), "day": F.floor(jd).cast("double")}).withColumn("part", jd - F.col("day")).orderBy("rank", "record")
    size = len(disk) * channels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                extras, date = dict(r["extras"] or []), iter((r["day"], r["part"]))
                seen: dict[str, int] = {}
                head = []
                for name in params:
                    kind = name.split("-")[0].upper()
                    if kind in ("UU", "VV", "WW", "BASELINE"):
                        head.append(r[{"UU": "u", "VV": "v", "WW": "uw", "BASELINE": "code"}[kind]])
                    elif kind == "DATE":
                        head.append(next(date))
                    elif name in extras:
                        head.append(extras[name][seen.get(name, 0)])
                        seen[name] = seen.get(name, 0) + 1
                    else:
                        raise ValueError(f"no values for parameter {name}")
                data = np.zeros((size, 3), dtype=np.float32)
                for c in r["cells"]:
                    data[c["i"]] = (c["re"], c["im"], c["w"])
                out.append(np.array(head, dtype=">f4").tobytes() + data.astype(">f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["bytes"])

    return rows.select("u", "v", "uw", "code", "day", "part", "extras", "cells").mapInArrow(run, "bytes binary")


def distinct_tables(uvset: UVSet) -> list[tuple[list, dict]]:
    """Antenna tables of the set's partitions, each once, with their array's name and centre."""
    used = [r[0] for r in uvset.partitions.groupBy("subarray").agg(F.min("leaf_ord").alias("o")).orderBy("o").select("subarray").collect()]
    out: list[tuple[list, dict]] = []
    for s in used:
        rows = uvset.antennas.where(F.col("subarray") == s).orderBy("ant").collect()
        array = uvset.arrays[s - 1] if s <= len(uvset.arrays) else {"name": "", "xyz": (0.0, 0.0, 0.0)}
        if not any([r[1:] for r in rows] == [q[1:] for q in old] and array == a for old, a in out):
            out.append((rows, array))
    return out


def _owners(uvset: UVSet, rows: list) -> list:
    """The subarrays that have these antennas."""
    alike = [r[1:] for r in rows]
    return [s for s in uvset.antennas.select("subarray").distinct().collect() if [r[1:] for r in uvset.antennas.where(F.col("subarray") == s[0]).orderBy("ant").collect()] == alike]


def antenna_table(rows: list, array: dict, obs: dict, setup, channels: int, extver: int) -> bytes:
    mount = {v: k for k, v in MOUNTS.items()}
    real = np.float32
    columns = {
        "ANNAME": [r["name"].ljust(8) for r in rows], "STABXYZ": np.array([[r["x"], r["y"], r["z"]] for r in rows]), "NOSTA": np.array([r["ant"] for r in rows], np.int32),
        "MNTSTA": np.array([mount[r["parallactic"], r["elevation"]] for r in rows], np.int32), "STAXOF": np.array([r["offset"] for r in rows], real),
        "POLTYA": [r["feed_1"] for r in rows], "POLAA": np.array([r["angle_1"] for r in rows], real), "POLTYB": [r["feed_2"] for r in rows], "POLAB": np.array([r["angle_2"] for r in rows], real),
    }
    keys = [("RDATE", "rdate"), ("GSTIA0", "gst_iat0"), ("DEGPDY", "earth_rot_rate"), ("UT1UTC", "ut1utc"), ("POLARX", "polarx"), ("POLARY", "polary"), ("DATUTC", "datutc"), ("TIMSYS", "time_sys"), ("FRAME", "frame"), ("XYZHAND", "xyzhand"), ("POLTYPE", "poltype")]
    cards = [Card("EXTVER", extver), *[Card(f"ARRAY{k}", float(x)) for k, x in zip("XYZ", array["xyz"])], Card("ARRNAM", array["name"]), Card("FREQ", setup["ref_freq"]), *[Card(k, obs[o]) for k, o in keys if o in obs], Card("NUMORB", 0), Card("NO_IF", channels), Card("NOPCAL", 0), Card("FREQID", setup["freqsel"])]
    return fits.table_bytes("AIPS AN", columns, cards)


def frequency_ids(setups: list) -> list[int]:
    """The selections that setups were read with; their places, if two are alike."""
    found = [s["freqsel"] for s in setups]
    return found if len(set(found)) == len(found) else list(range(1, len(found) + 1))


def frequency_table(setups: list, freqids: list[int], channels: int) -> bytes:
    matrix = lambda key: np.array([s[key] for s in setups], float).reshape(len(setups), channels)
    columns = {
        "FRQSEL": np.array(freqids, np.int32), "IF FREQ": matrix("freqs") - np.array([[s["ref_freq"]] for s in setups]),
        "CH WIDTH": matrix("widths").astype(np.float32), "TOTAL BANDWIDTH": matrix("bandwidths").astype(np.float32), "SIDEBAND": matrix("sidebands").astype(np.int32),
    }
    return fits.table_bytes("AIPS FQ", columns, [Card("NO_IF", channels)])


def scan_table(scans: list, freqid: dict[str, int], extver: dict[int, int]) -> bytes:
    ends = np.cumsum([s["n"] or 0 for s in scans])
    starts = ends - [s["n"] or 0 for s in scans] + 1
    lo, hi = (np.array([s[k] for s in scans], float) for k in ("lo", "hi"))
    columns = {
        "TIME": (lo + hi) / 2 / 24, "TIME INTERVAL": ((hi - lo) / 24).astype(np.float32), "SOURCE ID": np.ones(len(scans), np.int32),
        "SUBARRAY": np.array([extver.get(s["subarray"], 1) for s in scans], np.int32), "FREQ ID": np.array([freqid.get(s["spw"], 1) for s in scans], np.int32),
        "START VIS": starts.astype(np.int32), "END VIS": ends.astype(np.int32),
    }
    return fits.table_bytes("AIPS NX", columns, [])
