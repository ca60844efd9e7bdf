"""A set of visibilities with all that describes them, as a bundle of tables.

==========  ====================================================================================================
vis         partition_key, ti (hours since the reference date), ant1, ant2, pol, chan (from 1), re, im, w
records     partition_key, record, ti, ant1, ant2, u, v, uw, extras: the order in which samples were read
partitions  partition_key, leaf_ord, source_name, scan_name, spw, spw_index, subarray, sub_scan_name, intent, ra, dec
antennas    subarray, ant, name, x, y, z, parallactic, elevation, offset, feed_1, feed_2, angle_1, angle_2
setups      spw, freqsel, ref_freq, freqs, widths, bandwidths, sidebands (arrays over channels)
==========  ====================================================================================================

``obs`` holds what is said of the whole observation, ``arrays`` the name and centre of each antenna table, ``cards`` the
header that it was read with. All operations give a new set; nothing is computed before it's read, but for errors that
a caller must see at once.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from interfera.functions import names
from interfera.functions.cplx import flagged
from interfera.operators import reduce, select

VIS = "partition_key string, ti double, ant1 int, ant2 int, pol string, chan int, re double, im double, w double"
#: How a partition's key is put together: a column, and how it's shown; empty parts are left out.
AXES: list[tuple[str, Callable[[Column], Column]]] = [
    ("source_name", names.sanitize_source), ("spw", lambda c: c), ("subarray_name", lambda c: c),
    ("scan_name", lambda c: F.when(c != "", F.concat(F.lit("scan_"), c)).otherwise("")), ("sub_scan_name", lambda c: c),
]
PARTITION = ["partition_key", "leaf_ord", "source_name", "scan_name", "spw", "spw_index", "subarray", "sub_scan_name", "intent", "ra", "dec"]


def partition_key(axes=AXES) -> Column:
    return names.partition_key(*[show(F.col(c)) for c, show in axes])


def fingerprint(*columns: str) -> Column:
    """Equal for rows that are equal in all these columns."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


@dataclass(frozen=True)
class UVSet:
    vis: DataFrame
    records: DataFrame
    partitions: DataFrame
    antennas: DataFrame
    setups: DataFrame
    obs: dict = field(default_factory=dict)
    arrays: tuple[dict, ...] = ()
    cards: tuple = ()

    @staticmethod
    def from_records(records: DataFrame, samples: DataFrame, antennas: DataFrame, setups: DataFrame, source: dict, obs: dict | None = None, arrays: tuple = (), cards: tuple = ()) -> UVSet:
        """records: record, ti, ant1, ant2, u, v, uw, scan_name, spw_index and subarray (both from 1), extras and, if given,
        intent and sub_scan_name; samples: record, pol, chan, re, im, w; source: source_name, ra, dec.

        There is a partition for each scan, window and subarray, in the order of their first records. Of records of the
        same time and baseline the last one's samples count; all stay in the order of records.
        """
        several = records.select("subarray").distinct().limit(2).count() > 1
        names_ = {"spw": F.concat(F.lit("spw_"), F.col("spw_index") - 1), "subarray_name": F.concat(F.lit("sub_"), F.col("subarray") - 1) if several else F.lit("")}
        given = {"source_name": F.lit(source["source_name"]), "intent": F.lit(""), "sub_scan_name": F.lit("")}
        records = records.withColumns({c: v for c, v in given.items() if c not in records.columns}).withColumns(names_)
        keyed = records.withColumn("partition_key", partition_key())
        kept = ["partition_key", "source_name", "scan_name", "spw", "spw_index", "subarray", "sub_scan_name", "intent"]
        partitions = keyed.groupBy(*kept).agg(F.min("record").alias("leaf_ord"))
        partitions = partitions.withColumns({"ra": F.lit(float(source.get("ra", 0.0))), "dec": F.lit(float(source.get("dec", 0.0)))}).select(*PARTITION)
        place = ["partition_key", "ti", "ant1", "ant2"]
        last = keyed.groupBy(*place).agg(F.max("record").alias("record"))
        vis = samples.join(last, "record").select(*place, "pol", "chan", "re", "im", "w")
        return UVSet(vis, keyed.select("partition_key", "record", "ti", "ant1", "ant2", "u", "v", "uw", "extras"), partitions, antennas, setups, obs or {}, arrays, cards)

    # --- what it holds -------------------------------------------------------------------------------------------

    def leaves(self) -> DataFrame:
        """The partitions in order."""
        return self.partitions.orderBy("leaf_ord")

    def sources(self) -> DataFrame:
        """Distinct sources by their first partition."""
        return self.partitions.groupBy("source_name").agg(F.min("leaf_ord").alias("first_leaf")).orderBy("first_leaf")

    def scan_ids(self, source: str) -> DataFrame:
        """The scan of each of a source's partitions, in order; a scan of several windows is named as often."""
        return self.partitions.where(F.col("source_name") == source).select("leaf_ord", "scan_name").orderBy("leaf_ord")

    def n_scans(self) -> DataFrame:
        return self.partitions.agg(F.countDistinct("scan_name").alias("n_scans"))

    def counters(self) -> DataFrame:
        """A row: distinct baselines, records, channels and polarisations."""
        rows = self.vis.groupBy("pol", "chan").agg(F.count(F.lit(1)).alias("n"))
        shape = rows.agg(F.countDistinct("chan").alias("n_channels"), F.countDistinct("pol").alias("n_pols"))
        order = self.records.groupBy("ant1", "ant2").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("n_baselines"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_integrations"))
        return order.crossJoin(shape)  # one row by one row

    def scan_windows(self) -> DataFrame:
        """partition_key, lo, hi (NaN without samples) and center."""
        ends = self.vis.groupBy("partition_key").agg(F.min("ti").alias("lo"), F.max("ti").alias("hi"))
        nan = F.lit(float("nan"))
        out = self.partitions.select("partition_key").join(ends, "partition_key", "left").select("partition_key", F.coalesce("lo", nan).alias("lo"), F.coalesce("hi", nan).alias("hi"))
        return out.withColumn("center", (F.col("lo") + F.col("hi")) / 2)

    def baselines(self) -> DataFrame:
        """partition_key, slot (from 1, by antennas), ant1, ant2, their names and label."""
        pairs = self.vis.select("partition_key", "ant1", "ant2").distinct()
        slots = pairs.withColumn("slot", F.row_number().over(W.partitionBy("partition_key").orderBy("ant1", "ant2")))
        return self._named(slots).withColumn("label", F.concat_ws("-", "ant1_name", "ant2_name"))

    def _named(self, rows: DataFrame) -> DataFrame:
        """Adds the names of both antennas, by the partition's subarray."""
        of = self.partitions.select("partition_key", "subarray")
        one, two = (self.antennas.select("subarray", F.col("ant").alias(f"ant{i}"), F.col("name").alias(f"ant{i}_name")) for i in (1, 2))
        return rows.join(of, "partition_key").join(one, ["subarray", "ant1"], "left").join(two, ["subarray", "ant2"], "left").drop("subarray")

    def baseline_index(self, key: tuple | list | str) -> DataFrame:
        """Partitions that have a baseline, given as two numbers, two names or a label in that order, and its slot."""
        return self.baselines().where(_is_baseline(key)).select("partition_key", "slot")

    def baseline_number(self, partition: str, key: tuple | list | str) -> int:
        """The slot of a baseline in a partition; one that isn't there is an error."""
        found = self.baseline_index(key).where(F.col("partition_key") == partition).first()
        if found is None:
            raise KeyError(f"no baseline {key} in {partition}")
        return found["slot"]

    def union_baselines(self) -> DataFrame:
        """Baselines of all partitions by antennas: slot, ant1, ant2, names and label."""
        every = self.baselines().groupBy("ant1", "ant2").agg(F.min("ant1_name").alias("ant1_name"), F.min("ant2_name").alias("ant2_name"), F.min("label").alias("label"))
        return every.withColumn("slot", F.row_number().over(W.orderBy("ant1", "ant2")))  # as many rows as pairs of antennas

    def participating_antennas(self) -> DataFrame:
        """partition_key and its antennas' names in order."""
        ends = self.baselines().select("partition_key", F.explode(F.array("ant1_name", "ant2_name")).alias("name")).distinct()
        return ends.groupBy("partition_key").agg(F.array_sort(F.collect_list("name")).alias("antennas"))

    def union_antennas(self) -> DataFrame:
        """One row for each antenna's name; two unlike ones of a name are an error when read."""
        what = [c for c in self.antennas.columns if c not in ("subarray", "ant", "name")]
        of = self.antennas.withColumn("print_", fingerprint(*what))
        found = of.groupBy("name").agg(F.countDistinct("print_").alias("n_"), F.min(F.struct("subarray", "ant", *what)).alias("first"))
        return found.where(F.when(F.col("n_") == 1, True).otherwise(F.raise_error(F.concat(F.lit("unlike antennas named "), "name")).cast("boolean"))).select("name", "first.ant", *[f"first.{c}" for c in what])

    def union_pol_products(self) -> list[str]:
        """The polarisations, if all partitions have the same; else an error."""
        sets = [r[0] for r in self.vis.groupBy("partition_key").agg(F.array_sort(F.collect_set("pol")).alias("p")).select("p").distinct().limit(2).collect()]
        if len(sets) > 1:
            raise ValueError("partitions have unlike polarisations")
        return list(sets[0]) if sets else []

    def union_frequency_axis(self) -> DataFrame:
        """Distinct frequency setups of the partitions, in the order of the first with each."""
        what = ["ref_freq", "freqs", "widths", "bandwidths", "sidebands"]
        used = self.partitions.join(self.setups, "spw").withColumn("print_", fingerprint(*what))
        first = used.groupBy("print_").agg(F.min(F.struct("leaf_ord", "spw", "freqsel", *what)).alias("s"))
        return first.select(F.col("s.leaf_ord").alias("first_leaf"), "s.spw", "s.freqsel", *[f"s.{c}" for c in what]).orderBy("first_leaf")

    def freq_setup(self) -> dict:
        """The one frequency setup; an error without any or with several."""
        found = self.union_frequency_axis().limit(2).collect()
        if len(found) != 1:
            raise ValueError("the set has no frequency setup" if not found else "the set has several frequency setups")
        return found[0].asDict(recursive=True)

    def summary(self) -> DataFrame:
        """A row for each partition in order, with its shape."""
        few = lambda c, name: F.size(F.collect_set(c)).cast("long").alias(name)
        shape = self.vis.groupBy("partition_key").agg(few("chan", "n_chan"), F.countDistinct("ti").alias("n_time"), few(F.struct("ant1", "ant2"), "n_baseline"), few("pol", "n_pol"))
        n = self.records.groupBy("partition_key").agg(F.count(F.lit(1)).alias("n_record"))
        return self.partitions.join(shape, "partition_key", "left").join(n, "partition_key", "left").na.fill(0, ["n_chan", "n_time", "n_baseline", "n_pol", "n_record"]).orderBy("leaf_ord")

    def leaf(self, key: str) -> dict:
        """What is known of one partition: its columns, times, baselines and records as tables, and its frequency setup."""
        row = self.partitions.where(F.col("partition_key") == key).first()
        if row is None:
            raise KeyError(f"no partition {key}")
        of = lambda df: df.where(F.col("partition_key") == key)
        setup = self.setups.where(F.col("spw") == row["spw"]).first()
        return row.asDict() | {
            "obs_time": of(self.vis).select("ti").distinct().orderBy("ti"), "baselines": of(self.baselines()), "record_order": of(self.records).orderBy("record"),
            "antennas": self.antennas.where(F.col("subarray") == row["subarray"]), "freq_setup": setup.asDict(recursive=True) if setup else None,
        }

    # --- parts of it ---------------------------------------------------------------------------------------------

    def _of(self, partitions: DataFrame) -> UVSet:
        """The same set with some of its partitions."""
        key = partitions.select("partition_key")
        return replace(self, partitions=partitions, vis=self.vis.join(key, "partition_key", "left_semi"), records=self.records.join(key, "partition_key", "left_semi"))

    def select_partition(self, **wanted: str | int | None) -> UVSet:
        """Partitions equal to all values given by column (source_name, scan_name, spw, intent ...); None asks nothing."""
        return self._of(select.partition(self.partitions, **wanted))

    def select_source(self, name: str) -> UVSet:
        return self.select_partition(source_name=name)

    def select_scan(self, source: str, scan: str | int) -> dict:
        """The first partition of a source and scan; none is an error."""
        found = self.partitions.where((F.col("source_name") == source) & (F.col("scan_name") == str(scan))).orderBy("leaf_ord").first()
        if found is None:
            raise KeyError(f"no scan {scan} of {source}")
        return self.leaf(found["partition_key"])

    def subset(self, keys: list[str]) -> UVSet:
        return self._of(self.partitions.where(F.col("partition_key").isin(keys)))

    def by_spw(self) -> DataFrame:
        """The keys of each window's partitions, in order."""
        return self.partitions.groupBy("spw").agg(F.transform(F.array_sort(F.collect_list(F.struct("leaf_ord", "partition_key"))), lambda x: x["partition_key"]).alias("keys"))

    def _filtered(self, condition: Callable[[DataFrame], DataFrame]) -> UVSet:
        """Samples and records that meet a condition; partitions without samples are dropped."""
        vis, records = condition(self.vis), condition(self.records)
        left = vis.select("partition_key").distinct()
        return replace(self, vis=vis, records=records, partitions=self.partitions.join(left, "partition_key", "left_semi"))

    def _by_baselines(self, condition: Column) -> UVSet:
        pairs = self.baselines().where(condition).select("partition_key", "ant1", "ant2")
        return self._filtered(lambda df: df.join(pairs, ["partition_key", "ant1", "ant2"], "left_semi"))

    def select_station(self, name: str) -> UVSet:
        return self._by_baselines((F.col("ant1_name") == name) | (F.col("ant2_name") == name))

    def select_baseline(self, key: tuple | str) -> UVSet:
        return self._by_baselines(_is_baseline(key))

    def time_window(self, lo: float, hi: float) -> UVSet:
        """Hours, both ends included."""
        return self._filtered(lambda df: df.where(F.col("ti").between(lo, hi)))

    def baseline(self, key: tuple | str, one_spw: bool = True) -> DataFrame:
        """A baseline's samples over all partitions in the order of partitions and times, with their description; several
        windows are an error, unless one_spw is off."""
        part = self.select_baseline(key)
        if one_spw and part.partitions.select("spw").distinct().limit(2).count() > 1:
            raise ValueError(f"baseline {key} is in several windows")
        return part.vis.join(part.partitions, "partition_key").withColumn("flag", flagged()).orderBy("leaf_ord", "ti", "pol", "chan")

    def baselines_per_scan(self, key: tuple | str) -> DataFrame:
        """The same, of any windows."""
        return self.baseline(key, one_spw=False)

    # --- new sets ------------------------------------------------------------------------------------------------

    def with_visibilities(self, vis: DataFrame) -> UVSet:
        """Other samples (of the columns of vis) for the same partitions."""
        return replace(self, vis=vis.select(*self.vis.columns))

    def flags(self) -> DataFrame:
        return self.vis.select("*", flagged().alias("flag"))

    def average(self) -> UVSet:
        """Each partition's samples averaged over time, at the middle of its window; no records are left, so it can't be
        written."""
        mean = reduce.scan_average(self.vis, "partition_key", "ant1", "ant2", "pol", "chan")
        middle = self.scan_windows().select("partition_key", F.col("center").alias("ti"))
        vis = mean.join(middle, "partition_key").withColumn("w", F.col("weight")).select(*self.vis.columns)
        return replace(self, vis=vis, records=self.records.where("false"))

    def uvw_average(self) -> DataFrame:
        """Means of coordinates by partition and baseline, weighted by each record's valid samples."""
        from interfera.functions.cplx import finite, sampled

        total = self.vis.where(sampled()).groupBy("partition_key", "ti", "ant1", "ant2").agg(F.sum("w").alias("t"))
        last = self.records.groupBy("partition_key", "ti", "ant1", "ant2").agg(F.max(F.struct("record", "u", "v", "uw")).alias("r")).select("partition_key", "ti", "ant1", "ant2", "r.u", "r.v", "r.uw")
        mean = lambda c: F.try_divide(F.sum(F.when(finite(F.col(c)), F.col("t") * F.col(c)).otherwise(0.0)), F.sum("t")).alias(c)
        return total.join(last, ["partition_key", "ti", "ant1", "ant2"]).groupBy("partition_key", "ant1", "ant2").agg(mean("u"), mean("v"), mean("uw"))

    @staticmethod
    def merge(first: UVSet, *others: UVSet) -> UVSet:
        """The union of sets of the same observation, of the same polarisations and without a partition in common; the
        header is the first one's."""
        pols = first.union_pol_products()
        parts, top = first.partitions, None
        out = first
        for other in others:
            if other.obs != first.obs or other.union_pol_products() != pols:
                raise ValueError("sets of unlike observations or polarisations")
            twice = parts.join(other.partitions, "partition_key", "left_semi").select("partition_key").first()
            if twice:
                raise ValueError(f"partition in two sets: {twice[0]}")
            top = parts.agg(F.max("leaf_ord")).first()[0] or 0
            records_top = out.records.agg(F.max("record")).first()[0] or 0
            parts = parts.unionByName(other.partitions.withColumn("leaf_ord", F.col("leaf_ord") + top + 1))
            records = out.records.unionByName(other.records.withColumn("record", F.col("record") + records_top + 1))
            distinct = lambda a, b: a.unionByName(b).dropDuplicates()
            out = replace(out, vis=out.vis.unionByName(other.vis), records=records, partitions=parts, antennas=distinct(out.antennas, other.antennas), setups=distinct(out.setups, other.setups))
        return out

    # --- functions of partitions ---------------------------------------------------------------------------------

    def apply(self, f: Callable) -> UVSet:
        """f of each partition: its samples (pandas), then its description and what is said of the set, if f takes them;
        returns its new samples. A partition is one task's."""
        return replace(self, vis=self._mapped(f, VIS))

    def mapleaves(self, f: Callable, schema: str) -> DataFrame:
        """A row for each partition (partition_key, leaf_ord and what f returns, a dict), in order."""

        def row(*given):
            return pd.DataFrame([f(*given[: _arity(f)])])

        return self._keyed(row, schema, 3)

    def flatmap(self, f: Callable, schema: str) -> DataFrame:
        """The rows (a list of dicts, or pandas) that f returns for each partition, with partition_key and leaf_ord."""

        def rows(*given):
            found = f(*given[: _arity(f)])
            if not isinstance(found, (list, tuple, pd.DataFrame)):
                raise TypeError("flatmap's function returns a list of rows")
            return found if isinstance(found, pd.DataFrame) else pd.DataFrame(list(found))

        return self._keyed(rows, schema, 3)

    def _keyed(self, f: Callable, schema: str, arity: int) -> DataFrame:
        fields = [x.strip().split(" ")[0] for x in schema.split(",")]

        def run(leaf, info, root):
            out = f(leaf, info, root)
            out = out if len(out) else pd.DataFrame(columns=fields)
            return out[fields].assign(partition_key=info["partition_key"], leaf_ord=info["leaf_ord"])

        return self._mapped(run, f"{schema}, partition_key string, leaf_ord bigint", arity).orderBy("leaf_ord")

    def _mapped(self, f: Callable, schema: str, arity: int | None = None) -> DataFrame:
        obs, n = dict(self.obs), arity or _arity(f)

        def run(leaf, info):
            return f(*(leaf, info.iloc[0].to_dict() if len(info) else {}, obs)[:n])

        # names of their own: both sides may come from the same table
        described = self.partitions.select(F.col("partition_key").alias("key_"), *[F.col(c).alias(c) for c in self.partitions.columns])
        return self.vis.groupBy("partition_key").cogroup(described.groupBy("key_")).applyInPandas(run, schema)


def _arity(f: Callable) -> int:
    """How many of a partition's samples, description and set f takes."""
    kinds = [p.kind for p in inspect.signature(f).parameters.values()]
    if inspect.Parameter.VAR_POSITIONAL in kinds:
        return 3
    n = sum(k in (inspect.Parameter.POSITIONAL_ONLY, inspect.Parameter.POSITIONAL_OR_KEYWORD) for k in kinds)
    if not 1 <= n <= 3:
        raise TypeError("the function takes a partition's samples, then its description and the set's")
    return n


def _is_baseline(key: tuple | list | str) -> Column:
    if isinstance(key, str):
        return F.col("label") == key
    a, b = key
    return (F.col("ant1") == a) & (F.col("ant2") == b) if isinstance(a, int) else (F.col("ant1_name") == a) & (F.col("ant2_name") == b)


def band_center(freqs: Column) -> Column:
    """Half the sum of the first and the last channel's frequency."""
    return (F.element_at(freqs, 1) + F.element_at(freqs, -1)) / 2


def centered(freqs: Column) -> Column:
    return F.transform(freqs, lambda f: f - band_center(freqs))
