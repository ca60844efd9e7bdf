"""System temperatures and gain curves from ANTAB text, in DataFrame operations alone.

A file is one row of text; blocks, columns and rows come from it by patterns, so that files are read in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_GAIN = r"(?im)^[\x20\t]*GAIN[\x20\t]+(\S+)([^\n]*)$"
#: Station, header up to the first slash, rows up to the next one.
_TSYS = r"(?im)^[\x20\t]*TSYS[\x20\t]+(\S+)([^/]*)/([^/]*)"
_NUMBERS = r"\s*=\s*([-+0-9.eE]+(?:\s*,\s*[-+0-9.eE]+)*)"


def _files(spark: SparkSession, path: str, year: int | None) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"![^\n]*|\r", "").alias("t"))
    two = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^[A-Za-z](\d\d)", 1)
    named = F.when(two == "", F.raise_error(F.concat(F.lit("no year in the file's name: "), "path"))).otherwise(two.cast("int") + F.when(two.cast("int") >= 70, 1900).otherwise(2000))
    return files.withColumn("year", named if year is None else F.lit(year))


def _numbers(text: Column, name: str) -> Column:
    found = F.regexp_extract(text, f"(?i){name}{_NUMBERS}", 1)
    return F.when(found == "", F.array().cast("array<double>")).otherwise(F.transform(F.split(found, ","), lambda x: F.trim(x).cast("double")))


def gain_curves(spark: SparkSession, path: str, year: int | None = None) -> DataFrame:
    """path, station, dpfu_1, dpfu_2, poly. One DPFU holds for both feeds, no POLY is [1]; of repeated lines, the last
    holds; a line without DPFU is an error when read."""
    lines = _files(spark, path, year).select("path", F.posexplode(F.regexp_extract_all("t", F.lit(_GAIN), F.lit(0))).alias("at", "line"))
    parts = lines.select("path", "at", F.regexp_extract("line", _GAIN, 1).alias("station"), _numbers(F.col("line"), "DPFU").alias("d"), _numbers(F.col("line"), "POLY").alias("p"))
    last = parts.groupBy("path", "station").agg(F.max_by(F.struct("d", "p"), "at").alias("x"))
    first = F.when(F.size("x.d") > 0, F.get("x.d", F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("no DPFU for "), "station")).cast("double"))
    return last.select("path", "station", first.alias("dpfu_1"), F.coalesce(F.get("x.d", F.lit(1)), first).alias("dpfu_2"), F.when(F.size("x.p") > 0, F.col("x.p")).otherwise(F.array(F.lit(1.0))).alias("poly"))


def _millis(text: Column) -> Column:
    """Since midnight: hours:minutes:seconds or hours:minutes, the last with a fraction."""
    p = F.split(text, ":")
    at = lambda i: F.get(p, F.lit(i)).cast("double")
    return F.rint(F.when(F.size(p) == 3, ((at(0) * 60 + at(1)) * 60 + at(2)) * 1000).otherwise((at(0) * 60 + at(1)) * 60000)).cast("long")


def system_temperatures(spark: SparkSession, path: str, year: int | None = None) -> DataFrame:
    """path, station, ts, at (the column's place from 1), channel (0: all), pol (R, L or both), value.

    Repeated blocks: the last holds. A row with too few values, an unknown column name, a block without INDEX and a
    station without a gain curve are errors when read; values beyond the columns are left out.
    """
    blocks = _files(spark, path, year).select("path", "year", F.posexplode(F.regexp_extract_all("t", F.lit(_TSYS), F.lit(0))).alias("n", "b"))
    parts = blocks.select("path", "year", "n", *[F.regexp_extract("b", _TSYS, i).alias(c) for i, c in ((1, "station"), (2, "head"), (3, "body"))])
    last = parts.groupBy("path", "year", "station").agg(F.max_by(F.struct("head", "body"), "n").alias("x"))
    known = gain_curves(spark, path, year).select("path", "station", F.lit(True).alias("known"))
    names = F.filter(F.transform(F.split(F.regexp_extract("x.head", r"(?is)INDEX\s*=\s*(.+)$", 1), ","), lambda s: F.regexp_replace(s, r"[\s'\"]", "")), lambda s: s != "")
    last = last.join(known, ["path", "station"], "left").withColumn("names", names)
    fault = F.when(F.col("known").isNull(), F.concat(F.lit("no gain for "), "station")).when(F.size("names") == 0, F.concat(F.lit("no INDEX for "), "station"))
    last = last.where(F.when(fault.isNull(), True).otherwise(F.raise_error(fault).cast("boolean")))
    rows = last.select("path", "year", "station", "names", F.explode(F.split("x.body", "\n")).alias("row")).withColumn("v", F.split(F.trim(F.regexp_replace("row", r"\s+", " ")), " "))
    rows = rows.where(F.trim("row") != "")
    rows = rows.where(F.when(F.size("v") >= F.size("names") + 2, True).otherwise(F.raise_error(F.concat(F.lit("short row: "), "row")).cast("boolean")))
    days = F.unix_date(F.make_date("year", F.lit(1), F.lit(1))) + F.get("v", F.lit(0)).cast("int") - 1
    cells = rows.select("path", "station", F.timestamp_millis(days.cast("long") * 86400000 + _millis(F.get("v", F.lit(1)))).alias("ts"), "v", F.posexplode("names").alias("i", "name"))
    pol = F.when(F.upper(F.substring("name", 1, 1)).isin("R", "X"), "R").otherwise("L")
    channel = F.regexp_extract("name", r"\d+", 0).cast("int")
    other = F.regexp_extract("name", r"\|[A-Za-z](\d+)$", 1)
    unknown = lambda t: F.raise_error(F.concat(F.lit("unknown column "), "name")).cast(t)
    one, range_, pair = (F.col("name").rlike(p) for p in (r"(?i)^[RLXY]\d+$", r"(?i)^[RLXY]\d+:\d+$", r"(?i)^[RLXY]\d+\|[RLXY]\d+$"))
    pair = pair & (other.cast("int") == channel)
    return cells.select(
        "path", "station", "ts", (F.col("i") + 1).alias("at"),
        F.when(range_, 0).when(one | pair, channel).otherwise(unknown("int")).alias("channel"),
        F.when(pair, "both").when(one | range_, pol).otherwise(unknown("string")).alias("pol"),
        F.get("v", F.col("i") + 2).cast("double").alias("value"),
    )
