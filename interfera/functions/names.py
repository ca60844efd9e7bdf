"""Names, labels and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitize_source(name: Column) -> Column:
    """A source's name as an identifier: other characters become _, a leading digit gets an M, blank is unknown."""
    bare = F.regexp_replace(name, r"^\s+|\s+$", "")
    plain = F.regexp_replace(bare, "[^A-Za-z0-9_]", "_")
    return F.when(bare == "", "unknown").when(plain.rlike("^[0-9]"), F.concat(F.lit("M"), plain)).otherwise(plain)


def partition_key(*parts: Column) -> Column:
    """Parts joined by _; empty ones are left out."""
    return F.concat_ws("_", *[F.nullif(p, F.lit("")) for p in parts])


def fold_pol(label: Column) -> Column:
    """Feed letters in any case as P and Q."""
    return F.translate(F.upper(F.trim(label)), "RXLY", "PPQQ")


def is_parallel(pol: Column) -> Column:
    return F.substring(pol, 1, 1) == F.substring(pol, 2, 1)


def feed(pol: Column, at: int) -> Column:
    """1 for P, 2 for Q, else an error; at: 1 or 2, which antenna's."""
    letter = F.substring(pol, at, 1)
    return F.when(letter == "P", 1).when(letter == "Q", 2).otherwise(F.raise_error(F.concat(F.lit("no feed: "), pol)).cast("int"))


def encode_baseline(a: Column, b: Column) -> Column:
    """256 a + b; antennas from 256 on have no code."""
    return F.when((a < 256) & (b < 256), a * 256 + b).otherwise(F.raise_error(F.lit("antenna index over 255")))


def decode_baseline(code: Column) -> tuple[Column, Column]:
    return F.floor(code / 256).cast("int"), (code % 256).cast("int")
