"""Spans of regular expressions in texts, as columns; native expressions alone.

A pattern must not match the empty string. Repeats in patterns are possessive where a group repeats, so that long
matches need no deep stack; they give what greedy ones would where nothing that follows can match inside them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = 128
EMPTY = "array<struct<s:int,e:int,m:string>>"
WITH_CONTEXT = "array<struct<s:int,e:int,m:string,b:string,a:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def starts(lengths: Column) -> Column:
    """The sums of the elements before each element; by blocks, so that long arrays don't take quadratic time."""
    block = lambda i: F.floor(i / _BLOCK).cast("int")

    def within(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), block(F.size(x))), lambda b: _sum(F.slice(x, b * _BLOCK + 1, F.lit(_BLOCK))))
        whole = let(blocks, lambda s: F.transform(s, lambda y, b: _sum(F.slice(s, F.lit(1), b))))
        inside = lambda i: _sum(F.slice(x, (i - i % _BLOCK + 1).cast("int"), (i % _BLOCK).cast("int")))
        return let(whole, lambda w: F.transform(x, lambda y, i: F.get(w, block(i)) + inside(i)))

    return let(lengths, within)


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, b: a + b)


def maxima(values: Column) -> Column:
    """The largest of the elements (0 or more) up to each element; by blocks, like ``starts``."""
    block = lambda i: F.floor(i / _BLOCK).cast("int")
    top = lambda x: F.coalesce(F.array_max(x), F.lit(0))

    def within(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), block(F.size(x))), lambda b: top(F.slice(x, b * _BLOCK + 1, F.lit(_BLOCK))))
        whole = let(blocks, lambda s: F.transform(s, lambda y, b: top(F.slice(s, F.lit(1), b))))
        inside = lambda i: top(F.slice(x, (i - i % _BLOCK + 1).cast("int"), (i % _BLOCK + 1).cast("int")))
        return let(whole, lambda w: F.transform(x, lambda y, i: F.greatest(F.get(w, block(i)), inside(i))))

    return let(values, within)


_PART = 4096


def parts(text: Column) -> Column:
    """The text in parts of _PART code points, found in one pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PART}}}"), F.lit(0))


def cut(parted: Column, start: Column, end: Column) -> Column:
    """Code points from start to end of a text in parts. Unlike a substring of the text, it doesn't count from the text's
    beginning."""
    a, b = F.floor(start / _PART).cast("int"), F.floor(end / _PART).cast("int")
    part = lambda i: F.coalesce(F.get(parted, i), F.lit(""))
    first = F.substring(part(a), start % _PART + 1, F.lit(_PART))
    between = F.array_join(F.slice(parted, a + 2, F.greatest(b - a - 1, F.lit(0))), "")
    last = F.substring(part(b), F.lit(1), end % _PART)
    return F.when(start >= end, "").when(a == b, F.substring(part(a), start % _PART + 1, end - start)).otherwise(F.concat(first, between, last))


def find(df: DataFrame, text: str, out: str, pattern: str, only: Column | None = None, context: int = 0) -> DataFrame:
    """Adds ``out``: start, end (exclusive) and string of the leftmost matches that don't overlap, in code points; with
    ``context``, also b, up to so many code points before the match and after the one before, and a, the next one.

    ``only``: a condition that holds for every text with a match.
    """
    every = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    df = df.withColumn("m_", every if only is None else F.when(only, every))

    def placed(m: Column) -> Column:
        between = F.split(F.col(text), pattern, -1)
        around = lambda t, i: [F.right(F.get(t, i), F.lit(context)).alias("b"), F.left(F.coalesce(F.get(t, i + 1), F.lit("")), F.lit(1)).alias("a")] if context else []
        lengths = lambda g: F.zip_with(F.slice(g, F.lit(1), F.size(m)), m, lambda a, b: a + F.length(b))
        span = lambda t, g, p: F.transform(m, lambda x, i: let(F.get(p, i) + F.get(g, i), lambda s: F.struct(s.alias("s"), (s + F.length(x)).alias("e"), x.alias("m"), *around(t, i))))
        if not context:
            return let(F.transform(between, F.length), lambda g: let(starts(lengths(g)), lambda p: span(None, g, p)))
        return let(between, lambda t: let(F.transform(t, F.length), lambda g: let(starts(lengths(g)), lambda p: span(t, g, p))))

    return df.withColumn(out, F.when(F.size("m_") > 0, let(F.col("m_"), placed)).otherwise(F.array().cast(WITH_CONTEXT if context else EMPTY))).drop("m_")


def joined(kinds: list[tuple[str, Column]]) -> Column:
    """kind:start:end of the spans of each kind, by start, then kind as listed, then end, joined by commas."""
    def tag(k: int):
        return lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"))

    tagged = [F.transform(c, tag(k)) for k, (_, c) in enumerate(kinds)]
    names = F.array(*[F.lit(n) for n, _ in kinds])
    return F.array_join(F.transform(F.array_sort(F.concat(*tagged)), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")
