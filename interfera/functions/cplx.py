"""Complex numbers as pairs of columns (re, im), and which samples count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Complex = tuple[Column, Column]


def mul(a: Complex, b: Complex) -> Complex:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def conj(a: Complex) -> Complex:
    return a[0], -a[1]


def abs2(a: Complex) -> Column:
    return a[0] * a[0] + a[1] * a[1]


def div(a: Complex, b: Complex) -> Complex:
    """a / b; null where b is zero."""
    n = mul(a, conj(b))
    d = abs2(b)
    return F.try_divide(n[0], d), F.try_divide(n[1], d)


def polar(amplitude: Column, phase: Column) -> Complex:
    return amplitude * F.cos(phase), amplitude * F.sin(phase)


def finite(x: Column) -> Column:
    """Not null, not NaN (which Spark takes for larger than any number) and not infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def weighted(w: str = "w") -> Column:
    return finite(F.col(w)) & (F.col(w) > 0)


def sampled(w: str = "w", re: str = "re", im: str | None = None) -> Column:
    """What averages take; with ``im``, what sums of the solver and of diagnostics take."""
    out = weighted(w) & finite(F.col(re))
    return out & finite(F.col(im)) if im else out


def flagged(w: str = "w") -> Column:
    """w <= 0; a NaN weight isn't flagged."""
    return (F.col(w) <= 0) & ~F.isnan(F.col(w))
