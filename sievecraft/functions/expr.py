"""Column expressions that several operators use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ramp(x: Column, lo: float, hi: float) -> Column:
    """0 up to lo, 1 from hi, linear between; a step where hi equals lo."""
    if hi == lo:
        return F.when(x >= hi, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.least(F.greatest((x - F.lit(lo)) / F.lit(hi - lo), F.lit(0.0)), F.lit(1.0))


def band(x: Column, lo: float, lo_full: float, hi_full: float, hi: float) -> Column:
    """1 between lo_full and hi_full, falling to 0 at lo and hi."""
    return F.least(ramp(x, lo, lo_full), F.lit(1.0) - ramp(x, hi_full, hi))


def midi_to_hz(note: Column) -> Column:
    return F.lit(440.0) * F.pow(F.lit(2.0), (note - 69) / F.lit(12.0))


def amp_to_db(x: Column) -> Column:
    return F.lit(20.0) * F.log10(F.greatest(x, F.lit(1e-9)))


def log10_floor(x: Column) -> Column:
    return F.log10(F.greatest(x, F.lit(1e-4)))


def squared_l2(a: Column, b: Column) -> Column:
    """Sum of squared differences of two arrays of doubles, from the first component on."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def normalised_l1(a: Column, b: Column, ranges: Sequence[float]) -> Column:
    """Mean over components of |a - b| / range."""
    scaled = F.zip_with(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.array(*[F.lit(float(r)) for r in ranges]), lambda d, r: d / r)
    return F.aggregate(scaled, F.lit(0.0), lambda s, d: s + d) / F.lit(float(len(ranges)))


def diff_fraction(a: Column, b: Column) -> Column:
    """Share of components that differ."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda d: d)) / F.size(a).cast("double")


def finite_or_zero(x: Column) -> Column:
    """x, or 0 where it is null, NaN or infinite."""
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def feature_vector(columns: Sequence[Column]) -> Column:
    return F.array(*[finite_or_zero(c) for c in columns])


def doubles(c: Column | str) -> Column:
    return col(c).cast("array<double>")


def round_half_up(x: Column) -> Column:
    """Nearest integer, halves upwards (also below zero)."""
    return F.floor(x + F.lit(0.5))


def let(value: Column, body) -> Column:
    """body(value), with value computed once per row however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)
