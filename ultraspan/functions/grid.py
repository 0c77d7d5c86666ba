"""Pixels, seconds and Hz. Axes are affine: value k is ``origin + k * step``; the *pixel span* is (last - first) / n."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def axis_end(origin: Column, step: Column, n: Column) -> Column:
    return origin + step * (n - 1)


def pixel_span(origin: Column, step: Column, n: Column) -> Column:
    """(last - first) / n, not n - 1: clips by axis values drift by one pixel, which is kept."""
    return (axis_end(origin, step, n) - origin) / n


def to_pixels(x: Column, span: Column) -> Column:
    """Seconds or Hz to a number of pixels, rounded up."""
    return F.ceil(x / span).cast("long")


def time_to_pixels(x: Column, t0: str = "t0", dt: str = "dt", n: str = "n_time") -> Column:
    return to_pixels(x, pixel_span(F.col(t0), F.col(dt), F.col(n)))


def freq_to_pixels(x: Column, f0: str = "f0", df: str = "df", n: str = "n_freq") -> Column:
    return to_pixels(x, pixel_span(F.col(f0), F.col(df), F.col(n)))


def nearest_index(v: Column, origin: Column, step: Column, n: Column) -> Column:
    """Index of the nearest axis value; ties go to the lower one."""
    return F.greatest(F.lit(0).cast("long"), F.least((n - 1).cast("long"), F.ceil((v - origin) / step - 0.5).cast("long")))


def axis_value(index: Column, origin: Column, step: Column, n: Column) -> Column:
    """Value at an index; an index of n (an end that was rounded up) counts as n - 1."""
    return origin + F.least(index, n - 1) * step


def unit_hash(*columns: Column) -> Column:
    """A number from 0 up to 1 that depends on the columns' texts only (52 bits of their md5)."""
    text = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
