"""Decibel conversions on arrays of magnitudes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def decibel(x: Column, ref: float = 1.0, amin: float = 1e-5) -> Column:
    """20 log10 of the magnitude against ``ref``, magnitudes below ``amin`` raised to it. No floor."""
    return F.lit(20.0) * F.log10(F.greatest(F.abs(x), F.lit(amin))) - F.lit(20.0 * math.log10(max(amin, abs(ref))))


def amplitude(db: Column, ref: float = 1.0) -> Column:
    return F.lit(float(ref)) * F.pow(F.lit(10.0), db / 20.0)
