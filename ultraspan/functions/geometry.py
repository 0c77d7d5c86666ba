"""Column functions on boxes (both ends included) and scores."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(prefix: str, name: str) -> Column:
    return F.col(f"{prefix}{name}")


def area(prefix: str = "") -> Column:
    return (_c(prefix, "t_end") - _c(prefix, "t_start") + 1) * (_c(prefix, "freq_end") - _c(prefix, "freq_start") + 1)


def overlap_area(a: str, b: str) -> Column:
    """Signed: each factor may be zero or negative for boxes apart."""
    t = F.least(_c(a, "t_end"), _c(b, "t_end")) - F.greatest(_c(a, "t_start"), _c(b, "t_start")) + 1
    f = F.least(_c(a, "freq_end"), _c(b, "freq_end")) - F.greatest(_c(a, "freq_start"), _c(b, "freq_start")) + 1
    return t * f


def box_iou(a: str, b: str) -> Column:
    """Intersection over union of two boxes given by column prefixes. A box of no area is an error."""
    shared = overlap_area(a, b)
    bad = (_c(a, "t_end") < _c(a, "t_start")) | (_c(a, "freq_end") < _c(a, "freq_start")) | (_c(b, "t_end") < _c(b, "t_start")) | (_c(b, "freq_end") < _c(b, "freq_start"))
    return F.when(bad, F.raise_error(F.lit("a box has no area")).cast("double")).otherwise(shared / (area(a) + area(b) - shared))


def axis_distance(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """0 if either start lies in the other interval, else the smaller distance between a start and the other's end."""
    inside = a_start.between(b_start, b_end) | b_start.between(a_start, a_end)
    return F.when(inside, F.lit(0)).otherwise(F.least(F.abs(a_start - b_end), F.abs(b_start - a_end)))


def box_distances(a: str, b: str) -> tuple[Column, Column]:
    """(time, frequency) distance in pixels."""
    return tuple(axis_distance(_c(a, f"{x}_start"), _c(a, f"{x}_end"), _c(b, f"{x}_start"), _c(b, f"{x}_end")) for x in ("t", "freq"))


def f_beta(precision: Column, recall: Column, beta: float | Column) -> Column:
    """(1 + b^2) p r / (b^2 p + r); 0 where the denominator is."""
    b2 = (F.lit(float(beta)) if isinstance(beta, (int, float)) else beta) ** 2
    below = b2 * precision + recall
    return F.when(below == 0, F.lit(0.0)).otherwise((1 + b2) * precision * recall / F.when(below != 0, below))


def position_features(max_pos: float, prefix: str = "") -> list[Column]:
    """cos and sin of the box's frequency ends, scaled so that ``max_pos`` is a right angle."""
    turn = lambda c: F.least(c, F.lit(float(max_pos))) * (math.pi / 2 / max_pos)
    lo, hi = turn(_c(prefix, "freq_start")), turn(_c(prefix, "freq_end"))
    return [F.cos(lo).alias("start_cos"), F.sin(lo).alias("start_sin"), F.cos(hi).alias("end_cos"), F.sin(hi).alias("end_sin")]


def latent_to_params(latent: Column) -> tuple[Column, Column]:
    """One search dimension for two parameters: (balloon, threshold)."""
    return F.when(latent > 1, F.lit(-1)).otherwise(F.lit(1)), F.when(latent > 1, 2 - latent).otherwise(latent)
