"""Interval work on boxes: overlap join, islands, union lengths and areas.

The overlap join cuts time into buckets, longer ones for longer boxes, so a recording is spread over many tasks and no two
boxes are compared unless they share a bucket; a pair is kept in the later of the two first buckets only, which needs no
shuffle to remove duplicates. Running maxima and counts over a recording go by buckets of time too: a prefix over one row for each bucket,
then a window inside each bucket. Unions are never drawn as bitmaps: islands give lengths, and a sweep with a segment tree
gives the area of each block of time.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import KEYS
from .grouped import longs, map_groups

#: Frames in a bucket of the running maxima; in a block whose area is measured.
BUCKET, AREA_BLOCK = 4096, 1024
#: Buckets of a level are so many times longer than those of the level below; so many levels above the first.
RATIO, LEVELS = 8, 13


def _prefixed(df: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c not in keys])


def _level(prefix: str, width: int, grow: int) -> Column:
    """The first level whose buckets (``width`` frames, ``RATIO`` times more at each level) are as long as the box."""
    length = F.col(f"{prefix}t_end") - F.col(f"{prefix}t_start") + 1 + 2 * grow
    level = F.when(length <= width, 0)
    for k in range(1, LEVELS):
        level = level.when(length <= width * RATIO**k, k)
    return level.otherwise(LEVELS)


def box_levels(df: DataFrame, width: int = 256, grow: int = 0) -> list[int]:
    """The levels that the boxes of a table are at: one number from an aggregation of two columns."""
    bits = df.filter("t_end >= t_start").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), _level("", width, grow)))).first()[0] or 0
    return [k for k in range(LEVELS + 1) if bits >> k & 1]


def _bucketed(df: DataFrame, prefix: str, width: int, grow: int, mine: list[int], others: list[int]) -> DataFrame:
    """Rows of a box for its own level (one of ``mine``), and for the coarser ones among ``others``; two buckets at each at
    most."""
    own = F.col(f"{prefix}level")
    at = lambda edge, k: F.floor((F.col(f"{prefix}{edge}") + (grow if edge == "t_end" else -grow)) / (width * RATIO**k))
    level = lambda k: F.struct(F.lit(k).alias("level"), at("t_start", k).alias("first"), at("t_end", k).alias("last"))
    shown = F.filter(F.array(*[level(k) for k in sorted({0, *mine, *others})]), lambda x: (x["level"] == own) | ((x["level"] > own) & x["level"].isin(*others)))
    dealt = df.withColumn(f"{prefix}level", _level(prefix, width, grow)).withColumn("_l", F.explode(shown))
    return dealt.withColumns({"_level": F.col("_l.level"), f"{prefix}first": F.col("_l.first"), "_bucket": F.explode(F.sequence("_l.first", "_l.last"))}).drop("_l")


def overlap_join(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS, width: int = 256, delta_time: int = 0, delta_freq: int = 0, levels: tuple[list[int], list[int]] | None = None) -> DataFrame:
    """All pairs of the same keys whose boxes share a pixel, or come within the deltas of it, as columns ``a_*``, ``b_*``.

    ``width`` is a bucket's length in frames; about the length of a usual box is best. A longer box has buckets of its own
    level, and shorter ones look there, too, if such boxes exist: a pair meets at the level of the longer one. So a box
    of any length makes two rows for each level in use, and one or two where all are short. ``levels``: those of both sides
    (``box_levels``) where the caller knows them.
    """
    in_a, in_b = levels or (box_levels(a, width, delta_time), box_levels(b, width))
    left = _bucketed(_prefixed(a.filter("t_end >= t_start"), keys, "a_"), "a_", width, delta_time, in_a, in_b)
    right = _bucketed(_prefixed(b.filter("t_end >= t_start"), keys, "b_"), "b_", width, 0, in_b, in_a)
    meets = (
        (F.col("a_t_start") - delta_time <= F.col("b_t_end"))
        & (F.col("b_t_start") <= F.col("a_t_end") + delta_time)
        & (F.col("a_freq_start") - delta_freq <= F.col("b_freq_end"))
        & (F.col("b_freq_start") <= F.col("a_freq_end") + delta_freq)
    )
    once = (F.col("_bucket") == F.greatest("a_first", "b_first")) & (F.col("_level") == F.greatest("a_level", "b_level"))
    return left.join(right, [*keys, "_level", "_bucket"]).filter(meets & once).drop("_level", "_bucket", "a_first", "b_first", "a_level", "b_level")


def same(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``a`` joined with ``b`` on keys, nulls being equal; the keys of ``b`` are dropped."""
    other = b.withColumnsRenamed({k: f"_{k}_of_b" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}_of_b"))
    return a.join(other, on, how).drop(*[f"_{k}_of_b" for k in keys])


def earlier_end(boxes: DataFrame, keys: Sequence[str], order: Sequence[str] = ("t_start", "t_end"), width: int = BUCKET) -> DataFrame:
    """Adds ``before``: the last end of all boxes of the key that come before in ``order`` (which begins with
    ``t_start``), null for the first. Buckets of ``width`` frames: a prefix over one row for each, then a window inside."""
    own = [*keys, "_at"]
    dealt = boxes.withColumn("_at", F.floor(F.col("t_start") / width))
    earlier = W.partitionBy(*keys).orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    ends = dealt.groupBy(*own).agg(F.max("t_end").alias("_end")).select(*own, F.max("_end").over(earlier).alias("_carried"))
    inside = W.partitionBy(*own).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return same(dealt, ends, own).withColumn("before", F.greatest(F.max("t_end").over(inside), F.col("_carried"))).drop("_at", "_carried")


def time_islands(boxes: DataFrame, keys: Sequence[str] = KEYS, gap: int = 0, width: int = BUCKET) -> DataFrame:
    """Adds ``island``: numbered per key; a new one starts where a box begins more than ``gap`` frames after all
    earlier ends. Boxes that touch, also in chains, are in one island. ``width``: frames in a bucket."""
    own = [*keys, "_at"]
    earlier = W.partitionBy(*keys).orderBy("_at").rowsBetween(W.unboundedPreceding, -1)  # a row for each bucket
    order = W.partitionBy(*own).orderBy("t_start", "t_end")
    new = F.when(F.col("before").isNull() | (F.col("t_start") > F.col("before") + gap), 1).otherwise(0)
    marked = earlier_end(boxes, keys, width=width).withColumns({"_at": F.floor(F.col("t_start") / width), "_new": new})
    counts = marked.groupBy(*own).agg(F.sum("_new").alias("_n")).select(*own, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0))
    return same(marked.withColumn("_inside", inside), counts, own).withColumn("island", F.col("_base") + F.col("_inside")).drop("_new", "_at", "before", "_inside", "_base")


def runs(flags: DataFrame, keys: Sequence[str], index: str, block: int = BUCKET) -> DataFrame:
    """Rows are the indices where a flag is set. Returns first, last of each maximal run (gaps and islands).

    Runs are found inside blocks of ``block`` indices; those that end at a block's border, two a block at most, are put
    together over the borders."""
    own = [*keys, "_block"]
    order = W.partitionBy(*own).orderBy(index)
    at = F.col(index).cast("long")
    dealt = flags.select(*keys, at.alias("_i"), F.floor(at / block).alias("_block")).withColumnRenamed("_i", index)
    parts = dealt.withColumn("_run", F.col(index) - F.row_number().over(order)).groupBy(*own, "_run").agg(F.min(index).alias("first"), F.max(index).alias("last"))
    border = (F.col("first") == F.col("_block") * block) | (F.col("last") == F.col("_block") * block + block - 1)
    over = W.partitionBy(*keys).orderBy("first")  # two rows for each block at most
    joined = parts.filter(border).withColumn("_new", F.when(F.col("first") == F.lag("last").over(over) + 1, 0).otherwise(1)).withColumn("_n", F.sum("_new").over(over.rowsBetween(W.unboundedPreceding, 0)))
    whole = joined.groupBy(*keys, "_n").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return parts.filter(~border).select(*keys, "first", "last").unionByName(whole.select(*keys, "first", "last"))


def union_length(boxes: DataFrame, keys: Sequence[str] = KEYS, axis: str = "t", width: int = BUCKET) -> DataFrame:
    """keys, ``covered``: pixels of one axis (``t`` or ``freq``) under at least one box. Of ranges with one start only the
    longest goes on."""
    longest = boxes.groupBy(*keys, F.col(f"{axis}_start").alias("t_start")).agg(F.max(f"{axis}_end").alias("t_end"))
    islands = time_islands(longest, keys, 0, width).groupBy(*keys, "island").agg((F.max("t_end") - F.min("t_start") + 1).alias("_part"))
    return islands.groupBy(*keys).agg(F.sum("_part").alias("covered"))


class _Covered:
    """A segment tree over the gaps between sorted coordinates: how often each gap is covered, and the length that is."""

    def __init__(self, coordinates: np.ndarray):
        self.at = coordinates.tolist()
        self.times, self.length = [0] * (4 * len(self.at)), [0] * (4 * len(self.at))

    def add(self, a: int, b: int, by: int, node: int = 1, lo: int = 0, hi: int | None = None) -> None:
        """Covers the gaps a..b-1 ``by`` times more."""
        hi = len(self.at) - 1 if hi is None else hi
        if a <= lo and hi <= b:
            self.times[node] += by
        else:
            mid = (lo + hi) // 2
            if a < mid:
                self.add(a, b, by, 2 * node, lo, mid)
            if b > mid:
                self.add(a, b, by, 2 * node + 1, mid, hi)
        if self.times[node]:
            self.length[node] = self.at[hi] - self.at[lo]
        else:
            self.length[node] = self.length[2 * node] + self.length[2 * node + 1] if hi - lo > 1 else 0


def area_of_union(t0: np.ndarray, t1: np.ndarray, f0: np.ndarray, f1: np.ndarray) -> int:
    """Pixels under boxes [t0, t1) x [f0, f1): a sweep over time with a segment tree over frequency."""
    if len(t0) < 3:
        area = int(((t1 - t0) * (f1 - f0)).sum())
        if len(t0) == 2:
            shared = max(0, int(t1.min() - t0.max())) * max(0, int(f1.min() - f0.max()))
            area -= shared
        return area
    coordinates, places = np.unique(np.concatenate([f0, f1]), return_inverse=True)
    n = len(t0)
    lo, hi = places[:n].tolist(), places[n:].tolist()
    times = np.concatenate([t0, t1])
    tree, area, before = _Covered(coordinates), 0, 0
    for i, t in zip((order := np.argsort(times, kind="stable")).tolist(), times[order].tolist(), strict=True):
        area += (t - before) * tree.length[1]
        before = t
        tree.add(lo[i % n], hi[i % n], 1 if i < n else -1)
    return area


def side_areas(boxes: DataFrame, keys: Sequence[str] = KEYS, width: int = AREA_BLOCK) -> DataFrame:
    """``boxes`` with ``side`` 1 or 2. keys, ``one``, ``two``, ``either``: pixels under boxes of the first side, of the
    second, of any. Boxes are cut at the borders of blocks of ``width`` frames, so a recording is many groups; a block
    costs its boxes times the logarithm of their number, whatever their height and however many overlap."""
    own = [*keys, "_block"]
    first = F.floor(F.col("t_start") / width)
    dealt = boxes.filter("t_end >= t_start and freq_end >= freq_start").withColumn("_block", F.explode(F.sequence(first, F.floor(F.col("t_end") / width))))
    lo, hi = F.greatest(F.col("t_start"), F.col("_block") * width), F.least(F.col("t_end") + 1, (F.col("_block") + 1) * width)
    # equal pieces of a block are one
    pieces = dealt.select(*own, lo.alias("_lo"), hi.alias("_hi"), F.col("freq_start").alias("_f"), (F.col("freq_end") + 1).alias("_g"), "side").distinct()

    def measure(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        cols = [longs(rows, c) for c in ("_lo", "_hi", "_f", "_g")]
        second = longs(rows, "side") == 2
        out = np.zeros((3, len(starts)), np.int64)
        for k, (a, b) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True)):
            part, two = [c[a:b] for c in cols], second[a:b]
            n = int(two.sum())
            out[2, k] = area_of_union(*part)
            out[0, k] = area_of_union(*[c[~two] for c in part]) if 0 < n else out[2, k]
            out[1, k] = (area_of_union(*[c[two] for c in part]) if n < b - a else out[2, k]) if n else 0
        table = rows.select([*keys]).take(pa.array(starts))
        for name, x in zip(("one", "two", "either"), out, strict=True):
            table = table.append_column(name, pa.array(x))
        return table

    kinds = T.StructType([boxes.schema[k] for k in keys] + [T.StructField(n, T.LongType()) for n in ("one", "two", "either")])
    parts = map_groups(pieces, own, [], measure, kinds)
    return parts.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in ("one", "two", "either")])


def union_area(boxes: DataFrame, keys: Sequence[str] = KEYS, width: int = AREA_BLOCK) -> DataFrame:
    """keys, ``covered``: pixels under at least one box."""
    return side_areas(boxes.select(*keys, "t_start", "t_end", "freq_start", "freq_end", F.lit(1).alias("side")), keys, width).select(*keys, F.col("either").alias("covered"))


def covered(boxes: DataFrame, keys: Sequence[str] = KEYS, axis: str | int | None = None) -> DataFrame:
    """``axis``: None for area, 0 or "time", 1 or "freq" for the projection on one axis."""
    if axis is None:
        return union_area(boxes, keys)
    if axis in (0, "time"):
        return union_length(boxes, keys, "t")
    if axis in (1, "freq"):
        return union_length(boxes, keys, "freq")
    raise ValueError("axis: None, 0 / 'time' or 1 / 'freq'")
