"""Entropy and energy detector, from Spark functions only.

Frames are reduced to one number each before any window runs over time, so windows hold scalars, never spectra.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import stash
from .boxes import filter_by_ratio, merge_boxes
from .intervals import runs
from .spectrogram import frames_in

#: Rows in a block of a moving average.
BLOCK = 4096


def flatness(mags: Column) -> Column:
    """Geometric over arithmetic mean: 0 if a bin is 0, null if all are (or there are none)."""
    n = F.size(mags)
    total = F.aggregate(mags, F.lit(0.0), lambda a, x: a + x)
    logs = F.aggregate(F.transform(mags, lambda x: F.coalesce(F.ln(x), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    zero = F.exists(mags, lambda x: x == 0)
    return F.when(total > 0, F.when(zero, F.lit(0.0)).otherwise(F.exp(logs / n) / (total / n)))


def spectral_entropy(frames: DataFrame) -> DataFrame:
    """recording, frame, ``entropy``."""
    return frames.select("recording", "frame", flatness(F.col("mags")).alias("entropy"))


def moving_average(df: DataFrame, value: str, width: int, keys: list[str], index: str, pad: Column | float = 1.0, block: int = BLOCK) -> DataFrame:
    """Replaces ``value`` by its mean over ``width`` rows around it; rows missing at the ends count as ``pad``.

    A row also goes to the neighbouring block of ``block`` rows where its value is needed, so no window holds more than
    a block and its margins."""
    left, right = width // 2, (width - 1) // 2
    at = F.col(index).cast("long")
    dealt = df.withColumn("_block", F.explode(F.sequence(F.floor((at - right) / block), F.floor((at + left) / block))))
    own = W.partitionBy(*keys, "_block").orderBy(at).rangeBetween(-left, right)
    pad = F.lit(float(pad)) if isinstance(pad, (int, float)) else pad
    mean = (F.sum(value).over(own) + (width - F.count(F.lit(1)).over(own)) * pad) / width
    return dealt.withColumn(value, mean).filter(F.floor(at / block) == F.col("_block")).drop("_block")


def low_entropy_ranges(frames: DataFrame, window: int = 5, threshold: float = 0.71) -> DataFrame:
    """recording, first, last: runs of frames whose averaged entropy is below the threshold."""
    entropy = moving_average(spectral_entropy(frames), "entropy", window, ["recording"], "frame")
    return runs(entropy.filter(F.col("entropy") < threshold).select("recording", "frame"), ["recording"], "frame")


def high_energy_rows(frames: DataFrame, ranges: DataFrame, window: int = 18, threshold: float = 2.1) -> DataFrame:
    """For each time range: runs of frequency bins whose averaged mean power exceeds ``threshold`` times the mean power
    of the range. recording, t_start, t_end, first, last."""
    spans = frames_in(frames, ranges)
    keys = ["recording", "t_start", "t_end"]
    power = spans.select("recording", F.col("first").alias("t_start"), F.col("last").alias("t_end"), F.posexplode("mags").alias("bin", "mag")).groupBy(*keys, "bin").agg(F.avg(F.col("mag") * F.col("mag")).alias("energy"))
    rows = power.withColumn("_mean", F.avg("energy").over(W.partitionBy(*keys)))
    smooth = moving_average(rows, "energy", window, keys, "bin", F.col("_mean"))
    return runs(smooth.filter(F.col("energy") > F.lit(float(threshold)) * F.col("_mean")).select(*keys, "bin"), keys, "bin")


def detect_entropy_energy(
    frames: DataFrame,
    meta: DataFrame,
    freq_cutoff: float = 22000,
    entropy_window: int = 5,
    entropy_threshold: float = 0.71,
    energy_window: int = 18,
    energy_threshold: float = 2.1,
    merge: bool = False,
    merge_delta_freq: int | None = None,
    merge_delta_time: int | None = None,
    filter: bool = False,
    filter_ratio: float | None = None,
) -> DataFrame:
    """Boxes: low-entropy time ranges, cut to high-energy frequency ranges, among bins above ``freq_cutoff``. Merge
    deltas are in pixels."""
    if merge and (merge_delta_freq is None or merge_delta_time is None):
        raise ValueError("merge_delta_freq and merge_delta_time must be given")
    if filter and filter_ratio is None:
        raise ValueError("filter_ratio must be given")
    above = lambda i: F.col("f0") + i * F.col("df") > F.lit(float(freq_cutoff))
    cut = stash(
        frames.join(meta.select("recording", "f0", "df"), "recording").select("recording", "frame", F.size(F.filter("mags", lambda v, i: ~above(i))).cast("long").alias("offset"), F.filter("mags", lambda v, i: above(i)).alias("mags"))
    )
    ranges = low_entropy_ranges(cut, entropy_window, entropy_threshold)
    rows = high_energy_rows(cut.select("recording", "frame", "mags"), ranges, energy_window, energy_threshold)
    offset = cut.groupBy("recording").agg(F.min("offset").alias("offset"))
    boxes = rows.join(offset, "recording").select(
        "recording",
        F.xxhash64("t_start", "t_end", "first", "last").alias("box_id"),
        (F.col("first") + F.col("offset")).cast("long").alias("freq_start"),
        (F.col("last") + F.col("offset")).cast("long").alias("freq_end"),
        "t_start",
        "t_end",
        F.lit(None).cast("string").alias("label"),
    )
    if merge:
        boxes = merge_boxes(boxes, merge_delta_freq, merge_delta_time)
    return filter_by_ratio(boxes, filter_ratio) if filter else boxes
