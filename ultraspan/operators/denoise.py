"""Two-dimensional filters and the noise gate."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.decibel import amplitude
from ..shared import stash
from .spectrogram import amplitude_to_db, cells, with_halo


#: Frames in a segment of the noise gate.
SEGMENT = 1024


def _odd(m: int) -> int:
    if m % 2 == 0:
        raise ValueError("the window size must be odd")
    return m // 2


def _margin(block: np.ndarray, left: int, right: int, r: int, mode: str = "symmetric") -> np.ndarray:
    """The block with r rows and columns of margin; edges of the spectrogram repeat in mirror order."""
    return np.pad(block, ((r, r), (r - left, r - right)), mode=mode)


def filter_with(frames: DataFrame, kernel: np.ndarray) -> DataFrame:
    """Correlation with a square kernel of odd size."""
    r = kernel.shape[0] // 2
    return with_halo(frames, r, lambda m, left, right: kernels.correlate(_margin(m, left, right, r), kernel))


def gaussian_filter(frames: DataFrame, sigma_x: float, sigma_y: float, m: int) -> DataFrame:
    """``sigma_x`` along time, ``sigma_y`` along frequency; window of m x m pixels, m odd."""
    _odd(m)
    return filter_with(frames, kernels.gaussian_kernel(sigma_x, sigma_y, m))


def diagonal_gaussian_filter(frames: DataFrame, sigma_x: float, sigma_y: float, m: int) -> DataFrame:
    """Gaussian along and across the diagonal."""
    _odd(m)
    return filter_with(frames, kernels.diagonal_kernel(sigma_x, sigma_y, m))


def transient_suppression(frames: DataFrame, alpha: float, m: int = 3, a: float | None = None) -> DataFrame:
    """alpha * S + (1 - alpha) * (max(horizontal, both diagonals) - vertical), all smoothed versions of S: what is
    short in time and wide in frequency is taken away. One pass with one halo."""
    r, a = _odd(m), m / 10 if a is None else a
    wide, tall = kernels.gaussian_kernel(6 * a, a, m), kernels.gaussian_kernel(a, 6 * a, m)
    up, down = kernels.diagonal_kernel(a, 6 * a, m), kernels.diagonal_kernel(6 * a, a, m)

    def run(x: np.ndarray, left: int, right: int) -> np.ndarray:
        b = _margin(x, left, right, r)
        along = np.maximum.reduce([_sum(b, k) for k in (tall, up, down)])
        return alpha * x[:, left : x.shape[1] - right] + (1 - alpha) * (along - _sum(b, wide))

    _sum = kernels.correlate
    return with_halo(frames, r, run)


def bilateral_filter(frames: DataFrame, d: int, sigma_color: float, sigma_space: float) -> DataFrame:
    """Edge-preserving mean in a disc of diameter ``d``; edges are mirrored without repeating the edge pixel."""
    r = d // 2
    return with_halo(frames, r, lambda m, left, right: kernels.bilateral(_margin(m, left, right, r, "reflect"), d, sigma_color, sigma_space))


def noise_profile(noise_frames: DataFrame, n_std_thresh: float = 1.5, ref: float = 1.0, amin: float = 1e-20, top_db: float | None = 80.0) -> DataFrame:
    """recording, bin, ``threshold``: mean + n population standard deviations of the noise in decibels."""
    return cells(amplitude_to_db(noise_frames, ref, amin, top_db), "db").groupBy("recording", "bin").agg((F.avg("db") + F.lit(float(n_std_thresh)) * F.stddev_pop("db")).alias("threshold"))


def triangle(n: int) -> list[float]:
    """[1 .. n+1 .. 1] / (n + 1), then divided by its sum."""
    x = [*range(1, n + 1), n + 1, *range(n, 0, -1)]
    return [v / sum(x) for v in x]


def noise_gate(frames: DataFrame, noise_frames: DataFrame, n_grad_freq: int = 3, n_grad_time: int = 3, n_std_thresh: float = 1.5, noise_decrease: float = 1.0, ref: float = 1.0, amin: float = 1e-20, top_db: float | None = 80.0) -> DataFrame:
    """Cells under their bin's noise threshold are moved towards the recording's lowest level. The mask is smoothed by
    triangles along both axes (nothing outside the spectrogram counts). Spark functions only: masks are arrays, the
    time axis is a window over the frames of a segment and copies of its neighbours' nearest."""
    db = stash(amplitude_to_db(frames, ref, amin, top_db).join(frames.select("recording", "frame", F.col("mags").alias("raw")), ["recording", "frame"]))
    profile = noise_profile(noise_frames, n_std_thresh, ref, amin, top_db).groupBy("recording").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "threshold"))), lambda x: x["threshold"]).alias("limit"))  # one value for each bin
    low = db.groupBy("recording").agg(F.min(F.array_min("mags")).alias("low"))
    masked = db.join(profile, "recording").withColumn("mask", F.zip_with("mags", "limit", lambda x, t: (x < t).cast("double")))
    # along frequency: shifted copies of the array, weighted and added
    weights = triangle(n_grad_freq)
    bins = F.size("mask")
    moved = lambda k: F.transform(F.sequence(F.lit(0), bins - 1), lambda i: F.when((i + k >= 0) & (i + k < bins), F.get("mask", i + k)).otherwise(0.0))
    smooth = None
    for k, w in zip(range(-n_grad_freq, n_grad_freq + 1), weights, strict=True):
        own = _times(moved(k), w)
        smooth = own if smooth is None else F.zip_with(smooth, own, lambda a, b: a + b)
    masked = masked.withColumn("mask", smooth)
    # along time: lags and leads of the mask, in segments with a halo
    segment = lambda at: F.floor(at / SEGMENT)
    masked = masked.withColumn("_segment", F.explode(F.sequence(segment(F.col("frame") - n_grad_time), segment(F.col("frame") + n_grad_time))))
    order = W.partitionBy("recording", "_segment").orderBy("frame")
    total = None
    for k, w in zip(range(-n_grad_time, n_grad_time + 1), triangle(n_grad_time), strict=True):
        at = F.lag("mask", -k).over(order) if k < 0 else F.lead("mask", k).over(order) if k else F.col("mask")
        own = _times(F.coalesce(at, F.transform("mask", lambda x: F.lit(0.0))), w)
        total = own if total is None else F.zip_with(total, own, lambda a, b: a + b)
    done = masked.withColumn("mask", _times(total, float(noise_decrease))).filter(F.col("_segment") == segment(F.col("frame"))).join(low, "recording")
    out = F.zip_with("mags", "mask", lambda x, m: x * (1 - m) + F.col("low") * m)
    return done.withColumn("_db", out).select("recording", "frame", F.zip_with("_db", "raw", lambda x, r: amplitude(x, ref) * F.signum(r)).alias("mags"))


def _times(array, w: float):
    return F.transform(array, lambda x: x * F.lit(w))

